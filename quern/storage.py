"""Tables that cut lineage: written to the folder that the cluster shares.

The folder is the session's ``spark.checkpoint.dir``; a temporary one is used (and set) only
where that is absent, as in tests on one machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL_ROWS = 1000
SMALL_BYTES = 1 << 20


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its lineage cut, for tables that are small more often than not: up to
    ``SMALL_ROWS`` rows pass through the driver and become a local table, more are written.
    What reads more than ``SMALL_BYTES`` is written first, since a look at its first rows would compute it once more."""
    kept = materialize(df, name) if _input_bytes(df) > SMALL_BYTES else None
    head = (df if kept is None else kept).limit(SMALL_ROWS + 1).toArrow()
    if head.num_rows <= SMALL_ROWS:
        return df.sparkSession.createDataFrame(head, df.schema)
    return kept if kept is not None else materialize(df, name)


def _input_bytes(df: DataFrame) -> int:
    """What the plan's leaves hold by their statistics; those without any count as large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
