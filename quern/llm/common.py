"""Helpers that the operators share: the cluster's shared folder and byte storage.

Operators write intermediate tables and media below the folder that the session
names in ``spark.checkpoint.dir``; a private temporary folder is used only where
that setting is absent and the master is local (single-machine tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


@contextmanager
def setting(spark: SparkSession, name: str, value) -> Iterator[None]:
    """Inside, the session has this setting."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later reads neither recompute it
    nor depend on the executors that made it. The job's shuffle files go when it ends."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later plan reads."""
    for t in tables:
        spark, path = t.sparkSession, t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.materialized_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def byte_bounded(df: DataFrame) -> DataFrame:
    """``df``, to be passed to Python: its session's Arrow batches are held to ``BATCH_BYTES`` (or one row)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def tidied(run):
    """The function of batches ``run``, after which the Python worker, which other tasks go on to use,
    gives memory that it has freed back to the system."""

    def inner(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return inner


def filesystem(uri: str):
    """(pyarrow file system, path inside it) of a URI or plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    store, path = filesystem(uri)
    store.create_dir(path, recursive=True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def text_bytes(c: Column) -> Column:
    """UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(c.cast("binary"), F.lit(b"").cast("binary"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
