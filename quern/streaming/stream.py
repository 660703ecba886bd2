"""Structured Streaming: rules over streams of quads, windows and retractions.

``run_rules`` hosts a rule engine in ``foreachBatch``: each micro-batch is one unit (or, with
``by_block``, a unit for each block). After a batch the quads are written below the
checkpoint folder under the batch's number, and a restart goes on from the last one that
was finished, so a batch that is run again starts from the same state.

``windowed`` and ``deduplicated`` are the event-time extensions: watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import terms as t
from quern.streaming.rules import RuleEngine


def _states(spark: SparkSession, folder: str) -> tuple[object, list[int]]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return store, []
    names = [s.getPath().getName() for s in store.listStatus(path)]
    done = [int(n.removeprefix("batch-")) for n in names if n.startswith("batch-") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return store, sorted(done)


def run_rules(stream: DataFrame, engine: RuleEngine, checkpoint: str, by_block: bool = False, trigger: dict | None = None, on_batch: Callable[[int, RuleEngine], None] | None = None):
    """Start a query that feeds ``stream`` (columns s, p, o, g and optionally block_id and
    ``w``, +1 or -1) to the engine. ``on_batch`` is called after each micro-batch."""
    spark = engine.spark
    folder = f"{checkpoint.rstrip('/')}/quads"

    def batch(df: DataFrame, number: int) -> None:
        store, done = _states(spark, folder)
        earlier = [n for n in done if n < number]
        if earlier:
            engine.quads = spark.read.schema(t.QUAD).parquet(f"{folder}/batch-{earlier[-1]}")
        if "w" in df.columns:
            signed = df.groupBy(*"spog").agg(F.sum("w").alias("w"))
            engine.change(signed.where("w < 0"), signed.where("w > 0"))
            engine.execute()
        elif by_block and "block_id" in df.columns:
            df = df.persist()
            for r in df.select("block_id").distinct().orderBy("block_id").toLocalIterator():
                engine.process(df.where(F.col("block_id") == r.block_id))
            df.unpersist()
        else:
            engine.process(df)
        engine.quads.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        for old in earlier[:-1]:
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch-{old}"), True)
        if on_batch:
            on_batch(number, engine)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def windowed(stream: DataFrame, time: str, length: str, keys: list[str], aggregates: dict[str, Column], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates for each window of event time, closed by the watermark."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    rows = stream.withWatermark(time, late).groupBy(window, *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], aggregates: dict[str, Column], late: str = "10 minutes") -> DataFrame:
    rows = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *aggregates)


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once; its memory ends with the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def closed_windows(events: DataFrame, time: str, length: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates of tumbling windows of a number column, for windows that a later event has
    closed (the batch form of a rule that waits for the next window)."""
    window = F.floor(F.col(time) / length)
    rows = events.groupBy(window.alias("window")).agg(*(c.alias(n) for n, c in aggregates.items()))
    after = rows.select((F.col("window") - 1).alias("window"))
    return rows.join(after, "window", "left_semi")
