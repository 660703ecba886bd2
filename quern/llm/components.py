"""Connected components of an edge table by alternating large and small stars.

Each round writes its edges to the shared folder (short lineage, survives lost executors)
and ends when a round changes nothing: about log^2 of the longest chain in the worst case.
Minima of neighbours are pre-aggregated before they are shuffled; a node with very many
neighbours is a hot join key that AQE splits. No edge reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "stars")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "stars")
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a > b"), least


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that isn't the smallest of its component, a written table.

    Nodes can have any orderable type; self-loops, repeated and null-ended edges are
    ignored, and no edges give no rows.
    """
    now = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        large, seen = _large_star(now)
        small, least = _small_star(large)
        new = materialize(small.distinct(), "edges")
        release(now, seen, least)
        before, state, now = state, _state(new), new
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.materialized_at = now.materialized_at
    return out
