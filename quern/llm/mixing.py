"""Mixing sources to target weights by Pfair scheduling of blocks.

Each source's rows are cut into blocks. Weights are whole numbers k out of Q = their sum;
block i (from 0) of a source with weight k / Q is released at slot floor(i Q / k) and due by
slot ceil((i + 1) Q / k). One block is emitted each slot: of those released, that with the
earliest deadline. On one processor with full load this meets every deadline, so after t
slots each source has had its share t k / Q within less than one block.

The schedule repeats after Q slots, so only one period is simulated, and block i has the
slot (i div k) Q + period[i mod k]: no scan over blocks, however many. When a source has
no block left, the rest go on with their own weights from a new period on (a new phase, in
which the bound holds again), so every row of every source is emitted once.

Rows are numbered inside their source by the hash of their id, without a window over the
source: hashes are counted by their leading bits (about ``BUCKET_ROWS`` rows a value), so a
row's number is the count of the rows in its source's lower buckets plus its place in its own,
and a source with most of the rows is dealt out over as many tasks as its share asks for. Only
ids and sources are read and shuffled for that. It yields, for each source, the hashes at which
the mixture is cut into partitions of equal length; the rows themselves then move once, to the
partition of their slots, and are numbered there. Counts of the sources (``MAX_SOURCES`` at most)
and cuts (``MAX_CUTS`` at most) are all that reaches the driver and the executors.

Edge cases: a null source is a source of its own; sources without a weight share the
smallest given one; weights must be positive; sources in the weights without rows are
skipped; repeated rows are numbered apart in arbitrary order; the last block of a source
can be short; rows of equal ids lie in one partition; an empty table gives an empty result;
other columns can have any names; result columns replace input columns of theirs.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_SOURCES = 1000
RESOLUTION = 10_000  # the parts of one that weights are rounded to; every source gets one at least
BUCKET_ROWS = 1 << 13
MAX_CUTS = 4_000_000
RESULTS = ("block", "slot", "position")


def whole_weights(weights: dict, resolution: int = RESOLUTION) -> dict:
    """Positive integers in proportion to ``weights``."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total = sum(weights.values())
    return {s: max(1, round(w * resolution / total)) for s, w in weights.items()}


def period(shares: list[int]) -> list[list[int]]:
    """For each of the sources the slots (0 to sum - 1) that its blocks get in one period."""
    total = sum(shares)
    slots: list[list[int]] = [[] for _ in shares]
    waiting = [(0, s) for s in range(len(shares))]  # (release, source)
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // shares[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        if len(slots[s]) < shares[s]:
            heapq.heappush(waiting, (len(slots[s]) * total // shares[s], s))
    return slots


def phases(blocks: list[int], shares: list[int]) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(source, first block, end block, first slot, period length, period slots) for each
    source and phase; a phase ends when a source has had its last block."""
    done, at, out = [0] * len(blocks), 0, []
    while active := [s for s in range(len(blocks)) if done[s] < blocks[s]]:
        plan = period([shares[s] for s in active])
        length = sum(shares[s] for s in active)
        ends = []
        for s, slots in zip(active, plan):
            last = blocks[s] - done[s] - 1
            ends.append(last // len(slots) * length + slots[last % len(slots)] + 1)
        end = min(ends)
        for s, slots in zip(active, plan):
            full, rest = divmod(end, length)
            n = full * len(slots) + sum(x < rest for x in slots)
            if n:
                out.append((s, done[s], done[s] + n, at, length, slots))
            done[s] += n
        at += end
    return out


def cut_numbers(plan: list[tuple], blocks: list[int], parts: int) -> list[list[int]]:
    """For each source its number of blocks before each of the ``parts`` - 1 slots that cut the
    mixture evenly."""
    total = sum(blocks)
    out = [[0] * (parts - 1) for _ in blocks]
    for s, first, end, at, length, slots in plan:
        for p in range(1, parts):
            full, rest = divmod(max(0, total * p // parts - at), length)
            out[s][p - 1] = max(out[s][p - 1], min(end, first + full * len(slots) + bisect_left(slots, rest)) if total * p // parts > at else 0)
    return out


def _hashes_at(rows: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """(key, part, hash, first) of ``wanted`` (key, part, number): the hash of the row with that number
    in its source, and the first number with that hash. rows: (key, hash)."""
    rows = rows.withColumn("bucket", F.shiftright("hash", 64 - bits) if bits else F.lit(0).cast("bigint"))
    counts = rows.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    lower = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("key", "bucket", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("number"), F.lit(None).cast("int").alias("part"))
    both = starts.unionByName(wanted.select("key", F.lit(None).cast("bigint").alias("bucket"), "number", "part"))
    upto = Window.partitionBy("key").orderBy("number", F.col("part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("key", "part", "number", F.last("bucket", True).over(upto).alias("bucket"), F.last(F.when(F.col("part").isNull(), F.col("number")), True).over(upto).alias("before")).where("part is not null")
    inside = Window.partitionBy("key", "bucket").orderBy("hash")
    numbered = rows.select("key", "bucket", "hash", (F.row_number().over(inside) - 1).alias("at"), (F.rank().over(inside) - 1).alias("first"))
    found = found.withColumn("at", (F.col("number") - F.col("before")).cast("int"))
    return numbered.join(found, ["key", "bucket", "at"]).select("key", "part", "hash", (F.col("before") + F.col("first")).alias("first"))


def _placed(cuts):
    """A function from sources' numbers and hashes to the part and the first row number in it."""

    @F.pandas_udf("part int, start bigint")
    def place(source: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        of, h = source.to_numpy(), hashes.to_numpy()
        part, start = np.zeros(len(h), "i4"), np.zeros(len(h), "i8")
        for s in np.unique(of).tolist():
            bounds, parts, firsts = cuts.value[s]
            here = of == s
            at = np.searchsorted(bounds, h[here], side="right")
            part[here], start[here] = parts[at], firsts[at]
        return pd.DataFrame({"part": part, "start": start})

    return place


def mix(docs: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = 64) -> DataFrame:
    """``docs`` with block (number in its source), slot (in the mixture) and position
    (of the row in the mixture); partitions follow each other in the mixture. Default weights:
    square roots of the sources' sizes."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("null")).alias("key")
    ident = F.col(f"`{id_col}`")
    narrow = docs.select(key, F.xxhash64(ident).alias("hash"))
    sizes = narrow.groupBy("key").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = {r.key: r.n for r in sorted(sizes, key=lambda r: r.key)}
    given = {"null" if s is None else f"={s}": w for s, w in weights.items()} if weights is not None else {s: n**0.5 for s, n in rows.items()}
    whole = whole_weights(given) if given else {}
    floor = min(whole.values(), default=1)
    names = list(rows)
    blocks = [ceil(rows[s] / block_rows) for s in names]
    plan = phases(blocks, [whole.get(s, floor) for s in names])

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(blocks), MAX_CUTS // max(1, len(names))))
    numbers = [[min(n * block_rows, rows[s]) for n in cut] for s, cut in zip(names, cut_numbers(plan, blocks, parts))]
    wanted = [(s, p, n) for s, cut in zip(names, numbers) for p, n in enumerate(cut, 1) if 0 < n < rows[s]]
    bits = max(0, (sum(rows.values()) // BUCKET_ROWS).bit_length())
    found: dict[str, list[tuple[int, int, int]]] = {s: [(p, -(2**63), 0) for p, n in enumerate(cut, 1) if n == 0] for s, cut in zip(names, numbers)}
    if wanted:
        for r in _hashes_at(narrow, spark.createDataFrame(wanted, "key string, part int, number bigint"), bits).collect():
            found[r.key].append((r.part, r.hash, r.first))
    cuts = []
    for s in names:
        of = sorted(found[s])
        cuts.append((np.array([h for _, h, _ in of], "i8"), np.array([0, *(p for p, _, _ in of)], "i4"), np.array([0, *(f for _, _, f in of)], "i8")))

    sources = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "key string, source int")  # MAX_SOURCES rows at most
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"), key, F.xxhash64(ident).alias("hash"), ident.alias("id"))
    dealt = boxed.join(F.broadcast(sources), "key").withColumn("to", _placed(spark.sparkContext.broadcast(cuts))("source", "hash"))
    moved = dealt.select("doc", "source", "hash", "id", F.col("to.part").alias("part"), F.col("to.start").alias("start")).repartitionById(parts, "part")
    number = F.col("start") + F.row_number().over(Window.partitionBy("part", "source").orderBy("hash", "id")) - 1
    numbered = moved.select("doc", "source", number.alias("n")).withColumn("block", F.floor(F.col("n") / block_rows))
    listed = [(s, a, b, at, length, slots) for s, a, b, at, length, slots in plan]
    table = spark.createDataFrame(listed, "source int, first bigint, end bigint, at bigint, length bigint, slots array<bigint>")
    joined = numbered.join(F.broadcast(table), (numbered.source == table.source) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("end")))
    i, k = F.col("block") - F.col("first"), F.size("slots")
    slot = F.col("at") + F.floor(i / k) * F.col("length") + F.element_at("slots", (i % k + 1).cast("int"))
    return joined.withColumn("slot", slot).select("doc.*", "block", "slot", (F.col("slot") * block_rows + F.col("n") % block_rows).alias("position"))
