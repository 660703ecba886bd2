"""SimHash near duplicates with deletion-variant signatures.

Fingerprints. A text's word shingles are hashed with XXH64; a fingerprint bit is set if it
is set in over half of the hashes.

Candidates. A fingerprint of 64 m bits is cut into 2 m segments of 32 bits, fewer than an
exact-match scheme would need: two fingerprints that differ in fewer than 4 m bits have a
segment that differs in one bit at most. Each segment is indexed under its 32 variants
that leave one bit out, so such a pair meets under a common variant (for 64 bits: all
pairs within 3). Variants are grouped by one shuffle on the variant key and a sort; a run
of equal keys is searched in its task and gives links of a spanning forest (at most one
less than its members), not all its pairs. Runs over ``WIDE_RUN`` members are searched
by leaving out two more bits at a time, which is linear in the run.

Equal fingerprints are pre-aggregated before any of this, so groups of copies cost one
row each. Components come from ``connected_components``. Nothing is collected.

``near_duplicate_groups`` is the plain operator (fingerprints within ``max_bits``).
``drop_near_duplicates`` keeps one row for each group that pairs of texts connect whose sets of
word shingles have a Jaccard similarity of ``similarity`` or more. Fingerprints alone can't
find all of those: a block of one text in ten changed moves 20 of 64 bits and more. So it has
two passes, and no pair is linked that isn't verified on the shingle sets. Texts of equal sets
are one to begin with. The first pass is the one above, by fingerprints of the sets within
``NEAR_BITS``; it connects the greater part of the copies. The second is exact and finds the
rest by a prefix join. All shingles have one order (common ones, as counted in a sample, last;
else by hash; any order gives the same result), and two sets as similar have one of the first
n - ceil(similarity n) + 1 of n shingles of each in common. A pair of such a run whose ends
aren't connected yet goes on if sizes and places in the order leave room for the overlap, and
if the sets' parities in ``FOLD`` bits a shingle differ in no more bits than the sets may differ
in shingles; neither test loses a pair. The nearest are verified first, then what is still apart.
Runs over ``WIDE_KEY`` members give two pairs a member at first, and then all pairs between
different components, in blocks of ``BETWEEN_ROWS`` members, so that no task holds a run.

The texts are written once, in the partitions in which they come, and stay there: a row's number
tells its partition, so what is found about rows is filed by partition and looked up by the task
that reads it (``_found``). Only texts that a candidate pair names are shuffled.

Edge cases: null and empty texts (and those of white space) have fingerprint zero and form
one group; fewer words than a shingle give one shingle; repeated rows are copies; a null id
never names a group unless it has no other; empty tables give empty results; ``drop_near_duplicates``
keeps all input columns, whatever their names, and ``near_duplicate_groups`` only the id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import byte_bounded, filesystem, materialize, release, setting, shared_dir, text_bytes, tidied
from quern.llm.components import connected_components

SEED = 42
WIDE_RUN = 1500
WIDE_KEY = 64
FIRST_PAIRS = 8  # of a member of a wide run, before all others
SAMPLE = 16  # one text of so many is counted for the order of shingles
COMMON = 6  # in the sample
MAX_COMMON = 200_000
FOLD = 4  # bits a shingle at least, in all a power of two
NEAR_BITS = 2  # of the first pass
BETWEEN_ROWS = 2048
PARTITION_SHIFT = 33  # of monotonically_increasing_id
EPS = 1e-9
TEXT_ROWS = 64  # of an Arrow batch with two texts a row
PROFILE_ROWS = 500  # of one with one text a row
BLOCK = 1 << 17
_LANES = np.uint64(0x0101010101010101)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and tab to carriage return, A-Z lower-cased."""
    return text.lower().split() if text else []


def shingle_hashes(words: list[bytes], k: int, seed: int = SEED) -> np.ndarray:
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist())), "<u8", len(words) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    counts = np.zeros(64, "i8")
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        padded = np.zeros(-(-len(part) // 255) * 255, "<u8")
        padded[: len(part)] = part
        grid = padded.reshape(-1, 255)
        for k in range(8):  # eight counters of 8 bits in each sum of 255 words
            sums = ((grid >> np.uint64(k)) & _LANES).sum(axis=1, dtype="<u8")
            counts[k::8] += sums.view("u1").reshape(-1, 8).sum(axis=0, dtype="i8")
    return int(np.packbits((2 * counts > len(hashes)).astype("u1"), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, k: int = 3) -> int:
    return majority(shingle_hashes(words_of(text), k))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, "<u8").view("<i8"))


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed([fingerprint(t.as_py(), k) for t in batch.column(1)])], ["id", "fp"])

    return run


def variants(fps: DataFrame, m: int) -> DataFrame:
    """A row for each fingerprint and bit left out: the key has the bit's number and the
    other bits of its segment."""
    bit = F.col("_bit")
    value = F.lit(None).cast("bigint")
    for s in range(2 * m):
        word = F.col(f"fp{s // 2}")
        value = F.when(F.floor(bit / 32) == s, F.shiftrightunsigned(word, 32) if s % 2 else word.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(value)
    rows = fps.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(64 * m - 1))))
    one = F.expr("shiftleft(1L, cast(_bit % 32 as int))")
    key = F.expr("shiftleft(cast(_bit as bigint), 32)").bitwiseOR(value.bitwiseAND(F.bitwise_not(one)))
    return rows.withColumn("key", key).drop("_bit")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(key, rows) of each run of two and more equal keys (column 0), across batch borders."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(0)[-1].as_py()
        if held and held[-1].column(0)[-1].as_py() == last:  # one run goes on
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        keys = table.column(0).to_numpy()
        upto = int(np.searchsorted(keys, last))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys[:upto])) + 1, [upto]))
        for i in np.flatnonzero(np.diff(cuts) > 1).tolist():
            yield int(keys[cuts[i]]), table.slice(cuts[i], cuts[i + 1] - cuts[i])
        held = table.slice(upto).to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows > 1:
        yield table.column(0)[0].as_py(), table.combine_chunks()


def _forest(fps: np.ndarray, max_bits: int, key: int) -> list[tuple[int, int]]:
    """Links that connect what is within ``max_bits`` in a run of distinct 64-bit values."""
    n = len(fps)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((int(fps[i]), int(fps[j])))

    if n <= WIDE_RUN or max_bits != 2:
        for i in range(n - 1):
            for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= max_bits).tolist():
                link(i, i + 1 + j)
        return links
    bit = key >> 32  # all bits of this one's segment but itself are equal
    half = bit // 32 % 2
    free = [bit % 64, *range(32 * (1 - half), 32 * (1 - half) + 32)]
    for x in range(33):
        for y in range(x + 1, 33):
            mask = np.uint64(0xFFFFFFFFFFFFFFFF ^ (1 << free[x]) ^ (1 << free[y]))
            kept = fps & mask
            order = np.argsort(kept, kind="stable")
            for p in np.flatnonzero(np.diff(kept[order]) == 0).tolist():
                link(int(order[p]), int(order[p + 1]))
    return links


def _search_runs(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for key, table in _runs(batches):
            for x, y in _forest(table.column(1).to_numpy().view("<u8"), max_bits, int(key)):
                a.append(x)
                b.append(y)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([_signed(a), _signed(b)], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([_signed(a), _signed(b)], ["a", "b"])

    return run


def print_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) of a spanning forest of the distinct fingerprints ``fp0`` that are within ``max_bits``."""
    return variants(fps.select("fp0"), 1).select("key", "fp0").repartition("key").sortWithinPartitions("key").mapInArrow(_search_runs(max_bits), "a bigint, b bigint")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for each row; ``max_bits`` can be 0 to 3."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments of 32 bits find all pairs within 3 bits")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    texts = docs.select(F.col(id_col).alias("id"), text_bytes(F.col(text_col)).alias("text"))
    with _text_batches(docs.sparkSession, PROFILE_ROWS):
        prints = materialize(byte_bounded(texts).mapInArrow(tidied(_fingerprints(shingle)), schema), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash")
    roots = connected_components(print_links(distinct.select(F.col("fp").alias("fp0")), max_bits), "a", "b")
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = materialize(labelled.select("fp", "root").join(groups, "root").select("fp", "component_id"), "simhash")
    release(distinct, roots)
    return prints.join(of_print, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def folded(own: np.ndarray) -> bytes:
    """Parities of a set of hashes, at least ``FOLD`` bits an element: one more or less changes one bit."""
    size = max(64, 1 << (FOLD * len(own) - 1).bit_length()) if len(own) else 64
    counts = np.bincount((own % np.uint64(size)).astype("i8"), minlength=size)
    return np.packbits((counts & 1).astype("u1")).tobytes()


def parity_distances(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many bits parities differ, each pair in the shorter one's length."""
    lengths = np.array([(len(a), len(b)) for a, b in zip(x, y)], "i8").reshape(-1, 2)
    out = np.zeros(len(lengths), "i8")
    for m, n in np.unique(lengths, axis=0).tolist():
        at = np.flatnonzero((lengths == (m, n)).all(axis=1))
        for i in range(0, len(at), max(1, (4 << 20) // max(m, n))):
            part = at[i : i + max(1, (4 << 20) // max(m, n))]
            a, b = (np.frombuffer(b"".join([z[k] for k in part.tolist()]), "<u8").reshape(len(part), -1) for z in (x, y))
            short = min(m, n) // 8
            a, b = (np.bitwise_xor.reduce(z.reshape(len(part), -1, short), axis=1) for z in (a, b))
            out[part] = np.bitwise_count(a ^ b).sum(axis=1, dtype="i8")
    return out


def prefix(own: np.ndarray, similarity: float, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first elements of a sorted set, one of which every set as similar has among its own."""
    if not len(own):
        return own
    n = len(own) - math.ceil(similarity * len(own) - EPS) + 1
    if not len(common):
        return own[:n]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    rank = np.where(common[at] == own, ranks[at], 0)
    return own[np.argsort(rank, kind="stable")[:n]]


def _shingle_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(words_of(t.as_py()), shingle)).view("<i8"))], ["h"])

    return run


def _common_shingles(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles and their ranks from 1, the most common last."""
    text = text_bytes(F.col(text_col))
    some = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = byte_bounded(some).mapInArrow(tidied(_shingle_rows(shingle)), "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    rows = counts.orderBy(F.desc("n"), "h").limit(MAX_COMMON).toArrow()
    hashes = rows.column("h").to_numpy().view("<u8")
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - np.arange(len(hashes)))[order]


def _profile(text_at: int, shingle: int, similarity: float, common):
    """(doc, digest, size, fold, prefix, fp) of (doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = common.value
        for batch in batches:
            digests, sizes, folds, firsts, prints = [], [], [], [], []
            for t in pc.struct_field(batch.column(0), text_at).cast(pa.binary()):
                own = np.unique(shingle_hashes(words_of(t.as_py()), shingle))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sizes.append(len(own))
                folds.append(folded(own))
                firsts.append(prefix(own, similarity, hashes, ranks).tobytes())
                prints.append(majority(own))
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(folds, pa.binary()), pa.array(firsts, pa.binary()), _signed(prints)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "digest", "size", "fold", "prefix", "fp"])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, size, place, root) of (id, size, prefix, root)."""
    for whole in batches:
        for i in range(0, whole.num_rows, 1000):
            batch = whole.slice(i, 1000)
            keys = [np.frombuffer(x, "<i8") for x in batch.column(2).to_pylist()]
            lengths = np.array([len(k) for k in keys], "i8")
            places = np.concatenate([np.arange(n, dtype="i4") for n in lengths])
            ids, size, root = (np.repeat(batch.column(k).to_numpy(), lengths) for k in (0, 1, 3))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate(keys), ids, size, places, root)], ["key", "id", "size", "place", "root"])


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables whose runs of equal keys (column 0) are whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(0)[-1].as_py()
        if held and held[-1].column(0)[-1].as_py() == last:
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        upto = int(np.searchsorted(table.column(0).to_numpy(), last))
        if upto:
            yield table.slice(0, upto)
        held = table.slice(upto).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _room(similarity: float, size_a, size_b, place_a, place_b):
    """If sets with a common element at these places can be as similar."""
    most = np.minimum(place_a, place_b) + np.minimum(size_a - place_a, size_b - place_b)
    sizes = size_a + size_b
    return (np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - EPS) & (most >= similarity / (1 + similarity) * sizes - EPS)


def _meet(similarity: float):
    """Of (key, id, size, place, root): pairs (a, b) of different roots, all of narrow runs and
    two a member of wide ones; the postings (a, key, size, place) of wide runs of several roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches):
            key, ids, size, place, root = (table.column(i).to_numpy() for i in range(5))
            size, place = size.astype("i8"), place.astype("i8")
            starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            lengths = np.diff(np.concatenate((starts, [len(key)])))
            several = np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts)
            wide_run = (lengths > WIDE_KEY) & several
            wide, open_run = np.repeat(wide_run, lengths), np.repeat((lengths <= WIDE_KEY) & several, lengths)
            a, b = [], []

            def add(i, j):
                fit = (root[i] != root[j]) & _room(similarity, size[i], size[j], place[i], place[j])
                x, y = ids[i[fit]], ids[j[fit]]
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))

            narrow = lengths[(lengths <= WIDE_KEY) & several]
            for d in range(1, int(narrow.max()) if len(narrow) else 0):
                i = np.flatnonzero((key[:-d] == key[d:]) & open_run[:-d])
                add(i, i + d)
            for s, n in zip(starts[wide_run].tolist(), lengths[wide_run].tolist()):
                i = np.arange(s, s + n)
                add(i[:-1], i[1:])
                add(i, np.full(n, s + int(np.argmin(place[s : s + n]))))  # fewest shingles of its own
            x, y = (np.concatenate(c) if c else np.zeros(0, "i8") for c in (a, b))
            pair = np.unique(np.stack([x, y], 1), axis=0)
            if n := len(pair):
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], ["a", "b", "key", "size", "place"])
            if n := int(np.count_nonzero(wide)):
                yield pa.RecordBatch.from_arrays([pa.array(ids[wide]), pa.nulls(n, pa.int64()), pa.array(key[wide]), pa.array(size[wide].astype("i4")), pa.array(place[wide].astype("i4"))], ["a", "b", "key", "size", "place"])

    return run


def _between(similarity: float, most: int | None):
    """Pairs between the components of each run of (part, id, size, place, root, fold, side): for
    each member the ``most`` nearest, or all. Members of sides 0 and 1 meet each other, those of
    side 2 one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _runs(batches):
            ids, size, place, root = (table.column(i).to_numpy().astype("i8") for i in range(1, 5))
            side = table.column(6).to_numpy()
            names, of = np.unique(root, return_inverse=True)
            if len(names) == 1:
                continue
            folds = table.column(5).to_pylist()
            largest = int(np.argmax(np.bincount(of)))
            a, b, held = [], [], 0
            for i in np.flatnonzero(of != largest).tolist():
                j = np.flatnonzero((of != of[i]) & ((side != side[i]) | (side[i] == 2)) & _room(similarity, size[i], size, place[i], place))
                j = j[(of[j] == largest) | (j > i)]
                far = parity_distances([folds[i]] * len(j), [folds[k] for k in j.tolist()])
                fit = far <= (1 - similarity) / (1 + similarity) * (size[i] + size[j]) + EPS
                j, far = j[fit], far[fit]
                if most is not None and len(j) > most:
                    j = j[np.argsort(far, kind="stable")[:most]]
                a.append(np.minimum(ids[j], ids[i]))
                b.append(np.maximum(ids[j], ids[i]))
                held += len(j)
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                    a, b, held = [], [], 0
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _in_blocks(sided: DataFrame) -> DataFrame:
    """(part, id, size, place, root, fold, side) of (key, id, size, place, root, fold): the runs of
    several roots, as pairs of blocks of about ``BETWEEN_ROWS`` members."""
    runs = sided.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
    rows = sided.join(runs.select("key", F.ceil(F.col("n") / BETWEEN_ROWS).cast("int").alias("blocks")), "key")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") == low, 0).otherwise(1)
    return rows.select(F.xxhash64("key", low, high).alias("part"), "id", "size", "place", "root", "fold", side.alias("side"))


def _plausible(similarity: float):
    """(a, b, far) of (a, b, the fold and size of a, those of b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(3).to_numpy().astype("i8") + batch.column(5).to_numpy()
            far = parity_distances(batch.column(2).to_pylist(), batch.column(4).to_pylist()).astype("i4")
            kept = np.flatnonzero(far <= (1 - similarity) / (1 + similarity) * sizes + EPS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)), pa.array(far[kept])], ["a", "b", "far"])

    return run


def _text_batches(spark, rows: int = TEXT_ROWS):
    """Inside, Arrow batches have so few rows that very long texts fit."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def _verify(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, last, own = [], None, set()
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != last:
                    last, own = a, set(shingle_hashes(words_of(batch.column(2)[i].as_py()), shingle).tolist())
                other = set(shingle_hashes(words_of(batch.column(3)[i].as_py()), shingle).tolist())
                both = len(own & other)
                if both >= similarity * (len(own) + len(other) - both) and both:
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64()))], ["a", "b"])

    return run


def _found(rows: DataFrame) -> Column:
    """A column of the written texts by ``row``: the value that ``rows`` (row, value; each row once)
    has for it, or -1. The values of one partition of the texts lie in one file."""
    path = shared_dir(rows.sparkSession, "rows")
    filed = rows.select("row", F.col("value").cast("bigint").alias("value"), F.shiftright("row", PARTITION_SHIFT).alias("part"))
    with setting(rows.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        filed.repartition("part").sortWithinPartitions("part", "row").write.partitionBy("part").parquet(path)

    @F.pandas_udf("bigint")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        store, root = filesystem(path)
        at, known, values = None, None, None
        for batch in batches:
            asked = batch.to_numpy()
            out = np.full(len(asked), -1, "i8")
            parts = asked >> PARTITION_SHIFT
            for part in np.unique(parts).tolist():
                if part != at:
                    folder = pa.fs.FileSelector(f"{root}/part={part}", allow_not_found=True)
                    tables = [pq.read_table(f.path, filesystem=store, partitioning=None, columns=["row", "value"]) for f in store.get_file_info(folder) if f.path.endswith(".parquet")]
                    at, (known, values) = part, [np.concatenate([t.column(i).to_numpy() for t in tables] or [np.zeros(0, "i8")]) for i in (0, 1)]
                if len(known):
                    here = np.flatnonzero(parts == part)
                    place = np.minimum(np.searchsorted(known, asked[here]), len(known) - 1)
                    out[here] = np.where(known[place] == asked[here], values[place], -1)
            yield pd.Series(out)

    return look("row")


class _Verifier:
    """Verifies candidate pairs on texts and keeps the components of the links found so far."""

    def __init__(self, whole: DataFrame, text_col: str, shingle: int, similarity: float):
        self.texts = whole.select("row", text_bytes(F.col("doc").getField(text_col)).alias("text"))
        self.check = _verify(shingle, similarity)
        self.links = self.roots = None

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends aren't connected yet."""
        of = lambda end: self.roots.select(F.col("node").alias(end), F.col("root").alias("root_" + end))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")

    def add(self, pairs: DataFrame) -> None:
        """Verify ``pairs`` (a written table)."""
        body = materialize(_named(self.texts, pairs), "near-duplicates")
        of = lambda end: body.select(F.col("row").alias(end), F.col("text").alias("text_" + end))
        with _text_batches(body.sparkSession):
            found = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(tidied(self.check), "a bigint, b bigint")
            new = materialize(found if self.links is None else found.union(self.links), "near-duplicates")
        roots = connected_components(new, "a", "b")
        release(*(t for t in (body, self.links, self.roots) if t is not None))
        self.links, self.roots = new, roots


def _named(of_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows that are an end of a pair."""
    ends = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct().withColumn("value", F.lit(1))
    return of_rows.withColumn("found", _found(ends)).where("found >= 0").drop("found")


def _similar_prints(distinct: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) by fingerprints: rows of an equal one with its first row, and the first
    rows of those within ``NEAR_BITS``."""
    first = materialize(distinct.groupBy("fp").agg(F.min("row").alias("least")), "near-duplicates")
    equal = distinct.select("fp", "row").join(first, "fp").where("row > least").select(F.col("least").alias("a"), F.col("row").alias("b"))
    near = print_links(first.select(F.col("fp").alias("fp0")), NEAR_BITS).distinct()
    of = lambda end: first.select(F.col("fp").alias(end), F.col("least").alias("row_" + end))
    near = near.join(of("a"), "a").join(of("b"), "b").select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"))
    return materialize(equal.union(near), "near-duplicates")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row (that of the smallest id) of each group of near duplicates."""
    keep = lambda df: materialize(df, "near-duplicates")
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    schema = T.StructType([*boxed.schema.fields, *T._parse_datatype_string("digest binary, size int, fold binary, prefix binary, fp bigint").fields])
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, text_col, shingle))
    with _text_batches(docs.sparkSession, PROFILE_ROWS):
        whole = keep(byte_bounded(boxed).mapInArrow(tidied(_profile(docs.columns.index(text_col), shingle, similarity, common)), schema).withColumn("row", F.monotonically_increasing_id()))
    own_id = F.col("doc").getField(id_col)
    keys = whole.select("digest", "size", "fp", F.struct(own_id.isNull().alias("no_id"), own_id.alias("id"), F.col("row").alias("row")).alias("one"))
    texts = keep(keys.groupBy("digest").agg(F.min("one").alias("one"), F.first("size").alias("size"), F.first("fp").alias("fp")).drop("digest"))

    verifier = _Verifier(whole, text_col, shingle, similarity)
    verifier.add(_similar_prints(texts.where("size > 0").select("one.row", "fp")))

    def rooted(rows: DataFrame, key: str) -> DataFrame:
        return rows.join(verifier.roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key))

    roots = rooted(texts.where("size > 0").select("one.row"), "row").withColumnRenamed("root", "value")
    postings = whole.select(F.col("row").alias("id"), "size", "prefix", _found(roots).alias("root")).where("root >= 0").mapInArrow(tidied(_postings), "key bigint, id bigint, size int, place int, root bigint")
    met = keep(postings.repartition("key").sortWithinPartitions("key", "size").mapInArrow(tidied(_meet(similarity)), "a bigint, b bigint, key bigint, size int, place int"))
    pairs = keep(met.where("b is not null").select("a", "b").distinct())
    facts = keep(_named(whole.select("row", "fold", "size"), pairs))
    of = lambda end: facts.select(F.col("row").alias(end), F.col("fold").alias("fold_" + end), F.col("size").alias("size_" + end))
    near = keep(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "fold_a", "size_a", "fold_b", "size_b").mapInArrow(tidied(_plausible(similarity)), "a bigint, b bigint, far int"))
    release(pairs, facts)
    both = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "far").union(near.select("b", "a", "far"))
    chosen = both.groupBy("x").agg(F.min(F.struct("far", "y")).alias("near"), F.min("y").alias("least")).select("x", F.explode(F.array("near.y", "least")).alias("y"))
    verifier.add(first := keep(chosen.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))
    verifier.add(keep(verifier.apart(near.select("a", "b").join(first, ["a", "b"], "left_anti"))))

    wide = met.where("b is null").select("key", F.col("a").alias("id"), "size", "place")
    if not wide.isEmpty():
        facts = _named(whole.select("row", "fold"), wide.select(F.col("id").alias("a"), F.col("id").alias("b")))
        wide = keep(wide.join(facts.withColumnRenamed("row", "id"), "id"))
        tried = near.select("a", "b")
        for most in (FIRST_PAIRS, None):
            parts = _in_blocks(rooted(wide, "id")).repartition("part").sortWithinPartitions("part")
            more = parts.mapInArrow(tidied(_between(similarity, most)), "a bigint, b bigint").distinct()
            more = keep(more.join(tried, ["a", "b"], "left_anti"))
            if more.isEmpty():
                break
            verifier.add(more)
            tried = tried.union(more)
        release(wide)
    grouped = rooted(texts.withColumn("row", F.col("one.row")), "row").groupBy("root").agg(F.min("one").alias("one"))
    kept = grouped.select("one.row", F.lit(1).alias("value"))
    out = whole.withColumn("found", _found(kept)).where("found >= 0").select("doc.*")
    release(met, near, first, texts)
    return out
