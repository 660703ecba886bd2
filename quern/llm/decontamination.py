"""Benchmark decontamination: a prefix-filtered join of documents with item windows.

A window is ``window`` consecutive words of an item (an item of fewer words is one
window). A document holds a window if the same words follow each other in it. Full
containment needs every word of a window, so the rarest one, by document frequency over
the whole corpus, is a sufficient prefix: windows are filed under it, and a document word
meets only the windows filed under that very word. The word's place in the window bounds
where the window can start (position filter) and end (length filter), and the words there
are then compared one by one as one byte string.

Items are taken in blocks of at most ``BLOCK_BYTES`` of text, so what is sent to the
executors has a fixed bound however long the benchmark is; with more than one block the
documents with their findings so far are written to the shared folder between the passes.
Two scans of the documents are made for each block (frequencies, then the search); no
document is shuffled or cut.

Words are runs of ASCII letters, digits and any non-ASCII characters, A-Z lower-cased.

Edge cases: null and empty texts have no words and hit nothing; items without words are
ignored; windows of items without an id hit and contaminate, but such items aren't counted or
listed; repeated items with one id count once; repeated documents are judged alike; an empty
benchmark marks nothing; input columns can have any names, and those called like a result
are replaced.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import byte_bounded, materialize, release, text_bytes, tidied

BLOCK_BYTES = 2 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    if 0 < len(words) < window:
        yield tuple(words)
    for i in range(len(words) - window + 1):
        yield tuple(words[i : i + window])


class PrefixIndex:
    """Windows by rarest word, then by (place of that word, length), then by their words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, frequency: dict[bytes, int]):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            for w in windows_of(words_of(text), window):
                owners[w].update([] if item is None else [item])
        self.by_word: dict[bytes, dict[tuple[int, int], dict[bytes, tuple[str, ...]]]] = {}
        for w, ids in owners.items():
            rank = min(range(len(w)), key=lambda i: (frequency.get(w[i], 0), w[i], i))
            if frequency.get(w[rank], 0):  # a window with a word that no document has can't occur
                self.by_word.setdefault(w[rank], {}).setdefault((rank, len(w)), {})[b" ".join(w)] = tuple(sorted(ids))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(hit [start, end) spans, items found)."""
        spans, items = [], set()
        for at in [i for i, w in enumerate(words) if w in self.by_word]:
            for (place, length), windows in self.by_word[words[at]].items():
                start = at - place
                if start >= 0 and start + length <= len(words) and (found := windows.get(b" ".join(words[start : start + length]))) is not None:
                    spans.append((start, start + length))
                    items.update(found)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _count_words(vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = vocabulary.value, Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(known.intersection(words_of(text.as_py())))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return count


def _search(index, text_at: int):
    """(doc, n_words, spans, items) of (doc, n_words, spans, items) with what this index adds."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        spans_type, items_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.list_(pa.string())
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                n_words, spans, items = [], [], []
                had = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                for text, (old_spans, old_items) in zip(pc.struct_field(batch.column(0), text_at).cast(pa.binary()), had):
                    words = words_of(text.as_py())
                    new_spans, new_items = known.search(words)
                    old = [(s["from"], s["to"]) for s in old_spans]
                    n_words.append(len(words))
                    spans.append([{"from": a, "to": b} for a, b in merged(old + new_spans)])
                    items.append(sorted(new_items.union(old_items)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(items, items_type)], ["doc", "n_words", "spans", "items"])

    return search


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """(doc, n_words, spans, items): the columns of ``docs`` as one, the hit word ranges (disjoint)
    and the ids found."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), text_bytes(F.col(f"`{item_text}`")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / BLOCK_BYTES))
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.lit(0).cast("bigint").alias("n_words"), F.expr("cast(array() as array<struct<from: bigint, to: bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for block in range(n_blocks):
        some = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == block) if n_blocks > 1 else items
        listed = [(r.id, bytes(r.text)) for r in some.collect()]
        vocabulary = sc.broadcast({w for _, t in listed for w in words_of(t)})
        texts = docs.select(text_bytes(F.col(f"`{text_col}`")).alias("text"))
        counted = byte_bounded(texts).mapInArrow(tidied(_count_words(vocabulary)), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        frequency = {bytes(r.word): r.n for r in counted.collect()}  # of this block's words alone
        index = sc.broadcast(PrefixIndex(listed, window, frequency))
        new = byte_bounded(found).mapInArrow(tidied(_search(index, docs.columns.index(text_col))), found.schema)
        if block < n_blocks - 1:
            before, new = found, materialize(new, "decontamination")
            if block:
                release(before)
        found = new
    return found


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with the columns ``RESULTS``."""
    found = find_contamination(docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["to"] - s["from"])
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in RESULTS]
    return found.select(*kept, "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
