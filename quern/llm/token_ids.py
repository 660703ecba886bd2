"""Token ids in byte or bit planes: a tokenizer stage, a file format and its reader.

Format. A file holds a run of documents in ascending key order. Ids are cut into blocks of
``BLOCK_IDS``; a block of n ids (unsigned 32-bit, little-endian) is transposed into 4 byte
planes or 32 bit planes, each plane is compressed with zstandard (a plane of zeros takes no
bytes), and the footer has the chunk index (offset, ids, length of each plane) and the
documents' keys and lengths. Readers can fetch any id range with one read of the footer
and of the blocks concerned.

Order. Rows are range-partitioned by key and sorted inside each partition, so every file
covers a key range and files follow each other by partition number; equal keys meet in one
file. Rows of Parquet files can instead keep the order in which they lie there (``in_place``):
nothing is shuffled then, and each stretch of a file that a task reads gives one file. The
driver sees one row for each file. Files of lost or repeated task attempts aren't in the
manifest and are never read.

Encoding gives what ``Tokenizer.encode(text, add_special_tokens=False)`` of the tokenizers
library gives. For a byte-level BPE that library spends most time on re-splitting words it
has seen; ``PlaneEncoder`` cuts texts where its pre-tokenizer always cuts (before a single
space between two characters that aren't white space), keeps a bounded table of encoded
pieces, and hands new ones to the library's BPE in batches.

Edge cases: null and empty texts give the end id alone; null keys come first; repeated rows
are all kept, in text order under an equal key; an empty table gives no file and no rows;
all columns but key and text are ignored.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import byte_bounded, filesystem, make_dir, materialize, release, setting, shared_dir, tidied

MAGIC = b"QPLANES1"
BLOCK_IDS = 1 << 16
RUN_BYTES, BATCH_ROWS = 8 << 20, 2000
CACHED_CHUNKS = 1_000_000  # the first ones are the frequent ones and stay; of pieces a fifth
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*")
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def _byte_alphabet() -> dict[int, str]:
    """The printable character that a byte-level vocabulary has for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PlaneEncoder:
    """Texts to bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, tokenizer_json: str, cached: int = CACHED_CHUNKS):
        import json

        import regex
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        self.cached = cached
        self.whole = Tokenizer.from_str(tokenizer_json)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = spec.get("normalizer") is None and spec.get("pre_tokenizer") == _BYTE_LEVEL and spec["model"]["type"] == "BPE"
        self.pieces_of = regex.compile(_PATTERN).findall
        self.alphabet = {b: c for b, c in _byte_alphabet().items() if b != 10}
        bare = spec | {"added_tokens": [], "pre_tokenizer": None, "post_processor": None, "truncation": None, "padding": None}
        self.words = Tokenizer.from_str(json.dumps(bare)) if self.fast else None  # of the byte alphabet's letters
        self.spaced: dict[str, bytes] = {}  # by chunk, without the space before it
        self.pieces: dict[str, bytes] = {}
        self.signs = {c: self._library(c) for c in ".,;:!?"}

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _fill(self, pieces: list[str]) -> None:
        """Encode pre-tokens that aren't known yet."""
        lined = [p for p in pieces if "\n" in p]
        self.pieces.update((p, self._library(p)) for p in lined)
        pieces = [p for p in pieces if "\n" not in p] if lined else pieces
        self.pieces.update(zip(pieces, self._bpe(pieces)))

    def _bpe(self, pieces: list[str]) -> list[bytes]:
        """Pre-tokens without line feeds."""
        if not pieces:
            return []
        spelt = "\n".join(pieces).encode().decode("latin-1").translate(self.alphabet).split("\n")
        return [array("I", x.ids).tobytes() for x in self.words.encode_batch_fast(spelt, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Chunks that begin and end at pre-token borders."""
        split = [self.pieces_of(c) if _PLAIN.fullmatch(c) else None for c in chunks]
        new = list(dict.fromkeys(p for s in split if s for p in s if p not in self.pieces))
        if len(self.pieces) + len(new) > self.cached // 5:
            self.pieces.clear()
            new = list(dict.fromkeys(p for s in split if s for p in s))
        self._fill(new)
        return [self._library(c) if s is None else b"".join([self.pieces[p] for p in s]) for c, s in zip(chunks, split)]

    def _encode_spaced(self, parts: list[str]) -> dict[str, bytes]:
        """Chunks of a space and one of ``parts``. A word with or without a sign after it
        needs no pattern, and is often known without the sign."""
        out: dict[str, bytes] = {}
        words: list[str] = []
        stems: list[tuple[str, str]] = []
        rest: list[str] = []
        for p in parts:
            if not (p.isascii() or _PLAIN.fullmatch(p)):
                rest.append(p)
            elif p.isalpha():
                words.append(p)
            elif p[-1] in self.signs and (stem := p[:-1]).isalpha():
                if (ids := self.spaced.get(stem)) is None:
                    words.append(stem)
                    stems.append((p, stem))
                else:
                    out[p] = ids + self.signs[p[-1]]
            else:
                rest.append(p)
        words = list(dict.fromkeys(words))
        out.update(zip(words, self._bpe([" " + w for w in words])))
        out.update((p, out[stem] + self.signs[p[-1]]) for p, stem in stems)
        out.update(zip(rest, self._encode_chunks([" " + p for p in rest])))
        return out

    def _odd(self, text: str) -> bytes:
        """A text with white space other than single spaces between its chunks."""
        chunks = _SAFE_CUT.split(text)
        return b"".join(self._encode_chunks([chunks[0], *(" " + c for c in chunks[1:])]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids. Texts are cut at spaces all at once; each distinct chunk is looked up
        once, and the texts' ids are gathered from those of their chunks."""
        out: list[bytes | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.fast and not any(a in t for a in self.added)]
        for i in set(range(len(texts))).difference(plain):
            out[i] = self._library(texts[i])
        if not plain:
            return out
        lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        at, chunks = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        begin = lists.offsets.to_numpy()[:-1]
        trimmed = pc.utf8_trim_whitespace(coded.dictionary)
        odd = pc.or_(pc.equal(coded.dictionary, ""), pc.not_equal(trimmed, coded.dictionary)).to_numpy(zero_copy_only=False)[at]
        odd[begin] = [chunks[k][-1:].isspace() for k in at[begin]]
        of_text = np.repeat(np.arange(len(plain)), np.diff(lists.offsets.to_numpy()))
        odd_text = np.logical_or.reduceat(odd, begin)
        for k in np.flatnonzero(odd_text).tolist():
            out[plain[k]] = self._odd(texts[plain[k]])
        good = np.flatnonzero(~odd_text)
        if not len(good):
            return out
        is_first = np.zeros(len(at), bool)
        is_first[begin] = True
        used = np.zeros(len(chunks), bool)
        used[at[~is_first & ~odd_text[of_text]]] = True
        numbers = np.flatnonzero(used)
        names = [chunks[k] for k in numbers.tolist()]
        ids = list(map(self.spaced.get, names))
        if new := [c for c, x in zip(names, ids) if x is None]:
            known = self._encode_spaced(new)
            ids = [known[c] if x is None else x for c, x in zip(names, ids)]
            if len(self.spaced) >= self.cached and len(new) > len(names) // 2:  # other texts than those before
                self.spaced = {}
            self.spaced.update(islice(known.items(), max(0, self.cached - len(self.spaced))))
        ids += self._encode_chunks([chunks[k] for k in at[begin[good]]])
        entry = np.zeros(len(chunks), "i4")
        entry[numbers] = np.arange(len(numbers))
        entry = entry[at]
        entry[begin[good]] = len(numbers) + np.arange(len(good))
        gathered = pa.array(ids, pa.binary()).take(pa.array(entry[~odd_text[of_text]]))
        _, borders, data = gathered.buffers()
        parts = np.cumsum(np.diff(lists.offsets.to_numpy())[good])
        ends = np.frombuffer(borders, "i4")[parts].tolist()
        data = memoryview(data or b"")
        for k, a, b in zip(good.tolist(), [0, *ends], ends):
            out[plain[k]] = bytes(data[a:b])
        return out


_ENCODERS: dict[tuple[int, int], PlaneEncoder] = {}


def encoder(tokenizer_json: str, cached: int) -> PlaneEncoder:
    """One encoder for each Python worker; its table outlives the task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (zlib.crc32(tokenizer_json.encode()), cached)
    if key not in _ENCODERS:
        _ENCODERS[key] = PlaneEncoder(tokenizer_json, cached)
    return _ENCODERS[key]


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """4 byte planes, or 32 bit planes of ceil(n / 8) bytes, lowest first."""
    octets = np.ascontiguousarray(ids.astype("<u4", copy=False)).view("u1").reshape(-1, 4)
    if not bits:
        return [octets[:, k].tobytes() for k in range(4)]
    return [np.packbits((octets[:, k // 8] >> (k % 8)) & 1, bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    octets = np.zeros((n, 4), "u1")
    if len(planes) == 4:
        for k, p in enumerate(planes):
            if p:
                octets[:, k] = np.frombuffer(p, "u1")
    else:
        for k, p in enumerate(planes):
            if p:
                octets[:, k // 8] |= np.unpackbits(np.frombuffer(p, "u1"), count=n, bitorder="little") << (k % 8)
    return octets.reshape(-1).view("<u4")


class PlaneWriter:
    """Appends documents' ids to one file."""

    def __init__(self, stream, bits: bool = False, level: int = 3, block_ids: int = BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.buffer, self.held, self.at, self.index = [], 0, 0, []
        self._put(MAGIC + struct.pack("<BI", bits, block_ids))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, raw: bytes) -> None:
        self.buffer.append(raw)
        self.held += len(raw)
        if self.held >= 4 * self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.buffer)
        size, at = 4 * self.block_ids, 0
        while len(data) - at >= size or last and at < len(data):
            ids = np.frombuffer(data[at : at + size], "<u4")
            planes = [self.pack(p) if p.count(0) < len(p) else b"" for p in to_planes(ids, self.bits)]
            self.index.append((self.at, len(ids), [len(p) for p in planes]))
            self._put(b"".join(planes))
            at += size
        self.buffer, self.held = [data[at:]], len(data) - at

    def close(self, docs: pa.RecordBatch) -> None:
        """docs: the documents' keys and numbers of ids."""
        self._flush(True)
        planes = 32 if self.bits else 4
        flat = b"".join(struct.pack(f"<QI{planes}I", o, n, *sizes) for o, n, sizes in self.index)
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, docs.schema) as w:
            w.write_batch(docs)
        parts = [self.pack(flat), self.pack(sink.getvalue())]
        foot = self.at
        for p in parts:
            self._put(struct.pack("<Q", len(p)) + p)
        self._put(struct.pack("<QI", foot, len(self.index)) + MAGIC)


class PlaneFile:
    """Reads a file that ``PlaneWriter`` wrote."""

    def __init__(self, handle, size: int):
        self.handle, self.unpack = handle, zstandard.ZstdDecompressor().decompress
        handle.seek(0)
        head = handle.read(len(MAGIC) + 5)
        tail_size = 12 + len(MAGIC)
        handle.seek(size - tail_size)
        tail = handle.read(tail_size)
        if head[: len(MAGIC)] != MAGIC or tail[12:] != MAGIC:
            raise ValueError("not a plane file")
        self.bits, self.block_ids = struct.unpack("<BI", head[len(MAGIC) :])
        foot, n = struct.unpack("<QI", tail[:12])
        handle.seek(foot)
        data = handle.read(size - tail_size - foot)
        a = struct.unpack("<Q", data[:8])[0]
        form = struct.Struct(f"<QI{32 if self.bits else 4}I")
        self.index = list(form.iter_unpack(self.unpack(data[8 : 8 + a]) if n else b""))
        self.docs = pa.ipc.open_stream(self.unpack(data[16 + a :])).read_all()

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k]
        self.handle.seek(at)
        data, planes, p = self.handle.read(sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.unpack(data[p : p + s]) if s else b"")
            p += s
        return from_planes(planes, n)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the file."""
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        whole = np.concatenate([self.block(k) for k in range(first, last + 1)]) if n else np.zeros(0, "<u4")
        return whole[start - first * self.block_ids :][:n]

    def documents(self) -> Iterator[np.ndarray]:
        """Each document's ids, one block in memory besides the document at hand."""
        left, k = np.zeros(0, "<u4"), 0
        for n in self.docs.column("n").to_pylist():
            parts, have = [left], len(left)
            while have < n:
                parts.append(self.block(k))
                have, k = have + len(parts[-1]), k + 1
            whole = np.concatenate(parts) if len(parts) > 1 else left
            yield whole[:n]
            left = whole[n:]


def _runs_of_texts(column: pa.Array, limit: int) -> Iterator[list[str]]:
    """The column's texts, about ``limit`` characters at a time."""
    run, size = [], 0
    for t in column:
        t = t.as_py() or ""
        run.append(t)
        size += len(t)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


class _TokenFile:
    """A file being written, and its row of the manifest."""

    def __init__(self, store, root: str, place: tuple, coder: PlaneEncoder, end_id: int, bits: bool, level: int):
        self.name, self.place, self.coder, self.end = f"part-{uuid.uuid4().hex}.planes", place, coder, struct.pack("<I", end_id)
        self.stream = store.open_output_stream(f"{root}/{self.name}", compression=None)
        self.writer = PlaneWriter(self.stream, bits, level)
        self.keys, self.sizes = [], []

    def add(self, keys: pa.Array, texts: pa.Array) -> None:
        self.keys.append(keys)
        for run in _runs_of_texts(texts, RUN_BYTES * self.coder.cached // CACHED_CHUNKS):
            for raw in self.coder.encode(run):
                self.writer.add(raw)
                self.writer.add(self.end)
                self.sizes.append(len(raw) // 4 + 1)

    def close(self) -> pa.RecordBatch:
        self.writer.close(pa.RecordBatch.from_arrays([pa.concat_arrays(self.keys), pa.array(self.sizes, pa.int64())], ["key", "n"]))
        self.stream.close()
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*self.place, self.name, sum(self.sizes), len(self.sizes))], ["source", "at", "file", "ids", "docs"])


def _write_files(path: str, tokenizer, end_id: int, bits: bool, level: int, cached: int):
    """Files of (key, text), or of (key, text, source file, row in it)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = filesystem(path)
        out, follows = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = [0]
            if batch.num_columns > 2:
                at, sources = batch.column(3).to_numpy(), batch.column(2).to_pylist()
                cuts += [i for i in range(1, len(at)) if at[i] != at[i - 1] + 1 or sources[i] != sources[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                place = (sources[a], int(at[a])) if batch.num_columns > 2 else ("", TaskContext.get().partitionId())
                if out and batch.num_columns > 2 and place != follows:
                    yield out.close()
                    out = None
                out = out or _TokenFile(store, root, place, encoder(tokenizer.value, cached), end_id, bits, level)
                out.add(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))
                follows = (place[0], place[1] + b - a)
        if out:
            coder = out.coder
            yield out.close()
            out = None
            if cached < CACHED_CHUNKS:  # memory counts more than time: the worker keeps no table for later tasks
                coder.spaced, coder.pieces = {}, {}

    return write


def _file_order(name: str) -> tuple:
    """Written files by their numbers, others by name."""
    number = re.match(r"part-(\d+)", name)
    return (int(number[1]) if number else -1, name)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, key_col: str, text_col: str, end_id: int, bits: bool = False, level: int = 3, in_place: bool = False, cached: int = CACHED_CHUNKS) -> list[tuple[str, int, int]]:
    """Encode and write ``docs`` by ascending key, then text (``cached``: chunks of text that a worker
    keeps encoded, some 300 bytes each with all that goes with them; fewer than the default are
    forgotten after each task); with ``in_place`` in the order of
    the files that they are read from (by the numbers in their names) and of the rows there.

    Returns (file, number of the ids before it, ids) for each file, in order.
    """
    make_dir(path)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())
    key, text = F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text")
    if in_place:
        origin = docs.metadataColumn("_metadata")
        rows = docs.select(key, text, origin.getField("file_name").alias("source"), origin.getField("row_index").alias("at"))
    else:
        by = [F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first()]
        rows = docs.select(key, text).repartitionByRange(by[0]).sortWithinPartitions(*by)
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS):
        made = materialize(byte_bounded(rows).mapInArrow(tidied(_write_files(path, tokenizer, end_id, bits, level, cached)), "source string, at bigint, file string, ids bigint, docs bigint"), "token-manifest")
    found, before = [], 0
    for r in sorted(made.collect(), key=lambda r: (_file_order(r.source), r["at"])):
        found.append((r.file, before, r.ids))
        before += r.ids
    release(made)
    return found


def _read_files(path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{name}") as handle:
                    f = PlaneFile(handle, handle.size())
                    sizes = f.docs.column("n").to_numpy()
                    starts = base + np.cumsum(sizes) - sizes
                    crc = np.fromiter((zlib.crc32(x.tobytes()) for x in f.documents()), "i8", len(sizes))
                    keys = f.docs.column("key").combine_chunks()
                    for i in range(0, len(sizes), 10_000):
                        yield pa.RecordBatch.from_arrays([keys.slice(i, 10_000), pa.array(starts[i : i + 10_000]), pa.array(sizes[i : i + 10_000]), pa.array(crc[i : i + 10_000])], ["key", "start", "n_tokens", "ids_crc32"])

    return read


def read_token_files(spark: SparkSession, path: str, files: list[tuple[str, int, int]], key_col: str, key_type: T.DataType) -> DataFrame:
    """One row for each document of the files: key, start, n_tokens, ids_crc32."""
    schema = T.StructType([T.StructField("key", key_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    listed = spark.createDataFrame([(f, b) for f, b, _ in files], "file string, base bigint").repartition(max(1, len(files)))
    return listed.mapInArrow(tidied(_read_files(path)), schema).withColumnRenamed("key", key_col)


def token_table(docs: DataFrame, tokenizer_path: str, key_col: str, text_col: str, end_id: int, bits: bool = False, in_place: bool = False, cached: int = CACHED_CHUNKS) -> DataFrame:
    """Write ``docs`` as token files and read them back."""
    path = shared_dir(docs.sparkSession, "tokens")
    files = write_token_files(docs, path, tokenizer_path, key_col, text_col, end_id, bits, in_place=in_place, cached=cached)
    return read_token_files(docs.sparkSession, path, files, key_col, docs.schema[key_col].dataType)
