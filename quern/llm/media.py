"""Media columns: content-addressed payloads in tar shards, rows with digest and byte range.

A payload is stored as a PNG of 8-bit RGB samples, 64 pixels (192 bytes) a row, as a tar
member named by the payload's SHA-256. Each task appends to shards of its own, so writing
needs no shuffle, and holds no payload twice in a shard: rows with equal payloads share a
byte range. Shard names are new for each attempt and only those in the returned manifest
are ever read. Rows carry (digest, shard, offset, length).

``one_place`` then lets all rows of a digest share one range over all shards. ``media_headers``
fills width, height, depth and channels by reading the 33 header bytes of a range;
``media_features`` reads whole ranges, restores the payload and checks it against its digest.
Rows are dealt out by stretches of a shard, so a task reads neighbouring ranges and hot payloads
are shared out.

Edge cases: a null text is an empty one; an empty payload is one row of 192 spaces;
repeated rows and ids are all returned; an empty table gives no shard and an empty result;
only the id and text columns are used.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import byte_bounded, filesystem, make_dir, materialize, text_bytes

UNIT, WIDTH = 192, 64
SHARD_BYTES = 256 << 20
STRETCH = 8 << 20
HEADER_BYTES = 33
LEVEL = 6


def padded(data: bytes) -> bytes:
    """Spaces are added up to a positive multiple of ``UNIT``."""
    return data + b" " * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, "u1").reshape(-1, UNIT)
    lines = np.concatenate([np.zeros((len(rows), 1), "u1"), rows], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, depth, channels) from the first ``HEADER_BYTES`` bytes."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth, kind = struct.unpack(">IIBB", head[16:26])
    return width, height, depth, {0: 1, 2: 3, 4: 2, 6: 4}[kind]


def from_png(data: bytes) -> bytes:
    """The payload of a PNG that ``to_png`` made."""
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), "u1").reshape(-1, UNIT + 1)
    if rows[:, 0].any():
        raise ValueError("filtered PNG rows")
    return rows[:, 1:].tobytes()


def _write(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        out, name, at = None, "", 0
        places: dict[bytes, tuple[int, int]] = {}  # of the open shard
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                found = []
                for text in batch.column(1):
                    text = text.as_py()
                    payload = padded(text)
                    digest = hashlib.sha256(payload).digest()
                    if out is None:
                        name, at, places = f"shard-{uuid.uuid4().hex}.tar", 0, {}
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    if digest not in places:
                        image = to_png(payload)
                        member = tarfile.TarInfo(f"{digest.hex()}.png")
                        member.size = len(image)
                        out.write(member.tobuf(tarfile.USTAR_FORMAT) + image + bytes(-len(image) % 512))
                        places[digest] = (at + 512, len(image))
                        at += 512 + len(image) + -len(image) % 512
                    found.append((digest.hex(), name, *places[digest], len(text)))
                    if at >= SHARD_BYTES:
                        out.write(bytes(1024))
                        out.close()
                        out = None
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0]), pa.array(columns[1]), *(pa.array(c, pa.int64()) for c in columns[2:])], ["id", "digest", "shard", "offset", "length", "n_bytes"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return write


def write_media(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """Store every text below ``path``: (id, digest, shard, offset, length, n_bytes)."""
    make_dir(path)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)] + [T.StructField(n, t) for n, t in (("digest", T.StringType()), ("shard", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()), ("n_bytes", T.LongType()))])
    return materialize(byte_bounded(docs.select(F.col(id_col).alias("id"), text_bytes(F.col(text_col)).alias("text"))).mapInArrow(_write(path), schema), "media")


def payload_index(media: DataFrame) -> DataFrame:
    """One place for each digest: (digest, shard, offset, length)."""
    return media.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def one_place(media: DataFrame) -> DataFrame:
    """``media`` with the place that ``payload_index`` gives each digest, a written table."""
    return materialize(media.drop("shard", "offset", "length").join(payload_index(media), "digest"), "media")


def _dealt(media: DataFrame) -> DataFrame:
    return media.repartition("shard", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("shard", "offset")


def _ranges(path: str, parse, size_at: int | None, types: list[pa.DataType], names: list[str]):
    """Appends what ``parse`` makes of each row's byte range (of ``size_at`` bytes at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        handle, open_name, last, value = None, None, None, None
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                shard, offset, length, digest = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("shard", "offset", "length", "digest"))
                found = []
                for s, o, n, d in zip(shard, offset, length, digest):
                    if s != open_name:
                        if handle is not None:
                            handle.close()
                        handle, open_name = store.open_input_file(f"{root}/{s}"), s
                    if (s, o) != last:  # rows of one payload follow each other
                        handle.seek(o)
                        last, value = (s, o), parse(handle.read(n if size_at is None else min(n, size_at)), d)
                    found.append(value)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*found), types))], [*batch.schema.names, *names])
        if handle is not None:
            handle.close()

    return run


def _plus(media: DataFrame, spec: str) -> T.StructType:
    return T.StructType([*media.schema.fields, *T.StructType.fromDDL(spec).fields])


def media_headers(media: DataFrame, path: str) -> DataFrame:
    """``media`` with width, height, depth and channels, from header bytes alone; dealt out by place."""
    spec = "width bigint, height bigint, depth bigint, channels bigint"
    parse = lambda data, _: png_header(data)
    return _dealt(media).mapInArrow(_ranges(path, parse, HEADER_BYTES, [pa.int64()] * 4, ["width", "height", "depth", "channels"]), _plus(media, spec))


def features(data: bytes, digest: str) -> tuple:
    channels = png_header(data)[3]
    payload = from_png(data)
    sha = hashlib.sha256(payload).hexdigest()
    if sha != digest:
        raise ValueError(f"payload {digest} is damaged")
    means = np.frombuffer(payload, "u1").reshape(-1, channels).mean(axis=0, dtype="f8")
    return len(payload), sha, zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), ",".join(f"{m:.2f}" for m in means)


def media_features(headed: DataFrame, path: str) -> DataFrame:
    """``headed`` (of ``media_headers``) with what the whole stored bytes give."""
    spec = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, means string"
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    found = headed.mapInArrow(_ranges(path, features, None, types, [f.split()[0] for f in spec.split(", ")]), _plus(headed, spec))
    return found.withColumn("feature", F.format_string("png %dx%d %dx%d mean %s", "width", "height", "channels", "depth", "means")).drop("means")
