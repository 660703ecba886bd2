"""WARC archives: a writer that links equal payloads, and a Python data source.

Writing. ``write_warc`` gives each row one record. Of rows with equal payloads (of
``min_revisit_bytes`` bytes or more) that with the smallest id is a ``response``; the
others are ``revisit`` records that refer to it and hold headers alone. The choice needs
only (id, sha1) rows: a pre-aggregated minimum for each digest, and of these only the
digests that occur more than once meet the rows again, in an equality join that AQE can
split when one digest is hot. Each task streams its rows into archive files of its own;
names are new for each attempt, and only files in the returned manifest count, so retried
and speculative tasks leave nothing behind that a reader would see. Records are separate
gzip members whose ``sl`` extra field tells their length, so a reader can pass over them.

Reading. The source plans byte ranges of the listed files (split points are record
starts), takes filters on the record type and header columns, parses a record's headers
first and neither reads nor inflates the payload of a record that is filtered out or whose
payload isn't wanted (option ``payload=false``). Payloads that are decoded are held
against their digest. Archives of other writers, without ``sl`` or not compressed, work.

Edge cases: a null payload is an empty one; a null url has no WARC-Target-URI; line
breaks in a url are percent-encoded; repeated rows with the smallest id are all responses;
rows with a null id refer to the smallest id that isn't null, and are responses if there is
none (their record ids are random); an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from quern.llm.common import byte_bounded, filesystem, make_dir, materialize, text_bytes

RECORD_PREFIX = "urn:quern:record:"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 8 << 20
FILE_BYTES = 256 << 20
SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, refers_to string, headers map<string,string>, content_length bigint, http_length bigint, payload binary"
HEADER_COLUMNS = {"record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
READ_BYTES = 1 << 16


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(record: object) -> str:
    return f"<{RECORD_PREFIX}{record}>"


def record_bytes(record: object, url: str | None, payload: bytes, first: object = None, date: str = DATE) -> bytes:
    """One record, not compressed; ``first`` is the id that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_uri(record) if record is not None else f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if first is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_uri(first)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member with the ``sl`` field: its own length and that of ``data``."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _writer(path: str, level: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        out, name, at, splits, count, made = None, "", 0, [0], 0, []

        def close() -> None:
            out.close()
            made.append((name, at, count, splits))

        for batch in batches:
            cols = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                record, url, payload, first = (c[i].as_py() for c in cols)
                if out is None:
                    name, at, splits, count = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0], 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip_member(record_bytes(record, url, payload, first, date), level)
                out.write(member)
                at, count = at + len(member), count + 1
                if at - splits[-1] >= SPLIT_BYTES:
                    splits.append(at)
                if at >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["file", "bytes", "records", "splits"])

    return write


def write_warc(rows: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int = 0, level: int = 6, date: str = DATE) -> DataFrame:
    """Write the archive below ``path``; returns its manifest (file, bytes, records, splits)."""
    make_dir(path)
    base = rows.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text_bytes(F.col(payload_col)).alias("payload"))
    base = base.withColumn("sha1", F.unhex(F.sha1("payload")))
    keyed = base.where(F.length("payload") >= min_revisit_bytes).select("id", "sha1")
    firsts = keyed.groupBy("sha1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    linked = base.join(firsts, "sha1", "left")
    small = F.length("payload") < min_revisit_bytes
    linked = linked.select("id", "url", "payload", F.when(~small & ~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("first"))
    made = byte_bounded(linked).mapInArrow(_writer(path, level, date), "file string, bytes bigint, records bigint, splits array<bigint>")
    return materialize(made, "warc-manifest")


class WarcRange(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class _Source:
    """Bytes of a file from ``start`` on, read as they are asked for."""

    def __init__(self, handle, start: int):
        self.handle, self.base, self.buffer = handle, start, b""
        handle.seek(start)

    def peek(self, n: int) -> bytes:
        while len(self.buffer) < n and (more := self.handle.read(max(READ_BYTES, n - len(self.buffer)))):
            self.buffer += more
        return self.buffer[:n]

    def skip(self, n: int) -> None:
        self.base += n
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.buffer = b""
            self.handle.seek(self.base)


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name, without the first line; folded lines are joined."""
    found: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def _member(source: _Source) -> tuple[bytes, object] | None:
    """(header block of the next record, how to get (content) and move on)."""
    start = source.peek(24)
    if not start:
        return None
    if start[:2] != b"\x1f\x8b":  # not compressed
        n = 4096
        while (cut := source.peek(n).find(b"\r\n\r\n")) < 0:
            if len(source.peek(n)) < n:
                if source.peek(n).strip(b"\r\n"):
                    raise ValueError("cut WARC header")
                return None
            n *= 2
        lead = len(source.peek(n)) - len(source.peek(n).lstrip(b"\r\n"))
        head = source.peek(cut)[lead:]
        length = int(_fields(head).get("content-length", 0))

        def plain(wanted: bool) -> bytes:
            body = source.peek(cut + 4 + length)[cut + 4 :] if wanted else b""
            source.skip(cut + 4 + length + 4)
            return body

        return head, plain
    known = struct.unpack("<I", start[16:20])[0] if start[3] & 4 and start[12:14] == b"sl" else None
    inflate, data, used = zlib.decompressobj(31), b"", 0

    def more() -> bool:
        nonlocal data, used
        piece = source.peek(used + READ_BYTES if known is None else min(known, used + READ_BYTES))[used:]
        if not piece or inflate.eof:
            return False
        data += inflate.decompress(piece)
        used += len(piece) - len(inflate.unused_data)
        return True

    # a short inflate is enough for the headers
    piece = source.peek(1024 if known is None else min(known, 1024))
    data = inflate.decompress(piece)
    used = len(piece) - len(inflate.unused_data)
    while (cut := data.find(b"\r\n\r\n")) < 0 and more():
        pass
    if cut < 0:
        raise ValueError("cut WARC header")
    head = data[:cut]
    length = int(_fields(head).get("content-length", 0))

    def packed(wanted: bool) -> bytes:
        nonlocal data
        if wanted or known is None:
            parts, data_size = [data], len(data)
            while not inflate.eof:
                data = b""
                if not more():
                    break
                parts.append(data)
                data_size += len(data)
            body = b"".join(parts)[cut + 4 : cut + 4 + length]
        else:
            body = b""
        source.skip(known if known is not None else used)
        return body

    return head, packed


def _accepts(fields: dict[str, str], tests: list[tuple[str, str, object]]) -> bool:
    for name, kind, value in tests:
        have = _value(fields, name)
        if have is None:
            return False
        ok = have == value if kind == "eq" else have in value if kind == "in" else have.startswith(value) if kind == "starts" else have.endswith(value) if kind == "ends" else value in have
        if not ok:
            return False
    return True


def _value(fields: dict[str, str], column: str) -> str | None:
    value = fields.get(HEADER_COLUMNS[column])
    if value is not None and column in ("record_id", "refers_to"):
        return value.strip("<>")
    if value is not None and column == "payload_digest":
        return value.removeprefix("sha1:")
    return value


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.want_payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        kinds = {EqualTo: "eq", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}
        for f in filters:
            kind = kinds.get(type(f))
            if kind and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS and f.value is not None:
                self.tests.append((f.attribute[0], kind, f.value))
            else:
                yield f

    def partitions(self):
        return [WarcRange(path, s, e) for path, splits in self.files for s, e in zip(splits, [*splits[1:], None])]

    def read(self, part: WarcRange):
        store, path = filesystem(part.path)
        rows, held = [], 0
        with store.open_input_file(path) as handle:
            source = _Source(handle, part.start)
            while (part.end is None or source.base < part.end) and (found := _member(source)):
                head, content = found
                fields = _fields(head)
                if not _accepts(fields, self.tests):
                    content(False)
                    continue
                kind, length = fields.get("warc-type"), int(fields.get("content-length", 0))
                over_http = "application/http" in fields.get("content-type", "") or kind == "revisit"
                block = content(self.want_payload or over_http and kind == "revisit")
                payload, http_length = None, None
                if block and over_http:
                    http, _, payload = block.partition(b"\r\n\r\n")
                    http_length = _fields(http).get("content-length")
                    http_length = int(http_length) if http_length and http_length.isdigit() else None
                elif self.want_payload:
                    payload = block
                if kind == "revisit" or not self.want_payload:
                    payload = None
                digest = _value(fields, "payload_digest")
                if payload is not None and fields.get("warc-payload-digest", "").startswith("sha1:") and payload_digest(payload) != digest:
                    raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't match its digest")
                rows.append((*(_value(fields, c) for c in HEADER_COLUMNS), list(fields.items()), length, http_length, payload))
                held += length
                if held >= 4 << 20 or len(rows) >= 2000:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.int64(), pa.binary()]
    names = [*HEADER_COLUMNS, "headers", "content_length", "http_length", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, files: list[tuple[str, list[int]]], payload: bool = True) -> DataFrame:
    """Records of archive files, given as (path, starts of byte ranges)."""
    if not files:
        return spark.createDataFrame([], SCHEMA)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("quern_warc").option("files", json.dumps(files)).option("payload", str(payload).lower()).load()


def manifest_files(manifest: DataFrame, path: str) -> list[tuple[str, list[int]]]:
    """One entry for each archive file of 256 MB: a list that grows by files, not by rows."""
    return [(f"{path}/{r.file}", list(r.splits)) for r in manifest.select("file", "splits").collect()]
