import hashlib
import io
import tarfile
import zlib

from quern.llm import media, op2
from quern.llm.common import filesystem, shared_dir

SF = "/root/testdata/sf0.001"


def _decoded(data):
    """Header and samples by the PNG specification, filters included."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, chunks = 8, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        chunks.append((data[at + 4 : at + 8], data[at + 8 : at + 8 + n]))
        at += 12 + n
    kinds = [k for k, _ in chunks]
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND"
    head = chunks[0][1]
    width, height, depth, colour = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9]
    assert (depth, colour, head[10:]) == (8, 2, bytes(3))
    raw, size = zlib.decompress(b"".join(d for k, d in chunks if k == b"IDAT")), 3 * width
    lines = [raw[i * (size + 1) : (i + 1) * (size + 1)] for i in range(height)]
    assert all(line[0] == 0 for line in lines) and len(raw) == height * (size + 1)
    return width, height, b"".join(line[1:] for line in lines)


def test_query_round_trip(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op2.op2_media(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        p = docs[r.doc_id]
        p += b" " * (-len(p) % 192 if p else 192)
        stored = media.to_png(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        width, height, samples = _decoded(stored)
        means = ",".join(f"{sum(p[c::3]) / len(p[c::3]):.2f}" for c in range(3))
        assert samples == p and r.feature == f"png {width}x{height} 3x8 mean {means}"
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_edges(spark, monkeypatch):
    rows = [(1, None), (2, ""), (2, ""), (None, "é" * 96), (3, "x" * 192), (4, "x" * 193), (5, "long " * 60_000), (5, "long " * 60_000)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, shard string").repartition(1)
    for limit in (1 << 30, 600):
        monkeypatch.setattr(media, "SHARD_BYTES", limit)
        path = shared_dir(spark, "media-test")
        table = media.write_media(df, path, "doc_id", "text")
        got = media.media_features(media.media_headers(media.one_place(table), path), path).collect()
        assert sorted((r.id or 0, r.n_bytes, r.payload_bytes) for r in got) == sorted((i or 0, len((t or "").encode()), len(media.padded((t or "").encode()))) for i, t in rows)
        heads = media.media_headers(table, path).collect()
        assert all((r.width, r.height, r.depth, r.channels) == (64, -(-max(r.n_bytes, 1) // 192), 8, 3) for r in heads) and len(heads) == len(rows)
        index = media.payload_index(table)
        assert index.count() == len({media.padded((t or "").encode()) for _, t in rows})
    path = shared_dir(spark, "media-test")
    monkeypatch.setattr(media, "SHARD_BYTES", 1 << 30)
    table = media.write_media(df, path, "doc_id", "text")
    (shard,) = {r.shard for r in table.collect()}
    store, root = filesystem(path)
    members = tarfile.open(fileobj=io.BytesIO(store.open_input_file(f"{root}/{shard}").read())).getmembers()
    assert len(members) == 5 and {(m.name[:-4], m.offset_data, m.size) for m in members} == {(r.digest, r.offset, r.length) for r in table.collect()}
    empty = media.write_media(df.limit(0), path, "doc_id", "text")
    assert media.media_features(media.media_headers(media.one_place(empty), path), path).count() == 0
