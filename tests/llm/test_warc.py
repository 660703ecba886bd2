import base64
import hashlib

from pyspark.sql import functions as F

from quern.llm import op8, warc
from quern.llm.common import filesystem, shared_dir

SF = "/root/testdata/sf0.001"


def _write(spark, rows, **options):
    path = shared_dir(spark, "warc-test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string, first int")
    return path, warc.manifest_files(warc.write_warc(df, path, "page_id", "url", "html", **options), path)


def test_query_matches_brute_force(spark):
    got = {r.page_id: r for r in op8.op8_warc(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html, p.page_id)
    assert len(got) == len(pages)
    for p in pages:
        body = p.html.encode()
        r = got[p.page_id]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[p.html] == p.page_id else ("revisit", first[p.html]))


def test_edges(spark):
    rows = [(3, "http://a/\r\nX: 1", "same", "x", 1), (1, None, "same", "x", 1), (2, "u", None, "x", 1), (5, "u", "", "x", 1), (1, None, "same", "x", 1), (None, "u", "same", "x", 1), (9, "u", "long" * 300_000 + "é", "x", 1)]
    _, files = _write(spark, rows)
    got = warc.read_warc(spark, files).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.warc_type, (r.record_id or "").removeprefix(warc.RECORD_PREFIX) if r.record_id.startswith(warc.RECORD_PREFIX) else "?", (r.refers_to or "").removeprefix(warc.RECORD_PREFIX)) for r in got)
    assert kinds == sorted([("response", "1", ""), ("response", "1", ""), ("revisit", "3", "1"), ("revisit", "?", "1"), ("response", "2", ""), ("revisit", "5", "2"), ("response", "9", "")])
    assert next(r for r in got if r.record_id.endswith(":9")).payload.decode() == "long" * 300_000 + "é"
    assert next(r for r in got if r.record_id.endswith(":3")).target_uri == "http://a/%0D%0AX: 1"
    _, files = _write(spark, rows, min_revisit_bytes=5)
    assert warc.read_warc(spark, files).where("warc_type = 'revisit'").count() == 0
    _, files = _write(spark, [])
    assert warc.read_warc(spark, files).count() == 0


def test_pushdown_and_foreign_archives(spark):
    path, files = _write(spark, [(i, f"http://h/{i}", f"body {i} " * i, "", 0) for i in range(50)])
    frame = warc.read_warc(spark, files, payload=False).where((F.col("warc_type") == "response") & F.col("target_uri").startswith("http://h/4"))
    assert {r.target_uri for r in frame.collect()} == {f"http://h/{i}" for i in [4, *range(40, 50)]}
    assert frame.where("payload is not null").count() == 0
    store, root = filesystem(path)
    import gzip

    plain = b"".join(warc.record_bytes(i, "u", b"p" * i) for i in range(5))
    for name, data in (("a.warc", plain), ("b.warc.gz", b"".join(gzip.compress(warc.record_bytes(i, "u", b"p" * i)) for i in range(5)))):
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(data)
        for payload in (True, False):
            got = warc.read_warc(spark, [(f"{path}/{name}", [0])], payload).orderBy("record_id").collect()
            assert [r.payload for r in got] == [b"p" * i if payload else None for i in range(5)], name


def test_byte_ranges_cover_each_record_once(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 500)
    data, splits = b"", [0]
    for i in range(40):
        data += warc.gzip_member(warc.record_bytes(i, "u", str(i).encode() * 100), 1)
        if len(data) - splits[-1] >= 500:
            splits.append(len(data))
    path = shared_dir(spark, "warc-test")
    store, root = filesystem(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/x.warc.gz", compression=None) as out:
        out.write(data)
    assert len(splits) > 5
    assert warc.read_warc(spark, [(f"{path}/x.warc.gz", splits)]).select("record_id").distinct().count() == 40
