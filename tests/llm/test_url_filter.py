import pytest

from quern.llm import url_filter as uf
from quern.llm.op6 import LISTED, LISTED_WORDS, RULES, op6_url_filter

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _judge(url, rules=RULES, listed=LISTED):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end].translate(LOWER), rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        _, rule, verdict = max(fit)
        return host, path, rule, verdict
    key = (host[4:] if host.startswith("www.") else host) + path.rstrip("/")
    return host, path, None, "block" if host and key in listed else "allow"


URLS = ["http://a.example.org/en/1x?q=/es/", "HTTP://Example.ORG/es/", "http://example.org/es", "https://notexample.org/en/1", "ftp://org/x", "x://org", "http://b.com/fr/#f", "http://c.com/de/1", "http://com/de/", "http://spam.example.net/index.html", "https://www.spam.example.net/index.html/?x#y", "http://spam.example.net/index.htm", "http://ÄB.example.org/en/12", "://", "http://", "no scheme", "", None, "http://x.org:80/es/", "http://u@d.org/x", "http://a://b.com/de/", "http://mirror.example.net/en/copy", "http://e.com?/de/", "http://e.com/de/" + "x" * 100_000, "http://.org/", "http://a..org/"]


def test_brute_force(spark):
    rows = [(i, u, "old", 1) for i, u in enumerate(URLS)] + [(0, URLS[0], "old", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, HOST int")
    rules = spark.createDataFrame([*RULES, RULES[0], (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([(u, "block") for u in [*LISTED, LISTED[0], None]], "url_key string, verdict string")
    got = uf.url_filter(pages, rules, listed).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in [x for x in got if x.rule]) == sorted((i, *_judge(u)) for i, u, *_ in rows if _judge(u)[2])
    assert sorted((r.page_id, r.host, r.path, r.verdict) for r in got) == sorted((i, *_judge(u)[:2], _judge(u)[3]) for i, u, *_ in rows)


def test_bloom_filter_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    n = 3000 * uf.BITS_PER_KEY // 256 + 1
    blocks = uf.bloom_blocks(keys, n)
    assert uf.may_contain(keys, blocks, n).count() == 3000
    assert uf.may_contain(spark.range(20_000).selectExpr("concat('x', id) AS key"), blocks, n).count() < 200


def test_false_positives_leave_no_trace(spark, monkeypatch):
    monkeypatch.setattr(uf, "may_contain", lambda candidates, *_: candidates)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert sorted((r.page_id, r.verdict) for r in uf.url_filter(pages, rules).collect()) == sorted((i, _judge(u, listed=())[3]) for i, u in enumerate(URLS))


@pytest.mark.parametrize("case", ["rules", "pages", "both"])
def test_empty(spark, case):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").where("page_id >= 0" if case == "rules" else "false")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string").where("true" if case == "pages" else "false")
    rows = uf.url_filter(pages, rules).collect()
    assert all(r.verdict == "allow" and r.rule is None for r in rows) and len(rows) == (len(URLS) if case == "rules" else 0)


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    keys = {r.page_id: _judge(r.url)[:2] for r in pages}
    listed = {(h[4:] if h.startswith("www.") else h) + p.rstrip("/") for h, p in keys.values() if any(w in h for w in LISTED_WORDS)} | {*LISTED}
    truth = {r.page_id: _judge(r.url, listed=listed) for r in pages}
    assert any(v == "block" and rule is None for _, _, rule, v in truth.values())
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op6_url_filter(spark, SF).collect()} == truth


def test_any_column_names_and_a_filter_too_small(spark, monkeypatch):
    monkeypatch.setattr(uf, "MAX_BLOCKS", 1)
    pages = spark.createDataFrame([(i, u, 1, 2, 3, 4) for i, u in enumerate(URLS)], "page long, url string, best int, key int, Host int, `a.b` int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(u, "block") for u in LISTED], "url_key string, verdict string")
    got = uf.url_filter(pages, rules, listed)
    assert got.columns == ["page", "url", "best", "key", "a.b", "host", "path", "rule", "verdict"]
    assert sorted((r.page, r.verdict) for r in got.collect()) == sorted((i, _judge(u)[3]) for i, u in enumerate(URLS))
