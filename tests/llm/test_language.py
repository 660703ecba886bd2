import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import language as lang
from quern.llm import op10

SF = "/root/testdata/sf0.001"
WORDS = {"aa": "alpha beta gamma delta", "bb": "zyx wvu tsr qpo"}


def _model(spark):
    docs = [(i, f"{WORDS[k.lower()]} {i} " * 5, k) for i, k in enumerate(["aa", "bb", "AA"] * 20)] + [(90, None, "aa"), (91, "", "bb"), (92, "noise", None), (93, "noise", "")]
    return lang.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))


def _page(text, declared=None):
    return f'<html{f" LANG={declared}-XX" if declared else ""}><head><style>zyx</style><script>alpha()</script></head><!-- zyx --><p>{text}</p>'


def test_extraction():
    assert lang.visible_text(_page("a &amp; b")).split() == ["a", "&", "b"]
    assert lang.declared_language('<html class="x" lang=\'EN-us\'>') == "en" and lang.declared_language("<p lang=en>") is None
    assert len(lang.grams("")) == 0 and len(lang.grams("12 !!")) == 0 and len(lang.grams("aB")) == 2
    assert (lang.grams("Été") == lang.grams("été")).all()


_PATTERN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "<!--", "-->", "<script", "<STYLE>", "</script >", "</style>", "</Script", "a", " ", "<p>", "scripty", "--", "!"]), max_size=25))
def test_scanner_equals_the_pattern(parts):
    markup = "".join(parts)
    assert lang.without_markup(markup) == _PATTERN.sub(" ", markup)


def test_bad_markup_takes_time_in_proportion():
    for part in ("<script>", "<!--", "<", "<html", "<html lang=", "<style></script>"):
        began = time.perf_counter()
        lang.visible_text(part * 100_000)
        lang.declared_language(part * 100_000 + " " * 100_000)
        assert time.perf_counter() - began < 5, part


def test_any_column_names(spark):
    df = spark.createDataFrame([(1, "http://a.b/", WORDS["aa"], 2, 3, 4)], "page int, url string, html string, _text int, c_host int, `a.b` int")
    got = lang.identify(df, _model(spark))
    assert got.columns == ["page", "url", "_text", "c_host", "a.b", *lang.RESULTS] and got.first().language == "aa"


def test_training_counts(spark):
    model = _model(spark)
    assert model.languages == ["aa", "bb"] and np.allclose(np.exp(model.log_p).sum(axis=0), 1)
    assert model.posterior(WORDS["aa"])[0] > 0.9 and model.posterior(WORDS["bb"])[1] > 0.9
    assert lang.train(spark.createDataFrame([], "doc_id long, text string, lang string")).languages == []


def test_fusion_against_brute_force(spark):
    model = _model(spark)
    pages = [(i, f"http://h{i % 3}.site.{'aa' if i % 2 else 'zz'}/x", _page(WORDS["aa"] if i % 3 else WORDS["bb"], "aa" if i % 4 else None)) for i in range(24)]
    pages += [(30, None, None), (31, "no address", ""), (32, "http://h0.site.zz/?", _page("1 2 3", "bb")), (33, "http://new.other.aa", _page("")), (33, "http://new.other.aa", _page("")), (34, "http://h1.site.aa/", _page(WORDS["aa"] * 20_000, "xx"))]
    df = spark.createDataFrame([(i, u, h, "old", "x") for i, u, h in pages], "page_id long, url string, html string, language string, extra string")
    got = sorted(lang.identify(df, model).collect(), key=lambda r: r.page_id)
    assert set(got[0].asDict()) == {"page_id", "url", "extra", *lang.RESULTS}

    text = [model.posterior(lang.visible_text(h or "")) for _, _, h in pages]
    host = [(u.split("://")[1].split("/")[0].split("?")[0] if u and "://" in u else "") for _, u, _ in pages]
    said = [lang.declared_language(h or "") for _, _, h in pages]
    kind = [("" if d is None else d if d in model.languages else "?") for d in said]
    level = lambda k: [".".join(x.split(".")[-k:]) for x in host]
    expected = []
    for i, own in enumerate(text):
        prior = (sum(text) + 1) / (len(text) + 2)
        for names in (level(1), level(2), host):
            c = np.maximum(sum(t for t, n in zip(text, names) if n == names[i]) - own, 0)
            prior = (c + lang.SMOOTHING * prior) / (c.sum() + lang.SMOOTHING)
        c = sum((t for t, k in zip(text, kind) if k == kind[i]), np.zeros(2))
        likely = np.array([(c[k] + (lang.SMOOTHING if kind[i] == n else 1)) / (sum(text)[k] + lang.SMOOTHING + 3) for k, n in enumerate(model.languages)])
        joint = own * prior * likely
        expected.append((pages[i][0], host[i], said[i], model.languages[int(joint.argmax())], round(joint.max() / joint.sum(), 4)))
    assert [(r.page_id, r.host, r.declared, r.language, round(r.posterior, 4)) for r in got] == sorted(expected, key=lambda e: e[0])


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert lang.identify(none, _model(spark)).count() == 0
    bare = lang.LanguageModel([], np.zeros((lang.GRAMS, 0)))
    rows = lang.identify(spark.createDataFrame([(1, "http://a.b/", "<p>x")], none.schema), bare).collect()
    assert [(r.language, r.posterior, r.host) for r in rows] == [(None, 0.0, "a.b")]


def test_accuracy_on_pages(spark):
    rows = op10.op10_language(spark, SF).collect()
    truth = {r.page_id: r.url.split("://")[1].split("/")[1] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(truth) and sum(truth[r.page_id] == r.language for r in rows) >= 0.95 * len(rows)
