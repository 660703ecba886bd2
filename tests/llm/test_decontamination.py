import hashlib

import pytest

from quern.llm import decontamination as d

ITEM = "one two three four five six seven eight nine ten eleven twelve"


def _brute(docs, items, window=10):
    out = {}
    for doc, text in docs:
        w = d.words_of((text or "").encode())
        hit, ids = set(), set()
        for item, it in items:
            for win in d.windows_of(d.words_of((it or "").encode()), window):
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit.update(range(s, s + len(win)))
                        ids.update([] if item is None else [str(item)])
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_BYTES", block)
    items = [(1, ITEM), (2, "short item"), (10, ITEM + " thirteen"), (3, ""), (4, None), (2, "short item"), (None, "zzz"), (5, "the the the the the the the the the the the"), (6, "Été-grüß x1")]
    docs = [(0, None), (1, ""), (2, "intro " + ITEM.upper() + " outro"), (3, "one two three four five six seven eight nine"), (4, "a short, item? short item short"), (5, "the " * 25), (6, ITEM.replace(" ", "\n--") + " " + ITEM), (7, "x été grüß X1 y"), (8, "... !!!"), (9, "zzz"), (10, "word " * 30_000 + ITEM)]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, items string, n_hit int")
    got = d.contamination_report(df, spark.createDataFrame(items, "item_id long, text string"))
    rows = {r.doc_id: tuple(r[c] for c in d.RESULTS) for r in got.collect()}
    assert rows == _brute(docs, items)
    assert rows[6][1] == 24 and rows[5][1] == 25 and rows[9][1:3] == (1, 0)
    assert got.columns == ["doc_id", "text", "items", *d.RESULTS]  # a column of that name is kept


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert [r.contaminated for r in d.contamination_report(docs, none).collect()] == [False, False]
    assert d.contamination_report(docs.limit(0), none).count() == 0
