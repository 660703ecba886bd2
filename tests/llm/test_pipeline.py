import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as p
from quern.llm import decontamination, simhash
from quern.llm.op3 import tokenizer_path

SF = "/root/testdata/sf0.001"


def _shingles(text):
    return frozenset(simhash.shingle_hashes(simhash.words_of(text.encode()), 5).tolist())


def test_stages_on_real_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in p.STAGES[:-1]:
        tables.append(p.materialize(stage(spark, tables[-1], SF), "t"))
        assert tables[-1].columns == docs.columns, name
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(rows[0]) - set(rows[1])
    assert np.mean([label[d] == 0 for d in gone if d in label] or [1]) > 0.7
    sets = {d: _shingles(r.text) for d, r in rows[1].items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert set(rows[2]) == {d for d in order if find(d) == d}
    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {w for _, t in items for w in decontamination.windows_of(decontamination.words_of(t), 10)}
    short = {n for n in map(len, windows) if n < 10}

    def leaks(text):
        w = decontamination.words_of(text.encode())
        return any(tuple(w[i : i + n]) in windows for n in (10, *short) for i in range(len(w) - n + 1))

    assert set(rows[3]) == {d for d, r in rows[2].items() if not leaks(r.text)}
    assert set(rows[4]) == set(rows[3])
    mixture = p.mix(tables[3], block_rows=p.BLOCK_ROWS).orderBy("position").collect()
    library = Tokenizer.from_file(tokenizer_path())
    got = sorted(p.token_ids(spark, tables[4], SF).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in mixture]
    assert [r.n_tokens for r in got] == [len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixture]


def test_planted_copies_and_leaks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rng = random.Random(4)
    base = next(r for r in docs if 1500 < r.n_chars < 4000 and r.lang == "en")
    words = base.text.split(" ")
    near = list(words)
    near[rng.randrange(len(near))] = "replaced"
    planted = [(900, base.text), (901, " ".join(near)), (902, base.text.upper()), (903, "intro words " + item)]
    df = spark.createDataFrame([tuple(r) for r in docs] + [(i, t, "en", "src0", len(t)) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in p.keep_one_of_near_copies(spark, df, SF).collect()}
    assert not kept & {900, 901, 902}
    assert 903 not in {r.doc_id for r in p.drop_leaks(spark, df, SF).collect()}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0
