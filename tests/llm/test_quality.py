import zlib

import numpy as np
import xxhash
import zstandard

from quern.llm import op7, quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = op7.op7_quality(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in label]
    good, bad = ([r for r in test if label[r.doc_id] == y] for y in (1, 0))
    assert np.mean([r.predicted == 1 for r in good]) > 0.97 and np.mean([r.predicted == 0 for r in bad]) > 0.85


def test_scores_equal_a_plain_loop(spark):
    rows = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    key = lambda i: int.from_bytes(xxhash.xxh64_digest(i.to_bytes(8, "little"), seed=42), "big", signed=True)
    order = {y: sorted((i for i in label if label[i] == y and zlib.crc32(str(i).encode()) % 3 != 1), key=key) for y in (0, 1)}
    packers = []
    for y in (1, 0):
        pieces = sorted(rows[i][k : k + 1024] for i in order[y][::2] for k in range(0, len(rows[i]), 1024))
        try:
            made = zstandard.ZstdCompressionDict(zstandard.train_dictionary(112_640, pieces).as_bytes())
        except zstandard.ZstdError:
            made = zstandard.ZstdCompressionDict(b"".join(pieces)[:112_640], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=3)
        packers.append(zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
    packers.append(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False))

    def differences(text):
        good, bad, plain = (sum(len(p.compress(text[k : k + 2048])) for k in range(0, len(text), 2048)) for p in packers)
        ratio = lambda x, y: (x - y) / max(x + y, 1)
        n = len(text)
        d = [ratio(bad, good), ratio(plain, good), ratio(plain, bad), ratio(n, good), ratio(n, bad), ratio(n, plain)]
        return [1.0, *d, *(d[i] * d[j] for i in range(6) for j in range(i, 6))]

    fitted = [(y, differences(rows[i])) for y in (0, 1) for i in order[y][1::2]]
    x, y = np.array([d for _, d in fitted]), np.array([y for y, _ in fitted], "f8")
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[0], scale[0] = 0, 1
    z, penalty = (x - mean) / scale, np.array([1e-6] + [quality.RIDGE] * 27)
    got = {r.doc_id: r.score for r in op7.op7_quality(spark, SF).collect()}
    apply = lambda w, d: 1 / (1 + np.exp(-np.clip((np.array(d) - mean) / scale @ w, -500, 500)))
    w = np.zeros(28)
    for _ in range(20_000):  # quasi-Newton with the bound p (1 - p) <= 1/4: slow and sure
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve(z.T @ z / 4 + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    assert max(abs(got[i] - float(apply(w, differences(t)))) for i, t in rows.items()) < 1e-6


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "a b", 9.0), (3, "x " * 60_000, 9.0), (3, "x " * 60_000, 9.0)], "doc_id long, text string, score double")
    for labels in ([], [(1, 1)], [(1, 1), (3, None)]):
        model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r.score for r in quality.score(docs, model).collect()} == {1.0 if any(y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1) else 0.5}
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    labelled = spark.createDataFrame([(i, f"good words {i} here" if i % 2 else f"b%%% a&&& {i}%%%") for i in ids], "doc_id long, text string")
    model = quality.train(labelled, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int"))
    assert model.dictionaries and quality._dictionary([b"ab"]) == (b"ab", False)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 5 and rows[3].score == rows[4].score and rows[0].score == rows[1].score and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.limit(0), model).count() == 0
