import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import op3
from quern.llm.token_ids import PlaneEncoder, PlaneFile, PlaneWriter, from_planes, to_planes, token_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    path = op3.tokenizer_path()
    return PlaneEncoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)


ODD = ["", " ", "  a", "a  b", "a \n b", "\n\na b ", "a b\t", "don't we'll it's", "x<|endoftext|>y z", "日本 語 テキスト", "a b c  d", "é è ß", "1 22 333a b1", "😀 😀😀 a", "a\x1c b \x1f", "a\x00b c", "word.\nNext word", "Ä" * 2000 + " b", "'s 't", "  ", "﻿ a ´a ` b"]


def test_encoder_equals_library(both):
    mine, library = both
    for texts in (ODD, ODD[::-1], [" ".join(ODD)]):
        for t, raw in zip(texts, mine.encode(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


ALPHABET = "aaabbb    ..,,'" + "\u65e5\U0001f600\u3000\x00\x0b\x1c\x85" + "".join(map(chr, [9, 10, 13, *range(32, 127), *range(161, 592)]))  # all that the fast path takes, and more


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab.,' \n\té日 1😀"), max_size=30), max_size=5))
def test_encoder_equals_library_on_any_text(texts):
    path = op3.tokenizer_path()
    global _BOTH
    try:
        mine, library = _BOTH
    except NameError:
        _BOTH = mine, library = PlaneEncoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    for t, raw in zip(texts, mine.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**32, n, dtype="u4")
        assert (from_planes(to_planes(ids, bits), n) == ids).all()
    docs = [rng.integers(0, 60_000, n, dtype="u4") for n in (0, 5, 100, 1, 250, 0)]
    out = io.BytesIO()
    w = PlaneWriter(out, bits, block_ids=64)
    for d in docs:
        w.add(d.tobytes())
    w.close(pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([len(d) for d in docs])], ["key", "n"]))
    f = PlaneFile(out, len(out.getvalue()))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(docs, f.documents(), strict=True))
    whole = np.concatenate(docs)
    assert (f.ids(60, 130) == whole[60:190]).all() and len(f.ids(3, 0)) == 0


def _expected(rows, library):
    out, before = [], 0
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((key, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    return out


def test_query(spark, both):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(map(tuple, op3.op3_token_planes(spark, SF).collect())) == _expected(rows, both[1])


def test_edges(spark, both):
    rows = [(5, None, 1), (None, "null key", 1), (2, "b", 1), (2, "a", 1), (2, "a", 1), (7, "", 1), (-1, "x y " * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long")
    by = sorted(((k, t) for k, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    for bits in (False, True):
        got = token_table(df, op3.tokenizer_path(), "doc_id", "text", 2, bits).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == _expected(by, both[1])
    assert token_table(df.limit(0), op3.tokenizer_path(), "doc_id", "text", 2).count() == 0


def test_in_place_keeps_the_order_of_files(spark, both, tmp_path):
    rows = [((i * 7) % 100, f"text {i} " * (i % 5)) for i in range(100)]
    for number, part in ((100_000, rows[60:]), (9, rows[:25]), (99_999, rows[25:60])):  # by number, not by name
        df = spark.createDataFrame(part, "doc_id long, text string").coalesce(1)
        df.write.option("parquet.block.size", 256).parquet(str(tmp_path / f"x{number}"))
        (made,) = (tmp_path / f"x{number}").glob("part-*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        made.rename(tmp_path / "all" / f"part-{number:05d}-c000.parquet")
    docs = spark.read.parquet(str(tmp_path / "all"))
    got = token_table(docs, op3.tokenizer_path(), "doc_id", "text", 2, in_place=True).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == _expected(rows, both[1])
