import random

import numpy as np
import xxhash

from quern.llm import op4, simhash
from quern.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def _brute_print(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _brute_groups(rows, link):
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if link(rows[i][1], rows[j][1]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return [min((d for d in ids[find(i)] if d is not None), default=None) for i in range(len(rows))]


def _check(spark, rows, got):
    prints = [(d, _brute_print(t)) for d, t in rows]
    want = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, _brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= 2))), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    _check(spark, rows, op4.op4_simhash(spark, SF).collect())


def test_edges(spark):
    rows = [(3, None), (1, ""), (2, " \t\n"), (9, "A b"), (4, "a  B"), (4, "a  B"), (None, "a b"), (None, "zz"), (8, "x y " * 40_000), (7, "tie one two"), (6, "tie one two")]
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fingerprint string, fp int")
    _check(spark, rows, simhash.near_duplicate_groups(df).collect())
    assert simhash.near_duplicate_groups(df.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 8]


def test_all_pairs_within_two_bits_meet(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(6)} | set(base)
    df = spark.createDataFrame([(int(np.uint64(p).astype("i8")),) for p in prints], "fp0 long")
    keyed = simhash.variants(df, 1).select("key", "fp0").repartition("key").sortWithinPartitions("key")
    roots = {r.node: r.root for r in connected_components(keyed.mapInArrow(simhash._search_runs(2), "a bigint, b bigint"), "a", "b").collect()}
    signed = sorted(int(np.uint64(p).astype("i8")) for p in prints)
    want = _brute_groups([(s, s) for s in signed], lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert [roots.get(s, s) for s in signed] == want


def test_wide_runs_equal_narrow_ones(monkeypatch):
    rng = random.Random(2)
    for key, low in ((5 << 32, 0), (40 << 32, 32)):
        free = [key >> 32, *range(32 - low, 64 - low)]
        fps = np.array(sorted({sum(1 << b for b in free[:12] if rng.random() < 0.5) for _ in range(150)}), "<u8")

        def groups():
            links = simhash._forest(fps, 2, key)
            rows = [(int(f), int(f)) for f in fps]
            have = set(links) | {(b, a) for a, b in links}
            return _brute_groups(rows, lambda a, b: (a, b) in have)

        narrow = groups()
        monkeypatch.setattr(simhash, "WIDE_RUN", 3)
        assert groups() == narrow
        monkeypatch.undo()


def _jaccard(a, b):
    x, y = (set(simhash.shingle_hashes(simhash.words_of(t.encode()), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_duplicates_of_similarity_from_0_8_go_and_others_stay(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    rows, planted, low = [], [], []
    for i in range(300):
        text = [word() for _ in range(rng.randint(80, 400))]
        rows.append((2 * i, " ".join(text)))
        edited = list(text)
        for p in rng.sample(range(len(text)), max(1, int(len(text) * rng.choice([0.004, 0.01, 0.015, 0.06, 0.1])))):
            edited[p] = word()
        rows.append((2 * i + 1, " ".join(edited)))
        j = _jaccard(rows[-1][1], rows[-2][1])
        (planted if j >= 0.85 else low if j < 0.8 else []).append(2 * i + 1)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(planted) > 80 and len(low) > 60
    assert sum(p in kept for p in planted) <= 0.02 * len(planted)
    assert all(p in kept for p in low) and all(2 * i in kept for i in range(300))


def _kept_by_brute_force(rows, similarity=0.8):
    sets = [(d, frozenset(simhash.shingle_hashes(simhash.words_of(t.encode()), 5).tolist())) for d, t in rows]
    return set(_brute_groups(sets, lambda a, b: len(a & b) >= similarity * len(a | b)))


def _kept(spark, rows):
    return {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_block_tail_and_short_edits_from_0_8_go(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    rows, near = [], 0
    for i in range(240):
        n = rng.choice([5, 8, 12, 20, 30, 60, 200, 900])
        text = [word() for _ in range(n)]
        edit = max(1, int(n * rng.choice([0.05, 0.1, 0.15, 0.18])))
        at = rng.randrange(n - edit + 1)
        other = [text + [word() for _ in range(edit)], text[:-edit], text[:at] + [word() for _ in range(edit)] + text[at + edit :], text[:at] + text[at + edit :]][i % 4]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
        near += 0.8 <= _jaccard(rows[-1][1], rows[-2][1]) < 1
    assert near > 80
    assert _kept(spark, rows) == _kept_by_brute_force(rows)


def test_texts_of_equal_word_sets_do_not_hide_others(spark):
    rng = random.Random(9)
    rows = []
    for g in range(5):
        words = [f"{rng.choice('abcdefgh')}{g}{i}" for i in range(120)]
        for changed in (False, True):
            for k in range(6):  # one sentence moved to six places
                text = words[:10] + words[20 : 20 + 15 * k] + words[10:20] + words[20 + 15 * k :]
                rows.append((len(rows), " ".join("other" if changed and w == words[5] else w for w in text)))
    assert _kept(spark, rows) == _kept_by_brute_force(rows) == {0, 12, 24, 36, 48}


def test_wide_runs_of_texts_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BETWEEN_ROWS", 16)  # runs here are wider than WIDE_KEY
    monkeypatch.setattr(simhash, "FIRST_PAIRS", 1)
    rng = random.Random(10)
    rows = []
    for g in range(3):
        words = [f"w{g}x{i}" for i in range(100)]
        for _ in range(70):  # some of these are similar only to few others
            text = list(words)
            for _ in range(rng.choice([1, 1, 2, 2, 3])):
                at, n = rng.randrange(90), rng.randint(1, 3)
                text[at : at + n] = [f"w{g}y{rng.randrange(9)}" for _ in range(n)]
            rows.append((len(rows), " ".join(text)))
    want = _kept_by_brute_force(rows)
    assert 3 < len(want) < 150
    assert _kept(spark, rows) == want


def test_equal_shingle_sets_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, 1, "a"), (1, text + " " + text + " " + text, 2, "b"), (2, "unlike the others in every word", 3, "c"), (None, text, 4, "d")]
    df = spark.createDataFrame(rows, "row long, doc string, digest int, _Root string")
    out = simhash.drop_near_duplicates(df, id_col="row", text_col="doc")
    assert out.columns == df.columns
    assert {tuple(r) for r in out.collect()} == {rows[1], rows[2]}


def test_parity_distances_bound_the_difference():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype="u8")) for n in (0, 1, 15, 16, 17, 100, 900, 5000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 2**64, len(s) // 5, dtype="u8")])) for s in sets]
    pairs = [(a, b) for a in sets for b in sets]
    far = simhash.parity_distances([simhash.folded(a) for a, _ in pairs], [simhash.folded(b) for _, b in pairs])
    for (a, b), n in zip(pairs, far.tolist()):
        true = len(set(a.tolist()) ^ set(b.tolist()))
        assert n <= true and (true - n) % 2 == 0
        if 0.9 * len(a) < len(b) < 1.1 * len(a):
            assert n >= true / 2
