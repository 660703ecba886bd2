from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import mixing, op5

SF = "/root/testdata/sf0.01"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8))
def test_period_stays_within_one_block(shares):
    slots, total = mixing.period(shares), sum(shares)
    assert sorted(x for s in slots for x in s) == list(range(total))
    for k, own in zip(shares, slots):
        assert len(own) == k
        for i, t in enumerate(own):
            assert i * total // k <= t < -(-(i + 1) * total // k)
        for t in range(total + 1):
            assert abs(sum(x < t for x in own) - Fraction(t * k, total)) < 1


def _simulate(blocks, shares):
    """The same schedule slot by slot, without periods in closed form."""
    done, order = [0] * len(blocks), []
    while active := [s for s in range(len(blocks)) if done[s] < blocks[s]]:
        total, had, t = sum(shares[s] for s in active), Counter(), 0
        while all(done[s] < blocks[s] for s in active):
            ready = [(-(-(had[s] + 1) * total // shares[s]), s) for s in active if had[s] * total // shares[s] <= t]
            s = min(ready)[1]
            order.append((s, done[s]))
            done[s] += 1
            had[s] += 1
            t += 1
    return order


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 7)), max_size=5))
def test_phases_equal_simulation(sources):
    blocks, shares = [b for b, _ in sources], [k for _, k in sources]
    got = {}
    for s, first, end, at, length, slots in mixing.phases(blocks, shares):
        for i in range(first, end):
            got[at + (i - first) // len(slots) * length + slots[(i - first) % len(slots)]] = (s, i)
    assert [got[t] for t in sorted(got)] == _simulate(blocks, shares) and sorted(got) == list(range(sum(blocks)))


def _check(docs, rows, weights, size):
    """Every row once, blocks full, each slot one source, and less than a block of deviation while all sources have blocks."""
    assert Counter(d for d, _ in docs) == Counter(r.doc_id for r in rows)
    by_slot = defaultdict(list)
    for r in rows:
        by_slot[r.slot].append(r)
    assert sorted(by_slot) == list(range(len(by_slot)))
    left, had = Counter(), Counter()
    for _, s in docs:
        left[s] += 1
    left = {s: -(-n // size) for s, n in left.items()}
    total = sum(weights.values())
    bound = True
    for t in range(len(by_slot)):
        (source,) = {r.source for r in by_slot[t]}
        assert {r.block for r in by_slot[t]} == {had[source]}
        had[source] += 1
        if bound:
            assert all(abs(had[s] - Fraction((t + 1) * weights[s], total)) < 1 for s in weights)
        bound &= had[source] < left[source]
        if had[source] < left[source]:
            assert len(by_slot[t]) == size
    assert len({r.position for r in rows}) == len(rows) and all(r.position // size == r.slot for r in rows)


def test_query(spark):
    docs = [(r.doc_id, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sizes = Counter(s for _, s in docs)
    _check(docs, op5.op5_mixing(spark, SF).collect(), mixing.whole_weights({s: n**0.5 for s, n in sizes.items()}), op5.BLOCK_ROWS)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    docs = [(i, "hot") for i in range(400)] + [(i, "b") for i in range(400, 450)] + [(None, None)] * 3 + [(7, "b"), (7, "b")] + [(900 + i, None) for i in range(20)]
    df = spark.createDataFrame([(d, s, 1) for d, s in docs], "doc_id long, source string, slot int")
    weights = {"hot": 3, "b": 2, None: 1, "absent": 4}
    whole = mixing.whole_weights(weights)
    got = mixing.mix(df, weights, block_rows=4)
    assert got.columns == ["doc_id", "source", "block", "slot", "position"]
    _check(docs, got.collect(), {s: whole[s] for s in ("hot", "b", None)}, 4)
    order = [x for part in mixing.mix(df.where("doc_id is not null and doc_id <> 7"), weights, block_rows=4).sortWithinPartitions("position").rdd.glom().collect() for x in [[r.position for r in part]]]
    assert sum(map(bool, order)) > 2 and [x for part in order for x in part] == sorted(x for part in order for x in part)  # partitions follow each other
    assert mixing.mix(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(i, "ab"[i % 2], 1, 2, 3) for i in range(50)], "doc_id long, source string, part int, n int, `a.b` int")
    assert mixing.mix(odd, block_rows=4).columns == [*odd.columns, "block", "slot", "position"] and mixing.mix(odd).count() == 50
    with pytest.raises(ValueError):
        mixing.mix(df, {"hot": 0})
