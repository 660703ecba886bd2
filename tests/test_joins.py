"""Compatibility joins with unbound variables on either side against a naive join."""

import random
from collections import Counter

import pytest

from quern.operators.joins import join, marked
from quern.plans.relation import Relation, VarType


def relation(spark, rng, names, nullable, n=7):
    rows = [tuple(None if x in nullable and rng.random() < 0.4 else rng.choice("ab") for x in names) for _ in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"v_{x} string" for x in names))
    return Relation(df, {x: VarType("string", nullable=x in nullable) for x in names}), [dict(zip(names, r)) for r in rows]


def bound(row):
    return tuple(sorted((k, v) for k, v in row.items() if v is not None))


def compatible(a, b, overlap=False):
    shared = [k for k in a if k in b and None not in (a[k], b[k])]
    return all(a[k] == b[k] for k in shared) and (bool(shared) or not overlap)


def naive(left, right, how, overlap):
    for a in left:
        met = [b for b in right if compatible(a, b, overlap)]
        if how in ("inner", "left"):
            yield from [dict(bound(a) + bound(b)) for b in met] or ([a] if how == "left" else [])
        elif bool(met) == (how == "left_semi"):
            yield a


@pytest.mark.parametrize(
    ("left", "loose", "right", "opened"),
    [("xy", "y", "xyz", "xy"), ("xw", "x", "xz", "x"), ("x", "", "xz", ""), ("abcdef", "abcde", "abcdeg", "bc")],
)
def test_joins_equal_a_naive_join(spark, left, loose, right, opened):
    rng = random.Random(5)
    (a, rows), (b, others) = relation(spark, rng, left, loose), relation(spark, rng, right, opened)
    for how, overlap in (("inner", False), ("left_anti", False), *((("left", False), ("left_semi", False), ("left_anti", True)) if len(left) < 5 else ())):
        out = join(a, b, how, overlap=overlap)
        got = Counter(bound({n: r[f"v_{n}"] for n in out.vars}) for r in out.df.collect())
        assert got == Counter(map(bound, naive(rows, others, how, overlap))), how
        assert {n for n in out.vars for r in got if n not in dict(r)} <= {n for n, v in out.vars.items() if v.nullable}
    if len(left) < 5:
        out = marked(a, b, "_exists0")
        got = Counter((bound({n: r[f"v_{n}"] for n in out.vars}), r["_exists0"]) for r in out.df.collect())
        assert got == Counter((bound(x), any(compatible(x, y) for y in others)) for x in rows)
