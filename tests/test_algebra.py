"""Patterns against a naive evaluator of the SPARQL algebra over Python dictionaries."""

import random
from collections import Counter

import pytest

from quern.session import Dataset
from quern.sources.quads import QuadSource, quads_of
from quern.sparql import ast as A
from quern.sparql.parser import parse

NODES, LINKS = "abcde", "pqr"


def data(rng):
    return sorted({(rng.choice(NODES), rng.choice(LINKS), rng.choice(NODES)) for _ in range(14)})


def compatible(x, y):
    return all(y.get(k, v) == v for k, v in x.items())


def joined(left, right):
    return [{**x, **y} for x in left for y in right if compatible(x, y)]


def solve(group, triples):
    out = [{}]
    for e in group.elements:
        if isinstance(e, A.Bgp):
            for t in e.triples:
                found = []
                for row in triples:
                    b = {}
                    if all((b.setdefault(x.name, v) == v) if isinstance(x, A.Var) else x.value == "http://e/" + v for x, v in zip((t.s, t.p, t.o), row)):
                        found.append(b)
                out = joined(out, found)
        elif isinstance(e, A.Group):
            out = joined(out, solve(e, triples))
        elif isinstance(e, A.Union):
            out = joined(out, [x for g in e.groups for x in solve(g, triples)])
        elif isinstance(e, A.Optional):
            right = solve(e.group, triples)
            out = [z for x in out for z in (joined([x], right) or [x])]
        elif isinstance(e, A.Minus):
            right = solve(e.group, triples)
            out = [x for x in out if not any(compatible(x, y) and set(x) & set(y) for y in right)]
        elif isinstance(e, A.Values):
            rows = [{v.name: x.value.rpartition("/")[2] for v, x in zip(e.vars, row) if x is not None} for row in e.rows]
            out = joined(out, rows)
        elif isinstance(e, A.Filter):  # [NOT] EXISTS alone
            right = solve(e.expr.group, triples)
            out = [x for x in out if any(compatible(x, y) for y in right) != e.expr.negated]
    return out


def pattern(rng, depth=0):
    var = lambda: "?" + rng.choice("xyz")
    triple = lambda: f"{var()} {rng.choice([':p', ':q', ':r', '?l'])} {rng.choice([var(), var(), ':a'])} ."
    parts = [triple() for _ in range(rng.randint(1, 2))]
    for _ in range(rng.randint(0, 2)) if depth < 2 else ():
        inner = pattern(rng, depth + 1)
        parts.append(rng.choice([f"OPTIONAL {{ {inner} }}", f"MINUS {{ {inner} }}", f"{{ {inner} }} UNION {{ {triple()} }}", f"{{ {inner} }}", f"FILTER EXISTS {{ {triple()} }}", f"FILTER NOT EXISTS {{ {triple()} }}", "VALUES (?x ?y) { (:a UNDEF) (UNDEF :b) (:c :d) }"]))
    parts.sort(key=lambda p: p.startswith("FILTER"))  # filters hold for the whole group
    return " ".join(parts)


@pytest.mark.parametrize("seed", range(14))
def test_random_patterns(spark, seed):
    rng = random.Random(seed)
    triples, text = data(rng), pattern(rng)
    quads = quads_of(spark, [A.Quad(*(A.Iri("http://e/" + x) for x in t)) for t in triples])
    query = parse(f"PREFIX : <http://e/> SELECT * {{ {text} }}")[0]
    names = sorted({v for v in A.variables(query.where)})
    got = Counter(tuple(r.asDict().get(n) for n in names) for r in Dataset(QuadSource(quads)).run(query).collect())
    short = lambda n, v: None if v is None else "http://e/" + v
    want = Counter(tuple(short(n, x.get(n)) for n in names) for x in solve(query.where, triples))
    assert got == want, text


def test_unbound_join_keys(spark):
    quads = quads_of(spark, [A.Quad(A.Iri("http://e/" + s), A.Iri("http://e/" + p), A.Iri("http://e/" + o)) for s, p, o in [("a", "p", "b"), ("c", "p", "d"), ("b", "q", "e"), ("f", "r", "e"), ("g", "r", "h")]])
    text = "PREFIX : <http://e/> SELECT ?x ?y ?z { ?x :p ?m OPTIONAL { ?m :q ?y } ?z :r ?y }"
    rows = lambda **o: sorted(tuple(v.rpartition("/")[2] for v in r) for r in Dataset(QuadSource(quads), **o).query(text).collect())
    assert rows() == [("a", "e", "f"), ("c", "e", "f"), ("c", "h", "g")]
    assert rows(parity=True) == [("a", "e", "f")]


def test_exists_sees_outer_variables_in_nested_expressions(spark):
    quads = quads_of(spark, [A.Quad(A.Iri(f"http://e/{s}"), A.Iri("http://e/v"), A.Lit(str(v), A.INTEGER)) for s, v in [("a", 1), ("b", 2), ("c", 3)]])
    d = Dataset(QuadSource(quads), prefixes={"": "http://e/"})
    one = lambda q: sorted(r.x.rpartition("/")[2] for r in d.query(q).collect())
    assert one("SELECT ?x { ?x :v ?n FILTER EXISTS { ?y :v ?m FILTER(?m > ?n) } }") == ["a", "b"]
    assert one("SELECT ?x { ?x :v ?n FILTER NOT EXISTS { ?y :v ?m FILTER(?m < ?n) } }") == ["a"]
    assert one("SELECT ?x { ?x :v ?n FILTER EXISTS { ?y :v ?m BIND(?n + 2 AS ?k) FILTER(?m = ?k) } }") == ["a"]
    assert one("SELECT ?x { ?x :v ?n FILTER(?n = 2 || NOT EXISTS { ?y :v ?m FILTER(?m > ?n) }) }") == ["b", "c"]


def test_exists_by_equal_expressions_is_a_hash_join(spark):
    """Equations between the two sides of EXISTS and OPTIONAL are keys; unbound and failing ones meet nothing."""
    d = Dataset(QuadSource(quads_of(spark, [])))
    inner = "VALUES (?k ?j) { (10 1) (20 2) (20 2) (UNDEF 3) (40 9) (50 UNDEF) }"
    cases = {
        f"FILTER EXISTS {{ {inner} FILTER(?k / 10 = ?w) }}": {1, 2, 4},
        f"FILTER NOT EXISTS {{ {inner} FILTER(?w + 0 = ?k / 10) }}": {3, 6, None},
        f"FILTER EXISTS {{ {inner} FILTER(?k / 10 = ?w && ?j = ?w && ?k > 10) }}": {2},
        f"FILTER EXISTS {{ {inner} FILTER(?k / (?j - 1) = ?w * 20) }}": {1},
        f"FILTER(?w = 3 || EXISTS {{ {inner} FILTER(?k / 10 = ?w) }})": {1, 2, 3, 4},
        f"OPTIONAL {{ {inner} FILTER(?k / 10 = ?w && ?j = ?w) }} FILTER(!BOUND(?k))": {3, 4, 6, None},
    }
    for text, want in cases.items():
        df = d.query(f"SELECT ?w {{ VALUES ?w {{ 1 2 3 4 6 UNDEF }} {text} }}")
        assert {r.w for r in df.collect()} == want and df.count() == len(want), text
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, text


def test_windows_closed_by_newer_ones_are_no_nested_loop(spark):
    from quern.catalog import window_avg_closed

    plan = window_avg_closed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
