"""Property paths.

Sequences and inverses are rewritten to triple patterns. Alternatives and negated sets are
unions. ``+`` and ``*`` from or to a constant widen a frontier round by round; between two
variables the closure squares itself, so a chain of n steps takes log2(n) joins. Each round
is written to the shared folder (unless it is small) and only new pairs go on.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import terms as t
from quern.operators.joins import join
from quern.plans.relation import Relation, VarType, none, union
from quern.sparql import ast as A
from quern.storage import settle

_fresh = count()


def fresh() -> A.Var:
    return A.Var(f"_:p{next(_fresh)}")


def steps(triple: A.Triple) -> list[A.Triple]:
    """A triple with a path as patterns without sequences and inverses of single steps."""
    p = triple.p
    if isinstance(p, A.PathInv):
        return steps(A.Triple(triple.o, p.path, triple.s))
    if isinstance(p, A.PathSeq):
        ends = [triple.s, *(fresh() for _ in p.items[1:]), triple.o]
        return [x for i, item in enumerate(p.items) for x in steps(A.Triple(ends[i], item, ends[i + 1]))]
    return [triple]


def relation(compiler, triple: A.Triple, graph: object) -> Relation:
    """Solutions of one triple with an alternative, a modified path or a negated set."""
    p = triple.p
    if isinstance(p, A.PathAlt):
        return union([compiler.bgp([A.Triple(triple.s, x, triple.o)], graph) for x in p.items])
    if isinstance(p, A.PathNeg):
        found = []
        for s, o, names in ((triple.s, triple.o, p.forward), (triple.o, triple.s, p.inverse)):
            if names or (not p.inverse and s is triple.s):
                v = fresh()
                r = compiler.bgp([A.Triple(s, v, o)], graph)
                r = r.where(~F.coalesce(t.lex(r.val(v.name)).isin([x.value for x in names]), F.lit(False)))
                found.append(r.keep([n for n in r.vars if n != v.name]))
        return union(found)
    if isinstance(p, A.PathMod):
        return _modified(compiler, triple, p, graph)
    return compiler.bgp([triple], graph)


def _modified(compiler, triple: A.Triple, p: A.PathMod, graph: object) -> Relation:
    x, y = fresh(), fresh()
    base = compiler.bgp([A.Triple(x, p.path, y)], graph)
    kind = base.vars[x.name].kind if base.vars[x.name].kind == base.vars[y.name].kind else "term"
    g = [graph.name] if isinstance(graph, A.Var) else []
    base = base.as_kind(x.name, kind).as_kind(y.name, kind).keep([x.name, y.name, *g])
    for n in g:
        base = base.as_kind(n, base.vars[n].kind)
    pairs = base.df.toDF("x", "y", *(["g"] if g else []))
    keys = ["g"] if g else []
    start, end = (None if isinstance(e, A.Var) else _as(e, kind) for e in (triple.s, triple.o))
    if p.mod == "?":
        reached = pairs.distinct()
        if start is not None:
            reached = reached.where(F.col("x") == start)
        if end is not None:
            reached = reached.where(F.col("y") == end)
    elif start is not None:
        reached = _frontier(pairs, "x", "y", start, keys)
        reached = reached.where(F.col("y") == end) if end is not None else reached
    elif end is not None:
        reached = _frontier(pairs, "y", "x", end, keys)
    else:
        reached = closure(pairs, keys)
    found = Relation(reached.select("x", "y", *keys), {})
    names = {"x": VarType(kind), "y": VarType(kind), **({"g": base.vars[g[0]]} if g else {})}
    r = Relation(found.df.select(*(F.col(c).alias(f"v_{c}") for c in names)), names)
    if p.mod in "?*":
        r = union([r, _zero(compiler, triple, graph, kind, keys)]).distinct()
    return _bound(r, triple, graph)


def _as(e: object, kind: str):
    v = t.constant(e)
    return v.col if v.kind == kind else t.to_term(v) if kind == "term" else F.lit(None).cast(t.SPARK_TYPES[kind])


def _zero(compiler, triple: A.Triple, graph: object, kind: str, keys: list[str]) -> Relation:
    """Paths of no step, as x, y (and g)."""
    spark = compiler.spark
    const = [e for e in (triple.s, triple.o) if not isinstance(e, A.Var)]
    if const:
        if len(const) == 2 and const[0] != const[1]:
            return none(spark, {"x": VarType("term"), "y": VarType("term")})
        v = t.constant(const[0])
        df = spark.range(1).select(v.col.alias("v_x"), v.col.alias("v_y"))
        r = Relation(df, {"x": VarType(v.kind), "y": VarType(v.kind)})
        if keys:
            graphs = compiler.source.graphs("g")
            r = join(r, graphs)
        return r
    g = A.Var("g") if keys else graph
    r = compiler.source.nodes(g, "x")
    r = r.as_kind("x", r.vars["x"].kind)
    return Relation(r.df.withColumn("v_y", F.col("v_x")), {**r.vars, "y": r.vars["x"]})


def _bound(r: Relation, triple: A.Triple, graph: object) -> Relation:
    """x, y and g under the names that the triple gives them."""
    out, types = [], {}
    for place, e in (("x", triple.s), ("y", triple.o), ("g", graph)):
        if place not in r.vars:
            continue
        v = r.val(place)
        if not isinstance(e, A.Var):
            if place != "g":
                r = r.where(t.to_term(v) == t.to_term(t.constant(e)))
        elif e.name in types:
            r = r.where(t.to_term(v) == t.to_term(r.val("x")))
        else:
            types[e.name] = VarType(v.kind)
            out.append(v.col.alias(f"v_{e.name}"))
    return Relation(r.df.select(*out or [F.lit(True).alias("_unit")]), types)


def _frontier(pairs: DataFrame, here: str, there: str, start, keys: list[str]) -> DataFrame:
    """All that can be reached from the constant ``start``, as pairs with it."""
    pairs = settle(pairs.select(F.col(here).alias("a"), F.col(there).alias("b"), *keys).distinct(), "path")
    new = settle(pairs.where(F.col("a") == start).select("b", *keys).distinct(), "path")
    seen = new
    while not new.isEmpty():
        step = new.select(F.col("b").alias("a"), *keys).join(pairs, ["a", *keys]).select("b", *keys).distinct()
        new = settle(step.join(seen, ["b", *keys], "left_anti"), "path")
        seen = seen.union(new)
    return seen.select(start.alias(here), F.col("b").alias(there), *keys)


def closure(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Transitive closure of (x, y) by squaring."""
    keys = keys or []
    every = settle(pairs.distinct(), "closure")
    new = every
    while not new.isEmpty():
        far = new.select("x", F.col("y").alias("m"), *keys)
        step = far.join(every.select(F.col("x").alias("m"), "y", *keys), ["m", *keys]).select("x", "y", *keys)
        back = every.select("x", F.col("y").alias("m"), *keys).join(new.select(F.col("x").alias("m"), "y", *keys), ["m", *keys]).select("x", "y", *keys)
        new = settle(step.union(back).distinct().join(every, ["x", "y", *keys], "left_anti"), "closure")
        every = every.union(new)
    return every

