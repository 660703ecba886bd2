"""Sequential state as a parallel prefix: running sums, counts, extremes and last values.

The usual stateful rule replaces one value for each key whenever an event arrives:

    DELETE { ?k :sum ?old } INSERT { ?k :sum ?new }
    WHERE { GRAPH ?e { ?k :reading ?v } ?k :sum ?old BIND(?old + ?v AS ?new) }

Run event by event this is a loop. Its results in order are a prefix aggregate, which
``running`` computes without putting a key into one task: rows are range-partitioned by
(key, order) and written down, each task aggregates its stretch of a key, the few totals
of the stretches are accumulated for each key, and each row adds what came before its
stretch. ``accumulator_of`` recognises such rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.sparql import ast as A
from quern.storage import materialize

AGGREGATES = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "last": F.last}


def running(events: DataFrame, key: str, order: list[str], value: str, kind: str, out: str = "running") -> DataFrame:
    """``events`` with the aggregate of ``value`` over the events of the key up to each one."""
    if kind not in AGGREGATES:
        raise ValueError(f"unknown aggregate {kind}")
    if clash := {"_stretch", "_part", "_total", "_before"} & set(events.columns):
        raise ValueError(f"columns {sorted(clash)} are needed by this operator")
    ranged = materialize(events.repartitionByRange(key, *order).withColumn("_stretch", F.spark_partition_id()), "running")
    f = (lambda c: F.last(c, ignorenulls=True)) if kind == "last" else AGGREGATES[kind]
    inside = Window.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = ranged.withColumn("_part", f(F.col(value)).over(inside))
    if kind == "last":
        totals = ranged.where(F.col(value).isNotNull()).groupBy(key, "_stretch").agg(F.max_by(F.col(value), F.struct(*order)).alias("_total"))
    else:
        totals = ranged.groupBy(key, "_stretch").agg(f(F.col(value)).alias("_total"))
    earlier = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_before", f(F.col("_total")).over(earlier)).select(F.col(key).alias("_k"), F.col("_stretch").alias("_s"), "_before")
    joined = parts.join(before, parts[key].eqNullSafe(before["_k"]) & (parts["_stretch"] == before["_s"]), "left")
    return joined.withColumn(out, _combined(kind, F.col("_before"), F.col("_part"))).select(*events.columns, out)


def _combined(kind: str, before: Column, part: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(before.isNull() & part.isNull(), F.lit(None)).otherwise(F.coalesce(before, F.lit(0)) + F.coalesce(part, F.lit(0)))
    if kind == "last":
        return F.coalesce(part, before)
    return (F.greatest if kind == "max" else F.least)(before, part)


@dataclass(frozen=True)
class Accumulator:
    """What a stateful rule keeps: state quads (subject, predicate, graph), how the new value
    comes from an event, and the rest of the rule's pattern."""

    subject: object
    predicate: object
    graph: object
    kind: str
    value: object  # expression over the event
    old: str
    new: str
    pattern: A.Group  # without the state


def accumulator_of(rule: A.Update) -> Accumulator | None:
    """The accumulator that a DELETE/INSERT rule is; None if it is something else."""
    if rule.kind != "MODIFY" or len(rule.insert) != 1 or len(rule.delete) != 1:
        return None
    ((d,), (i,)) = rule.delete, rule.insert
    if (d.s, d.p, d.g) != (i.s, i.p, i.g) or not isinstance(d.o, A.Var) or not isinstance(i.o, A.Var):
        return None
    old, new = d.o, i.o
    kept, binds, filters, state = [], [], [], 0
    for e in rule.where.elements:
        inner = e.group.elements if isinstance(e, A.Graph) and e.name == d.g else (e,) if d.g is None else ()
        hit = [t for b in inner if isinstance(b, A.Bgp) for t in b.triples if (t.s, t.p, t.o) == (d.s, d.p, old)]
        if hit:
            state += len(hit)
            rest = tuple(t for b in inner if isinstance(b, A.Bgp) for t in b.triples if t not in hit)
            if rest:
                kept.append(A.Bgp(rest) if d.g is None else A.Graph(d.g, A.Group((A.Bgp(rest),))))
        elif isinstance(e, A.Bind) and e.var == new:
            binds.append(e.expr)
        elif isinstance(e, A.Filter) and old.name in A.variables(e):
            filters.append(e.expr)
        else:
            kept.append(e)
    if state != 1 or any(old.name in A.variables(e) for e in kept):
        return None
    made = _step(binds, filters, old, new)
    return Accumulator(d.s, d.p, d.g, *made, old.name, new.name, A.Group(tuple(kept))) if made else None


def _step(binds: list, filters: list, old: A.Var, new: A.Var) -> tuple[str, object] | None:
    """(kind, value) of how the new value comes from the old one."""
    free = lambda e: old.name not in A.variables(e) and new.name not in A.variables(e)
    if len(binds) == 1 and not filters:
        e = binds[0]
        if isinstance(e, A.Call) and e.name == "+" and old in e.args:
            value = e.args[1] if e.args[0] == old else e.args[0]
            return ("sum", value) if free(value) else None
        if isinstance(e, A.Call) and e.name == "IF" and isinstance(e.args[0], A.Call) and e.args[0].name in ("<", ">"):
            test, a, b = e.args
            greater, less = test.args if test.name == ">" else test.args[::-1]
            if {a, b} == {greater, less} and old in (a, b):
                value = a if b == old else b
                return (("max" if a == greater else "min"), value) if free(value) else None
        return ("last", e) if free(e) else None
    if not binds and len(filters) == 1 and isinstance(filters[0], A.Call) and filters[0].name in ("<", ">") and set(filters[0].args) == {old, new}:
        greater = filters[0].args[0] if filters[0].name == ">" else filters[0].args[1]
        return ("max" if greater == new else "min", new)
    return ("last", new) if not binds and not filters else None
