"""Incremental answers by signed deltas.

A view over a join of patterns is kept under changes of the quads. For a change d of the
quads R, the change of P1 x ... x Pn is the sum over i of P1(new) x ... x Pi(d) x ... x Pn(old),
with weights that multiply over joins and are added up per answer; so only rows that meet
the change are joined. A change of more than a ``SHARE`` of the quads costs less by its definition, in
one join: P1(new) x ... x Pn(new) - P1(old) x ... x Pn(old) over the quads of either. Views whose group
has more than patterns, BINDs and FILTERs without EXISTS (OPTIONAL, MINUS, aggregates ...) are
evaluated anew and compared. The quads before and after a change are one table, made in one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.registry import Context
from quern.operators.joins import join
from quern.plans.compiler import Compiler, _has_exists
from quern.plans.relation import Relation, VarType, quoted
from quern.session import rendered
from quern.sources.quads import DEFAULT, QuadSource
from quern.sparql import ast as A
from quern.storage import settle


#: Column of multiplicities and their changes; no variable can be called so.
WEIGHT = "weight#"

#: Of the quads before and after a change, the part from which the change counts as large.
SHARE = 1 / 16


class _Weighted(QuadSource):
    """Quads with weights that each pattern binds under its own names."""

    def __init__(self, quads: DataFrame, names: dict[str, str]):
        super().__init__(quads)
        self.extra = {name: (column, VarType("integer")) for name, column in names.items()}


def is_monotone_group(group: A.Group) -> bool:
    """Whether a group is made of plain patterns, BINDs and FILTERs without EXISTS alone."""

    def ok(e: object) -> bool:
        if isinstance(e, A.Bgp):
            return all(isinstance(x.p, A.Iri | A.Var) for x in e.triples)
        if isinstance(e, A.Filter | A.Bind):
            return not _has_exists(e if isinstance(e, A.Filter) else A.Filter(e.expr))
        return isinstance(e, A.Graph) and bool(_patterns(e, DEFAULT)) and all(map(ok, e.group.elements))

    return all(map(ok, group.elements))


def is_monotone(q: A.Query) -> bool:
    plain = not (q.group_by or q.having or q.values or q.limit is not None or q.offset)
    return q.form == "SELECT" and plain and not _aggregating(q) and is_monotone_group(q.where)


def _aggregating(q: A.Query) -> bool:
    from quern.plans.compiler import _aggregates

    return bool(_aggregates([x[0] for x in q.projection or () if isinstance(x, tuple)]))


class IncrementalView:
    """Answers of a SELECT with their multiplicities."""

    def __init__(self, query: A.Query, quads: DataFrame, ctx: Context | None = None):
        self.query, self.quads, self.ctx = query, quads.select(*"spog"), ctx or Context()
        self.monotone = is_monotone(query)
        self.counts = settle(self._counted(self._batch()), "view")

    def _batch(self) -> DataFrame:
        return rendered(Compiler(QuadSource(self.quads), self.ctx).select(self.query), "term")

    def _counted(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*map(quoted, rows.columns)).agg(F.count(F.lit(1)).alias(WEIGHT))

    def rows(self) -> DataFrame:
        """The present answers, repeated as often as they occur."""
        repeated = self.counts.withColumn("copy#", F.explode(F.sequence(F.lit(1), F.col(quoted(WEIGHT)).cast("int"))))
        return repeated.drop(WEIGHT, "copy#").distinct() if self.query.distinct else repeated.drop(WEIGHT, "copy#")

    def change(self, delete: DataFrame, insert: DataFrame) -> DataFrame:
        """Apply deletes, then inserts; returns the changes of answers with their weights."""
        marks = lambda df, **of: df.select(*"spog", *(F.lit(of.get(c, 0)).cast("bigint").alias(c) for c in ("before", "gone", "come")))
        every = marks(self.quads, before=1).union(marks(delete, gone=1)).union(marks(insert, come=1))
        every = every.groupBy(*"spog").agg(*(F.max(c).alias(c) for c in ("before", "gone", "come")))
        after = F.greatest("come", F.col("before") * (1 - F.col("gone")))
        quads = settle(every.select(*"spog", "before", after.alias("after"), (after - F.col("before")).alias("w")).where("before > 0 OR after > 0"), "quads")
        self.quads = quads.where("after > 0").select(*"spog")
        if not self.monotone:
            before = self.counts.withColumn(WEIGHT, -F.col(quoted(WEIGHT)))
            changed = self._counted(self._batch()).unionByName(before)
        else:
            n, moved = quads.agg(F.count(F.lit(1)), F.sum(F.abs("w"))).first()
            changed = self._difference(quads) if (moved or 0) > n * SHARE else self._delta(quads)
        names = [quoted(c) for c in self.counts.columns if c != WEIGHT]
        net = lambda df: df.groupBy(*names).agg(F.sum(quoted(WEIGHT)).alias(WEIGHT)).where(f"{quoted(WEIGHT)} <> 0")
        changed = settle(net(changed), "changed")
        self.counts = settle(net(self.counts.unionByName(changed)), "view")
        return changed

    def _delta(self, quads: DataFrame) -> DataFrame:
        """The sum over the patterns, of which each in turn is matched with the change alone."""
        old, new, delta = (quads.where(f"{c} <> 0") for c in ("before", "after", "w"))
        patterns = self._joined_patterns()
        total = None
        for i in range(len(patterns)):
            order = [i, *(k for k in range(len(patterns)) if k != i)]  # the change leads
            r = self._product([(k, delta if k == i else new if k < i else old, {f"_:w{k}": "w" if k == i else "after" if k < i else "before"}) for k in order])
            out = self._finish(r, self._weight(r, "w", len(patterns)))
            total = out if total is None else total.unionByName(out)
        return total

    def _difference(self, quads: DataFrame) -> DataFrame:
        """The product over the quads after the change without that over those before."""
        patterns = self._joined_patterns()
        order = sorted(range(len(patterns)), key=lambda k: len(A.variables(patterns[k][0])))  # constants lead
        r = self._product([(k, quads, {f"_:b{k}": "before", f"_:a{k}": "after"}) for k in order])
        return self._finish(r, self._weight(r, "a", len(patterns)) - self._weight(r, "b", len(patterns)))

    def _joined_patterns(self) -> list[tuple[A.Triple, object]]:
        return [(x, g) for e in self.query.where.elements for x, g in _patterns(e, DEFAULT)]

    def _product(self, parts: list[tuple[int, DataFrame, dict[str, str]]]) -> Relation:
        """The join of patterns (number, quads, weights), in this order where they meet."""
        patterns, r = self._joined_patterns(), None
        while parts:
            at = next((i for i, x in enumerate(parts) if r is None or _meets(patterns[x[0]], r)), 0)
            k, quads, names = parts.pop(at)
            part = _Weighted(quads, names).pattern(*patterns[k])
            r = part if r is None else join(r, part)
        return r

    def _weight(self, r: Relation, of: str, n: int) -> Column:
        return reduce(lambda a, b: a * b, (r.val(f"_:{of}{k}").col for k in range(n)))

    def _finish(self, r: Relation, weight: Column) -> DataFrame:
        compiler = Compiler(QuadSource(self.quads), self.ctx)
        r = Relation(r.df.withColumn("v__:w", weight).where("`v__:w` <> 0"), {**r.vars, "_:w": VarType("integer")})
        rest = [e for e in self.query.where.elements if isinstance(e, A.Bind)] + [e for e in _filters(self.query.where)]
        for e in rest:
            if isinstance(e, A.Bind):
                r = r.with_val(e.var.name, compiler.expr(e.expr, r.val))
            else:
                r = compiler.where(e.expr, r, DEFAULT)
        for x in self.query.projection or ():
            if isinstance(x, tuple):
                r = r.with_val(x[1].name, compiler.expr(x[0], r.val))
        names = [c for c in self.counts.columns if c != WEIGHT]
        return rendered(r.keep([*names, "_:w"]), "term").select(*map(quoted, names), F.col("`_:w`")["lex"].cast("bigint").alias(WEIGHT))


def _patterns(e: object, graph: object) -> list[tuple[A.Triple, object]]:
    if isinstance(e, A.Bgp):
        return [(x, graph) for x in e.triples]
    if isinstance(e, A.Graph):
        return [y for x in e.group.elements for y in _patterns(x, e.name)]
    return []


def _filters(group: A.Group) -> list[A.Filter]:
    return [f for e in group.elements for f in ([e] if isinstance(e, A.Filter) else _filters(e.group) if isinstance(e, A.Graph) else [])]


def _meets(pattern: tuple[A.Triple, object], r: Relation) -> bool:
    return bool(set(A.variables([pattern[0], pattern[1] if isinstance(pattern[1], A.Var) else None])) & set(r.vars))
