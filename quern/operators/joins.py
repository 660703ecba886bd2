"""Joins of solution sets by SPARQL compatibility.

Two solutions are compatible if no variable that both bind differs. Where the shared
variables are bound on both sides (known at compile time) this is an equality join. Where
one may be unbound, the left side is parted by which of its variables are unbound, and each
part is an equality join on those that are left. Inner and anti joins without a key that is
surely bound on both sides part the right side in the same way; else an unbound variable on
the right, and on the left each beyond ``PARTED``, is let through by a residual condition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import terms as t
from quern.plans.relation import Relation, aligned, none, quoted, union

#: (left view, right view) -> a further condition; the views give ``Val``s of either side.
Condition = Callable[[Relation, Relation], Column]


#: variables by which the sides are parted (into two to the power of as many parts, all told)
PARTED = 4


def _renamed(r: Relation, prefix: str) -> tuple[Relation, Callable[[str], str]]:
    """A copy whose columns can't clash with another side's."""
    df = r.df.select(*(F.col(quoted(c)).alias(prefix + c) for c in r.all_columns()) or [F.lit(True).alias("_unit")]) if r.vars else r.df.select(F.lit(True).alias("_unit_" + prefix))
    return Relation(df, r.vars), lambda c: prefix + c


class _Side(Relation):
    """A relation whose columns have been prefixed."""

    def columns(self, name: str) -> list[str]:
        return ["r_" + c for c in super().columns(name)]

    def val(self, name: str):
        v = self.vars.get(name)
        if v is None:
            return t.null()
        if v.template is None:
            return t.Val(v.kind, F.col(quoted(f"r_v_{name}")))
        from quern.plans.relation import iri_of

        return t.Val("iri", iri_of(v.template, [F.col(quoted(c)) for c in self.columns(name)]))


def _equal(name: str, left: Relation, right: Relation) -> Column:
    c = F.lit(True)
    for i, (x, y) in enumerate(zip(left.columns(name), right.columns(name))):
        one = F.col(quoted(x)) == F.col(quoted(y))
        c = one if i == 0 else c & one
    return c


def join(left: Relation, right: Relation, how: str = "inner", condition: Condition | None = None, overlap: bool = False, null_safe: bool = False, split: bool = True) -> Relation:
    """how: inner, left, left_semi or left_anti.

    overlap: only solutions that share a bound variable are compatible (MINUS).
    null_safe: unbound equals unbound alone, instead of anything.
    split: whether the right side may be parted by what is unbound there.
    """
    shared = [n for n in left.vars if n in right.vars]
    left, right, never = aligned(left, right, shared)
    if never & {n for n in shared if not left.vars[n].nullable and not right.vars[n].nullable}:
        return _apart(left, right, how)
    if overlap and not shared:
        return left if how == "left_anti" else none(left.df.sparkSession, left.vars)
    opened = [n for n in shared if right.vars[n].nullable][: max(0, PARTED - sum(left.vars[n].nullable for n in shared))]
    if opened and split and not null_safe and how in ("inner", "left_anti") and all(left.vars[n].nullable or right.vars[n].nullable for n in shared):
        parts = _by_bound(right, opened)
        if how == "inner":
            return union([join(left, part, how, condition, overlap, split=False) for part in parts])
        for part in parts:
            left = join(left, part, how, condition, overlap, split=False)
        return left
    side, _ = _renamed(right, "r_")
    right = _Side(side.df, right.vars)
    loose = [n for n in shared if left.vars[n].nullable] if not null_safe else []
    loose, rest = loose[:PARTED], set(loose[PARTED:])
    parts = []
    for mask in product((False, True), repeat=len(loose)):
        unbound = {n for n, m in zip(loose, mask) if m}
        part = left
        for n in loose:
            part = part.where(left.is_null(n) if n in unbound else ~left.is_null(n))
        parts.append(_join_part(part, right, [n for n in shared if n not in unbound], unbound, shared, how, condition, overlap, null_safe, never, rest))
    return parts[0] if len(parts) == 1 else union(parts)


def _by_bound(r: Relation, names: list[str]) -> list[Relation]:
    """``r`` parted by which of ``names`` are unbound; each part has only its bound ones, surely bound."""
    parts = []
    for mask in product((False, True), repeat=len(names)):
        part, unbound = r, {n for n, m in zip(names, mask) if m}
        for n in names:
            part = part.where(r.is_null(n) if n in unbound else ~r.is_null(n))
        vars = {n: replace(v, nullable=False) if n in names else v for n, v in r.vars.items() if n not in unbound}
        parts.append(Relation(part.df, vars))
    return parts


def _apart(left: Relation, right: Relation, how: str) -> Relation:
    """No two solutions are compatible."""
    spark = left.df.sparkSession
    if how == "left_semi":
        return none(spark, left.vars)
    if how == "left_anti":
        return left
    if how == "inner":
        return Relation(left.df.limit(0), left.vars) if not set(right.vars) - set(left.vars) else none(spark, {**right.vars, **left.vars})
    extra = {n: replace(v, nullable=True) for n, v in right.vars.items() if n not in left.vars}
    shape = none(spark, extra)
    df = left.df
    for c in shape.all_columns() if extra else []:
        df = df.withColumn(c, F.lit(None).cast(right.df.schema[c].dataType if c in right.df.columns else "string"))
    return Relation(df, {**left.vars, **extra})


def _join_part(left: Relation, right: Relation, keys: list[str], unbound: set[str], shared: list[str], how: str, condition: Condition | None, overlap: bool, null_safe: bool, never: set[str], rest: set[str]) -> Relation:
    """One part of a join: the left side's ``unbound`` variables are null in all of its rows, those in
    ``rest`` may be null in some."""
    on, any_bound = None, F.lit(False)
    for n in keys:
        if n in never:
            c = F.lit(False)
        elif null_safe:
            c = F.lit(True)
            for x, y in zip(left.columns(n), right.columns(n)):
                c = c & F.col(quoted(x)).eqNullSafe(F.col(quoted(y)))
        else:
            c = _equal(n, left, right)
        both = F.lit(True)
        if right.vars[n].nullable and not null_safe:
            both = ~right.is_null(n)
            c = right.is_null(n) | c
        if n in rest:
            both = both & ~left.is_null(n)
            c = left.is_null(n) | c
        any_bound = any_bound | both
        on = c if on is None else on & c
    if overlap:
        if not keys:
            return left if how == "left_anti" else none(left.df.sparkSession, left.vars)
        on = on & any_bound
    if condition is not None:
        extra = condition(left, right)
        on = extra if on is None else on & extra
    if how in ("left_semi", "left_anti"):
        if on is None:  # only whether there is any solution at all counts
            on = F.lit(True)
        return Relation(left.df.join(right.df, on, how), left.vars)
    df = left.df.crossJoin(right.df) if on is None and how == "inner" else left.df.join(right.df, F.lit(True) if on is None else on, how)
    cols: list[Column] = []
    types = {}
    for n, v in left.vars.items():
        filled = n in unbound or n in rest or (n in shared and v.nullable and null_safe)
        for x, y in zip(left.columns(n), right.columns(n) if n in right.vars else left.columns(n)):
            cols.append(F.coalesce(F.col(quoted(x)), F.col(quoted(y))).alias(x) if filled and n in right.vars else F.col(quoted(x)))
        still = v.nullable and (n not in shared or ((n in unbound or n in rest) and (how == "left" or right.vars[n].nullable)) or null_safe)
        types[n] = replace(v, nullable=still)
    for n, v in right.vars.items():
        if n not in left.vars:
            for c in right.columns(n):
                cols.append(F.col(quoted(c)).alias(c[2:]))
            types[n] = replace(v, nullable=v.nullable or how == "left")
    return Relation(df.select(*cols or [F.lit(True).alias("_unit")]), types)


def marked(left: Relation, right: Relation, flag: str, condition: Condition | None = None) -> Relation:
    """``left`` with a boolean column that says whether a compatible right solution exists.

    Where all shared variables are surely bound this is one left join with the distinct keys;
    else both sides are joined twice."""
    shared = [n for n in left.vars if n in right.vars]
    if shared and condition is None and not _flags(left.df) and not any(r.vars[n].nullable for r in (left, right) for n in shared):
        keys = right.keep(shared).distinct().with_val(flag, t.Val("boolean", F.lit(True)))
        found = join(left, keys, "left")
        column = quoted(found.columns(flag)[0])
        kept = {n: v for n, v in found.vars.items() if n != flag}
        names = Relation(found.df, kept).all_columns()
        return Relation(found.df.select(*map(quoted, names), F.coalesce(F.col(column), F.lit(False)).alias(flag)), kept)
    yes = join(left, right, "left_semi", condition)
    no = join(left, right, "left_anti", condition)
    vars = yes.vars
    frames: list[DataFrame] = [r.df.select(*(quoted(c) for c in (Relation(r.df, r.vars).all_columns())), *_flags(r.df), F.lit(v).alias(flag)) for r, v in ((yes, True), (no, False))]
    return Relation(frames[0].unionByName(frames[1]), vars)


def _flags(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_exists")]
