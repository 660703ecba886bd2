"""Aggregates: COUNT, SUM, AVG, MIN, MAX, SAMPLE and GROUP_CONCAT.

Spark computes all but GROUP_CONCAT in two steps (partial sums before the shuffle).
Values that aren't numbers are left out of SUM and AVG. Sums over quads are exact as long as a
group has integers or decimals alone (up to 38 digits, 18 of them after the point). SAMPLE is the least value and
GROUP_CONCAT is in the order of its values, so that both are the same at every run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern import terms as t
from quern.sparql import ast as A
from quern.terms import NUMERIC, Val


def aggregate(agg: A.Agg, v: Val | None, all_columns: list[Column], parity: bool = False) -> Val:
    """``v`` is the argument over the rows of a group, None for COUNT(*)."""
    if agg.name == "COUNT":
        if v is None:
            return Val("integer", F.count_distinct(F.struct(*all_columns)) if agg.distinct and all_columns else F.count(F.lit(1)))
        return Val("integer", F.count_distinct(v.col) if agg.distinct else F.count(F.lit(1) if parity else v.col))
    if agg.name in ("SUM", "AVG"):
        return _sum(agg, v) if agg.name == "SUM" else _average(agg, v, parity)
    if agg.name in ("MIN", "MAX", "SAMPLE"):
        if v.kind != "term":
            return Val(v.kind, (F.max if agg.name == "MAX" else F.min)(v.col))
        key = F.when(v.col.isNotNull(), F.struct(*(k.alias(f"o{i}") for i, k in enumerate(t.order_key(v)))))
        return Val("term", (F.max_by if agg.name == "MAX" else F.min_by)(v.col, key))
    separator = agg.separator if agg.separator is not None else "" if parity else " "
    parts = (F.collect_set if agg.distinct else F.collect_list)(t.lex(v))
    return Val("string", F.array_join(F.sort_array(parts), separator))


def _distinct(agg: A.Agg, c: Column) -> Column:
    return F.sum_distinct(c) if agg.distinct else F.try_sum(c)


def _rank(v: Val) -> Column:
    """Highest numeric type of a group: 0 integer, 1 decimal, 2 float, 3 double."""
    c = v.col
    return F.max(F.when(c["dt"].isin(t.INTEGER_TYPES), 0).when(c["dt"] == A.DECIMAL, 1).when(c["dt"] == A.FLOAT, 2).when(c["dt"] == A.DOUBLE, 3))


def _typed(rank: Column, value: Column, whole: bool) -> Val:
    as_term = lambda kind, cast: t.to_term(Val(kind, value.cast(cast)))
    first = as_term("integer", "bigint") if whole else as_term("decimal", "double")
    return Val("term", F.when(F.coalesce(rank, F.lit(0)) == 0, first).when(rank == 1, as_term("decimal", "double")).when(rank == 2, as_term("float", "float")).otherwise(as_term("double", "double")))


def _sum(agg: A.Agg, v: Val) -> Val:
    n = t.number(v)
    if n is None:
        return Val("integer", F.lit(0).cast("bigint") + F.count(F.lit(1)) * 0)
    if v.kind in NUMERIC:
        zero = F.lit(0).cast(t.SPARK_TYPES[v.kind])
        return Val(v.kind, F.coalesce(_distinct(agg, n), zero).cast(t.SPARK_TYPES[v.kind]))
    rank, dt, lex = _rank(v), v.col["dt"], v.col["lex"]
    whole = _distinct(agg, F.when(dt.isin(t.INTEGER_TYPES), lex.try_cast("decimal(38,0)"))).cast("string")
    exact = _distinct(agg, F.when(t.is_numeric(v.col), lex.try_cast("decimal(38,18)"))).cast("string")
    exact = F.regexp_replace(F.regexp_replace(exact, "0+$", ""), r"\.$", ".0")
    loose = _typed(rank, F.coalesce(_distinct(agg, n), F.lit(0.0)), True).col
    return Val("term", F.when((rank == 0) & whole.isNotNull(), t.struct(t.LITERAL, whole, A.INTEGER)).when((rank == 1) & exact.isNotNull(), t.struct(t.LITERAL, exact, A.DECIMAL)).otherwise(loose))


def _average(agg: A.Agg, v: Val, parity: bool) -> Val:
    n = t.number(v)
    if n is None:
        return Val("integer", F.lit(0).cast("bigint") + F.count(F.lit(1)) * 0)
    n = n.cast("double")
    rows = F.count(F.lit(1)) if parity else F.count_distinct(n) if agg.distinct else F.count(n)
    mean = F.coalesce(F.try_divide(_distinct(agg, n), rows.cast("double")), F.lit(0.0))
    if v.kind in NUMERIC:
        return Val("decimal" if v.kind in ("integer", "decimal") else v.kind, mean.cast(t.SPARK_TYPES[v.kind]) if v.kind == "float" else mean)
    return _typed(_rank(v), mean, False)
