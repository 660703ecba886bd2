"""Solution sets: a DataFrame and what its columns say about the variables.

A variable of kind ``iri`` whose IRIs all have one prefix followed by key values (subjects and
foreign keys of tables) is kept as its key columns: joins compare keys, filters reach the
scan, and the IRI text is only built where it is needed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import terms as t
from quern.terms import Val


@dataclass(frozen=True)
class VarType:
    kind: str
    template: str | None = None
    arity: int = 1
    nullable: bool = False


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    vars: dict[str, VarType]

    def columns(self, name: str) -> list[str]:
        v = self.vars[name]
        return [f"k{i}_{name}" for i in range(v.arity)] if v.template is not None else [f"v_{name}"]

    def all_columns(self) -> list[str]:
        return [c for n in self.vars for c in self.columns(n)]

    def val(self, name: str) -> Val:
        v = self.vars.get(name)
        if v is None:
            return t.null()
        if v.template is None:
            return Val(v.kind, F.col(quoted(f"v_{name}")))
        return Val("iri", iri_of(v.template, [F.col(quoted(c)) for c in self.columns(name)]))

    def is_null(self, name: str) -> Column:
        return F.col(quoted(self.columns(name)[0])).isNull()

    def with_val(self, name: str, v: Val, nullable: bool = True) -> Relation:
        return Relation(self.df.withColumn(f"v_{name}", v.col), {**self.vars, name: VarType(v.kind, nullable=nullable)})

    def keep(self, names: Iterable[str]) -> Relation:
        names = [n for n in dict.fromkeys(names) if n in self.vars]
        cols = [quoted(c) for n in names for c in self.columns(n)]
        return Relation(self.df.select(*cols), {n: self.vars[n] for n in names})

    def as_kind(self, name: str, kind: str) -> Relation:
        """The variable as one column of ``kind``."""
        v = self.vars[name]
        if v.template is None and v.kind == kind:
            return self
        column = t.as_kind(self.val(name), kind).alias(f"v_{name}")
        others = [quoted(c) for n in self.vars if n != name for c in self.columns(n)]
        return Relation(self.df.select(*others, column), {**self.vars, name: VarType(kind, nullable=v.nullable)})

    def where(self, condition: Column) -> Relation:
        return replace(self, df=self.df.where(condition))

    def nullable(self, names: Iterable[str] | None = None) -> Relation:
        names = set(self.vars if names is None else names)
        return replace(self, vars={n: replace(v, nullable=True) if n in names else v for n, v in self.vars.items()})

    def distinct(self) -> Relation:
        return replace(self, df=self.df.distinct())


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def iri_of(template: str, keys: list[Column]) -> Column:
    parts: list[Column] = [F.lit(template)]
    for i, k in enumerate(keys):
        parts += [F.lit("/")] * (i > 0) + [k.cast("string")]
    return F.concat(*parts)


def unit(spark: SparkSession) -> Relation:
    """One solution without variables."""
    return Relation(spark.range(1).select(F.lit(True).alias("_unit")), {})


def none(spark: SparkSession, vars: dict[str, VarType]) -> Relation:
    empty = Relation(spark.range(0), vars)
    cols = [F.lit(None).cast(t.SPARK_TYPES[v.kind] if v.template is None else "string").alias(c) for n, v in vars.items() for c in empty.columns(n)]
    return Relation(spark.range(0).select(*cols or [F.lit(True).alias("_unit")]), vars)


def aligned(a: Relation, b: Relation, names: Iterable[str]) -> tuple[Relation, Relation, set[str]]:
    """Both with comparable columns for the shared ``names``; and those that can never be equal."""
    never = set()
    for n in names:
        x, y = a.vars[n], b.vars[n]
        if x.template is not None and (x.template, x.arity) == (y.template, y.arity):
            continue
        if x.kind == y.kind:
            if x.template is not None and y.template is not None and not (x.template.startswith(y.template) or y.template.startswith(x.template)):
                never.add(n)
            a, b = a.as_kind(n, x.kind), b.as_kind(n, x.kind)
        else:
            if "term" not in (x.kind, y.kind):
                never.add(n)
            a, b = a.as_kind(n, "term"), b.as_kind(n, "term")
    return a, b, never


def union(relations: list[Relation]) -> Relation:
    """Bag union; a variable that a branch lacks is unbound there."""
    names = list(dict.fromkeys(n for r in relations for n in r.vars))
    for n in names:
        having = [r.vars[n] for r in relations if n in r.vars]
        if len({(v.kind, v.template, v.arity) for v in having}) > 1:
            kind = having[0].kind if len({v.kind for v in having}) == 1 else "term"
            relations = [r.as_kind(n, kind) if n in r.vars else r for r in relations]
    types, frames = {}, []
    for n in names:
        having = [r.vars[n] for r in relations if n in r.vars]
        types[n] = replace(having[0], nullable=len(having) < len(relations) or any(v.nullable for v in having))
    whole = Relation(relations[0].df, types)
    for r in relations:
        cols = []
        for n in names:
            for c in whole.columns(n):
                if n in r.vars:
                    cols.append(F.col(quoted(c)))
                else:
                    source = next(x for x in relations if n in x.vars)
                    cols.append(F.lit(None).cast(source.df.schema[c].dataType).alias(c))
        frames.append(r.df.select(*cols or [F.lit(True).alias("_unit")]))
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    return Relation(df, types)
