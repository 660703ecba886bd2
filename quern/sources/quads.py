"""Quads: the source for free RDF data.

A quad table has TERM columns s, p, o and g (NULL in the default graph) and is a set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import terms as t
from quern.plans.relation import Relation, VarType, unit
from quern.sparql import ast as A

DEFAULT = object()  # the default graph, as a graph name


def empty_quads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], t.QUAD)


def quads_of(spark: SparkSession, quads: list[A.Quad]) -> DataFrame:
    """A table of ground quads."""

    def cell(x: object) -> tuple | None:
        if x is None:
            return None
        if isinstance(x, A.Iri):
            return (t.IRI, x.value, None, None)
        if isinstance(x, A.BNode):
            return (t.BNODE, "_:" + x.label, None, None)
        return (t.LITERAL, x.lex, x.dt, x.lang)

    return spark.createDataFrame([tuple(cell(x) for x in (q.s, q.p, q.o, q.g)) for q in quads], t.QUAD)


def value_key(c: Column) -> Column:
    """A term with its number in one spelling, so that 1 and 01 of one type join."""
    return F.when(c["dt"].isin(t.INTEGER_TYPES) & c["lex"].try_cast("bigint").isNotNull(), t.struct(t.LITERAL, c["lex"].try_cast("bigint").cast("string"), c["dt"])).otherwise(c)


class QuadSource:
    """Matches triple patterns against a quad table."""

    def __init__(self, quads: DataFrame, default_graphs: list[str] | None = None, named_graphs: list[str] | None = None):
        self.quads, self.spark = quads, quads.sparkSession
        self.default_graphs, self.named_graphs = default_graphs, named_graphs

    def dataset(self, default: list[str], named: list[str]) -> QuadSource:
        """With FROM and FROM NAMED: the default graph is the merge of ``default``."""
        return QuadSource(self.quads, default, named) if default or named else self

    def scope(self, graph: object) -> DataFrame:
        g = self.quads["g"]["lex"]
        if graph is DEFAULT:
            if self.default_graphs is None:
                return self.quads.where(self.quads["g"].isNull())
            merged = self.quads.where(g.isin(self.default_graphs)).select("s", "p", "o").distinct()
            return merged.withColumn("g", F.lit(None).cast(t.TERM))
        named = self.quads.where(self.quads["g"].isNotNull())
        if self.named_graphs is not None:
            named = named.where(g.isin(self.named_graphs))
        if isinstance(graph, A.Iri):
            named = named.where(g == graph.value)
        return named

    def bgp(self, triples: list[A.Triple], graph: object = DEFAULT) -> list[Relation]:
        """One relation for each pattern; the caller joins them."""
        return [self.pattern(x, graph) for x in triples]

    #: further columns that every pattern binds: variable -> (column, type)
    extra: dict = {}

    def pattern(self, triple: A.Triple, graph: object) -> Relation:
        df = self.scope(graph)
        positions: dict[str, list[str]] = {}
        for column, x in (("s", triple.s), ("p", triple.p), ("o", triple.o), *([("g", graph)] if isinstance(graph, A.Var) else [])):
            if isinstance(x, A.Var):
                positions.setdefault(x.name, []).append(column)
            elif isinstance(x, A.Iri):
                df = df.where((F.col(column)["kind"] == t.IRI) & (F.col(column)["lex"] == x.value))
            else:
                df = df.where(_matches(F.col(column), x))
        for columns in positions.values():
            for other in columns[1:]:
                df = df.where(F.col(columns[0]) == F.col(other))
        cols = [F.col(c[0]).alias(f"v_{n}") for n, c in positions.items()] + [F.col(c).alias(f"v_{n}") for n, (c, _) in self.extra.items()]
        kinds = {n: VarType("term") for n in positions} | {n: k for n, (_, k) in self.extra.items()}
        return Relation(df.select(*cols or [F.lit(True).alias("_unit")]), kinds)

    def nodes(self, graph: object, name: str) -> Relation:
        """Every subject and object, once."""
        df = self.scope(graph)
        extra = [F.col("g").alias(f"v_{graph.name}")] if isinstance(graph, A.Var) else []
        both = df.select(F.col("s").alias(f"v_{name}"), *extra).union(df.select("o", *extra)).distinct()
        return Relation(both, {name: VarType("term"), **({graph.name: VarType("term")} if extra else {})})

    def graphs(self, name: str) -> Relation:
        named = self.quads.where("g is not null")
        if self.named_graphs is not None:
            named = named.where(F.col("g")["lex"].isin(self.named_graphs))
        return Relation(named.select(F.col("g").alias(f"v_{name}")).distinct(), {name: VarType("term")})

    def unit(self) -> Relation:
        return unit(self.spark)

    def describe(self, resources: Relation, name: str) -> DataFrame:
        """Quads whose subject is a resource, and those of blank nodes below them."""
        subjects = resources.as_kind(name, "term").df.select(F.col(f"v_{name}").alias("s")).where("s is not null").distinct()
        found = self.quads.join(subjects, "s", "left_semi")
        seen = subjects
        while True:
            below = found.select(F.col("o").alias("s")).where(F.col("s")["kind"] == t.BNODE).distinct().join(seen, "s", "left_anti")
            if below.isEmpty():
                return found.select(*"spog").distinct()
            seen = seen.union(below)
            found = found.union(self.quads.join(below, "s", "left_semi"))


def _matches(c: Column, x: A.Lit) -> Column:
    """The same literal; integers by value within their type."""
    if x.dt in t.INTEGER_TYPES:
        return (c["dt"] == x.dt) & (c["lex"].try_cast("bigint") == int(x.lex))
    if x.dt == A.STRING or x.lang is None:
        return (c["kind"] == t.LITERAL) & (c["dt"] == x.dt) & (c["lex"] == x.lex)
    return (c["lex"] == x.lex) & (F.lower(c["lang"]) == x.lang.lower())
