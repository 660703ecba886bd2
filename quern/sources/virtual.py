"""Tables as RDF graphs: the source for relational data.

Every row is a subject ``<subject prefix><keys>`` of class ``<class>``; every column is a
predicate; a foreign key is a further predicate whose object is another table's subject.
NULL means that the triple is absent. Patterns that share a subject (a star) become one scan
of the columns they name instead of self-joins; constants become filters on native
columns, so both reach the Parquet reader.

A table can be spread over named graphs by one of its columns (``graph_column``): its rows
are then in graph ``<graph prefix><value>`` and not in the default graph.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import terms as t
from quern.plans.relation import Relation, VarType, iri_of, none, quoted, union, unit
from quern.sources.quads import DEFAULT
from quern.sparql import ast as A
from quern.terms import Val

RDF_TYPE = A.RDF + "type"
TABLE_NS, COLUMN_NS, LINK_NS, CLASS_NS, GRAPH_NS = "urn:t:", "urn:c:", "urn:r:", "urn:t:", "urn:g:"


@dataclass
class Table:
    """How a table is seen as RDF."""

    name: str
    df: DataFrame
    keys: list[str]
    class_iri: str
    prefix: str
    links: dict[str, tuple[list[str], str]] = field(default_factory=dict)  # predicate -> (columns, object prefix)
    columns: dict[str, str] = field(default_factory=dict)  # predicate -> column
    graph_column: str | None = None
    graph_prefix: str = GRAPH_NS

    def __post_init__(self):
        if not self.columns:
            self.columns = {COLUMN_NS + c: c for c in self.df.columns if _kind(self.df.schema[c].dataType)}

    def predicates(self) -> list[str]:
        return [RDF_TYPE, *self.columns, *self.links]


def _kind(kind: T.DataType) -> str | None:
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "integer"
    return {T.StringType: "string", T.DoubleType: "double", T.FloatType: "float", T.BooleanType: "boolean", T.TimestampNTZType: "dateTime", T.TimestampType: "dateTime", T.DateType: "dateTime", T.DecimalType: "decimal"}.get(type(kind))


class VirtualSource:
    def __init__(self, spark: SparkSession, tables: list[Table], default_graphs: list[str] | None = None, named_graphs: list[str] | None = None):
        self.spark, self.tables = spark, tables
        self.default_graphs, self.named_graphs = default_graphs, named_graphs

    def dataset(self, default: list[str], named: list[str]) -> VirtualSource:
        return VirtualSource(self.spark, self.tables, default, named) if default or named else self

    def unit(self) -> Relation:
        return unit(self.spark)

    # -- patterns ----------------------------------------------------------------------------

    def bgp(self, triples: list[A.Triple], graph: object = DEFAULT) -> list[Relation]:
        """One relation for each star (patterns of one subject)."""
        stars: dict[object, list[A.Triple]] = {}
        for x in triples:
            stars.setdefault(x.s, []).append(x)
        return [self.star(s, patterns, graph) for s, patterns in stars.items()]

    def star(self, subject: object, patterns: list[A.Triple], graph: object) -> Relation:
        wanted = list(dict.fromkeys(n for n in A.variables([subject, patterns, graph if isinstance(graph, A.Var) else None])))
        found = []
        for table in self.tables:
            if (base := self.base(table, graph)) is None:
                continue
            predicates = set(table.predicates())
            if any(isinstance(x.p, A.Iri) and x.p.value not in predicates for x in patterns):
                continue
            if isinstance(subject, A.Iri) and not subject.value.startswith(table.prefix):
                continue
            if isinstance(subject, A.Lit):
                continue
            if (r := self.scan(table, base, subject, patterns, graph)) is not None:
                found.append(r)
        if not found:
            return none(self.spark, {n: VarType("term") for n in wanted})
        return found[0] if len(found) == 1 else union(found)

    def base(self, table: Table, graph: object) -> DataFrame | None:
        """Rows of the table in a graph; None if there can't be any."""
        g = table.graph_column
        if graph is DEFAULT:
            if self.default_graphs is None:
                return table.df if g is None else None
            values = [x[len(table.graph_prefix) :] for x in self.default_graphs if x.startswith(table.graph_prefix)]
            return table.df.where(F.col(quoted(g)).isin(values)) if g is not None and values else None
        if g is None:
            return None
        rows = table.df.where(F.col(quoted(g)).isNotNull())
        if self.named_graphs is not None:
            rows = rows.where(F.col(quoted(g)).isin([x[len(table.graph_prefix) :] for x in self.named_graphs if x.startswith(table.graph_prefix)]))
        if isinstance(graph, A.Iri):
            if not graph.value.startswith(table.graph_prefix):
                return None
            rows = rows.where(F.col(quoted(g)) == graph.value[len(table.graph_prefix) :])
        return rows

    def scan(self, table: Table, df: DataFrame, subject: object, patterns: list[A.Triple], graph: object) -> Relation | None:
        """The star over one table; None if a constant rules it out."""
        bound: dict[str, tuple[VarType, list]] = {}  # variable -> type, source columns
        conditions = []

        def equal(left: tuple[VarType, list], right: tuple[VarType, list]):
            (x, xs), (y, ys) = left, right
            if x.template is not None and (x.template, x.arity) == (y.template, y.arity):
                return [a == b for a, b in zip(xs, ys)]
            if x.kind != y.kind:
                return None
            return [_text(x, xs) == _text(y, ys)]

        def bind(x: object, kind: VarType, cols: list) -> bool:
            if isinstance(x, A.Var):
                if x.name not in bound:
                    bound[x.name] = (kind, cols)
                    return True
                if (more := equal(bound[x.name], (kind, cols))) is None:
                    return False
                conditions.extend(more)
                return True
            if (more := _constant(x, kind, cols)) is None:
                return False
            conditions.extend(more)
            return True

        col = lambda c: F.col(quoted(c))
        if not bind(subject, VarType("iri", table.prefix, len(table.keys)), [col(c) for c in table.keys]):
            return None
        if isinstance(graph, A.Var):
            bind(graph, VarType("iri", table.graph_prefix, 1), [col(table.graph_column)])
        variable = [x for x in patterns if not isinstance(x.p, A.Iri)]
        for x in patterns:
            if not isinstance(x.p, A.Iri):
                continue
            p = x.p.value
            if p == RDF_TYPE:
                if isinstance(x.o, A.Iri) and x.o.value != table.class_iri:
                    return None
                if not bind(x.o, VarType("iri"), [F.lit(table.class_iri)]):
                    return None
                continue
            if p in table.links:
                columns, prefix = table.links[p]
                kind, cols = VarType("iri", prefix, len(columns)), [col(c) for c in columns]
            else:
                c = table.columns[p]
                kind, cols = VarType(_kind(df.schema[c].dataType)), [_native(df, c)]
                columns = [c]
            for c in columns:
                df = df.where(col(c).isNotNull())
            if not bind(x.o, kind, cols):
                return None
        if len(variable) == 1:
            df = self.unpivoted(table, df)
            x = variable[0]
            if not bind(x.p, VarType("iri"), [F.col("_p")]) or not bind_term(x.o, bound, conditions):
                return None
        elif variable:
            raise ValueError("a star with two variable predicates over tables")
        for c in conditions:
            df = df.where(c)
        out, types = [], {}
        for n, (kind, cols) in bound.items():
            types[n] = kind
            names = [f"k{i}_{n}" for i in range(kind.arity)] if kind.template is not None else [f"v_{n}"]
            out += [c.cast("bigint").alias(a) if kind.template is None and kind.kind == "integer" else c.alias(a) for c, a in zip(cols, names)]
        return Relation(df.select(*out or [F.lit(True).alias("_unit")]), types)

    def unpivoted(self, table: Table, df: DataFrame) -> DataFrame:
        """A row for each triple of a row, from one scan: _p and the term _o."""
        pairs = [F.struct(F.lit(RDF_TYPE).alias("p"), t.to_term(Val("iri", F.lit(table.class_iri))).alias("o"))]
        for p, c in table.columns.items():
            pairs.append(F.struct(F.lit(p).alias("p"), t.to_term(Val(_kind(df.schema[c].dataType), _native(df, c))).alias("o")))
        for p, (columns, prefix) in table.links.items():
            pairs.append(F.struct(F.lit(p).alias("p"), t.to_term(Val("iri", iri_of(prefix, [F.col(quoted(c)) for c in columns]))).alias("o")))
        rows = df.withColumn("_po", F.explode(F.array(*pairs)))
        return rows.withColumns({"_p": F.col("_po.p"), "_o": F.col("_po.o")}).where("_o is not null")

    def nodes(self, graph: object, name: str) -> Relation:
        every = self.star(A.Var("_:s"), [A.Triple(A.Var("_:s"), A.Var("_:p"), A.Var(name))], graph)
        keep = [name, *([graph.name] if isinstance(graph, A.Var) else [])]
        subjects = self.star(A.Var(name), [A.Triple(A.Var(name), A.Iri(RDF_TYPE), A.Var("_:c"))], graph)
        return union([every.keep(keep).as_kind(name, "term"), subjects.keep(keep).as_kind(name, "term")]).distinct()

    def graphs(self, name: str) -> Relation:
        found = [self.scan(x, rows, A.Var("_:s"), [], A.Var(name)).keep([name]).distinct() for x in self.tables if (rows := self.base(x, A.Var(name))) is not None]
        return union(found) if found else none(self.spark, {name: VarType("iri")})

    def describe(self, resources: Relation, name: str) -> DataFrame:
        every = self.star(A.Var(name), [A.Triple(A.Var(name), A.Var("_:p"), A.Var("_:o"))], DEFAULT)
        from quern.operators.joins import join

        kept = join(every, resources.keep([name]).distinct(), "left_semi")
        return kept.df.select(t.to_term(kept.val(name)).alias("s"), t.to_term(kept.val("_:p")).alias("p"), t.to_term(kept.val("_:o")).alias("o"), F.lit(None).cast(t.TERM).alias("g"))


def bind_term(x: object, bound: dict, conditions: list) -> bool:
    o = F.col("_o")
    if isinstance(x, A.Var):
        if x.name in bound:
            kind, cols = bound[x.name]
            conditions.append(t.to_term(Val(kind.kind, _text(kind, cols))) == o)
        else:
            bound[x.name] = (VarType("term"), [o])
    else:
        conditions.append(o == t.to_term(t.constant(x)))
    return True


def _text(kind: VarType, cols: list):
    return iri_of(kind.template, cols) if kind.template is not None else cols[0]


def _native(df: DataFrame, c: str):
    """The column in the type that its kind has."""
    kind = df.schema[c].dataType
    column = F.col(quoted(c))
    if isinstance(kind, T.TimestampType):
        return F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(column, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    if isinstance(kind, T.DateType):
        return column.cast("timestamp_ntz")
    if isinstance(kind, T.DecimalType):
        return column.cast("double")
    return column


def _constant(x: object, kind: VarType, cols: list) -> list | None:
    """Conditions for a column to be the constant; None if it can't be."""
    if isinstance(x, A.Iri):
        if kind.kind != "iri":
            return None
        if kind.template is None:
            return [cols[0] == x.value]
        if not x.value.startswith(kind.template):
            return None
        parts = x.value[len(kind.template) :].split("/")
        if len(parts) != kind.arity:
            return [iri_of(kind.template, cols) == x.value]
        out = []
        for part, c in zip(parts, cols):
            whole = part.lstrip("-").isdigit() and str(int(part)) == part and -(2**63) <= int(part) < 2**63
            out.append(c == (int(part) if whole else part))
        return out
    if isinstance(x, A.Lit):
        v = t.constant(x)
        if v.kind != kind.kind and not (kind.kind == "dateTime" and x.dt == A.DATETIME):
            return None
        if kind.kind == "dateTime":
            return [cols[0] == t.instant(v)]
        return [cols[0] == v.col]
    return None


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None, graph_columns: dict[str, str] | None = None) -> VirtualSource:
    """The Parquet tables below ``sf_dir`` under the direct mapping of ``KEYS`` and ``LINKS``."""
    tables = []
    for name in names or list(KEYS):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        links = {LINK_NS + link: (cols, TABLE_NS + target + "/") for link, cols, target in LINKS.get(name, [])}
        tables.append(Table(name, df, KEYS[name], CLASS_NS + name.capitalize(), TABLE_NS + name + "/", links, graph_column=(graph_columns or {}).get(name)))
    return VirtualSource(spark, tables)


KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], "events": ["event_id"], "documents": ["doc_id"],
    "labels": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"],
}
LINKS = {
    "nation": [("region", ["n_regionkey"], "region")], "customer": [("nation", ["c_nationkey"], "nation")], "supplier": [("nation", ["s_nationkey"], "nation")],
    "orders": [("customer", ["o_custkey"], "customer")], "lineitem": [("order", ["l_orderkey"], "orders"), ("part", ["l_partkey"], "part"), ("supplier", ["l_suppkey"], "supplier")],
    "events": [("user", ["user_id"], "customer")], "labels": [("document", ["doc_id"], "documents")],
}
