"""RDF terms as Spark columns.

A variable or expression is a ``Val``: a column with a static kind. Kinds whose type is
known at compile time are plain Spark columns, so that joins, filters and aggregates on them
stay native and reach the scan; ``term`` is a struct for values whose type varies by row.

  iri, string: STRING   bnode: STRING with ``_:``   integer: BIGINT   decimal, double: DOUBLE
  float: FLOAT   boolean: BOOLEAN   dateTime: TIMESTAMP_NTZ in UTC
  term: STRUCT<kind TINYINT, lex STRING, dt STRING, lang STRING>

An unbound variable and an expression error are NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sparql import ast as A

IRI, BNODE, LITERAL = 0, 1, 2
TERM = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("lex", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("lang", T.StringType())])
TERM_DDL = TERM.simpleString()
QUAD = T.StructType([T.StructField(c, TERM) for c in "spog"])
SPARK_TYPES = {"iri": "string", "string": "string", "bnode": "string", "integer": "bigint", "decimal": "double", "double": "double", "float": "float", "boolean": "boolean", "dateTime": "timestamp_ntz", "term": TERM_DDL}
DATATYPES = {"string": A.STRING, "integer": A.INTEGER, "decimal": A.DECIMAL, "double": A.DOUBLE, "float": A.FLOAT, "boolean": A.BOOLEAN, "dateTime": A.DATETIME}
NUMERIC = ("integer", "decimal", "float", "double")
#: The datatypes that XML Schema derives from integer.
INTEGER_TYPES = [A.XSD + n for n in ("integer", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte", "nonNegativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "positiveInteger")]
NUMERIC_TYPES = [*INTEGER_TYPES, A.DECIMAL, A.FLOAT, A.DOUBLE]
_DATETIME = r"^(-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?)(Z|[+-]\d\d:\d\d)?$"


@dataclass(frozen=True)
class Val:
    kind: str
    col: Column


def lit(value: str) -> Column:
    return F.lit(value)


def null(kind: str = "term") -> Val:
    return Val(kind, F.lit(None).cast(SPARK_TYPES[kind]))


def struct(kind: Column | int, lex: Column, dt: Column | str | None = None, lang: Column | None = None) -> Column:
    """A term, NULL where ``lex`` is."""
    as_col = lambda x, t: (F.lit(x) if not isinstance(x, Column) else x).cast(t)
    made = F.struct(as_col(kind, "tinyint").alias("kind"), lex.alias("lex"), as_col(dt, "string").alias("dt"), as_col(lang, "string").alias("lang"))
    return F.when(lex.isNotNull(), made)


def decimal_text(c: Column) -> Column:
    """A DOUBLE as xsd:decimal: no exponent, no closing zeros."""
    fixed = c.try_cast("decimal(38,15)").cast("string")
    return F.when(fixed.contains("."), F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", ".0")).otherwise(fixed)


def datetime_text(c: Column) -> Column:
    """Canonical dateTime in UTC."""
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", ""), F.lit("Z"))


def lex(v: Val) -> Column:
    """STR(v)."""
    if v.kind == "term":
        return v.col["lex"]
    if v.kind == "decimal":
        return decimal_text(v.col)
    if v.kind == "dateTime":
        return datetime_text(v.col)
    return v.col if v.kind in ("iri", "string", "bnode") else v.col.cast("string")


def to_term(v: Val) -> Column:
    if v.kind == "term":
        return v.col
    if v.kind in ("iri", "bnode"):
        return struct(IRI if v.kind == "iri" else BNODE, v.col)
    return struct(LITERAL, lex(v), DATATYPES[v.kind])


def constant(t: A.Iri | A.Lit | A.BNode | None) -> Val:
    """The Val of a term of the query text."""
    if t is None:
        return null()
    if isinstance(t, A.Iri):
        return Val("iri", F.lit(t.value))
    if isinstance(t, A.BNode):
        return Val("bnode", F.lit("_:" + t.label))
    kind = next((k for k, dt in DATATYPES.items() if dt == t.dt), None)
    try:
        if t.lang is None and kind == "string":
            return Val("string", F.lit(t.lex))
        if kind == "integer" and -(2**63) <= int(t.lex) < 2**63:
            return Val("integer", F.lit(int(t.lex)).cast("bigint"))
        if kind in ("decimal", "double"):
            return Val(kind, F.lit(float(t.lex)))
        if kind == "float":
            return Val(kind, F.lit(float(t.lex)).cast("float"))
        if kind == "boolean" and t.lex in ("true", "false", "1", "0"):
            return Val("boolean", F.lit(t.lex in ("true", "1")))
    except ValueError:
        pass
    return Val("term", struct(LITERAL, F.lit(t.lex), t.dt, F.lit(t.lang)))


def constant_term(t: A.Iri | A.Lit | A.BNode) -> Column:
    """The exact term of the query text, its lexical form kept."""
    if isinstance(t, A.Lit):
        return struct(LITERAL, F.lit(t.lex), t.dt, F.lit(t.lang))
    return to_term(constant(t))


# Views: what a value is where it has a given type, else NULL; None where it can't have it. ----


def is_numeric(c: Column) -> Column:
    return c["dt"].isin(NUMERIC_TYPES)


def number(v: Val) -> Column | None:
    if v.kind in NUMERIC:
        return v.col
    if v.kind == "term":
        return F.when(is_numeric(v.col), v.col["lex"].try_cast("double"))
    return None


def text(v: Val) -> Column | None:
    """Of plain strings."""
    if v.kind == "string":
        return v.col
    return F.when(v.col["dt"] == A.STRING, v.col["lex"]) if v.kind == "term" else None


def truth(v: Val) -> Column | None:
    if v.kind == "boolean":
        return v.col
    if v.kind == "term":
        return F.when(v.col["dt"] == A.BOOLEAN, F.when(v.col["lex"].isin("true", "1"), True).when(v.col["lex"].isin("false", "0"), False))
    return None


def timestamp_of(c: Column) -> Column:
    """UTC TIMESTAMP_NTZ of the lexical form of a dateTime (without zone: UTC)."""
    base, zone = F.regexp_extract(c, _DATETIME, 1), F.regexp_extract(c, _DATETIME, 2)
    minutes = F.when(zone.isin("", "Z"), 0).otherwise(F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int"))
    minutes = F.when(zone.startswith("-"), -minutes).otherwise(minutes)
    return F.when(base != "", base).try_cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


def instant(v: Val) -> Column | None:
    if v.kind == "dateTime":
        return v.col
    return F.when(v.col["dt"] == A.DATETIME, timestamp_of(v.col["lex"])) if v.kind == "term" else None


def ebv(v: Val) -> Column:
    """Effective boolean value; NULL is an error."""
    if v.kind == "boolean":
        return v.col
    if v.kind == "string":
        return F.length(v.col) > 0
    if v.kind in NUMERIC:
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.kind in ("iri", "bnode", "dateTime"):
        return F.when(v.col.isNull(), F.lit(None)).cast("boolean")
    c = v.col
    n = c["lex"].try_cast("double")
    return F.when(c["dt"] == A.STRING, F.length(c["lex"]) > 0).when(c["dt"] == A.BOOLEAN, c["lex"].isin("true", "1")).when(is_numeric(c), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False)))


def order_key(v: Val) -> list[Column]:
    """Sort columns: unbound < blank nodes < IRIs < literals (numbers, times, others)."""
    if v.kind != "term":
        return [v.col]
    c = v.col
    rank = F.when(c.isNull(), 0).when(c["kind"] == BNODE, 1).when(c["kind"] == IRI, 2).when(number(v).isNotNull(), 3).when(instant(v).isNotNull(), 4).otherwise(5)
    return [rank, number(v), instant(v), c["lex"], c["dt"], c["lang"]]


def ntriples(v: Val) -> Column:
    """The term as N-Triples text."""
    c = to_term(v)
    body = c["lex"]
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(escaped))
    literal = F.concat(F.lit('"'), body, F.lit('"'), F.when(c["lang"].isNotNull(), F.concat(F.lit("@"), c["lang"])).when(c["dt"] != A.STRING, F.concat(F.lit("^^<"), c["dt"], F.lit(">"))).otherwise(""))
    return F.when(c["kind"] == IRI, F.concat(F.lit("<"), c["lex"], F.lit(">"))).when(c["kind"] == BNODE, c["lex"]).otherwise(literal)


def unified(vals: list[Val]) -> str:
    """The kind that can hold all of the values."""
    kinds = {v.kind for v in vals}
    return kinds.pop() if len(kinds) == 1 else "term"


def as_kind(v: Val, kind: str) -> Column:
    return v.col if v.kind == kind else to_term(v) if kind == "term" else v.col.cast(SPARK_TYPES[kind])
