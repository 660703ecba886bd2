"""N-Triples and N-Quads: line formats, read in parallel by the text reader.

Parsing is made of built-in columns (regular expressions), so files are split, filters run
where the lines are, and the same code serves ``readStream``. Blank nodes are renamed by
the file they come from. A line that isn't a statement is an error unless
``malformed="drop"``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import terms as t
from quern.sparql import ast as A

_IRI = r"<([^<>\"{}|^`\x00-\x20]*)>"
_BNODE = r"(_:[\w][\w.\-:]*[\w\-:]|_:\w)"
_LITERAL = r"\"((?:[^\"\\\n\r]|\\.)*)\"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>]*)>)?"
_SUBJECT, _OBJECT = rf"(?:{_IRI}|{_BNODE})", rf"(?:{_IRI}|{_BNODE}|{_LITERAL})"
STATEMENT = rf"^\s*{_SUBJECT}\s*{_IRI}\s*{_OBJECT}\s*(?:{_SUBJECT}\s*)?\.\s*(?:#.*)?$"
BLANK = r"^\s*(?:#.*)?$"


def unescaped(c: Column) -> Column:
    r"""Resolves \t \b \n \r \f \" \' \\ and code points."""
    hexed = F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<!\\)(?:\\\\)*(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})"), F.lit(1))), lambda e: F.struct(e.alias("raw"), F.decode(F.unhex(F.lpad(F.substring(e, 3, 8), 8, "0")), "UTF-32").alias("made")))
    points = F.aggregate(hexed, c, lambda s, e: F.replace(s, e["raw"], e["made"]))
    held = F.replace(points, F.lit("\\\\"), F.lit("\x00"))
    for raw, made in (("\\t", "\t"), ("\\b", "\b"), ("\\n", "\n"), ("\\r", "\r"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
        held = F.replace(held, F.lit(raw), F.lit(made))
    return F.when(c.contains("\\"), F.replace(held, F.lit("\x00"), F.lit("\\"))).otherwise(c)


def parsed(line: Column, scope: Column) -> list[Column]:
    """Terms s, p, o and g of a line."""
    part = lambda i: F.nullif(F.regexp_extract(line, STATEMENT, i), F.lit(""))
    renamed = lambda c: F.concat(F.lit("_:b"), F.substring(F.md5(scope), 1, 8), F.lit("_"), F.substring(c, 3, 1000))
    node = lambda iri, blank: F.coalesce(t.struct(t.IRI, unescaped(part(iri))), t.struct(t.BNODE, renamed(part(blank))))
    is_literal = part(4).isNull() & part(5).isNull()
    lang, dt = part(7), part(8)
    literal = t.struct(t.LITERAL, F.when(is_literal, unescaped(F.regexp_extract(line, STATEMENT, 6))), F.when(lang.isNotNull(), A.LANG_STRING).otherwise(F.coalesce(dt, F.lit(A.STRING))), lang)
    return [node(1, 2).alias("s"), t.struct(t.IRI, unescaped(part(3))).alias("p"), F.coalesce(node(4, 5), literal).alias("o"), node(9, 10).alias("g")]


def quads_from_lines(lines: DataFrame, line_col: str = "value", scope: Column | None = None, graph: str | None = None, malformed: str = "fail") -> DataFrame:
    line = F.col(line_col)
    rows = lines.where(~line.rlike(BLANK))
    good = line.rlike(STATEMENT)
    if malformed == "fail":
        rows = rows.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), line)).cast("boolean")))
    else:
        rows = rows.where(good)
    out = rows.select(*parsed(line, scope if scope is not None else F.lit("")))
    if graph is not None:
        out = out.withColumn("g", F.coalesce("g", t.to_term(t.Val("iri", F.lit(graph)))))
    return out.select(*(F.col(c).cast(t.TERM).alias(c) for c in "spog"))


def read_statements(spark: SparkSession, path: str | list[str], graph: str | None = None, malformed: str = "fail") -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    return quads_from_lines(lines, scope=F.col("_file"), graph=graph, malformed=malformed)


def stream_statements(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    lines = spark.readStream.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    return quads_from_lines(lines, scope=F.col("_file"), graph=graph, malformed="drop")


def statements(quads: DataFrame, named: bool = True) -> DataFrame:
    """Quads as lines of N-Quads (or N-Triples)."""
    cells = [t.ntriples(t.Val("term", F.col(c))) for c in ("spog" if named else "spo")]
    return quads.select(F.concat(F.concat_ws(" ", *cells), F.lit(" .")).alias("value"))


def write_statements(quads: DataFrame, path: str, named: bool = True, mode: str = "error") -> None:
    statements(quads, named).write.mode(mode).text(path)
