"""SELECT and ASK results as files: CSV, TSV, SPARQL XML and JSON, and the result-set vocabulary.

CSV is written by Spark's writer, in parallel. XML, JSON and Turtle results are single
documents made on the driver row by row from an iterator, for results that fit one file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import terms as t
from quern.sparql import ast as A

SRX = "http://www.w3.org/2005/sparql-results#"
RESULT_SET = "http://www.w3.org/2001/sw/DataAccess/tests/result-set#"


def csv_rows(terms: DataFrame) -> DataFrame:
    """Term columns as CSV text columns; an unbound value is ``UNBOUND``."""
    return terms.select(*(F.coalesce(F.col(c)["lex"], F.lit("UNBOUND")).alias(c) for c in terms.columns))


def write_csv(terms: DataFrame, path: str, mode: str = "error", separator: str = ",") -> None:
    csv_rows(terms).write.mode(mode).option("sep", separator).option("escape", '"').csv(path, header=True)


def csv_text(terms: DataFrame, header: bool = True) -> str:
    """The whole result as one CSV text."""

    def cell(x: str) -> str:
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n\r') else x

    lines = [",".join(terms.columns)] if header else []
    lines += [",".join(cell(x) for x in row) for row in csv_rows(terms).toLocalIterator()]
    return "".join(line + "\n" for line in lines)


def _binding(x: Row) -> str:
    if x.kind == t.IRI:
        return f"<uri>{escape(x.lex)}</uri>"
    if x.kind == t.BNODE:
        return f"<bnode>{escape(x.lex[2:])}</bnode>"
    tag = f" xml:lang={quoteattr(x.lang)}" if x.lang else f" datatype={quoteattr(x.dt)}" if x.dt and x.dt != A.STRING else ""
    return f"<literal{tag}>{escape(x.lex)}</literal>"


def srx_lines(terms: DataFrame) -> Iterator[str]:
    yield f'<?xml version="1.0"?>\n<sparql xmlns="{SRX}">\n'
    if terms.columns == ["ask"]:
        yield f"<head/>\n<boolean>{str(terms.first().ask).lower()}</boolean>\n</sparql>\n"
        return
    yield "<head>" + "".join(f"<variable name={quoteattr(c)}/>" for c in terms.columns) + "</head>\n<results>\n"
    for row in terms.toLocalIterator():
        yield "<result>" + "".join(f"<binding name={quoteattr(c)}>{_binding(x)}</binding>" for c, x in row.asDict().items() if x is not None) + "</result>\n"
    yield "</results>\n</sparql>\n"


def srj_text(terms: DataFrame) -> str:
    if terms.columns == ["ask"]:
        return json.dumps({"head": {}, "boolean": terms.first().ask})

    def value(x: Row) -> dict:
        out = {"type": ("uri", "bnode", "literal")[x.kind], "value": x.lex[2:] if x.kind == t.BNODE else x.lex}
        if x.lang:
            out["xml:lang"] = x.lang
        elif x.dt and x.dt != A.STRING:
            out["datatype"] = x.dt
        return out

    rows = [{c: value(x) for c, x in row.asDict().items() if x is not None} for row in terms.toLocalIterator()]
    return json.dumps({"head": {"vars": terms.columns}, "results": {"bindings": rows}}, ensure_ascii=False)


def result_set_turtle(terms: DataFrame) -> Iterator[str]:
    yield f"@prefix rs: <{RESULT_SET}> .\n"
    if terms.columns == ["ask"]:
        yield f"[] a rs:ResultSet ; rs:boolean {str(terms.first().ask).lower()} .\n"
        return
    yield "[] a rs:ResultSet"
    for c in terms.columns:
        yield f' ;\n  rs:resultVariable "{c}"'
    text = terms.select(*(t.ntriples(t.Val("term", F.col(c))).alias(c) for c in terms.columns))
    for row in text.toLocalIterator():
        cells = " ; ".join(f'rs:binding [ rs:variable "{c}" ; rs:value {x} ]' for c, x in row.asDict().items() if x is not None)
        yield f" ;\n  rs:solution [ {cells} ]"
    yield " .\n"


def read_srx(spark: SparkSession, text: str) -> DataFrame:
    """A result document as term columns, or the column ``ask``."""
    root = ElementTree.fromstring(text)
    if (b := root.find(f"{{{SRX}}}boolean")) is not None:
        return spark.createDataFrame([(b.text.strip() == "true",)], "ask boolean")
    names = [v.get("name") for v in root.iter(f"{{{SRX}}}variable")]
    rows = []
    for result in root.iter(f"{{{SRX}}}result"):
        row: dict[str, tuple] = {}
        for b in result:
            (x,) = list(b)
            kind = x.tag.rpartition("}")[2]
            lang = x.get("{http://www.w3.org/XML/1998/namespace}lang")
            value = x.text or ""
            row[b.get("name")] = (t.IRI, value, None, None) if kind == "uri" else (t.BNODE, "_:" + value, None, None) if kind == "bnode" else (t.LITERAL, value, A.LANG_STRING if lang else x.get("datatype") or A.STRING, lang)
        rows.append(tuple(row.get(n) for n in names))
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, t.TERM) for n in names]))


def read_srj(spark: SparkSession, text: str) -> DataFrame:
    data = json.loads(text)
    if "boolean" in data:
        return spark.createDataFrame([(data["boolean"],)], "ask boolean")
    names = data["head"]["vars"]

    def term(x: dict) -> tuple:
        if x["type"] == "uri":
            return (t.IRI, x["value"], None, None)
        if x["type"] == "bnode":
            return (t.BNODE, "_:" + x["value"], None, None)
        lang = x.get("xml:lang")
        return (t.LITERAL, x["value"], A.LANG_STRING if lang else x.get("datatype", A.STRING), lang)

    rows = [tuple(term(b[n]) if n in b else None for n in names) for b in data["results"]["bindings"]]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, t.TERM) for n in names]))
