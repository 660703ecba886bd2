"""Turtle and TriG: parser, Spark data source and writer.

These formats can't be split, so a file is one task: the data source ``quern_rdf`` plans a
partition for each file and yields Arrow batches of quads with the file, the number of the
block and of the statement's quad (``block_id`` counts TriG blocks and, outside of them,
Turtle statements). Blank nodes are named by file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern import terms as t
from quern.sparql import ast as A
from quern.sparql.lexer import SparqlSyntaxError
from quern.sparql.parser import Parser

SCHEMA = f"s {t.TERM_DDL}, p {t.TERM_DDL}, o {t.TERM_DDL}, g {t.TERM_DDL}, file string, block_id bigint, seq bigint"
_TERM = pa.struct([("kind", pa.int8()), ("lex", pa.string()), ("dt", pa.string()), ("lang", pa.string())])
BATCH_ROWS = 10_000


class TurtleParser(Parser):
    """Statements of Turtle or TriG as (block number, quad)."""

    def __init__(self, text: str, base: str = "", prefixes: dict[str, str] | None = None, trig: bool = True):
        super().__init__(text, base, prefixes)
        self.in_template, self.trig = True, trig

    def directive(self) -> bool:
        at = self.now.kind == "lang" and self.now.text.lower() in ("@prefix", "@base") and self.now.text[1:].upper()
        if not at and not self.is_word("PREFIX", "BASE"):
            return False
        kind = at or self.now.text.upper()
        self.step()
        if kind == "PREFIX":
            if self.now.kind != "pname" or not self.now.text.endswith(":"):
                self.fail("a prefix")
            prefix = self.step().text[:-1]
            if self.now.kind != "iri":
                self.fail("an IRI")
            self.prefixes[prefix] = self.resolve(self.step().text[1:-1])
        else:
            if self.now.kind != "iri":
                self.fail("an IRI")
            self.base = self.resolve(self.step().text[1:-1])
        if at:
            self.need(".")
        return True

    def statements(self) -> Iterator[tuple[int, A.Quad]]:
        block = 0
        while self.now.kind != "end":
            if self.directive():
                continue
            graph = None
            keyword = self.trig and self.word("GRAPH")
            named = self.tokens[self.at + 1].text == "{" or self.is_sign("[") and self.tokens[self.at + 2].text == "{"
            if keyword or self.trig and (named or self.is_sign("{")):
                if not self.is_sign("{"):
                    graph = self.term()
                    if not isinstance(graph, A.Iri | A.BNode):
                        self.fail("a graph name")
                elif keyword:
                    self.fail("a graph name")
                self.need("{")
                while not self.sign("}"):
                    yield from ((block, q) for q in self.subject(graph))
                    if not self.is_sign("}"):
                        self.need(".")
            else:
                yield from ((block, q) for q in self.subject(None))
                self.need(".")
            block += 1

    def subject(self, graph: object) -> list[A.Quad]:
        triples: list[A.Triple] = []
        self.triples(triples, False)
        for x in triples:
            if isinstance(x.s, A.Lit) or not isinstance(x.p, A.Iri):
                raise SparqlSyntaxError("a subject or predicate can't be a literal")
            if A.variables(x):
                raise SparqlSyntaxError("data can't have variables")
        return [A.Quad(x.s, x.p, x.o, graph) for x in triples]


def parse_quads(text: str, base: str = "", trig: bool = True, prefixes: dict[str, str] | None = None) -> Iterator[tuple[int, A.Quad]]:
    return TurtleParser(text, base, prefixes, trig).statements()


def _cell(x: object, scope: str) -> dict | None:
    if x is None:
        return None
    if isinstance(x, A.Iri):
        return {"kind": t.IRI, "lex": x.value, "dt": None, "lang": None}
    if isinstance(x, A.BNode):
        return {"kind": t.BNODE, "lex": f"_:b{scope}_{x.label}", "dt": None, "lang": None}
    return {"kind": t.LITERAL, "lex": x.lex, "dt": x.dt, "lang": x.lang}


def quad_batches(text: str, name: str, base: str = "", graph: str | None = None, trig: bool = True) -> Iterator[pa.RecordBatch]:
    scope = hashlib.md5(name.encode()).hexdigest()[:8]
    target = A.Iri(graph) if graph else None
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = [_TERM] * 4 + [pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["s", "p", "o", "g", "file", "block_id", "seq"])

    for seq, (block, q) in enumerate(parse_quads(text, base, trig)):
        rows.append((*(_cell(x, scope) for x in (q.s, q.p, q.o, q.g or target)), name, block, seq))
        if len(rows) >= BATCH_ROWS:
            yield batch()
            rows = []
    if rows:
        yield batch()


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class RdfFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class RdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split("\n")
        self.base, self.graph = options.get("base", ""), options.get("graph")
        self.trig = options.get("trig", "true") == "true"

    def partitions(self):
        return [RdfFile(p) for p in self.paths]

    def read(self, part: RdfFile):
        store, path = _open(part.path)
        with store.open_input_stream(path) as f:
            data = f.read()
        yield from quad_batches(data.decode("utf-8"), part.path, self.base or part.path, self.graph, self.trig)


class RdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_rdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RdfReader:
        return RdfReader(self.options)


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files of a path or glob, by Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    if not found:
        raise FileNotFoundError(path)
    out = []
    for status in found:
        if status.isDirectory():
            out += [str(x.getPath()) for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(status.getPath()) if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
        else:
            out.append(str(status.getPath()))
    return sorted(out)


def read_turtle(spark: SparkSession, path: str | list[str], base: str = "", graph: str | None = None, trig: bool = True) -> DataFrame:
    """Quads with file, block_id and seq."""
    paths = [f for p in ([path] if isinstance(path, str) else path) for f in files_of(spark, p)]
    spark.dataSource.register(RdfSource)
    reader = spark.read.format("quern_rdf").option("base", base).option("trig", str(trig).lower())
    if graph:
        reader = reader.option("graph", graph)
    return reader.option("path", "\n".join(paths)).load()


# Writing -------------------------------------------------------------------------------------


def prefixed(c, prefixes: dict[str, str]):
    """An IRI column as a prefixed name under the longest fitting expansion, else in <>."""
    out = F.concat(F.lit("<"), c, F.lit(">"))
    for name, iri in sorted(prefixes.items(), key=lambda x: len(x[1])):
        local = F.substring(c, len(iri) + 1, 100_000)
        out = F.when(c.startswith(iri) & local.rlike(r"^(\w([\w\-]*[\w])?)?$"), F.concat(F.lit(name + ":"), local)).otherwise(out)
    return out


def turtle_blocks(quads: DataFrame, prefixes: dict[str, str] | None = None, trig: bool = True) -> DataFrame:
    """One text ``value`` for each subject (and graph), the quads once each and sorted."""
    prefixes = prefixes or {}

    def node(name: str):
        c = F.col(name)
        literal = t.ntriples(t.Val("term", c))
        return F.when(c["kind"] == t.IRI, prefixed(c["lex"], prefixes)).otherwise(literal)

    predicate = F.when(F.col("p")["lex"] == A.RDF + "type", "a").otherwise(node("p"))
    rows = quads.select(node("g").alias("g"), node("s").alias("s"), predicate.alias("p"), node("o").alias("o")).distinct()
    objects = rows.groupBy("g", "s", "p").agg(F.array_join(F.sort_array(F.collect_list("o")), ", ").alias("o"))
    subjects = objects.groupBy("g", "s").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "p", "o"))), " ;\n    ").alias("po"))
    body = F.concat("s", F.lit(" "), "po", F.lit(" ."))
    if trig:
        body = F.when(F.col("g").isNotNull(), F.concat(F.lit("GRAPH "), "g", F.lit(" { "), body, F.lit(" }"))).otherwise(body)
    return subjects.orderBy(F.col("g").asc_nulls_first(), "s").select(body.alias("value"))


def prefix_header(prefixes: dict[str, str]) -> str:
    return "".join(f"PREFIX {n}: <{i}>\n" for n, i in prefixes.items())


def write_turtle(quads: DataFrame, path: str, prefixes: dict[str, str] | None = None, trig: bool = True, mode: str = "error") -> None:
    """A folder of text files. Each block declares the prefixes it may use, so that every file
    is complete however the blocks are dealt out."""
    prefixes = prefixes or {}
    blocks = turtle_blocks(quads, prefixes, trig)
    if prefixes:
        blocks = blocks.select(F.concat(F.lit(prefix_header(prefixes)), "value").alias("value"))
    blocks.write.mode(mode).text(path)
