"""Queries over one source: the batch entry point.

    graph = Dataset(register(spark, "/data"))
    graph.query("SELECT ?name { ?c a <urn:t:Customer> ; <urn:c:c_name> ?name }")
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import terms as t
from quern.functions.registry import Context
from quern.plans.compiler import Compiler
from quern.plans.relation import Relation
from quern.sparql import ast as A
from quern.sparql.parser import parse


@dataclass
class Dataset:
    """A source with what queries over it need.

    terms: how SELECT gives values: ``native`` (Spark types where the type is known, text
    elsewhere), ``term`` (structs) or ``ntriples`` (text with types and quotes).
    """

    source: object
    base: str = ""
    prefixes: dict[str, str] = field(default_factory=dict)
    services: dict[str, object] = field(default_factory=dict)
    terms: str = "native"
    parity: bool = False
    ctx: Context = None

    def __post_init__(self):
        if self.ctx is None:
            self.ctx = Context(base=self.base, parity=self.parity)

    def compiler(self, default: list[str] = (), named: list[str] = ()) -> Compiler:
        return Compiler(self.source.dataset(list(default), list(named)), self.ctx, self.services)

    def parse(self, text: str) -> list[A.Operation]:
        return parse(text, self.base, self.prefixes)

    def query(self, text: str) -> DataFrame:
        """The result of the text's one query: rows, the column ``ask``, or quads."""
        operations = self.parse(text)
        if len(operations) != 1 or not isinstance(operations[0], A.Query):
            raise ValueError("one query expected")
        return self.run(operations[0])

    def run(self, q: A.Query) -> DataFrame:
        compiler = self.compiler([x.value for x in q.from_], [x.value for x in q.from_named])
        if q.form == "SELECT":
            return rendered(compiler.select(q), self.terms)
        return {"ASK": compiler.ask, "CONSTRUCT": compiler.construct, "DESCRIBE": compiler.describe}[q.form](q)


def rendered(r: Relation, terms: str = "native") -> DataFrame:
    """One column for each variable, named by it."""
    out = []
    for n in r.vars:
        v = r.val(n)
        c = v.col if terms == "native" and v.kind != "term" else t.lex(v) if terms == "native" else t.to_term(v) if terms == "term" else t.ntriples(v)
        out.append(c.alias(n))
    return r.df.select(*out)


def quad_text(quads: DataFrame) -> DataFrame:
    """Quads as text columns: IRIs and literals by their lexical forms."""
    return quads.select(*(F.col(c)["lex"].alias(c) for c in "spog"))
