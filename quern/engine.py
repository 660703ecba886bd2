"""The engine: rules, inputs, outputs and their options in one object.

    engine = Engine(spark, EngineConfig(unit="block"))
    engine.add_rules(rules_text)
    engine.add_input("events.trig")
    engine.run()
    engine.results("rule1").show()
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import terms as t
from quern.functions.registry import Context
from quern.session import Dataset
from quern.sources import ntriples, results, turtle
from quern.sources.quads import QuadSource
from quern.sparql import ast as A
from quern.sparql.parser import parse
from quern.storage import settle
from quern.streaming.rules import OPERATIONS, Rule, RuleEngine

FORMATS = {"trig": "trig", "ttl": "turtle", "turtle": "turtle", "nt": "nt", "n-triples": "nt", "nq": "nq", "n-quads": "nq"}
UNITS = ("single", "block", "document")
EVENT = ("add", "execute", "remove", "execute")


@dataclass
class EngineConfig:
    """unit: what is processed at a time: ``single`` quads, ``block``s or a ``document``.

    operations: what is done with each unit, a list or text like ``add:execute``; ``event`` is
    short for add:execute:remove:execute.
    """

    unit: str = "single"
    operations: str | tuple[str, ...] = ("add", "execute")
    policy: str = "repeat-first"
    allow_removal: bool = True
    base: str = ""
    graph: str | None = None
    prefixes: dict[str, str] = field(default_factory=dict)
    prefix_encoding: bool = False
    parity: bool = False
    warn_on_errors: bool = False
    report_sizes: bool = False
    max_rounds: int = 10_000
    name: str = "engine"

    def operation_list(self) -> tuple[str, ...]:
        ops = self.operations.split(":") if isinstance(self.operations, str) else list(self.operations)
        flat = [x for o in ops for x in (EVENT if o == "event" else (o,))]
        if bad := [o for o in flat if o not in OPERATIONS]:
            raise ValueError(f"unknown operation {bad[0]}")
        return tuple(flat)


def format_of(path: str) -> str:
    suffix = os.path.basename(path.rstrip("/")).rpartition(".")[2].lower()
    if suffix not in FORMATS:
        raise ValueError(f"can't tell the format of {path}")
    return FORMATS[suffix]


def read_rdf(spark: SparkSession, path: str, format: str | None = None, base: str = "", graph: str | None = None) -> DataFrame:
    """Quads of a file with file, block_id and seq (null where lines are read in parallel)."""
    kind = FORMATS[format] if format else format_of(path)
    if kind in ("nt", "nq"):
        return ntriples.read_statements(spark, path, graph)
    return turtle.read_turtle(spark, path, base, graph, trig=kind == "trig")


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        c = self.config
        if c.unit not in UNITS:
            raise ValueError(f"unknown unit {c.unit}")
        self.ctx = Context(base=c.base, parity=c.parity)
        self.services: dict[str, object] = {}
        self.rules = RuleEngine(spark, self.ctx, c.operation_list(), c.policy, c.allow_removal, c.max_rounds, self.services, self.read, report_sizes=c.report_sizes)
        self.inputs: list[DataFrame] = []
        self.listeners: list[Engine] = []
        self.prefixes = dict(c.prefixes)
        self.status: list[str] = []

    # -- set-up ------------------------------------------------------------------------------

    def register_function(self, iri: str, function: Callable[..., Column], returns: str = "string") -> None:
        """``function`` takes columns (numbers as numbers, all else as text) and returns one of
        the kind ``returns``; it can be made of built-ins or be a ``pandas_udf``."""
        self.ctx.register(iri, lambda _, *args: t.Val(returns, function(*(t.number(a) if a.kind in t.NUMERIC else t.lex(a) for a in args))))

    def register_service(self, iri: str, source: object) -> None:
        self.services[iri] = source

    def add_rules(self, text: str, base: str | None = None) -> list[Rule]:
        operations = parse(text, base or self.config.base, self.prefixes)
        for op in operations:
            if isinstance(op, A.Query) and (op.from_ or op.from_named):
                self.status.append("FROM is left out of standing rules")
        return self.rules.add_rules(operations)

    def add_rules_file(self, path: str, base: str | None = None) -> list[Rule]:
        lines = self.spark.read.text(path, wholetext=True).collect()
        return self.add_rules(lines[0].value if lines else "", base)

    def read(self, path: str, format: str | None = None) -> DataFrame:
        return read_rdf(self.spark, path, format, self.config.base, self.config.graph)

    def add_input(self, source: str | DataFrame, format: str | None = None) -> None:
        self.inputs.append(self.read(source, format) if isinstance(source, str) else source)

    def add_listener(self, other: Engine) -> None:
        """What CONSTRUCT rules give becomes a unit of the other engine's input."""
        self.listeners.append(other)

    # -- running -----------------------------------------------------------------------------

    def units(self) -> list[DataFrame]:
        """Inputs cut into units; several inputs take turns."""
        cut = []
        for df in self.inputs:
            if self.config.unit == "document":
                cut.append([df])
                continue
            by = "seq" if self.config.unit == "single" else "block_id"
            if by not in df.columns:
                df = df.withColumn(by, F.monotonically_increasing_id())
            df = settle(df, "input")
            keys = [r[0] for r in df.select(*([by] if "file" not in df.columns else [F.struct("file", by)])).distinct().toLocalIterator()]
            keys.sort(key=lambda k: tuple(k) if isinstance(k, tuple) else (k,))
            cut.append([df.where(F.col(by) == k if not isinstance(k, tuple) else (F.col("file") == k[0]) & (F.col(by) == k[1])) for k in keys])
        turns = max(map(len, cut), default=0)
        return [units[i] for i in range(turns) for units in cut if i < len(units)]

    def run(self) -> None:
        self._sending(self.rules.execute)
        for unit in self.units():
            self.process(unit)
        self.inputs = []

    def process(self, unit: DataFrame) -> None:
        self._sending(lambda: self.rules.process(unit))

    def _sending(self, action: Callable[[], None]) -> None:
        """Listeners get what CONSTRUCT rules give while ``action`` runs, not what they gave before."""
        rounds, fired = self.rules.rounds, {r.name: r.fired for r in self.rules.rules}
        action()
        for r in self.rules.rules:
            if self.listeners and isinstance(r.operation, A.Query) and r.operation.form == "CONSTRUCT" and r.fired > fired.get(r.name, 0):
                made = self.rules.output(r, with_round=True).where(F.col("round_") > rounds).drop("round_")
                for other in self.listeners:
                    other.process(made)

    # -- results -----------------------------------------------------------------------------

    @property
    def quads(self) -> DataFrame:
        return self.rules.quads

    def dataset(self) -> Dataset:
        """The quads as they are now, for ad-hoc queries."""
        return Dataset(QuadSource(self.quads), self.config.base, self.prefixes, self.services, ctx=self.ctx)

    def results(self, rule: str) -> DataFrame | None:
        return self.rules.output(rule)

    def csv(self, rule: str) -> str:
        """CSV text of a SELECT rule's output in the order of execution."""
        found = self.rules.output(rule, with_round=True)
        if found is None:
            return ""
        ordered = found.orderBy("round_").drop("round_") if "round_" in found.columns else found
        return results.csv_text(ordered)

    def run_sequential(self, text: str) -> None:
        """An update script in the classical reading: each operation once, in order."""
        from quern.operators.update import run_sequential

        operations = parse(text, self.config.base, self.prefixes)
        make = lambda quads: self.rules.compiler().__class__(QuadSource(quads), self.ctx, self.services)
        after = settle(run_sequential(self.quads, operations, make, self.read), "quads")
        self.rules.change(self.quads.subtract(after), after.subtract(self.quads))

    def report(self) -> list[tuple[str, str, int, int]]:
        """(rule, form, times run, present matches)."""
        form = lambda op: op.form if isinstance(op, A.Query) else op.kind
        return [(r.name, form(r.operation), r.fired, r.matches.count() if r.matches is not None else 0) for r in self.rules.rules]


class Registry:
    """Engines by name, for rules and programs that set up others."""

    def __init__(self, spark: SparkSession):
        self.spark, self.engines = spark, {}

    def create(self, name: str, config: EngineConfig | None = None) -> Engine:
        self.engines[name] = Engine(self.spark, config or EngineConfig(name=name))
        return self.engines[name]

    def get(self, name: str) -> Engine:
        return self.engines[name]

