"""Command line: rules, inputs and outputs in the order in which they are given.

    python -m quern.cli -r rules.rq --input-blocks=events.trig --select-output=out.csv
"""

from __future__ import annotations

import os
import shlex
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import __doc__ as ABOUT
from quern.engine import FORMATS, Engine, EngineConfig, read_rdf
from quern.sources import results, turtle
from quern.sources.ntriples import statements
from quern.sparql import ast as A

VERSION = "0.1.0"
SHORT = {"h": "help", "v": "version", "f": "file", "r": "rules", "i": "input", "t": "input", "b": "base", "d": "directory", "g": "graph", "e": "execute", "n": "name"}
FLAGS = {"help", "version", "execute", "noexecute", "pause"}
INPUTS = {"input": None, "input-trig": "trig", "input-turtle": "ttl", "input-ttl": "ttl", "input-nq": "nq", "input-n-quads": "nq", "input-nt": "nt", "input-n-triples": "nt"}
COMBOS = {"input-single": "single", "input-blocks": "block", "input-document": "document", "input-events": "block"}
OUTPUT_KINDS = {"csv": "csv", "srx": "srx", "srj": "srj", "json": "srj", "ttl": "ttl", "turtle": "ttl", "trig": "trig", "nq": "nq", "n-quads": "nq", "nt": "nt", "n-triples": "nt"}
REPORTS = {"select", "construct", "modify", "all", "rete-add", "rete-remove", "queue", "rdf-operations", "execute"}
USAGE = """Options are of the form -o, -o VALUE or --option=VALUE and work in their order.
  --help --version --file=FILE (more options)
  --rules=FILE (-r)           rules; --base=IRI (-b) and --directory=DIR (-d) count from here on
  --input=FILE (-i, -t)       RDF by suffix; --input-trig|-turtle|-ttl|-nq|-n-quads|-nt|-n-triples=FILE
  --graph=IRI (-g)            graph of the triples that follow; 'default' for none
  --rdf-input-unit=single|block|document   --rdf-operations=add:execute|event|...
  --input-single|-blocks|-document|-events=FILE   unit and input in one
  --allow-rule-instance-removal=BOOL   --execute (-e)   --noexecute
  --ask-output[-ttl|-srx]=FILE   --select-output[-append|-csv|-srx|-ttl]=FILE
  --construct-output[-append|-trig|-ttl|-nq|-nt]=FILE
  --prefix-encoding=BOOL   --print-prefix-encodings=BOOL
  --report=KINDS   --report-sizes-file=FILE   --rete-html=FILE (plans of the rules)
  --warn-on-errors=BOOL   --verbose=KINDS   --name=NAME (-n)   --time=FILE   --pause
  --run-sparql-conformance-tests=MANIFEST[:NAME]
"""


class UsageError(ValueError):
    pass


def options(args: list[str]) -> list[tuple[str, str | None]]:
    """(name, value) in order; the options of a --file come in its place."""
    out, rest = [], list(args)
    while rest:
        arg = rest.pop(0)
        if arg.startswith("--"):
            name, eq, value = arg[2:].partition("=")
            value = value if eq else None
        elif arg.startswith("-") and arg[1:] in SHORT:
            name = SHORT[arg[1:]]
            value = None if name in FLAGS else rest.pop(0) if rest else None
        else:
            raise UsageError(f"unknown argument {arg}")
        if name not in FLAGS and value is None:
            raise UsageError(f"--{name} needs a value")
        if name == "file":
            with open(value, encoding="utf-8") as f:
                rest = shlex.split(f.read(), comments=True) + rest
            continue
        out.append((name, value))
    return out


def _bool(value: str) -> bool:
    if value.lower() not in ("true", "false"):
        raise UsageError("true or false expected")
    return value.lower() == "true"


class Session:
    """What the options set so far."""

    def __init__(self, spark: SparkSession, out: Callable[[str], object] = sys.stdout.write):
        self.spark, self.out, self.config, self.engine = spark, out, EngineConfig(), None
        self.directory, self.immediate, self.started, self.clock = "", True, time.time(), None
        self.outputs: dict[str, tuple[str, str, bool]] = {}  # form -> file, kind, append
        self.print_prefixes, self.reports, self.sizes_file, self.plan_file = True, set(), None, None
        self.waiting = False

    def get(self) -> Engine:
        if self.engine is None:
            self.engine = Engine(self.spark, self.config)
        return self.engine

    def path(self, value: str) -> str:
        return value if "://" in value or os.path.isabs(value) else os.path.join(self.directory, value)

    def apply(self, name: str, value: str | None) -> None:
        c = self.config
        if name in INPUTS:
            self.read(value, INPUTS[name])
        elif name in COMBOS:
            c.unit = COMBOS[name]
            if name == "input-events":
                self.operations("event")
            self.read(value, None)
        elif name == "rules":
            engine = self.get()
            engine.config.base = c.base
            with_base = "file://" + os.path.abspath(self.path(value)) if not c.base and "://" not in value else None
            engine.add_rules_file(self.path(value), with_base)
            if self.plan_file:
                self.write_plans()
        elif name == "base":
            c.base = value
        elif name == "directory":
            self.directory = value.removeprefix("file://")
        elif name == "graph":
            c.graph = None if value.lower() == "default" else value
        elif name == "rdf-input-unit":
            if value not in ("single", "block", "document"):
                raise UsageError(f"unknown unit {value}")
            c.unit = value
        elif name == "rdf-operations":
            self.operations(value)
        elif name == "allow-rule-instance-removal":
            c.allow_removal = _bool(value)
            self.get().rules.allow_removal = c.allow_removal
        elif name in ("execute", "noexecute"):
            self.immediate = name == "execute"
            self.maybe_run()
        elif name.startswith(("ask-output", "select-output", "construct-output")):
            form, _, kind = name.partition("-output")
            kind = kind.lstrip("-")
            suffix = OUTPUT_KINDS.get(value.rpartition(".")[2].lower(), "csv" if form == "select" else "trig" if form == "construct" else "srx")
            self.outputs[form] = (value, OUTPUT_KINDS.get(kind, suffix), kind == "append")
        elif name == "prefix-encoding":
            c.prefix_encoding = _bool(value)
        elif name == "print-prefix-encodings":
            self.print_prefixes = _bool(value)
        elif name == "report":
            self.reports = set(value.split(":"))
            if bad := [r for r in self.reports if r not in REPORTS and not r.rstrip("0123456789") in ("memory", "memories")]:
                raise UsageError(f"unknown report {bad[0]}")
        elif name == "report-sizes-file":
            self.sizes_file = value
            self.get().rules.report_sizes = True
        elif name == "rete-html":
            self.plan_file = value
        elif name == "warn-on-errors":
            c.warn_on_errors = _bool(value)
        elif name == "verbose":
            self.reports |= {"queue"}
        elif name == "name":
            c.name = value
        elif name == "time":
            self.clock = value
        elif name == "pause":
            input("Press enter to continue: ")
        elif name == "run-sparql-conformance-tests":
            self.conformance(value)
        else:
            raise UsageError(f"unknown option --{name}")

    def operations(self, value: str) -> None:
        self.config.operations = value
        self.get().rules.operations = self.config.operation_list()

    def read(self, value: str, format: str | None) -> None:
        if format is not None and format not in FORMATS:
            raise UsageError(f"unknown format {format}")
        engine = self.get()
        engine.config.unit = self.config.unit
        engine.add_input(read_rdf(self.spark, self.path(value), format, self.config.base, self.config.graph))
        self.waiting = True
        self.maybe_run()

    def maybe_run(self) -> None:
        if self.immediate and self.engine is not None and self.waiting:
            self.engine.run()
            self.waiting = False

    def conformance(self, value: str) -> None:
        from quern.conformance import run_manifest

        path, _, name = value.partition(":")
        for o in run_manifest(self.spark, path, name or None):
            self.out(f"{'passed' if o.passed else 'FAILED'} {o.kind} {o.name} {o.detail}\n")

    # -- output ------------------------------------------------------------------------------

    def finish(self) -> None:
        if self.engine is not None:
            self.engine.run()
        rules = self.engine.rules.rules if self.engine is not None else []
        for form in ("ask", "select", "construct"):
            chosen = [r for r in rules if isinstance(r.operation, A.Query) and r.operation.form.lower() == form]
            if chosen and (form in self.outputs or form == "select"):
                self.write(form, chosen)
        self.report(rules)
        if self.clock:
            self.put(self.clock, f"total,{time.time() - self.started:.3f}\n", False)

    def put(self, file: str, text: str, append: bool) -> None:
        if file == "-":
            self.out(text)
            return
        with open(file, "a" if append else "w", encoding="utf-8") as f:
            f.write(text)

    def write(self, form: str, rules: list) -> None:
        file, kind, append = self.outputs.get(form, ("-", "csv", False))
        text = ""
        for r in rules:
            df = self.engine.rules.output(r, with_round=True)
            if df is None:
                df = None if form == "construct" else self.spark.createDataFrame([], ", ".join(f"{n} struct<kind:tinyint,lex:string,dt:string,lang:string>" for n in [c[2:] for c in r.matches.columns if c.startswith("v_")]) or "x int")
                if df is None:
                    continue
            if "round_" in df.columns:
                df = df.orderBy("round_").drop("round_")
            header = not (append and file != "-" and os.path.exists(file))
            text += self.text(form, kind, df, header)
        self.put(file, text, append)

    def text(self, form: str, kind: str, df: DataFrame, header: bool) -> str:
        if form == "construct":
            prefixes = self.engine.prefixes if self.config.prefix_encoding else {}
            if kind in ("nq", "nt"):
                return "".join(r.value + "\n" for r in statements(df, kind == "nq").toLocalIterator())
            body = "".join(r.value + "\n" for r in turtle.turtle_blocks(df if kind == "trig" else df.where(F.col("g").isNull()), prefixes, kind == "trig").toLocalIterator())
            return (turtle.prefix_header(prefixes) if self.print_prefixes else "") + body
        if form == "ask":
            df = df.agg(F.coalesce(F.bool_or("ask"), F.lit(False)).alias("ask"))
        if kind == "srx":
            return "".join(results.srx_lines(df))
        if kind == "srj":
            return results.srj_text(df) + "\n"
        if kind == "ttl":
            return "".join(results.result_set_turtle(df))
        return str(df.first().ask).lower() + "\n" if form == "ask" else results.csv_text(df, header)

    def report(self, rules: list) -> None:
        forms = {"select": ("SELECT",), "construct": ("CONSTRUCT",), "modify": ("MODIFY", "DELETE WHERE", "INSERT DATA", "DELETE DATA")}
        wanted = {f for k, fs in forms.items() if k in self.reports or "all" in self.reports for f in fs}
        for name, form, fired, now in self.engine.report() if rules and wanted else []:
            if form in wanted:
                self.out(f"{name},{form},{fired},{now}\n")
        if self.sizes_file:
            self.put(self.sizes_file, "round,rule,matches\n" + "".join(f"{r},{n},{s}\n" for r, n, s in self.engine.rules.sizes), False)

    def write_plans(self) -> None:
        from html import escape

        engine = self.engine.rules
        parts = []
        for r in engine.rules:
            plan = engine._solutions(r).df._jdf.queryExecution().toString()
            parts.append(f"<h2>{escape(r.name)}</h2><pre>{escape(plan)}</pre>")
        with open(self.plan_file, "w", encoding="utf-8") as f:
            f.write(f"<!DOCTYPE html><meta charset=utf-8><title>{escape(self.config.name)}</title>{''.join(parts)}")


def main(args: list[str] | None = None, spark: SparkSession | None = None, out: Callable[[str], object] = sys.stdout.write) -> int:
    try:
        given = options(sys.argv[1:] if args is None else args)
    except (UsageError, OSError) as e:
        out(f"{e}\n{USAGE}")
        return 2
    if not given or any(n == "help" for n, _ in given):
        out(f"{ABOUT}\n\n{USAGE}")
        return 0
    if any(n == "version" for n, _ in given):
        out(f"quern {VERSION}\n")
        return 0
    session = Session(spark or SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").getOrCreate(), out)
    try:
        for name, value in given:
            session.apply(name, value)
        session.finish()
    except UsageError as e:
        out(f"{e}\n{USAGE}")
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
