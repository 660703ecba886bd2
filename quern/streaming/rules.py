"""Standing rules: sets of queries and updates that are kept matched against changing quads.

A change of the quads (a unit of input, or what a rule inserted or deleted) is matched in
bulk, and only by rules that the changed predicates can concern. Where quads were only added,
a rule of plain patterns, BINDs and FILTERs (``is_plain``) is joined with the added quads alone:
one pattern after another reads them, the others all quads. Any other rule is evaluated as one
DataFrame, and the difference to its former matches gives the new rule instances and those that
are no longer satisfied. Quads and matches are not rewritten at a change: what came and
went is laid over them, and after ``LAYERS`` changes they are written anew. Instances wait in an agenda; ``execute`` takes them by one of the policies
``first``, ``snapshot``, ``repeat-first`` and ``repeat-snapshot``. Under ``snapshot`` all waiting
instances run as one job, with the effect of running them in order: per quad the last
instance to touch it decides, and an instance deletes before it inserts. ``first`` runs one
updating instance at a time and is meant for small, order-dependent rule sets.

Quads, matches and output live in the session's shared folder; tables of at most a thousand
rows and the names of changed predicates (at most ``MAX_PREDICATES``) pass through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import terms as t
from quern.functions.registry import Context
from quern.operators import update as U
from quern.plans.compiler import Compiler
from quern.plans.relation import Relation, quoted, union
from quern.session import rendered
from quern.sources.quads import QuadSource, empty_quads
from quern.sparql import ast as A
from quern.storage import settle, shared_dir
from quern.streaming.incremental import is_monotone, is_monotone_group

OPERATIONS = ("add", "remove", "execute", "execute-first", "execute-snapshot", "execute-repeat-first", "execute-repeat-snapshot", "flush")
POLICIES = ("first", "snapshot", "repeat-first", "repeat-snapshot")
MAX_PREDICATES = 1000
LAYERS = 8


class RuleLimit(RuntimeError):
    """The rules didn't come to rest within ``max_rounds``."""


@dataclass
class Rule:
    operation: A.Operation
    name: str
    predicates: set[str] | None  # None: any change can concern it
    matches: DataFrame | None = None
    output: str | None = None  # folder
    fired: int = 0
    layers: int = 0  # tables of which ``matches`` is the union

    @property
    def updates(self) -> bool:
        return isinstance(self.operation, A.Update | A.Manage)


@dataclass
class Waiting:
    rule: Rule
    rows: Relation


def predicates_of(node: object) -> set[str] | None:
    """IRIs that the patterns of an operation match as predicates; None if others can count."""
    found: set[str] = set()

    def walk(x: object) -> bool:
        if isinstance(x, A.Triple):
            return path(x.p)
        if isinstance(x, tuple):
            return all(map(walk, x))
        if isinstance(x, A.Service):
            return False
        if isinstance(x, A.Graph) and isinstance(x.name, A.Var) and not any(isinstance(e, A.Bgp) for e in x.group.elements):
            return False
        if hasattr(x, "__dataclass_fields__"):
            return all(walk(getattr(x, f)) for f in x.__dataclass_fields__)
        return True

    def path(p: object) -> bool:
        if isinstance(p, A.Iri):
            found.add(p.value)
            return True
        if isinstance(p, A.PathSeq | A.PathAlt):
            return all(map(path, p.items))
        if isinstance(p, A.PathInv):
            return path(p.path)
        return isinstance(p, A.PathMod) and p.mod == "+" and path(p.path)

    where = node.where if isinstance(node, A.Query | A.Update) else None
    if isinstance(node, A.Query) and node.form == "DESCRIBE" or not walk(where) or not walk(getattr(node, "having", ())):
        return None
    return found


def is_plain(op: A.Operation) -> bool:
    """Whether quads that are added can only add to the matches, each by way of a pattern."""
    if isinstance(op, A.Query):
        return op.form in ("SELECT", "CONSTRUCT") and not (op.from_ or op.from_named) and is_monotone(replace(op, form="SELECT"))
    return isinstance(op, A.Update) and op.where is not None and not (op.using or op.using_named) and is_monotone_group(op.where)


class Added(QuadSource):
    """All quads, but for the pattern number ``at`` (in the order of matching) those that were added."""

    def __init__(self, quads: DataFrame, added: DataFrame, at: int):
        super().__init__(quads)
        self.added, self.at, self.patterns = QuadSource(added), at, 0

    def pattern(self, triple: A.Triple, graph: object) -> Relation:
        self.patterns += 1
        return self.added.pattern(triple, graph) if self.patterns - 1 == self.at else super().pattern(triple, graph)


def _meeting(rows: DataFrame, others: DataFrame, how: str = "left_semi") -> DataFrame:
    """Those of ``rows`` that are (or with left_anti: are not) in ``others``; unbound equals unbound."""
    a, b = rows.alias("a"), others.alias("b")
    return a.join(b, [F.col(f"a.{quoted(c)}").eqNullSafe(F.col(f"b.{quoted(c)}")) for c in rows.columns], how)


def _without(rows: DataFrame, others: DataFrame) -> DataFrame:
    return _meeting(rows, others, "left_anti")


@dataclass
class RuleEngine:
    spark: SparkSession
    ctx: Context = field(default_factory=Context)
    operations: tuple[str, ...] = ("add", "execute")
    policy: str = "repeat-first"
    allow_removal: bool = True
    max_rounds: int = 10_000
    services: dict | None = None
    load: object = None
    rules: list[Rule] = field(default_factory=list)
    agenda: list[Waiting] = field(default_factory=list)
    quads: DataFrame | None = None
    rounds: int = 0
    units: int = 0
    sizes: list[tuple[int, str, int]] = field(default_factory=list)
    report_sizes: bool = False
    layers: int = 0  # changes that lie over the written quads

    def __post_init__(self):
        if bad := [o for o in self.operations if o not in OPERATIONS]:
            raise ValueError(f"unknown operation {bad[0]}")
        if self.policy not in POLICIES:
            raise ValueError(f"unknown policy {self.policy}")
        if self.quads is None:
            self.quads = empty_quads(self.spark)

    # -- rules -------------------------------------------------------------------------------

    def add_rules(self, operations: list[A.Operation]) -> list[Rule]:
        """New rules see the quads that are there already."""
        new = [Rule(op, op.name or f"rule{len(self.rules) + i + 1}", predicates_of(op)) for i, op in enumerate(operations)]
        self.rules += new
        self._match(new)
        return new

    def compiler(self) -> Compiler:
        return Compiler(QuadSource(self.quads), self.ctx, self.services)

    def _solutions(self, rule: Rule, compiler: Compiler | None = None) -> Relation:
        op, compiler = rule.operation, compiler or self.compiler()
        if isinstance(op, A.Query):
            if op.form == "SELECT":
                return compiler.select(replace(op, order_by=()) if op.limit is None and not op.offset else op)
            r = compiler.solutions(op)
        elif isinstance(op, A.Manage) or op.kind in ("INSERT DATA", "DELETE DATA"):
            return compiler.source.unit()
        else:
            r = U.with_dataset(compiler, op).group(op.where, *([op.with_] if op.with_ is not None and not op.using else []))
        template = op.template if isinstance(op, A.Query) else (op.delete, op.insert)
        if op.kind != "MODIFY" if isinstance(op, A.Update) else op.form != "CONSTRUCT":
            return r
        fresh = any(isinstance(x, A.BNode) for q in (op.template if isinstance(op, A.Query) else op.insert) for x in (q.s, q.p, q.o))
        return r if fresh else r.keep(A.variables(template)) if any(n in r.vars for n in A.variables(template)) else r

    def _additions(self, rule: Rule, added: DataFrame) -> Relation:
        """What a plain rule matches by way of added quads (at least its new matches)."""
        found, at = [], 0
        while True:
            source = Added(self.quads, added, at)
            r = self._solutions(rule, Compiler(source, self.ctx, self.services))
            if at >= source.patterns:  # no pattern is left that has not read the added quads
                return union(found) if found else Relation(r.df.limit(0), r.vars)
            found.append(r)
            at += 1

    def _match_added(self, rules: list[Rule], added: DataFrame) -> None:
        """Match rules again after quads were added, none removed."""
        for rule in rules:
            if rule.matches is None or not is_plain(rule.operation):
                self._match([rule])
                continue
            found, before = self._additions(rule, added), rule.matches
            if found.vars:
                columns = [quoted(c) for c in before.columns]
                reached = settle(found.df.select(*columns).distinct(), "reached")
                new = settle(_without(reached, _meeting(before, reached)), "agenda")
            else:
                new = settle(found.df.limit(1 if before.isEmpty() else 0), "agenda")
            if not new.isEmpty():
                rule.matches, rule.layers = before.union(new), rule.layers + 1
                if rule.layers >= LAYERS:
                    rule.matches, rule.layers = settle(rule.matches, "matches"), 0
                self.agenda.append(Waiting(rule, Relation(new, found.vars)))
            if self.report_sizes:
                self.sizes.append((self.rounds, rule.name, rule.matches.count()))

    def _match(self, rules: list[Rule]) -> None:
        for rule in rules:
            found = self._solutions(rule)
            now = settle(found.df.distinct() if found.vars else found.df.limit(1), "matches")
            before = rule.matches
            rule.matches, rule.layers = now, 0
            if self.report_sizes:
                self.sizes.append((self.rounds, rule.name, now.count()))
            if before is not None:
                gone = before.subtract(now) if found.vars else (before if now.isEmpty() else before.limit(0))
                if self.allow_removal and any(w.rule is rule for w in self.agenda) and not gone.isEmpty():
                    for w in self.agenda:
                        if w.rule is rule:
                            w.rows = Relation(settle(w.rows.df.subtract(gone) if found.vars else w.rows.df.limit(0), "agenda"), w.rows.vars)
                now = now.subtract(before) if found.vars else (now if before.isEmpty() else now.limit(0))
            new = Relation(settle(now, "agenda"), found.vars)
            if not new.df.isEmpty():
                self.agenda.append(Waiting(rule, new))

    # -- input -------------------------------------------------------------------------------

    def process(self, unit: DataFrame) -> None:
        """Run the operations on one unit of input."""
        self.units += 1
        unit = unit.select(*"spog")
        for op in self.operations:
            if op == "add":
                self.change(unit.limit(0), unit)
            elif op == "remove":
                self.change(unit, unit.limit(0))
            elif op.startswith("execute"):
                self.execute(op.removeprefix("execute").removeprefix("-") or self.policy)

    def change(self, delete: DataFrame, insert: DataFrame) -> None:
        """Apply a set of changes to the quads and match the rules again."""
        before = self.quads
        delete, insert = settle(delete.select(*"spog").distinct(), "delete"), settle(insert.select(*"spog").distinct(), "insert")
        gone = settle(_without(_meeting(before, delete), insert), "gone") if not delete.isEmpty() else delete
        come = settle(_without(insert, _meeting(before, insert)), "come")
        names = [r.p for r in gone.union(come).select(F.col("p")["lex"].alias("p")).distinct().limit(MAX_PREDICATES + 1).collect()]
        if not names:
            return
        only_added = gone.isEmpty()
        self.quads = (before if only_added else _without(before, gone)).union(come)
        self.layers += 1
        if self.layers >= LAYERS:
            self.quads, self.layers = settle(self.quads, "quads"), 0
        concerned = [r for r in self.rules if r.predicates is None or len(names) > MAX_PREDICATES or r.predicates & set(names)]
        if only_added:
            self._match_added(concerned, come)
        else:
            self._match(concerned)

    # -- execution ---------------------------------------------------------------------------

    def execute(self, policy: str | None = None) -> None:
        policy = policy or self.policy
        rounds = 0
        while self._prune():
            rounds += 1
            self.rounds += 1
            if rounds > self.max_rounds:
                raise RuleLimit(f"the rules still fire after {self.max_rounds} rounds")
            if policy.endswith("first"):
                self._run(self._take_first())
            else:
                taken, self.agenda = self.agenda, []
                self._run(taken)
            if not policy.startswith("repeat"):
                return

    def _prune(self) -> bool:
        self.agenda = [w for w in self.agenda if not w.rows.df.isEmpty()]
        return bool(self.agenda)

    def _take_first(self) -> list[Waiting]:
        """The instances up to the first that changes the quads."""
        taken = []
        while self.agenda and not self.agenda[0].rule.updates:
            taken.append(self.agenda.pop(0))
        if self.agenda:
            w = self.agenda[0]
            cols = [quoted(c) for c in w.rows.df.columns]
            one = settle(w.rows.df.orderBy(*cols).limit(1), "agenda")
            w.rows = Relation(settle(w.rows.df.subtract(one) if w.rows.vars else w.rows.df.limit(0), "agenda"), w.rows.vars)
            taken.append(Waiting(w.rule, Relation(one, w.rows.vars)))
        return taken

    def _run(self, taken: list[Waiting]) -> None:
        compiler = self.compiler()
        writes: list[DataFrame] = []
        managed: list[A.Manage] = []
        for i, w in enumerate(taken):
            op = w.rule.operation
            w.rule.fired += 1
            if isinstance(op, A.Query):
                self._emit(w, compiler)
            elif isinstance(op, A.Manage):
                managed.append(op)
            else:
                writes += self._writes(w, compiler, i)
        if writes:
            every = writes[0]
            for x in writes[1:]:
                every = every.unionByName(x)
            last = every.groupBy(*"spog").agg(F.max("seq").alias("seq"))
            last = settle(last, "writes")
            self.change(last.where("seq.step = 0").select(*"spog"), last.where("seq.step = 1").select(*"spog"))
        for op in managed:
            after = U.managed(self.quads, op, self.load)
            self.change(self.quads.subtract(after), after.subtract(self.quads))

    def _writes(self, w: Waiting, compiler: Compiler, at: int) -> list[DataFrame]:
        op, rows = w.rule.operation, w.rows
        delete = op.delete if op.kind != "DELETE WHERE" or op.delete else ()
        instance = F.md5(F.to_json(F.struct(F.lit(0).alias("x"), *(F.col(quoted(c)) for c in rows.all_columns()))))
        out = []
        for step, template in ((0, delete), (1, op.insert)):
            if template:
                ordered = Relation(rows.df.withColumn("_seq", F.struct(F.lit(at).alias("at"), instance.alias("instance"), F.lit(step).alias("step"))), rows.vars)
                out.append(_instances(compiler, ordered, template, op.with_))
        return out

    def _emit(self, w: Waiting, compiler: Compiler) -> None:
        op, rule = w.rule.operation, w.rule
        if op.form == "SELECT":
            df = rendered(w.rows, "term")
            if op.order_by and set(A.variables([e for e, _ in op.order_by])) <= set(w.rows.vars):
                df = rendered(compiler.ordered(w.rows, list(op.order_by), None), "term")
        elif op.form == "ASK":
            df = self.spark.range(1).select(F.lit(True).alias("ask"))
        elif op.form == "CONSTRUCT":
            df = compiler.instantiate(w.rows, op.template).distinct()
        else:
            df = compiler.describe(op)
        if rule.output is None:
            rule.output = shared_dir(self.spark, "output")
        df.withColumn("round_", F.lit(self.rounds)).write.mode("append").parquet(rule.output)

    def output(self, rule: Rule | str, with_round: bool = False) -> DataFrame | None:
        """What a query rule has given so far; None if it hasn't fired."""
        if isinstance(rule, str):
            rule = next(r for r in self.rules if r.name == rule)
        if rule.output is None:
            return self.spark.range(1).select(F.lit(False).alias("ask")) if isinstance(rule.operation, A.Query) and rule.operation.form == "ASK" else None
        df = self.spark.read.parquet(rule.output)
        return df if with_round else df.drop("round_")


def _instances(compiler: Compiler, rows: Relation, template: tuple, default_graph: A.Iri | None) -> DataFrame:
    """Quads of a template, each with its instance's ``seq``."""
    made = compiler.instantiate(rows, template, default_graph, extra={"seq": F.col("_seq")})
    return made.select(*(F.col(c).cast(t.TERM).alias(c) for c in "spog"), "seq")
