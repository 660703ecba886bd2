"""SPARQL algebra to DataFrames.

A group is compiled bottom-up into one ``Relation``; nothing runs until the result is used.
The join order inside a basic graph pattern only avoids cross products; the rest is left to
Catalyst. FILTERs are applied at the end of their group (Catalyst pushes them down), EXISTS
becomes a semi or anti join, or a mark column where it is part of an expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import terms as t
from quern.functions.aggregates import aggregate
from quern.functions.registry import ENGINE_NS, Context
from quern.operators.joins import join, marked
from quern.plans import paths
from quern.plans.relation import Relation, VarType, none, quoted, union
from quern.sources.quads import DEFAULT
from quern.sparql import ast as A
from quern.terms import Val


DYNAMIC_CALL = ENGINE_NS + "dynamic_call"


#: Functions that have a value for all arguments of these kinds.
TOTAL = {f: t.NUMERIC for f in ("+", "-", "*", "u+", "u-", "ABS", "ROUND", "CEIL", "FLOOR")}
TOTAL |= {f: ("string",) for f in ("STRLEN", "UCASE", "LCASE", "CONCAT", "STRBEFORE", "STRAFTER", "ENCODE_FOR_URI", "MD5", "SHA1", "SHA256", "SHA384", "SHA512")}
TOTAL |= {f: ("dateTime",) for f in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS", "TZ")} | {"STR": ("iri", *t.DATATYPES)}


@dataclass(frozen=True)
class Mark:
    """An EXISTS whose answer is in a column."""

    column: str
    negated: bool


@dataclass
class Compiler:
    source: object
    ctx: Context
    services: dict | None = None

    @property
    def spark(self):
        return self.source.spark

    # -- expressions -------------------------------------------------------------------------

    def expr(self, e: object, lookup: Callable[[str], Val]) -> Val:
        if isinstance(e, A.Var):
            return lookup(e.name)
        if isinstance(e, A.Iri | A.Lit | A.BNode):
            return t.constant(e)
        if isinstance(e, Mark):
            c = F.col(e.column)
            return Val("boolean", ~c if e.negated else c)
        if isinstance(e, A.Call):
            if e.name == "BOUND":
                return Val("boolean", lookup(e.args[0].name).col.isNotNull())
            if e.name == DYNAMIC_CALL and e.args:  # the function is named by an argument
                if not isinstance(e.args[0], A.Iri):
                    return t.null()
                e = A.Call(e.args[0].value, e.args[1:])
            args = [self.expr(a, lookup) for a in e.args]
            f = self.ctx.lookup(e.name)
            if f is None:
                return t.null()
            return f(self.ctx, *args)
        raise ValueError(f"an expression can't have {type(e).__name__} here")

    def total(self, e: object, r: Relation) -> bool:
        """Whether an expression surely has a value, so that joins on it are equality joins. (The
        overflow of 64 bits has none; such a row then joins nothing.)"""
        if isinstance(e, A.Iri | A.Lit):
            return True
        if isinstance(e, A.Var):
            return e.name in r.vars and not r.vars[e.name].nullable
        if not isinstance(e, A.Call) or e.name not in TOTAL or not all(self.total(a, r) for a in e.args):
            return False
        return all(self.expr(a, r.val).kind in TOTAL[e.name] for a in e.args)

    def evaluated(self, e: object, r: Relation, graph: object) -> tuple[Relation, Val]:
        """The value over ``r``, which may get mark columns for it."""
        e, r = self.with_marks(e, r, graph)
        return r, self.expr(e, r.val)

    def with_marks(self, e: object, r: Relation, graph: object) -> tuple[object, Relation]:
        if isinstance(e, A.Exists):
            flag = f"_exists{sum(c.startswith('_exists') for c in r.df.columns)}"
            inner, condition = self.exists_side(e.group, r, graph)
            return Mark(flag, e.negated), marked(r, inner, flag, condition)
        if isinstance(e, A.Call):
            args = []
            for a in e.args:
                a, r = self.with_marks(a, r, graph)
                args.append(a)
            return replace(e, args=tuple(args)), r
        return e, r

    def where(self, e: object, r: Relation, graph: object) -> Relation:
        """Rows for which the filter is true."""
        if isinstance(e, A.Call) and e.name == "&&":
            for a in e.args:
                r = self.where(a, r, graph)
            return r
        if isinstance(e, A.Call) and e.name == "!" and isinstance(e.args[0], A.Exists):
            e = replace(e.args[0], negated=not e.args[0].negated)
        if isinstance(e, A.Exists):
            inner, condition = self.exists_side(e.group, r, graph)
            return join(r, inner, "left_anti" if e.negated else "left_semi", condition)
        before = r
        r, v = self.evaluated(e, r, graph)
        r = r.where(t.ebv(v))
        return Relation(r.df.select(*map(quoted, before.all_columns()) or [F.lit(True).alias("_unit")]), r.vars) if "_exists0" in r.df.columns and "_exists0" not in before.df.columns else r

    def exists_side(self, group: A.Group, outer: Relation, graph: object):
        """The solutions of an EXISTS pattern and the condition that its filters set."""
        filters = [A.Filter(e) for x in group.elements if isinstance(x, A.Filter) for e in _conjuncts(x.expr)]
        others = A.Group(tuple(x for x in group.elements if not isinstance(x, A.Filter)))
        own = set(_pattern_variables(others))
        lifted = [x for x in filters if any(v not in own and v in outer.vars for v in A.variables(x)) and not _has_exists(x)]
        inside = A.Group((*others.elements, *(x for x in filters if x not in lifted)))
        outside = [v for v in _expression_variables(inside) if v not in own and v in outer.vars]
        seed = outer.keep(outside).distinct() if outside else None
        inner = self.group(inside, graph, seed)
        wanted = [n for n in inner.vars if n in outer.vars or any(n in A.variables(x) for x in lifted)]
        inner = inner.keep(wanted)
        if not lifted:
            return inner, None
        inner = self.extreme(inner, outer, lifted)
        inner, lifted = self.keyed(inner, outer, lifted)
        return inner, self.condition(lifted)

    def extreme(self, inner: Relation, outer: Relation, lifted: list[A.Filter]) -> Relation:
        """An EXISTS side whose one condition compares an inner variable with outer ones needs
        only the extreme of each key: a row is met by some value above it if and only if it is met
        by the greatest. So a key with many rows on both sides costs no pairs."""
        if len(lifted) != 1 or not isinstance(lifted[0].expr, A.Call) or lifted[0].expr.name not in ("<", ">", "<=", ">="):
            return inner
        a, b = lifted[0].expr.args
        name = lifted[0].expr.name
        if isinstance(b, A.Var) and b.name in inner.vars and b.name not in outer.vars:
            a, b, name = b, a, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}[name]
        if not isinstance(a, A.Var) or a.name not in inner.vars or a.name in outer.vars or set(A.variables(b)) & (set(inner.vars) - set(outer.vars)):
            return inner
        kind = inner.vars[a.name]
        keys = [n for n in inner.vars if n != a.name]
        if kind.kind in ("term", "iri", "bnode") or kind.template is not None or any(n not in outer.vars or inner.vars[n].nullable for n in keys):
            return inner
        column = inner.columns(a.name)[0]
        best = (F.max if name in (">", ">=") else F.min)(F.col(quoted(column))).alias(column)
        df = inner.df.groupBy(*(quoted(c) for n in keys for c in inner.columns(n))).agg(best)
        return Relation(df, {n: replace(v, nullable=True) if n == a.name else v for n, v in inner.vars.items()})

    def keyed(self, inner: Relation, outer: Relation, lifted: list[A.Filter]) -> tuple[Relation, list[A.Filter]]:
        """An EXISTS side whose conditions all equate an expression over it with one over the outer
        side needs only the distinct values of its expressions, which are keys of the join."""
        own, sides = set(inner.vars) - set(outer.vars), []
        for x in lifted:
            if not isinstance(x.expr, A.Call) or x.expr.name != "=":
                return inner, lifted
            a, b = x.expr.args
            if not set(A.variables(a)) & own:
                a, b = b, a
            if not set(A.variables(a)) or not set(A.variables(a)) <= own or set(A.variables(b)) & own:
                return inner, lifted
            sides.append((a, b))
        keys = [n for n in inner.vars if n in outer.vars]
        for i, (a, _) in enumerate(sides):
            inner = inner.with_val(f"_:e{i}", self.expr(a, inner.val))
        names = [f"_:e{i}" for i in range(len(sides))]
        return inner.keep([*keys, *names]).distinct(), [A.Filter(A.Call("=", (A.Var(n), b))) for n, (_, b) in zip(names, sides)]

    def condition(self, filters: list[A.Filter]):
        """For the condition of a join, where NULL counts as false; so equations stay keys that Catalyst sees."""

        def made(left: Relation, right: Relation) -> Column:
            lookup = lambda n: left.val(n) if n in left.vars and (n not in right.vars or not left.vars[n].nullable) else right.val(n)
            out = F.lit(True)
            for x in filters:
                out = out & t.ebv(self.expr(x.expr, lookup))
            return out

        return made

    # -- groups ------------------------------------------------------------------------------

    def group(self, group: A.Group, graph: object = DEFAULT, seed: Relation | None = None) -> Relation:
        r, filters = seed, []
        unit = self.source.unit
        both = lambda a, b: b if a is None else join(a, b, null_safe=self.ctx.parity)
        for e in group.elements:
            if isinstance(e, A.Filter):
                filters.append(e.expr)
            elif isinstance(e, A.Bgp):
                r = self.bgp(list(e.triples), graph, r)
            elif isinstance(e, A.Group):
                r = both(r, self.group(e, graph))
            elif isinstance(e, A.SubSelect):
                r = both(r, self.select(e.query, graph))
            elif isinstance(e, A.Union):
                r = both(r, union([self.group(g, graph) for g in e.groups]))
            elif isinstance(e, A.Graph):
                r = both(r, self.graph(e))
            elif isinstance(e, A.Values):
                r = both(r, self.values(e))
            elif isinstance(e, A.Service):
                r = both(r, self.service(e))
            elif isinstance(e, A.Optional):
                r = self.optional(r if r is not None else unit(), e.group, graph)
            elif isinstance(e, A.Minus):
                r = join(r if r is not None else unit(), self.group(e.group, graph), "left_anti", overlap=True)
            elif isinstance(e, A.Bind):
                r, v = self.evaluated(e.expr, r if r is not None else unit(), graph)
                r = r.with_val(e.var.name, v, nullable=not self.total(e.expr, r))
                r = Relation(r.df.select(*map(quoted, r.all_columns())), r.vars)
            else:
                raise ValueError(f"unknown pattern {type(e).__name__}")
        r = r if r is not None else unit()
        for e in filters:
            r = self.where(e, r, graph)
        return r

    def optional(self, r: Relation, group: A.Group, graph: object) -> Relation:
        filters = [x for x in group.elements if isinstance(x, A.Filter) and not _has_exists(x)]
        inner = self.group(A.Group(tuple(x for x in group.elements if x not in filters)), graph)
        return join(r, inner, "left", self.condition(filters) if filters else None, null_safe=self.ctx.parity)

    def graph(self, e: A.Graph) -> Relation:
        if isinstance(e.name, A.Var) and not any(isinstance(x, A.Bgp) for x in e.group.elements):
            return self.group(e.group, e.name, self.source.graphs(e.name.name))
        return self.group(e.group, e.name)

    def bgp(self, triples: list[A.Triple], graph: object, r: Relation | None = None) -> Relation:
        plain, waiting = [], []
        for x in triples:
            for y in paths.steps(x):
                (plain if isinstance(y.p, A.Var | A.Iri) else waiting).append(y)
        negated = {}
        for y in list(waiting):  # !(a|b) is a variable predicate of its subject's star, filtered
            if isinstance(y.p, A.PathNeg) and y.p.forward and not y.p.inverse and not any(isinstance(z.p, A.Var) and z.s == y.s for z in plain):
                v = paths.fresh()
                negated[v.name] = [x.value for x in y.p.forward]
                plain.append(A.Triple(y.s, v, y.o))
                waiting.remove(y)
        parts = list(self.source.bgp(plain, graph)) if plain else []
        parts += [paths.relation(self, y, graph) for y in waiting]
        while parts:
            if r is None:
                r = parts.pop(0)
                continue
            at = next((i for i, p in enumerate(parts) if set(p.vars) & set(r.vars)), 0)
            r = join(r, parts.pop(at), null_safe=self.ctx.parity)
        r = r if r is not None else self.source.unit()
        for name, iris in negated.items():
            r = r.where(~F.coalesce(t.lex(r.val(name)).isin(iris), F.lit(False)))
            r = r.keep([n for n in r.vars if n != name])
        return r

    def values(self, e: A.Values) -> Relation:
        kinds, columns = {}, []
        for i, v in enumerate(e.vars):
            given = [row[i] for row in e.rows]
            found = {_static(x) for x in given if x is not None}
            kind = found.pop() if len(found) == 1 else "term"
            kinds[v.name] = VarType(kind, nullable=None in given)
            columns.append([None if x is None else _python(x, kind) for x in given])
        schema = T.StructType([T.StructField(f"v_{n}", _spark_type(k.kind)) for n, k in kinds.items()])
        rows = list(zip(*columns)) if columns else [() for _ in e.rows]
        if not columns:
            return self.source.unit() if e.rows else none(self.spark, {})
        return Relation(self.spark.createDataFrame(rows, schema), kinds)

    def service(self, e: A.Service) -> Relation:
        known = self.services or {}

        def one(iri: str) -> Relation:
            source = known[iri]
            if callable(source):
                source = source(self.spark)
            return Compiler(source, self.ctx, self.services).group(e.group)

        if isinstance(e.name, A.Iri):
            if e.name.value not in known:
                if e.silent:
                    return self.source.unit()
                raise ValueError(f"no source is registered for the service <{e.name.value}>")
            return one(e.name.value)
        found = [one(iri).with_val(e.name.name, Val("iri", F.lit(iri)), nullable=False) for iri in known]
        return union(found) if found else none(self.spark, {e.name.name: VarType("iri")})

    # -- queries -----------------------------------------------------------------------------

    def solutions(self, q: A.Query, graph: object = DEFAULT) -> Relation:
        """WHERE, VALUES, grouping, HAVING and the expressions of the projection."""
        r = self.group(q.where, graph)
        if q.values is not None:
            r = join(r, self.values(q.values), null_safe=self.ctx.parity)
        projection = [x if isinstance(x, tuple) else (x, x) for x in q.projection or ()]
        aggs = _aggregates([x[0] for x in projection] + list(q.having) + [x for x, _ in q.order_by]) if q.form == "SELECT" else []
        names = {a: A.Var(f"_:a{i}") for i, a in enumerate(aggs)}
        if q.group_by or aggs:
            r = self.grouped(r, q, names, graph)
            allowed = {x[1].name if isinstance(x, tuple) else x.name for x in q.group_by if isinstance(x, A.Var | tuple)}
            alias = {x[1].name for x in projection if x[0] is not x[1]}
            for e, _ in projection:
                loose = [v for v in A.variables(_replaced(e, names)) if not v.startswith("_:a") and v not in allowed | alias]
                if loose and not any(_replaced(e, names) == g for g in q.group_by):
                    raise ValueError(f"?{loose[0]} is neither grouped nor aggregated")
        for e in q.having:
            r = self.where(_replaced(e, names), r, graph)
        keys = {g: A.Var(f"_:g{i}") for i, g in enumerate(q.group_by) if not isinstance(g, A.Var | tuple)}
        for e, v in projection:
            if e is not v:
                r, value = self.evaluated(_replaced(_replaced(e, keys), names), r, graph)
                r = r.with_val(v.name, value)
        self._order = [(_replaced(_replaced(e, keys), names), d) for e, d in q.order_by]
        return r

    def grouped(self, r: Relation, q: A.Query, names: dict[A.Agg, A.Var], graph: object) -> Relation:
        keys = []
        for i, g in enumerate(q.group_by):
            if isinstance(g, A.Var):
                keys.append(g.name)
                if g.name not in r.vars:
                    r = r.with_val(g.name, t.null())
                continue
            e, name = (g[0], g[1].name) if isinstance(g, tuple) else (g, f"_:g{i}")
            r, v = self.evaluated(e, r, graph)
            r = r.with_val(name, v)
            keys.append(name)
        everything = [F.col(quoted(c)) for c in r.all_columns() if not c.startswith("v__:")]
        types = {n: r.vars[n] for n in keys}
        made = []
        for a, var in names.items():
            v = None
            if a.arg is not None:
                v = self.expr(a.arg, r.val)
            out = aggregate(a, v, everything, self.ctx.parity)
            types[var.name] = VarType(out.kind, nullable=True)
            made.append(out.col.alias(f"v_{var.name}"))
        cols = [quoted(c) for n in keys for c in r.columns(n)]
        if not made:
            return Relation(r.df.select(*cols).distinct(), types)
        if keys:
            return Relation(r.df.groupBy(*cols).agg(*made), types)
        df = r.df.agg(*made, F.count(F.lit(1)).alias("_rows"))
        return Relation((df.where("_rows > 0") if self.ctx.parity else df).drop("_rows"), types)

    def select(self, q: A.Query, graph: object = DEFAULT) -> Relation:
        r = self.solutions(q, graph)
        order = self._order
        names = [x[1].name if isinstance(x, tuple) else x.name for x in q.projection] if q.projection is not None else [n for n in _pattern_variables(q.where) if n in r.vars and not n.startswith("_:")] + [n for n in A.variables(q.values) if n in r.vars and n not in _pattern_variables(q.where)]
        for n in names:
            if n not in r.vars:
                r = r.with_val(n, t.null())
        if q.distinct or (q.reduced and self.ctx.parity):
            r = r.keep(names).distinct()
        if order:
            r = self.ordered(r, order, graph)
        r = r.keep(names)
        if q.offset:
            r = replace(r, df=r.df.offset(q.offset))
        if q.limit is not None:
            r = replace(r, df=r.df.limit(q.limit))
        return r

    def ordered(self, r: Relation, order: list, graph: object) -> Relation:
        by = []
        for e, descending in order:
            r, v = self.evaluated(e, r, graph)
            by += [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in t.order_key(v)]
        return replace(r, df=r.df.orderBy(*by))

    def ask(self, q: A.Query) -> DataFrame:
        return self.solutions(q).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))

    def construct(self, q: A.Query) -> DataFrame:
        r = self.solutions(q)
        if self._order:
            r = self.ordered(r, self._order, DEFAULT)
        df = r.df.offset(q.offset) if q.offset else r.df
        r = Relation(df.limit(q.limit) if q.limit is not None else df, r.vars)
        return self.instantiate(r, q.template).distinct()

    def instantiate(self, r: Relation, template: tuple, default_graph: A.Iri | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
        """Quads of a template for each solution; those with an unbound part are left out, and
        blank nodes are new for each solution. ``extra``: further columns of the result."""
        extra = extra or {}
        if not template:
            return self.spark.createDataFrame([], t.QUAD)
        solution = F.md5(F.to_json(F.struct(F.lit(0).alias("x"), *(F.col(quoted(c)) for c in r.all_columns()))))

        def cell(x: object) -> Column:
            if x is None:
                return F.lit(None).cast(t.TERM)
            if isinstance(x, A.Var):
                return t.to_term(r.val(x.name)).cast(t.TERM)
            if isinstance(x, A.BNode):
                return t.to_term(Val("bnode", F.concat(F.lit(f"_:{x.label}_"), solution))).cast(t.TERM)
            return t.constant_term(x).cast(t.TERM)

        made = F.array(*(F.struct(*(cell(x).alias(c) for c, x in (("s", q.s), ("p", q.p), ("o", q.o), ("g", q.g if q.g is not None else default_graph))), F.lit(isinstance(q.g, A.Var)).alias("named")) for q in template))
        rows = r.df.select(F.explode(made).alias("q"), *(c.alias(n) for n, c in extra.items())).select("q.*", *extra)
        legal = (F.col("s")["kind"] != t.LITERAL) & (F.col("p")["kind"] == t.IRI) & F.col("o").isNotNull() & (~F.col("named") | F.coalesce(F.col("g")["kind"] == t.IRI, F.lit(False)))
        return rows.where(legal).select(*"spog", *extra)

    def describe(self, q: A.Query) -> DataFrame:
        r = self.solutions(replace(q, projection=None))
        targets = q.projection if q.projection is not None else tuple(A.Var(n) for n in r.vars if not n.startswith("_:"))
        found = []
        for x in targets:
            if isinstance(x, A.Iri):
                found.append(Relation(self.spark.range(1).select(F.lit(x.value).alias("v_d")), {"d": VarType("iri")}))
            elif x.name in r.vars:
                one = r.keep([x.name])
                found.append(Relation(one.df.toDF(*(c[: len(c) - len(x.name)] + "d" for c in one.df.columns)), {"d": one.vars[x.name]}))
        frames = [self.source.describe(x, "d") for x in found]
        out = frames[0] if frames else self.spark.createDataFrame([], t.QUAD)
        for f in frames[1:]:
            out = out.union(f)
        return out.distinct()


def _static(x: A.Iri | A.Lit) -> str:
    return t.constant(x).kind


def _python(x: A.Iri | A.Lit, kind: str) -> object:
    if kind == "term":
        return (t.IRI, x.value, None, None) if isinstance(x, A.Iri) else (t.LITERAL, x.lex, x.dt, x.lang)
    if isinstance(x, A.Iri):
        return x.value
    return {"integer": int, "string": str, "boolean": lambda s: s in ("true", "1")}.get(kind, float)(x.lex)


def _spark_type(kind: str) -> T.DataType:
    return t.TERM if kind == "term" else T.StructType.fromDDL(f"x {t.SPARK_TYPES[kind]}")[0].dataType


def _has_exists(node: object) -> bool:
    if isinstance(node, A.Exists):
        return True
    if isinstance(node, A.Call):
        return any(map(_has_exists, node.args))
    return isinstance(node, A.Filter) and _has_exists(node.expr)


def _conjuncts(e: object) -> list:
    return [y for x in e.args for y in _conjuncts(x)] if isinstance(e, A.Call) and e.name == "&&" else [e]


def _pattern_variables(group: object) -> list[str]:
    """Variables that patterns (not filters or expressions) of a group can bind."""
    found: dict[str, None] = {}

    def walk(e: object) -> None:
        if isinstance(e, A.Bgp | A.Values):
            found.update(dict.fromkeys(A.variables(e)))
        elif isinstance(e, A.Bind):
            found[e.var.name] = None
        elif isinstance(e, A.Group):
            for x in e.elements:
                walk(x)
        elif isinstance(e, A.Union):
            for x in e.groups:
                walk(x)
        elif isinstance(e, A.Optional):
            walk(e.group)
        elif isinstance(e, A.Graph | A.Service):
            found.update(dict.fromkeys(A.variables(e.name)))  # as SELECT * orders them
            walk(e.group)
        elif isinstance(e, A.SubSelect):
            q = e.query
            found.update(dict.fromkeys(A.variables(q.projection) if q.projection is not None else _pattern_variables(q.where)))

    walk(group)
    return list(found)


def _expression_variables(group: A.Group) -> list[str]:
    """Variables of the filters and expressions that stand in a group itself."""
    return A.variables([e.expr for e in group.elements if isinstance(e, A.Filter | A.Bind)])


def _aggregates(node: object) -> list[A.Agg]:
    if isinstance(node, A.Agg):
        return [node]
    if isinstance(node, list | tuple):
        return list(dict.fromkeys(a for x in node for a in _aggregates(x)))
    return _aggregates(node.args) if isinstance(node, A.Call) else []


def _replaced(node: object, by: dict) -> object:
    if isinstance(node, A.Agg | A.Call) and node in by:
        return by[node]
    if isinstance(node, A.Call):
        return replace(node, args=tuple(_replaced(a, by) for a in node.args))
    return node
