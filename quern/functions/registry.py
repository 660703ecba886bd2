"""Scalar functions: SPARQL 1.1 built-ins, operators, casts and extension functions.

Each takes and returns ``Val``s made of built-in Spark columns; none is a Python UDF. A type
that can't fit is an error, and an error is NULL. ``Context.register`` adds functions by IRI;
names are looked up without case.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern import terms as t
from quern.sparql import ast as A
from quern.terms import NUMERIC, Val

EXPT_NS = "http://quern.example/math#"
TIME_NS = "http://quern.example/datetime#"
ENGINE_NS = "http://quern.example/engine#"
UNIVERSAL_EPOCH = 2_208_988_800  # seconds from 1900 to 1970
Function = Callable[..., Val]


@dataclass
class Context:
    """What functions need besides their arguments.

    parity: 0-based SUBSTR, counts of unbound values and other departures from SPARQL 1.1
    that rules written for an older engine can rely on.
    """

    base: str = ""
    parity: bool = False
    extra: dict[str, Function] = field(default_factory=dict)

    def register(self, iri: str, function: Function) -> None:
        self.extra[iri.lower()] = function

    def lookup(self, name: str) -> Function | None:
        return BUILTINS.get(name) or self.extra.get(name.lower()) or EXTENSIONS.get(name.lower())


def _null_like(kind: str) -> Val:
    return t.null(kind)


# Logic ---------------------------------------------------------------------------------------


def not_(_, a: Val) -> Val:
    return Val("boolean", ~t.ebv(a))


def or_(_, a: Val, b: Val) -> Val:
    return Val("boolean", t.ebv(a) | t.ebv(b))


def and_(_, a: Val, b: Val) -> Val:
    return Val("boolean", t.ebv(a) & t.ebv(b))


def if_(_, test: Val, a: Val, b: Val) -> Val:
    kind = t.unified([a, b])
    c = t.ebv(test)
    return Val(kind, F.when(c, t.as_kind(a, kind)).when(~c, t.as_kind(b, kind)))


def coalesce(_, *args: Val) -> Val:
    if not args:
        return t.null()
    kind = t.unified(list(args))
    return Val(kind, F.coalesce(*(t.as_kind(a, kind) for a in args)))


# Comparison ----------------------------------------------------------------------------------


def same_term(_, a: Val, b: Val) -> Val:
    if a.kind == b.kind and a.kind != "term":
        return Val("boolean", a.col == b.col)
    if "term" not in (a.kind, b.kind):
        return Val("boolean", F.when(a.col.isNotNull() & b.col.isNotNull(), False))
    x, y = t.to_term(a), t.to_term(b)
    return Val("boolean", F.when(x.isNotNull() & y.isNotNull(), x.eqNullSafe(y)))


def _views(a: Val, b: Val) -> list[tuple[Column, Column]]:
    """Pairs of columns that hold both values where both have one comparable type."""
    return [(x, y) for f in (t.number, t.text, t.truth, t.instant) if (x := f(a)) is not None and (y := f(b)) is not None]


def _compared(op: Callable[[Column, Column], Column], a: Val, b: Val) -> Column:
    found = F.lit(None).cast("boolean")
    pairs = _views(a, b)
    if len(pairs) == 1 and "term" not in (a.kind, b.kind):
        return op(*pairs[0])
    for x, y in reversed(pairs):
        found = F.when(x.isNotNull() & y.isNotNull(), op(x, y)).otherwise(found)
    return found


def equal(ctx, a: Val, b: Val) -> Val:
    if "term" not in (a.kind, b.kind):
        if _views(a, b):
            return Val("boolean", _compared(lambda x, y: x == y, a, b))
        if a.kind == b.kind:
            return Val("boolean", a.col == b.col)
        both_literals = a.kind in t.DATATYPES and b.kind in t.DATATYPES
        return Val("boolean", F.lit(None).cast("boolean") if both_literals else F.when(a.col.isNotNull() & b.col.isNotNull(), False))
    x, y = t.to_term(a), t.to_term(b)
    lang = F.lower(F.coalesce(x["lang"], F.lit(""))) == F.lower(F.coalesce(y["lang"], F.lit("")))
    same = (x["kind"] == y["kind"]) & (x["lex"] == y["lex"]) & x["dt"].eqNullSafe(y["dt"]) & lang
    by_value = _compared(lambda p, q: p == q, a, b)
    literals = (x["kind"] == t.LITERAL) & (y["kind"] == t.LITERAL)
    return Val("boolean", F.when(x.isNull() | y.isNull(), F.lit(None)).when(by_value.isNotNull(), by_value).when(same, True).when(~literals, False))


def not_equal(ctx, a: Val, b: Val) -> Val:
    return Val("boolean", ~equal(ctx, a, b).col)


def _ordering(op: Callable[[Column, Column], Column]) -> Function:
    return lambda _, a, b: Val("boolean", _compared(op, a, b))


def in_(ctx, a: Val, *items: Val) -> Val:
    if items and a.kind in ("iri", "string", "integer") and all(i.kind == a.kind for i in items):
        return Val("boolean", a.col.isin(*(i.col for i in items)))
    found = F.lit(False)
    for i in items:
        found = found | equal(ctx, a, i).col
    return Val("boolean", found)


def not_in(ctx, a: Val, *items: Val) -> Val:
    return Val("boolean", ~in_(ctx, a, *items).col)


# Arithmetic ----------------------------------------------------------------------------------

_TRY = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}


def _divide(x: Column, y: Column, inexact: bool) -> Column:
    x, y = x.cast("double"), y.cast("double")
    if not inexact:
        return F.try_divide(x, y)
    zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(y == 0, F.when(x.isNotNull(), zero)).otherwise(F.try_divide(x, y))


def _ranked(op: str, x: Column, y: Column, kind: str) -> Column:
    if op == "/":
        return _divide(x, y, kind in ("float", "double"))
    cast = "bigint" if kind == "integer" else "double"
    return _TRY[op](x.cast(cast), y.cast(cast))


def _rank(c: Column) -> Column:
    return F.when(c["dt"].isin(t.INTEGER_TYPES), 0).when(c["dt"] == A.DECIMAL, 1).when(c["dt"] == A.FLOAT, 2).when(c["dt"] == A.DOUBLE, 3)


def arithmetic(op: str) -> Function:
    def apply(_, a: Val, b: Val) -> Val:
        if a.kind in NUMERIC and b.kind in NUMERIC:
            kind = NUMERIC[max(NUMERIC.index(a.kind), NUMERIC.index(b.kind))]
            out = _ranked(op, a.col, b.col, kind)
            if kind == "float":
                out = out.cast("float")
            return Val("decimal" if op == "/" and kind == "integer" else kind, out)
        if "term" not in (a.kind, b.kind) or t.number(a) is None or t.number(b) is None:
            return t.null("double")
        x, y = t.to_term(a), t.to_term(b)
        rank = F.greatest(_rank(x), _rank(y))
        rank = F.when(_rank(x).isNotNull() & _rank(y).isNotNull(), rank)
        ints = [v.col if v.kind == "integer" else t.to_term(v)["lex"].try_cast("bigint") for v in (a, b)]
        p, q = t.number(a).cast("double"), t.number(b).cast("double")
        whole = t.Val("decimal", _divide(p, q, False)) if op == "/" else t.Val("integer", _TRY[op](*ints))
        made = F.when(rank == 0, t.to_term(whole)).when(rank == 1, t.to_term(Val("decimal", _ranked(op, p, q, "decimal"))))
        inexact = _ranked(op, p, q, "double")
        made = made.when(rank == 2, t.to_term(Val("float", inexact.cast("float")))).when(rank == 3, t.to_term(Val("double", inexact)))
        return Val("term", made)

    return apply


def _numeric(on_integer: Callable[[Column], Column], on_other: Callable[[Column], Column]) -> Function:
    """A function of one number that keeps its type."""

    def apply(_, a: Val) -> Val:
        if a.kind == "integer":
            return Val("integer", on_integer(a.col))
        if a.kind in NUMERIC:
            return Val(a.kind, on_other(a.col).cast(t.SPARK_TYPES[a.kind]))
        if a.kind != "term":
            return t.null("double")
        c, n = a.col, t.number(a)
        made = F.when(c["dt"].isin(t.INTEGER_TYPES), t.to_term(Val("integer", on_integer(c["lex"].try_cast("bigint")))))
        for kind in ("decimal", "float", "double"):
            made = made.when(c["dt"] == t.DATATYPES[kind], t.to_term(Val(kind, on_other(n).cast(t.SPARK_TYPES[kind]))))
        return Val("term", made)

    return apply


_same = lambda c: c
_floor_double = lambda c: F.rint(c) - F.when(F.rint(c) > c, 1.0).otherwise(0.0)  # noqa: E731  keeps DOUBLE, infinities and NaN
_ceil_double = lambda c: F.rint(c) + F.when(F.rint(c) < c, 1.0).otherwise(0.0)


# Terms ---------------------------------------------------------------------------------------


def _kind_is(static: tuple[str, ...], code: int) -> Function:
    def apply(_, a: Val) -> Val:
        if a.kind == "term":
            return Val("boolean", a.col["kind"] == code)
        return Val("boolean", F.when(a.col.isNotNull(), a.kind in static))

    return apply


def is_numeric(_, a: Val) -> Val:
    if a.kind == "term":
        return Val("boolean", F.when(a.col.isNotNull(), F.coalesce(t.number(a).isNotNull(), F.lit(False))))
    return Val("boolean", F.when(a.col.isNotNull(), a.kind in NUMERIC))


def str_(_, a: Val) -> Val:
    return Val("string", F.when(a.col["kind"] != t.BNODE, a.col["lex"]) if a.kind == "term" else t.lex(a) if a.kind != "bnode" else F.lit(None).cast("string"))


def lang(_, a: Val) -> Val:
    if a.kind == "term":
        return Val("string", F.when(a.col["kind"] == t.LITERAL, F.coalesce(a.col["lang"], F.lit(""))))
    return Val("string", F.when(a.col.isNotNull() & F.lit(a.kind in t.DATATYPES), ""))


def datatype(_, a: Val) -> Val:
    if a.kind == "term":
        return Val("iri", F.when(a.col["kind"] == t.LITERAL, a.col["dt"]))
    return Val("iri", F.when(a.col.isNotNull(), t.DATATYPES.get(a.kind)).cast("string"))


def iri(ctx: Context, a: Val) -> Val:
    if a.kind == "iri":
        return a
    if a.kind == "term":
        c = F.when((a.col["kind"] == t.IRI) | (a.col["dt"] == A.STRING), a.col["lex"])
    elif a.kind == "string":
        c = a.col
    else:
        return t.null("iri")
    if ctx.base:
        c = F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), c).otherwise(F.concat(F.lit(ctx.base[: ctx.base.rfind("/") + 1]), c))
    return Val("iri", c)


def bnode(_, label: Val | None = None) -> Val:
    if label is None:
        return Val("bnode", F.concat(F.lit("_:u"), F.replace(F.uuid(), F.lit("-"), F.lit(""))))
    return Val("bnode", F.concat(F.lit("_:l"), F.md5(t.text(label)))) if t.text(label) is not None else t.null("bnode")


def strdt(_, a: Val, dt: Val) -> Val:
    if t.text(a) is None or dt.kind not in ("iri", "term"):
        return t.null()
    datatype_ = dt.col if dt.kind == "iri" else F.when(dt.col["kind"] == t.IRI, dt.col["lex"])
    return Val("term", F.when(datatype_.isNotNull(), t.struct(t.LITERAL, t.text(a), datatype_)))


def strlang(_, a: Val, tag: Val) -> Val:
    if t.text(a) is None or t.text(tag) is None:
        return t.null()
    return Val("term", F.when(t.text(tag).isNotNull(), t.struct(t.LITERAL, t.text(a), A.LANG_STRING, F.lower(t.text(tag)))))


# Strings -------------------------------------------------------------------------------------


def _string(v: Val) -> Column | None:
    """Lexical form of plain and language-tagged strings."""
    if v.kind == "string":
        return v.col
    return F.when(v.col["dt"].isin(A.STRING, A.LANG_STRING), v.col["lex"]) if v.kind == "term" else None


def _like(v: Val, c: Column) -> Val:
    """A string of the kind (with the language) of ``v``."""
    return Val("string", c) if v.kind == "string" else Val("term", t.struct(t.LITERAL, c, v.col["dt"], v.col["lang"]))


def _lang(v: Val) -> Column:
    return F.coalesce(v.col["lang"], F.lit("")) if v.kind == "term" else F.lit("")


def _compatible(a: Val, b: Val, c: Column) -> Column:
    if b.kind != "term":
        return c
    return F.when((_lang(b) == "") | (F.lower(_lang(a)) == F.lower(_lang(b))), c)


def strlen(_, a: Val) -> Val:
    return Val("integer", F.length(_string(a)).cast("bigint")) if _string(a) is not None else t.null("integer")


def substr(ctx: Context, a: Val, start: Val, length: Val | None = None) -> Val:
    s, first = _string(a), t.number(start)
    if s is None or first is None or length is not None and t.number(length) is None:
        return t.null("string")
    first = F.floor(first + 0.5).cast("int") + (1 if ctx.parity else 0)
    end = first + F.floor(t.number(length) + 0.5).cast("int") if length is not None else F.length(s) + 1
    begin = F.greatest(first, F.lit(1))
    cut = F.when(s.isNotNull() & first.isNotNull() & end.isNotNull(), F.substring(s, begin, F.greatest(end - begin, F.lit(0))))
    if ctx.parity:
        cut = F.when((first >= 1) & (first <= F.length(s) + 1) & (end <= F.length(s) + 1), cut)
    return _like(a, cut)


def _mapped(f: Callable[[Column], Column]) -> Function:
    def apply(_, a: Val) -> Val:
        return _like(a, f(_string(a))) if _string(a) is not None else t.null("string")

    return apply


def _tested(f: Callable[[Column, Column], Column]) -> Function:
    def apply(_, a: Val, b: Val) -> Val:
        x, y = _string(a), _string(b)
        return Val("boolean", _compatible(a, b, f(x, y))) if x is not None and y is not None else t.null("boolean")

    return apply


def _parted(after: bool) -> Function:
    def apply(_, a: Val, b: Val) -> Val:
        s, d = _string(a), _string(b)
        if s is None or d is None:
            return t.null("string")
        at = F.call_function("instr", s, d)
        cut = F.substring(s, at + F.length(d), F.length(s)) if after else F.substring(s, F.lit(1), at - 1)
        empty = F.length(d) == 0
        found = F.when(empty, s if after else F.when(s.isNotNull(), "")).when(at > 0, cut)
        kept = _like(a, _compatible(a, b, found))
        missing = F.when((at == 0) & ~empty & _compatible(a, b, F.lit(True)), "")
        if kept.kind == "string":
            return Val("string", F.coalesce(kept.col, missing))
        return Val("term", F.coalesce(kept.col, t.struct(t.LITERAL, missing, A.STRING)))

    return apply


def encode_for_uri(_, a: Val) -> Val:
    s = _string(a)
    if s is None:
        return t.null("string")
    coded = F.url_encode(s)
    for raw, fixed in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(raw), F.lit(fixed))
    return Val("string", coded)


def concat(_, *args: Val) -> Val:
    if any(_string(a) is None for a in args):
        return t.null("string")
    joined = F.concat(*(_string(a) for a in args)) if args else F.lit("")
    if all(a.kind == "string" for a in args):
        return Val("string", joined)
    tags = [_lang(a) for a in args]
    same = F.lit(True)
    for x in tags[1:]:
        same = same & (x == tags[0])
    tag = F.when(same & (tags[0] != ""), tags[0])
    return Val("term", t.struct(t.LITERAL, joined, F.when(tag.isNotNull(), A.LANG_STRING).otherwise(A.STRING), tag))


def lang_matches(_, tag: Val, wanted: Val) -> Val:
    a, b = t.text(tag), t.text(wanted)
    if a is None or b is None:
        return t.null("boolean")
    a, b = F.lower(a), F.lower(b)
    return Val("boolean", F.when(b == "*", a != "").otherwise((a == b) | F.startswith(a, F.concat(b, F.lit("-")))))


def _pattern(pattern: Column, flags: Val | None) -> Column:
    """Flags become inline flags; q quotes the pattern."""
    if flags is None:
        return pattern
    f = t.text(flags)
    quoted = F.concat(F.lit("\\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    inline = F.regexp_replace(f, "[^imsx]", "")
    return F.when(f.rlike("^[smixq]*$"), F.concat(F.when(inline != "", F.concat(F.lit("(?"), inline, F.lit(")"))).otherwise(""), F.when(f.contains("q"), quoted).otherwise(pattern)))


def regex(_, a: Val, pattern: Val, flags: Val | None = None) -> Val:
    s, p = _string(a), t.text(pattern)
    if s is None or p is None or flags is not None and t.text(flags) is None:
        return t.null("boolean")
    return Val("boolean", F.rlike(s, _pattern(p, flags)))


def replace(_, a: Val, pattern: Val, new: Val, flags: Val | None = None) -> Val:
    s, p, r = _string(a), t.text(pattern), t.text(new)
    if s is None or p is None or r is None:
        return t.null("string")
    return _like(a, F.regexp_replace(s, _pattern(p, flags), r))


# Dates, hashes, casts ------------------------------------------------------------------------


def _local(v: Val) -> Column | None:
    """The time as written, in its own zone."""
    if v.kind == "dateTime":
        return v.col
    if v.kind == "term":
        return F.when(v.col["dt"] == A.DATETIME, F.regexp_extract(v.col["lex"], r"^(-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?)", 1)).try_cast("timestamp_ntz")
    return None


def _field(f: Callable[[Column], Column], kind: str = "integer") -> Function:
    def apply(_, a: Val) -> Val:
        local = _local(a)
        return Val(kind, f(local).cast(t.SPARK_TYPES[kind])) if local is not None else t.null(kind)

    return apply


def _zone(v: Val) -> Column | None:
    if v.kind == "dateTime":
        return F.when(v.col.isNotNull(), "Z")
    return F.when(v.col["dt"] == A.DATETIME, F.regexp_extract(v.col["lex"], r"(Z|[+-]\d\d:\d\d)$", 1)) if v.kind == "term" else None


def tz(_, a: Val) -> Val:
    return Val("string", _zone(a)) if _zone(a) is not None else t.null("string")


def timezone(ctx: Context, a: Val) -> Val:
    z = _zone(a)
    if z is None:
        return t.null()
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    if ctx.parity:  # a number of hours
        signed = F.when(z.startswith("-"), -1.0).otherwise(1.0) * (hours + minutes / 60.0)
        return Val("decimal", F.when(z == "Z", 0.0).when(z != "", signed))
    body = F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(F.when(hours > 0, "").otherwise("0S")))
    return Val("term", t.struct(t.LITERAL, F.when(z == "Z", "PT0S").when(z != "", body), A.XSD + "dayTimeDuration"))


def _hashed(f: Callable[[Column], Column]) -> Function:
    def apply(_, a: Val) -> Val:
        return Val("string", f(t.text(a))) if t.text(a) is not None else t.null("string")

    return apply


def _cast(kind: str) -> Function:
    def apply(_, a: Val) -> Val:
        if kind == "string":
            return Val("string", t.lex(a) if a.kind not in ("bnode", "term") else F.when(a.col["kind"] != t.BNODE, a.col["lex"]) if a.kind == "term" else F.lit(None).cast("string"))
        if kind == "dateTime":
            if a.kind == "dateTime":
                return a
            s = t.text(a) if a.kind != "term" else F.when(a.col["dt"].isin(A.STRING, A.DATETIME), a.col["lex"])
            return Val("dateTime", t.timestamp_of(s)) if s is not None else t.null(kind)
        if a.kind in ("iri", "bnode", "dateTime"):
            return t.null(kind)
        n, s, b = t.number(a), t.text(a), t.truth(a)
        options = []
        if kind == "boolean":
            if n is not None:
                options.append((n != 0) & ~F.isnan(n.cast("double")))
            if s is not None:
                options.append(F.when(F.trim(s).isin("true", "1"), True).when(F.trim(s).isin("false", "0"), False))
            if b is not None:
                options.append(b)
        else:
            if n is not None:
                whole = F.when(~F.isnan(n.cast("double")), n.try_cast("bigint")) if kind == "integer" else n.try_cast(t.SPARK_TYPES[kind])
                options.append(n if a.kind == kind else whole)
            if s is not None:
                pattern = {"integer": r"^\s*[+-]?\d+\s*$", "decimal": r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$"}.get(kind, r"^\s*([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)\s*$")
                options.append(F.when(s.rlike(pattern), F.replace(F.trim(s), F.lit("INF"), F.lit("Infinity")).try_cast(t.SPARK_TYPES[kind])))
            if b is not None:
                options.append(F.when(b, 1).when(~b, 0).cast(t.SPARK_TYPES[kind]))
        return Val(kind, F.coalesce(*options)) if options else t.null(kind)

    return apply


def _power(_, a: Val, b: Val) -> Val:
    x, y = t.number(a), t.number(b)
    return Val("double", F.pow(x.cast("double"), y.cast("double"))) if x is not None and y is not None else t.null("double")


def _root(_, a: Val) -> Val:
    return Val("double", F.sqrt(t.number(a).cast("double"))) if t.number(a) is not None else t.null("double")


def _universal_seconds(_, a: Val) -> Val:
    at = t.instant(a)
    return Val("integer", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at) + UNIVERSAL_EPOCH) if at is not None else t.null("integer")


BUILTINS: dict[str, Function] = {
    "!": not_, "||": or_, "&&": and_, "=": equal, "!=": not_equal, "IN": in_, "NOT IN": not_in, "IF": if_, "COALESCE": coalesce, "SAMETERM": same_term,
    "<": _ordering(lambda x, y: x < y), ">": _ordering(lambda x, y: x > y), "<=": _ordering(lambda x, y: x <= y), ">=": _ordering(lambda x, y: x >= y),
    "+": arithmetic("+"), "-": arithmetic("-"), "*": arithmetic("*"), "/": arithmetic("/"), "u+": _numeric(_same, _same), "u-": _numeric(lambda c: F.try_subtract(F.lit(0).cast("bigint"), c), lambda c: -c),
    "ABS": _numeric(F.abs, F.abs), "ROUND": _numeric(_same, lambda c: _floor_double(c + 0.5)), "CEIL": _numeric(_same, _ceil_double), "FLOOR": _numeric(_same, _floor_double),
    "RAND": lambda _: Val("double", F.rand()), "NOW": lambda _: Val("dateTime", F.localtimestamp()),
    "ISIRI": _kind_is(("iri",), t.IRI), "ISURI": _kind_is(("iri",), t.IRI), "ISBLANK": _kind_is(("bnode",), t.BNODE), "ISLITERAL": _kind_is(tuple(t.DATATYPES), t.LITERAL), "ISNUMERIC": is_numeric,
    "STR": str_, "LANG": lang, "DATATYPE": datatype, "IRI": iri, "URI": iri, "BNODE": bnode, "STRDT": strdt, "STRLANG": strlang,
    "UUID": lambda _: Val("iri", F.concat(F.lit("urn:uuid:"), F.uuid())), "STRUUID": lambda _: Val("string", F.uuid()),
    "STRLEN": strlen, "SUBSTR": substr, "UCASE": _mapped(F.upper), "LCASE": _mapped(F.lower), "CONCAT": concat, "LANGMATCHES": lang_matches, "REGEX": regex, "REPLACE": replace,
    "STRSTARTS": _tested(F.startswith), "STRENDS": _tested(F.endswith), "CONTAINS": _tested(F.contains), "STRBEFORE": _parted(False), "STRAFTER": _parted(True), "ENCODE_FOR_URI": encode_for_uri,
    "YEAR": _field(F.year), "MONTH": _field(F.month), "DAY": _field(F.day), "HOURS": _field(F.hour), "MINUTES": _field(F.minute), "SECONDS": _field(lambda c: F.date_part(F.lit("SECOND"), c), "decimal"), "TIMEZONE": timezone, "TZ": tz,
    "MD5": _hashed(F.md5), "SHA1": _hashed(F.sha1), "SHA256": _hashed(lambda c: F.sha2(c, 256)), "SHA384": _hashed(lambda c: F.sha2(c, 384)), "SHA512": _hashed(lambda c: F.sha2(c, 512)),
}
EXTENSIONS: dict[str, Function] = {A.XSD.lower() + k.lower(): _cast(k) for k in ("string", "integer", "decimal", "float", "double", "boolean", "dateTime")}
EXTENSIONS |= {A.XSD.lower() + k: _cast("integer") for k in ("int", "long")}
EXTENSIONS |= {ENGINE_NS + "printing": lambda _, message, x: x}  # a debugging identity
EXTENSIONS |= {EXPT_NS + "expt": _power, EXPT_NS + "sqrt": _root, TIME_NS + "datetime_in_seconds": _universal_seconds}
