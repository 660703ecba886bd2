"""Truth tables of operators and functions: constants (static types) and data (types at run time)."""

import datetime

import pytest

from quern.session import Dataset
from quern.sources.quads import QuadSource, quads_of
from quern.sparql import ast as A
from quern.sparql.parser import Parser

PREFIXES = {"xsd": A.XSD, "": "http://e/"}
E = None  # error or unbound


def term(text):
    return None if text is None else Parser(text, prefixes=PREFIXES).term()


CASES = {
    "?x = ?y": [("1", "1.0", "true"), ("1.0e0", "1", "true"), ("-1", "10", "false"), ('""', '""', "true"), ('"Some"', '""', "false"), ('"Some"@en', '"Some"@EN', "true"), ('"Some"@fi', '"Some"@en', E), ('"Some"@en', '"Some"', E), ('"string"', "1", E), (":a", ":a", "true"), (":a", ":b", "false"), (":a", "1", "false"), ('"2013-10-23T22:34:56Z"^^xsd:dateTime', '"2013-10-24T00:34:56+02:00"^^xsd:dateTime', "true"), ('"huup"^^:t', '"huup"^^:t', "true"), ('"huup"^^:t', '"puup"^^:t', E), ("true", "false", "false")],
    "?x != ?y": [("1", "1.0", "false"), ("-1", "10", "true"), ('"Some"@fi', '"Some"@en', E), ('"string"', "1", E), (":a", ":b", "true")],
    "?x < ?y": [("1", "2.5", "true"), ('"a"', '"b"', "true"), ('"b"', '"a"', "false"), ("false", "true", "true"), ('"2013-10-23T22:34:56Z"^^xsd:dateTime', '"2013-10-23T22:34:56-01:00"^^xsd:dateTime', "true"), ('"a"', "1", E), (":a", ":b", E)],
    "?x >= ?y": [("2", "2.0", "true"), ("1", "2", "false")],
    "?x + ?y": [("1", "2", "3"), ("1", "2.5", "3.5"), ("1", "2.5e0", "3.5"), ('"1"', "2", E), ("9223372036854775807", "1", E)],
    "?x / ?y": [("1", "2", "0.5"), ("1", "0", E), ("1.0", "0", E)],
    "?x * ?y - 1": [("3", "4", "11"), (":a", "1", E)],
    "?x && ?y": [("true", "true", "true"), ("false", ":a", "false"), ("true", ":a", E), ("0", "true", "false"), ('""', "true", "false")],
    "?x || ?y": [("false", "false", "false"), ("true", ":a", "true"), ("false", ":a", E), ("1.3", "false", "true")],
    "!?x": [("true", None, "false"), ('""', None, "true"), ('"some"', None, "false"), ("0", None, "true"), ("1.2e10", None, "false"), (None, None, E), (":a", None, E), ('"2013-10-22T12:34:56"^^xsd:dateTime', None, E), ('"abc"^^xsd:integer', None, "true")],
    "-?x": [("1", None, "-1"), ("-10.5", None, "10.5"), ("true", None, E)],
    "sameTerm(?x, ?y)": [("1", "1", "true"), ("1", "1.0", "false"), ('"a"', '"a"@en', "false"), (":a", ":a", "true")],
    "?x IN (?y, 2, :a)": [("2", "5", "true"), ("5", "5", "true"), (":a", ":b", "true"), ("7", "5", "false")],
    "IF(?x, ?y, \"no\")": [("true", "1", "1"), ("false", "1", "no"), (":a", "1", E)],
    "COALESCE(?x, 1/0, ?y)": [(None, "7", "7"), ('"a"', "7", "a"), (None, None, E)],
    "STR(?x)": [("1", None, "1"), (":a", None, "http://e/a"), ('"a"@en', None, "a")],
    "LANG(?x)": [('"a"@en', None, "en"), ('"a"', None, ""), (":a", None, E)],
    "STR(DATATYPE(?x))": [("1", None, A.INTEGER), ('"a"', None, A.STRING), ('"a"@en', None, A.LANG_STRING), (":a", None, E)],
    "isNumeric(?x)": [("1", None, "true"), ('"1"', None, "false"), ('"x"^^xsd:integer', None, "false")],
    "isIRI(?x)": [(":a", None, "true"), ("1", None, "false")],
    "isLiteral(?x)": [(":a", None, "false"), ("1", None, "true")],
    "SUBSTR(?x, 2, 3)": [('"abcdef"', None, "bcd"), ('"a"', None, ""), ("1", None, E)],
    "LANG(UCASE(?x))": [('"abc"@en', None, "en"), ('"abc"', None, "")],
    "STRBEFORE(?x, ?y)": [('"abc"', '"b"', "a"), ('"abc"', '"z"', ""), ('"abc"@en', '"b"@fr', E), ('"abc"', '""', "")],
    "STRAFTER(?x, ?y)": [('"abc"', '"b"', "c"), ('"abc"', '"z"', ""), ('"abc"', '""', "abc"), ('"abc"@en', '"b"', "c")],
    "CONTAINS(?x, ?y)": [('"abc"', '"b"', "true"), ('"abc"', '"b"@en', E), ('"abc"@en', '"b"@en', "true")],
    "CONCAT(?x, ?y)": [('"a"', '"b"', "ab"), ('"a"', "1", E)],
    "LANG(CONCAT(?x, ?y))": [('"a"@en', '"b"@en', "en"), ('"a"@en', '"b"', "")],
    "ENCODE_FOR_URI(?x)": [('"Los Angeles~*é"', None, "Los%20Angeles~%2A%C3%A9")],
    "REGEX(?x, ?y)": [('"abc"', '"^a.c$"', "true"), ('"abc"', '"^b"', "false"), ("1", '"1"', E)],
    'REGEX(?x, ?y, "i")': [('"ABC"', '"^a"', "true")],
    'REGEX(?x, ?y, "q")': [('"a.c"', '"."', "true"), ('"abc"', '"."', "false")],
    'REPLACE(?x, ?y, "Z")': [('"abcb"', '"b"', "aZcZ")],
    "langMatches(?x, ?y)": [('"en-US"', '"EN"', "true"), ('"en"', '"*"', "true"), ('""', '"*"', "false"), ('"eng"', '"en"', "false")],
    "ABS(?x)": [("-3", None, "3"), ("-2.5", None, "2.5"), ('"a"', None, E)],
    "ROUND(?x)": [("-2.5", None, "-2.0"), ("2.5", None, "3.0"), ("7", None, "7")],
    "CEIL(?x)": [("1.2", None, "2.0"), ("-1.2", None, "-1.0")],
    "FLOOR(?x)": [("1.8", None, "1.0"), ("-1.2", None, "-2.0")],
    "HOURS(?x)": [('"2011-01-10T14:45:13.815-05:00"^^xsd:dateTime', None, "14"), ('"a"', None, E)],
    "SECONDS(?x)": [('"2011-01-10T14:45:13.815-05:00"^^xsd:dateTime', None, "13.815")],
    "TZ(?x)": [('"2011-01-10T14:45:13-05:00"^^xsd:dateTime', None, "-05:00"), ('"2011-01-10T14:45:13"^^xsd:dateTime', None, ""), ('"2011-01-10T14:45:13Z"^^xsd:dateTime', None, "Z")],
    "STR(TIMEZONE(?x))": [('"2011-01-10T14:45:13-05:00"^^xsd:dateTime', None, "-PT5H"), ('"2011-01-10T14:45:13Z"^^xsd:dateTime', None, "PT0S"), ('"2011-01-10T14:45:13"^^xsd:dateTime', None, E)],
    "MD5(?x)": [('"abc"', None, "900150983cd24fb0d6963f7d28e17f72"), (":a", None, E)],
    "xsd:integer(?x)": [("3.7", None, "3"), ('"12"', None, "12"), ('"x"', None, E), ("true", None, "1"), (":a", None, E)],
    "xsd:double(?x)": [('"1.5e1"', None, "15.0"), ("2", None, "2.0")],
    "xsd:boolean(?x)": [('"true"', None, "true"), ("0", None, "false"), ('"x"', None, E)],
    "xsd:string(?x)": [("1", None, "1"), (":a", None, "http://e/a")],
    "xsd:dateTime(?x)": [('"2011-01-10T14:45:13Z"', None, "2011-01-10T14:45:13Z"), ("1", None, E)],
    "STRLEN(STRDT(?x, :t))": [('"ab"', None, E)],
    "LANG(STRLANG(?x, ?y))": [('"ab"', '"DE"', "de")],
    "<http://e/unknown>(?x)": [("1", None, E)],
}


def _result(spark, expr, rows):
    quads = [A.Quad(A.Iri(f"http://e/r{i}"), A.Iri(f"http://e/{n}"), term(v)) for i, (x, y, _) in enumerate(rows) for n, v in (("x", x), ("y", y), ("row", str(i))) if v is not None]
    d = Dataset(QuadSource(quads_of(spark, quads)), prefixes=PREFIXES)
    found = d.query(f"SELECT ?i ?z {{ ?r :row ?i OPTIONAL {{ ?r :x ?x }} OPTIONAL {{ ?r :y ?y }} BIND({expr} AS ?z) }}").collect()
    return {int(r.i): _text(r.z) for r in found}


def _text(x):
    if isinstance(x, datetime.datetime):
        return x.isoformat() + "Z"
    return None if x is None else str(x).lower() if isinstance(x, bool) else str(x)


@pytest.mark.parametrize("expr", list(CASES))
def test_run_time_types(spark, expr):
    rows = CASES[expr]
    got = _result(spark, expr, rows)
    want = {i: w for i, (_, _, w) in enumerate(rows)}
    same = lambda a, b: a == b or (a is not None and b is not None and _number(a) is not None and _number(a) == _number(b))
    assert all(same(_text(got[i]), want[i]) for i in want), (expr, got, want)


def _number(s):
    try:
        return float(s)
    except ValueError:
        return None


def test_static_types(spark):
    """The same tables with constants in the query text, in one query for each row."""
    d = Dataset(QuadSource(quads_of(spark, [])), prefixes=PREFIXES)
    parts, want = [], []
    for expr, rows in CASES.items():
        for x, y, w in rows:
            if x is None or (y is None and "?y" in expr):
                continue
            text = expr.replace("?x", x).replace("?y", y or "")
            parts.append(f"({text} AS ?v{len(parts)})")
            want.append((text, w))
    got = []
    for i in range(0, len(parts), 40):
        row = d.query(f"SELECT {' '.join(parts[i : i + 40])} {{}}").first()
        got += [_text(v) for v in row]
    bad = [(t, g, w) for (t, w), g in zip(want, got) if g != w and (g is None or w is None or _number(g) is None or _number(g) != _number(w))]
    assert not bad


def test_random_and_registered_functions(spark):
    from pyspark.sql import functions as F

    from quern.engine import Engine

    engine = Engine(spark)
    engine.register_function("http://e/shout", lambda c: F.concat(F.upper(c), F.lit("!")))
    row = engine.dataset().query('SELECT (<http://e/shout>("hey") AS ?a) (STRLEN(STRUUID()) AS ?b) (STRSTARTS(STR(UUID()), "urn:uuid:") AS ?c) (RAND() < 1 AS ?d) (isBlank(BNODE()) AS ?e) (NOW() > "2020-01-01T00:00:00Z"^^<http://www.w3.org/2001/XMLSchema#dateTime> AS ?f) {}').first()
    assert tuple(row) == ("HEY!", 36, True, True, True, True)


def test_parity_mode(spark):
    d = Dataset(QuadSource(quads_of(spark, [])), parity=True)
    assert tuple(d.query('SELECT (SUBSTR("abc", 1) AS ?a) (SUBSTR("abc", 5) AS ?b) {}').first()) == ("bc", None)
    assert d.query("SELECT (COUNT(*) AS ?n) { ?s ?p ?o }").count() == 0
