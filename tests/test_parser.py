import pytest

from quern.sparql import SparqlSyntaxError, parse
from quern.sparql import ast as A

P = "PREFIX : <http://e/> "


def where(text):
    return parse(P + f"SELECT * {{ {text} }}")[0].where.elements


def test_triples_and_lists():
    (bgp,) = where(":a a :B ; :p 1, 2.5, 1e3, 'x'@en, \"y\"^^:t, true ; .")
    assert [t.o for t in bgp.triples] == [A.Iri("http://e/B"), A.Lit("1", A.INTEGER), A.Lit("2.5", A.DECIMAL), A.Lit("1e3", A.DOUBLE), A.Lit("x", A.LANG_STRING, "en"), A.Lit("y", "http://e/t"), A.Lit("true", A.BOOLEAN)]
    (bgp,) = where("(1 ?x) :p [ :q [] ] .")
    assert len(bgp.triples) == 6


def test_variables_ignore_case_and_mark():
    (bgp,) = where("?Abc :p $aBC")
    assert bgp.triples[0].s == bgp.triples[0].o == A.Var("abc")


def test_precedence():
    (f,) = where("FILTER(?a + 1 * 2 < 3 && ?b = 4 || !?c)")
    assert f.expr.name == "||" and f.expr.args[0].name == "&&" and f.expr.args[0].args[0].name == "<"
    assert f.expr.args[0].args[0].args[0] == A.Call("+", (A.Var("a"), A.Call("*", (A.Lit("1", A.INTEGER), A.Lit("2", A.INTEGER)))))


def test_paths():
    (bgp,) = where("?x (:a/^:b|!(:c|^:d))+ ?y")
    p = bgp.triples[0].p
    assert isinstance(p, A.PathMod) and isinstance(p.path, A.PathAlt) and p.path.items[1] == A.PathNeg((A.Iri("http://e/c"),), (A.Iri("http://e/d"),))


def test_escapes_names_and_several_operations():
    ops = parse(P + r'''# @name First
        SELECT * { ?s :p "A\t" } ;
        # @name Second
        DELETE { ?s :p ?o } INSERT { GRAPH :g { ?s :q [] } } WHERE { ?s :p ?o } ; INSERT DATA { :a :b :c }''')
    assert [o.name for o in ops] == ["First", "Second", None]
    assert ops[0].where.elements[0].triples[0].o == A.Lit("A\t")
    assert ops[1].insert[0].g == A.Iri("http://e/g") and isinstance(ops[1].insert[0].o, A.BNode)


def test_base_and_prefix_resolution():
    (q,) = parse("BASE <http://b/x/> PREFIX p: <y#> SELECT * { <z> p:k <http://abs/> }")
    t = q.where.elements[0].triples[0]
    assert (t.s.value, t.p.value, t.o.value) == ("http://b/x/z", "http://b/x/y#k", "http://abs/")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT", "SELECT * { ?s ?p }", "SELECT * { ?s :p ?o", "SELECT * { _:a :p 1 OPTIONAL { ?x :p 2 } _:a :q 3 }", "SELECT ?x { BIND(1 AS ?x) BIND(2 AS ?x) }", "SELECT (1 AS ?a) (2 AS ?a) {}",
        "INSERT DATA { ?x :p 1 }", "DELETE { _:b :p 1 } WHERE {}", "SELECT * { FILTER(STRLEN()) }", "SELECT * { ?s nope:p 1 }", "ASK { VALUES (?a ?b) { (1) } }", "SELECT * { ?s :p 'a\\q' }", "SELECT * {} GROUP BY ?x",
    ],
)
def test_errors(text):
    with pytest.raises(SparqlSyntaxError):
        parse(P + text)
