import pytest

from quern.compare import cells, isomorphic, same_quads, same_solutions
from quern.engine import format_of, read_rdf
from quern.session import Dataset
from quern.sources import ntriples, results, turtle
from quern.sources.quads import QuadSource, quads_of
from quern.sparql import ast as A

TRIG = """@prefix : <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a a :B ; :p 1, 2.50, "x\\ty"@en, '''long
text''' , [ :q true ] ; :l (1 2) .
GRAPH :g { _:b :p "z"^^:t . :c :p _:b }
:h { :d :p :e } { :f :p :i }
PREFIX k: <http://k/>
k:x\\~y :p <rel>, "q\\"uote\\\\" .
"""


@pytest.fixture
def quads(spark, tmp_path):
    (tmp_path / "in.trig").write_text(TRIG, encoding="utf-8")
    return read_rdf(spark, f"{tmp_path}/in.trig", base="http://base/").cache()


def test_trig(quads):
    assert quads.count() == 18 and [r.block_id for r in quads.select("block_id").distinct().orderBy("block_id").collect()] == [0, 1, 2, 3, 4]
    assert {r.g.lex for r in quads.where("g is not null").select("g").collect()} == {"http://e/g", "http://e/h"}
    assert "http://base/rel" in {r.o.lex for r in quads.select("o").collect()} and "http://k/x~y" in {r.s.lex for r in quads.select("s").collect()}


@pytest.mark.parametrize("kind", ["nq", "trig", "prefixed"])
def test_round_trip(spark, quads, tmp_path, kind):
    out = f"{tmp_path}/out"
    if kind == "nq":
        ntriples.write_statements(quads, out)
        back = ntriples.read_statements(spark, out)
    else:
        turtle.write_turtle(quads, out, {"": "http://e/"} if kind == "prefixed" else None)
        back = turtle.read_turtle(spark, out)
    if kind == "nq":
        assert same_quads(quads, back)
    else:  # blank nodes that files share are told apart by file
        ground = lambda df: df.where("s.kind <> 1 and o.kind <> 1")
        assert same_quads(ground(quads), ground(back)) and back.count() == quads.count()


def test_line_format(spark, tmp_path):
    lines = ['<http://e/s> <http://e/p> "a\\u00e9\\\\u0041\\n\\"" .', "# comment", "", "_:x.y <http://e/p> <http://e/o> <http://e/g> . # end", '_:x.y <http://e/p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .', '<http://e/s> <http://e/p> "x"@en-GB .']
    (tmp_path / "a.nq").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "b.nq").write_text(lines[3], encoding="utf-8")
    rows = ntriples.read_statements(spark, f"{tmp_path}/a.nq").collect()
    assert sorted(r.o.lex for r in rows) == ["1", 'aé\\u0041\n"', "http://e/o", "x"] and {r.o.lang for r in rows} == {None, "en-GB"}
    blank = {r.s.lex for r in ntriples.read_statements(spark, [f"{tmp_path}/a.nq", f"{tmp_path}/b.nq"]).collect() if r.s.kind == 1}
    assert len(blank) == 2  # renamed by file
    (tmp_path / "bad.nt").write_text("<http://e/s> nonsense .\n<http://e/s> <http://e/p> <http://e/o> .", encoding="utf-8")
    assert ntriples.read_statements(spark, f"{tmp_path}/bad.nt", malformed="drop").count() == 1
    with pytest.raises(Exception, match="not a statement"):
        ntriples.read_statements(spark, f"{tmp_path}/bad.nt").collect()


def test_formats():
    assert [format_of(f"x.{s}") for s in ("trig", "TTL", "nt", "n-quads")] == ["trig", "turtle", "nt", "nq"]
    with pytest.raises(ValueError, match="format"):
        format_of("x.rdf")


def test_results_round_trip(spark):
    quads = quads_of(spark, [A.Quad(A.Iri("http://e/a"), A.Iri("http://e/p"), o) for o in (A.Lit("x,\"y\"", A.STRING), A.Lit("<z>", A.LANG_STRING, "en"), A.Lit("1", A.INTEGER), A.BNode("b"))])
    d = Dataset(QuadSource(quads), terms="term")
    df = d.query("SELECT ?s ?o ?u { ?s ?p ?o OPTIONAL { ?o ?q ?u } }")
    assert same_solutions(df, results.read_srx(spark, "".join(results.srx_lines(df))))
    assert same_solutions(df, results.read_srj(spark, results.srj_text(df)))
    text = results.csv_text(df)
    assert text.splitlines()[0] == "s,o,u" and 'http://e/a,"x,""y""",UNBOUND' in text
    from quern.conformance import result_set

    made = [q for _, q in turtle.parse_quads("".join(results.result_set_turtle(df)))]
    assert same_solutions(df, result_set(spark, made))
    ask = d.query("ASK { ?s ?p 1 }")
    assert results.read_srx(spark, "".join(results.srx_lines(ask))).first().ask and results.read_srj(spark, results.srj_text(ask)).first().ask


def test_isomorphism(spark):
    b = lambda n: (1, n, None, None)
    i = (0, "p", None, None)
    ring = lambda names: [(b(x), i, b(y)) for x, y in zip(names, names[1:] + names[:1])]
    assert isomorphic(ring(list("abcd")), ring(list("wxyz"))) and not isomorphic(ring(list("abcd")), ring(list("ab")) + ring(list("cd")))
    assert not isomorphic([(b("a"), i, b("a"))], [(b("a"), i, b("b"))])
    assert cells(quads_of(spark, [])) == []


def test_conformance_runner(spark, tmp_path):
    from quern.conformance import run_manifest

    (tmp_path / "d.ttl").write_text("<http://e/a> <http://e/p> 1 , 2 .")
    (tmp_path / "q.rq").write_text("SELECT ?o { ?s <http://e/p> ?o FILTER(?o > 1) }")
    (tmp_path / "r.srx").write_text('<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head><variable name="o"/></head><results><result><binding name="o"><literal datatype="http://www.w3.org/2001/XMLSchema#integer">2</literal></binding></result></results></sparql>')
    (tmp_path / "bad.rq").write_text("SELECT {")
    (tmp_path / "u.ru").write_text("DELETE WHERE { ?s ?p 1 }")
    (tmp_path / "after.ttl").write_text("<http://e/a> <http://e/p> 2 .")
    (tmp_path / "manifest.ttl").write_text("""@prefix mf: <http://www.w3.org/2001/sw/DataAccess/tests/test-manifest#> . @prefix qt: <http://www.w3.org/2001/sw/DataAccess/tests/test-query#> . @prefix ut: <http://www.w3.org/2009/sparql/tests/test-update#> .
<> mf:entries (<#1> <#2> <#3>) . <#1> a mf:QueryEvaluationTest ; mf:name "one" ; mf:action [ qt:query <q.rq> ; qt:data <d.ttl> ] ; mf:result <r.srx> .
<#2> a mf:NegativeSyntaxTest11 ; mf:name "two" ; mf:action <bad.rq> . <#3> a mf:UpdateEvaluationTest ; mf:name "three" ; mf:action [ ut:request <u.ru> ; ut:data <d.ttl> ] ; mf:result [ ut:data <after.ttl> ] .""")
    assert [(o.name, o.passed) for o in run_manifest(spark, f"{tmp_path}/manifest.ttl")] == [("one", True), ("two", True), ("three", True)]
