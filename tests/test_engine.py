"""Standing rules: end-to-end cases with their known outputs."""

import pytest

from quern.cli import main
from quern.engine import Engine, EngineConfig, Registry
from quern.streaming.rules import RuleLimit

P = "PREFIX : <http://e/> PREFIX mem: <http://e/memory/>\n"
T = "@prefix : <http://e/> .\n"


def run(spark, tmp_path, rules, data="", suffix="ttl", **config):
    engine = Engine(spark, EngineConfig(base="http://b/", **config))
    made = engine.add_rules(P + rules)
    if data:
        (tmp_path / f"in.{suffix}").write_text(T + data)
        engine.add_input(f"{tmp_path}/in.{suffix}")
    engine.run()
    return engine, [engine.csv(r.name) for r in made if not r.updates]


def test_unbound_template_variables_are_skipped(spark, tmp_path):
    _, (out,) = run(spark, tmp_path, "INSERT { ?s ?p ?o } WHERE { BIND(:s2 AS ?s) OPTIONAL { ?s ?p ?o } } ; SELECT * { ?s ?p ?o }", ":s :p :o .")
    assert out == "s,p,o\nhttp://e/s,http://e/p,http://e/o\n"


def test_empty_where_fires_once_before_the_input(spark, tmp_path):
    _, (out,) = run(spark, tmp_path, "SELECT * { ?s ?p ?o } ; INSERT { :s :p :o } WHERE { }", ":d :v 1 . :d :v 2 .")
    assert out == "s,p,o\nhttp://e/s,http://e/p,http://e/o\nhttp://e/d,http://e/v,1\nhttp://e/d,http://e/v,2\n"


def test_feedback_in_the_order_of_events(spark, tmp_path):
    rules = """INSERT { GRAPH mem: { :count :value ?value } } WHERE { :init :value ?value } ;
      DELETE { :event :value ?val GRAPH mem: { :count :value ?sum } } INSERT { GRAPH mem: { :count :value ?new } }
      WHERE { :event :value ?val GRAPH mem: { :count :value ?sum } BIND(?sum + ?val AS ?new) } ;
      SELECT * { GRAPH mem: { ?s ?p ?o } }"""
    _, (out,) = run(spark, tmp_path, rules, ":init :value 0 . :event :value 1 . :event :value 1 . :event :value 1 . :event :value 7 .")
    assert [line.rpartition(",")[2] for line in out.splitlines()] == ["o", "0", "1", "2", "3", "10"]


def test_group_average(spark, tmp_path):
    _, (out,) = run(spark, tmp_path, "SELECT ?v (AVG(?v) AS ?avg) { :d :v ?v } GROUP BY ?v", ":d :v 1 . :d :v 2 . :d :v 3 .", unit="document")
    assert sorted(out.splitlines()) == ["1,1.0", "2,2.0", "3,3.0", "v,avg"]


@pytest.mark.parametrize(
    ("rules", "expected"),
    [
        ('SELECT ?result { BIND(COALESCE(?foo, "bar") AS ?result) }', "result\nbar\n"),
        ('SELECT ?result { BIND(IF("string" != 1, "correct", "problem") AS ?result) }', "result\nUNBOUND\n"),
        ("SELECT ?var { OPTIONAL { ?s1 ?p1 ?o1 } GRAPH mem: { OPTIONAL { ?s ?p ?var } } }", "var\nUNBOUND\n"),
        ("INSERT DATA { :s :p :o . GRAPH :g { :s :p :o } } ; SELECT * { GRAPH ?g { ?s ?p ?o } }", "g,s,p,o\nhttp://e/g,http://e/s,http://e/p,http://e/o\n"),
    ],
)
def test_rules_without_input(spark, tmp_path, rules, expected):
    assert run(spark, tmp_path, rules)[1] == [expected]


def test_difference_of_events_across_graphs(spark, tmp_path):
    data = ":G1 { :e1 a :E ; :list _:n1 . _:n1 :el :first, :second, :third } :G2 { :e2 a :E ; :list _:n2 . _:n2 :el :second, :third, :fourth }"
    rules = "SELECT DISTINCT ?e1 ?x { GRAPH ?g1 { ?e1 a :E ; :list ?y1 . ?y1 :el ?x } GRAPH ?g2 { ?e2 a :E ; :list ?y2 . ?y2 :el ?z } FILTER NOT EXISTS { GRAPH ?g2 { ?y2 :el ?x } } }"
    _, (out,) = run(spark, tmp_path, rules, data, "trig", unit="block")
    assert sorted(out.splitlines()) == ["e1,x", "http://e/e1,http://e/first", "http://e/e2,http://e/fourth"]


def test_event_mode_forgets_its_blocks(spark, tmp_path):
    rules = "DELETE { GRAPH mem: { :s :prev ?p } } INSERT { GRAPH mem: { :s :prev ?h } GRAPH :out { ?e :hour ?h } } WHERE { ?e :at ?t GRAPH mem: { OPTIONAL { :s :prev ?p } } BIND(HOURS(?t) AS ?h) }"
    data = '@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . :a :at "2014-01-07T09:18:21"^^xsd:dateTime . :b :at "2014-01-07T11:32:34"^^xsd:dateTime .'
    engine, _ = run(spark, tmp_path, rules, data, unit="block", operations="add:execute-snapshot:remove:execute")
    rows = {(r.s.lex.rpartition("/")[2], r.o.lex) for r in engine.quads.collect()}
    assert {("a", "9"), ("b", "11"), ("s", "11")} <= rows and all(r.p.lex != "http://e/at" for r in engine.quads.collect())


def test_policies_and_removal(spark, tmp_path):
    rules = "DELETE { ?x :token ?t } INSERT { ?x :took ?t } WHERE { ?x :free true . ?x :token ?t }"
    data = ":x :free true ; :token 1 ."
    engine, _ = run(spark, tmp_path, rules, data, unit="document", policy="first")
    assert sum(r.p.lex == "http://e/took" for r in engine.quads.collect()) == 1
    loop = "INSERT { ?x :n ?m } WHERE { ?x :n ?k BIND(?k + 1 AS ?m) }"
    with pytest.raises(RuleLimit):
        run(spark, tmp_path, loop, ":x :n 1 .", unit="document", policy="repeat-snapshot", max_rounds=3)
    engine, _ = run(spark, tmp_path, loop, ":x :n 1 .", unit="document", policy="snapshot")
    assert engine.quads.count() == 2
    with pytest.raises(ValueError, match="unknown"):
        Engine(spark, EngineConfig(operations="add:explode"))


def test_late_rules_chains_and_scripts(spark, tmp_path):
    first = Engine(spark, EngineConfig(unit="document"))
    first.add_rules(P + "CONSTRUCT { ?s :big ?v } WHERE { ?s :v ?v FILTER(?v > 1) }")
    second = Registry(spark).create("second")
    second.add_rules(P + "# @name Seen\nSELECT ?s { ?s :big ?v }")
    first.add_listener(second)
    (tmp_path / "d.ttl").write_text(T + ":a :v 1 . :b :v 2 .")
    first.add_input(f"{tmp_path}/d.ttl")
    first.run()
    assert [r.s.lex for r in second.results("Seen").collect()] == ["http://e/b"]
    (late,) = first.add_rules(P + "SELECT ?s { ?s :v ?v }")
    first.run()
    assert first.results(late.name).count() == 2
    first.run_sequential(P + "DELETE WHERE { ?s :v 1 } ; INSERT DATA { :c :v 9 } ; CLEAR GRAPH :none")
    assert sorted(r.s.lex for r in first.quads.collect()) == ["http://e/b", "http://e/c"]


def test_command_line(spark, tmp_path):
    (tmp_path / "r.rq").write_text(P + "# @name All\nSELECT ?s ?v { ?s :v ?v } ; ASK { ?s :v 2 } ; CONSTRUCT { ?v :of ?s . :x :had ?v } WHERE { ?s :v ?v }")
    (tmp_path / "d.ttl").write_text(T + ":a :v 1 . :b :v 2 .")
    said = []
    code = main([f"--directory={tmp_path}", "--select-output=" + f"{tmp_path}/o.csv", f"--ask-output-srx={tmp_path}/o.srx", f"--construct-output-nt={tmp_path}/o.nt", "--report=all", f"--report-sizes-file={tmp_path}/s.csv", f"--rete-html={tmp_path}/p.html", "-r", "r.rq", "--input-document=d.ttl", f"--time={tmp_path}/t.csv"], spark, said.append)
    assert code == 0
    assert sorted((tmp_path / "o.csv").read_text().splitlines()) == ["http://e/a,1", "http://e/b,2", "s,v"]
    assert "<boolean>true</boolean>" in (tmp_path / "o.srx").read_text() and (tmp_path / "o.nt").read_text().count(" .\n") == 2
    assert any(x.startswith("All,SELECT,1") for x in said) and "round,rule" in (tmp_path / "s.csv").read_text() and "Project" in (tmp_path / "p.html").read_text()
    assert main(["--help"], spark, said.append) == 0 and main(["--nonsense=1"], spark, said.append) == 2 and main(["--version"], spark, said.append) == 0
