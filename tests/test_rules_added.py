"""Rules that are matched with the added quads alone, and what listeners get."""

from quern.engine import Engine, EngineConfig
from quern.sources.quads import quads_of
from quern.sparql.parser import parse
from quern.streaming.rules import is_plain

P = "PREFIX : <http://e/>\n"


class Listener:
    def __init__(self):
        self.got = []

    def process(self, unit):
        self.got.append({(r.s.lex[-1], r.o.lex[-1]) for r in unit.collect()})


def test_added_quads_alone(spark):
    engine = Engine(spark, EngineConfig(unit="document", policy="repeat-snapshot"))
    pairs, _ = engine.add_rules(P + "SELECT ?x ?z { ?x :p ?y . ?y :p ?z FILTER(?x != ?z) } ; CONSTRUCT { ?y :inv ?x } WHERE { ?x :p ?y }")
    listener = Listener()
    engine.add_listener(listener)
    unit = lambda text: quads_of(spark, list(parse(P + "INSERT DATA {" + text + "}", "", {})[0].insert))
    for text in (":a :p :b . :b :p :c", ":a :p :b . :c :p :a"):
        engine.process(unit(text))
    assert listener.got == [{("b", "a"), ("c", "b")}, {("a", "c")}]
    assert {(r.x.lex[-1], r.z.lex[-1]) for r in engine.results(pairs.name).collect()} == {("a", "c"), ("b", "a"), ("c", "b")}
    gone = unit(":b :p :c")
    engine.rules.change(gone, gone.limit(0))
    assert pairs.matches.count() == 1 and engine.quads.where("p.lex = 'http://e/p'").count() == 2


def test_plain_rules():
    plain = lambda text: is_plain(parse(P + text, "", {})[0])
    assert plain("SELECT ?x { ?x :p ?y GRAPH ?g { ?y :q ?z } BIND(1 AS ?k) }") and plain("DELETE { ?x :p ?y } INSERT { ?x :q ?y } WHERE { ?x :p ?y }")
    for text in ("SELECT ?x { ?x :p+ ?y }", "SELECT ?x { ?x :p ?y OPTIONAL { ?y :q ?z } }", "SELECT (COUNT(*) AS ?n) { ?x :p ?y }", "SELECT ?x { ?x :p ?y FILTER NOT EXISTS { ?y :q ?x } }", "SELECT ?x { ?x :p ?y } LIMIT 1", "CLEAR ALL"):
        assert not plain(text)
