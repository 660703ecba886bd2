import json

from quern.llm import chat, op1

SF = "/root/testdata/sf0.001"
SCHEMAS = [("add", "a", "integer", True), ("add", "b", "number", True), ("add", "note", "string", False), ("add", "o", "object", False), ("add", "l", "array", False), ("add", "f", "boolean", False)]


def _link(spark, calls, results, schemas=SCHEMAS):
    c = spark.createDataFrame([(*x, 0) for x in calls], "call_id string, parent_id string, name string, arguments string, level int")
    r = spark.createDataFrame([(*x, 0) for x in results], "call_id string, content string, json int")
    s = spark.createDataFrame(schemas, "tool string, param string, kind string, required boolean")
    return chat.link_tool_calls(c, r, s)


def test_levels_of_chains_trees_and_circles(spark):
    calls = [(f"c{i}", f"c{i - 1}", "add", None) for i in range(40)] + [("x", "y", "add", None), ("y", "x", "add", None), ("z", "y", "add", None), ("s", "s", "add", None), ("t", "c5", "add", None), ("u", "nowhere", "add", None), ("v", None, "add", None)]
    rows = {r.call_id: (r.parent_id, r.root_id, r.level) for r in _link(spark, calls, []).collect()}
    assert all(rows[f"c{i}"] == (f"c{i - 1}" if i else None, "c0", i) for i in range(40))
    assert rows["t"] == ("c5", "c0", 6) and rows["u"] == (None, "u", 0) and rows["v"] == (None, "v", 0)
    assert all(rows[k][1:] == (None, None) for k in "xyzs")


def test_validation(spark):
    good = '{"b": 1.5, "a":1}'
    cases = {good: "", '{"a":"1","b":2}': "type:a", '{"a":1}': "missing:b", '{"a":1,"b":2,"q":0}': "unknown:q", "[1]": "json", "{": "json", "null": "json", '{"a":null,"b":true}': "type:a,type:b", '{"a":1,"b":2,"note":"","o":{"k":[]},"l":[1],"f":false}': "", '{"a":1,"a":2,"b":1}': "json"}
    calls = [(str(i), None, "add", a) for i, a in enumerate(cases)] + [("n", None, "add", None), ("t", None, "other", "{}"), ("e", None, None, "{}")]
    rows = {r.call_id: r for r in _link(spark, calls, []).collect()}
    assert {a: rows[str(i)].errors for i, a in enumerate(cases)} == cases
    assert rows["n"].errors == "json" and rows["t"].errors == "tool" and rows["e"].errors == "tool" and not rows["n"].valid
    assert rows["0"].json.startswith('{"arguments":{"a":1,"b":1.5},"id":"0","level":0,')
    assert all(list(json.loads(r.json)) == sorted(json.loads(r.json)) for r in rows.values())


def test_linking_edges(spark):
    calls = [("a", None, "add", '{"a":1,"b":1}'), ("a", None, "add", '{"a":2,"b":1}'), ("a", None, "add", '{"a":2,"b":1}'), ("p", "a", "add", "{}"), (None, "a", "add", "{}")]
    results = [("a", "two"), ("a", "one"), ("o", "lost"), (None, "none"), ("p", None), ("big", "é\n" * 100_000)]
    rows = _link(spark, calls, results).collect()
    assert sorted((r.call_id or "", r.status) for r in rows) == [("", "unidentified"), ("", "unidentified"), ("a", "linked"), ("big", "orphan"), ("o", "orphan"), ("p", "linked")]
    a = next(r for r in rows if r.call_id == "a")
    assert json.loads(a.json) == {"arguments": {"a": 1, "b": 1}, "id": "a", "level": 0, "name": "add", "result": "one", "status": "linked", "valid": True}
    assert json.loads(next(r for r in rows if r.call_id == "big").json)["result"] == "é\n" * 100_000
    assert _link(spark, [], []).count() == 0 and _link(spark, calls, results, []).where("errors = 'tool'").count() == 2


def test_query_has_no_python_on_executors(spark):
    frame = op1.op1_tool_calls(spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert frame.where("status = 'linked'").count() > 0


def test_canonical_json(spark):
    same = [["1", "1.0", "1e0", "10e-1"], ["100", "1e2", "1E+2"], ["0", "-0", "0.0", "0e9"], ["1e-7", "0.0000001"], ["1e21", "1000000000000000000000"], ["0.000001", "1e-6"], ["-12.5", "-1.25e1"], ["123456789012345680000", "1.2345678901234568e20"], ["9007199254740992"]]
    want = ["1", "100", "0", "1e-7", "1e+21", "0.000001", "-12.5", "123456789012345680000", "9007199254740992"]
    rows = [(i, '{"b":[%s],"a":{"x 1e0":"-1.0e2\\\\\\" 7.0"}}' % t) for i, group in enumerate(same) for t in group]
    df = spark.createDataFrame(rows, "i int, t string")
    for r in df.select("i", chat.canonical_json(df.t).alias("json"), chat.has_lost_numbers(df.t).alias("lost")).collect():
        assert r.json == '{"a":{"x 1e0":"-1.0e2\\\\\\" 7.0"},"b":[%s]}' % want[r.i] and not r.lost, r
    cases = {"9007199254740993": True, "1E400": True, "-1e400": True, "9" * 41: True, '"1E400"': False, "1e-400": False, "0.1": False, "1152921504606846976": True, "{": False, '"' + '\\n\\"' * 100_000 + '"': False}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.lost for r in df.select("t", chat.has_lost_numbers(df.t).alias("lost")).collect()} == cases
    (row,) = _link(spark, [("a", None, "add", '{"a":1,"b":1e400}')], []).collect()
    assert (row.errors, row.valid, row.json) == ("number", False, '{"id":"a","level":0,"name":"add","status":"pending","valid":false}')
