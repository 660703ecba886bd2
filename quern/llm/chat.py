"""Chat formatting: link tool calls with their results, order them, check and serialise them.

Native throughout: DataFrame functions alone, no Python on the executors.

Calls (call_id, parent_id, name, arguments as JSON text) and results (call_id, content) are
reduced to one row for each id with partial aggregation and meet in an equality join on the
id, so neither a hot conversation nor a repeated id makes a hot key. A call may name one
earlier call as its parent; levels (the topological order) and roots come from pointer
doubling over ids alone: after k rounds a row knows its ancestor 2^k levels up, so a chain
of n calls takes log2(n) joins, each written to the shared folder. Arguments are parsed as
variants and checked against the tool's schema; the JSON text has sorted keys, no white
space and one spelling for each value, numbers as RFC 8785 has them (the shortest text of the
double). Whole numbers that this spelling would change and numbers beyond its range are refused.

Result, one row for each id that is a call or a result: call_id, status (``linked``,
``pending`` for a call without result, ``orphan`` for a result without call), parent_id
(null unless that call exists), root_id, level (0 for roots; null for orphans and where the
parents form a circle), valid, errors (comma-joined: ``json``, ``number``, ``tool``,
``missing:p``, ``type:p``, ``unknown:p``), json.

Edge cases: rows with a null id are left out of the ids and returned once each as
``unidentified`` with their own JSON; of several calls or results with one id the smallest
(by name, arguments, parent; by content) counts; null or malformed arguments are a ``json``
error, refused numbers a ``number`` error, and both are left out of the JSON text; a null result content is a result; empty tables give
empty results; columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize

_KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT%", "array": "ARRAY%"}


def _outside_strings(text: Column, change) -> Column:
    """JSON text with ``change`` applied to the arrays of its tokens outside of strings."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    parts = F.transform(F.split(plain, '"', -1), lambda p, i: F.when(i % 2 == 1, p).otherwise(F.array_join(change(F.regexp_extract_all(p, F.lit("(-?[0-9][0-9.eE+-]*|[^0-9-]+|-)"), F.lit(1))), "")))
    return F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def canonical_number(token: Column) -> Column:
    """The spelling that RFC 8785 gives the double nearest to a JSON number."""
    value = token.cast("double")
    java = F.abs(value).cast("string")  # like 12.5 or 1.25E-7
    part = lambda i: F.regexp_extract(java, r"^([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", i)
    both = F.concat(part(1), part(2))
    bare = F.regexp_replace(both, "^0+", "")
    digits = F.regexp_replace(bare, "0+$", "")
    point = F.length(part(1)) + F.when(part(3) == "", 0).otherwise(part(3).try_cast("int")) - (F.length(both) - F.length(bare))
    k = F.length(digits)
    whole = F.concat(digits, F.repeat(F.lit("0"), point - k))
    mixed = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, k))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    fraction = F.when(k > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), k))).otherwise("")
    power = F.concat(F.substring(digits, 1, 1), fraction, F.when(point > 0, "e+").otherwise("e-"), F.abs(point - 1).cast("string"))
    text = F.when(value == 0, "0").when((k <= point) & (point <= 21), whole).when((point > 0) & (point <= 21), mixed).when((point > -6) & (point <= 0), small).otherwise(power)
    return F.concat(F.when(value < 0, "-").otherwise(""), text)


def _is_number(token: Column) -> Column:
    return token.rlike("^-?[0-9]")


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys, no white space and canonical numbers; null if it isn't JSON."""
    made = F.to_json(F.try_parse_json(text))
    spelt = _outside_strings(made, lambda tokens: F.transform(tokens, lambda t: F.when(_is_number(t), canonical_number(t)).otherwise(t)))
    return F.when(made.rlike("[0-9]([.eE]|[0-9]{15})"), spelt).otherwise(made)  # short whole numbers are canonical


def has_lost_numbers(text: Column) -> Column:
    """If JSON text has a whole number that its canonical spelling changes, or one beyond a double."""
    exact = lambda t: F.coalesce(t.try_cast("decimal(38,0)") == t.cast("double").try_cast("decimal(38,0)"), F.lit(False))
    lost = lambda t: _is_number(t) & (F.coalesce(F.abs(t.try_cast("double")) == float("inf"), F.lit(False)) | (t.rlike("^-?[0-9]{16,}$") & ~exact(t)))
    return F.coalesce(text.rlike("[0-9]([eE]|[0-9]{15})"), F.lit(False)) & F.contains(_outside_strings(text, lambda tokens: F.transform(tokens, lambda t: F.when(lost(t), F.lit("\x03")).otherwise(F.lit("")))), F.lit("\x03"))


def topological_levels(calls: DataFrame) -> DataFrame:
    """(call_id, parent_id, root_id, level) of unique calls; see the module for circles."""
    ids = calls.select(F.col("call_id").alias("parent_id"), F.lit(True).alias("known"))
    linked = calls.select("call_id", "parent_id").join(ids, "parent_id", "left").select("call_id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"))
    state = materialize(linked.select("call_id", "parent_id", F.col("parent_id").alias("up"), F.col("parent_id").isNotNull().cast("bigint").alias("level"), F.coalesce("parent_id", "call_id").alias("root_id")), "levels")
    rounds = state.count().bit_length() + 1
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            break
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next_up"), F.col("level").alias("more"), F.col("root_id").alias("next_root"))
        state = materialize(state.join(above, "up", "left").select("call_id", "parent_id", F.col("next_up").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), F.coalesce("next_root", "root_id").alias("root_id")), "levels")
    circle = F.col("up").isNotNull()
    return state.select("call_id", "parent_id", F.when(~circle, F.col("root_id")).alias("root_id"), F.when(~circle, F.col("level")).alias("level"))


def argument_errors(arguments: Column, params: Column, lost: Column) -> Column:
    """Names of what ``arguments`` (JSON text; ``lost``: with refused numbers) break of ``params`` (array
    of name, kind, required; null for an unknown tool)."""
    parsed = F.from_json(arguments, "map<string,variant>")

    def fits(p: Column, kind: Column) -> Column:
        ok = (p["kind"] == "number") & kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        for name, pattern in _KINDS.items():
            ok = ok | ((p["kind"] == name) & kind.like(pattern))
        return ok

    def check(p: Column) -> Column:
        value = F.try_element_at(parsed, p["name"])
        there = F.coalesce(F.map_contains_key(parsed, p["name"]), F.lit(False))
        return F.when(~there & p["required"], F.concat(F.lit("missing:"), p["name"])).when(there & ~F.coalesce(fits(p, F.schema_of_variant(value)), F.lit(False)), F.concat(F.lit("type:"), p["name"]))

    unknown = F.transform(F.array_except(F.map_keys(parsed), F.transform(params, lambda p: p["name"])), lambda k: F.concat(F.lit("unknown:"), k))
    found = F.concat(F.filter(F.transform(params, check), lambda e: e.isNotNull()), unknown)
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, F.array(F.lit("json"))).when(lost, F.array(F.lit("number"))).when(params.isNull(), F.array(F.lit("tool"))).otherwise(F.array_sort(found))


def _with_canonical(calls: DataFrame) -> DataFrame:
    """With ``lost`` and the canonical text of the arguments, each worked out once."""
    marked = calls.withColumn("lost", F.coalesce(has_lost_numbers(F.col("arguments")), F.lit(False)))
    return marked.withColumn("canonical", F.when(~F.col("lost"), canonical_json(F.col("arguments"))))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls: (call_id, parent_id, name, arguments); results: (call_id, content); schemas:
    (tool, param, kind, required) with kinds string, integer, number, boolean, object, array."""
    plain = {"ignoreNullFields": "true"}
    one_call = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("name", "arguments", "parent_id")).alias("c")).select("call_id", "c.name", "c.arguments", "c.parent_id")
    one_result = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"))
    levels = topological_levels(one_call)
    tools = schemas.groupBy("tool").agg(F.sort_array(F.collect_set(F.struct(F.col("param").alias("name"), "kind", "required"))).alias("params"))  # as long as the schema
    joined = one_call.drop("parent_id").join(levels, "call_id").withColumn("is_call", F.lit(True)).join(one_result.withColumn("is_result", F.lit(True)), "call_id", "full")
    joined = joined.join(tools, F.col("name") == F.col("tool"), "left")
    joined = _with_canonical(joined)
    errors = F.when(F.col("is_call"), argument_errors(F.col("arguments"), F.col("params"), F.col("lost"))).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("is_call") & F.col("is_result"), "linked").when(F.col("is_call"), "pending").otherwise("orphan")
    out = joined.select("call_id", status.alias("status"), "parent_id", "root_id", "level", "name", "canonical", "content", errors.alias("found"))
    body = F.struct(F.col("call_id").alias("id"), "level", "name", F.col("parent_id").alias("parent"), F.col("content").alias("result"), "status", (F.size("found") == 0).alias("valid"))
    whole = lambda args, rest: F.when(args.isNull(), rest).otherwise(F.concat(F.lit('{"arguments":'), args, F.when(rest == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(rest, F.lit(2), F.length(rest))))))
    identified = out.select("call_id", "status", "parent_id", "root_id", "level", (F.size("found") == 0).alias("valid"), F.array_join("found", ",").alias("errors"), whole(F.col("canonical"), F.to_json(body, plain)).alias("json"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("call_id",)]
    rest = [F.lit("unidentified").alias("status"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("root_id"), F.lit(None).cast("bigint").alias("level"), F.lit(False).alias("valid"), F.lit("id").alias("errors")]
    lone = _with_canonical(calls.where("call_id is null")).select(*nothing, *rest, whole(F.col("canonical"), F.to_json(F.struct("name"), plain)).alias("json")).unionByName(results.where("call_id is null").select(*nothing, *rest, F.to_json(F.struct(F.col("content").alias("result")), plain).alias("json")))
    return identified.unionByName(lone)
