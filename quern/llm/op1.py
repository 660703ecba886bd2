"""Query of tool-call linking over ``conversations``.

A user's turn calls the tool ``reply`` with the turn's text, and a turn of another role but the
assistant's the tool ``instruct``, which no schema has; the assistant's next turn is its result;
the call two turns before is its parent. Every turn is in a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.chat import link_tool_calls
from quern.llm.common import read_table


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    ident = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    calls = turns.where("coalesce(role, '') <> 'assistant'").select(ident(0).alias("call_id"), ident(2).alias("parent_id"), F.when(F.col("role") == "user", "reply").otherwise("instruct").alias("name"), F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt"))).alias("arguments"))
    results = turns.where("role = 'assistant'").select(ident(1).alias("call_id"), F.col("text").alias("content"))
    schemas = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit("reply").alias("tool"), F.lit(p).alias("param"), F.lit(k).alias("kind"), F.lit(r).alias("required")) for p, k, r in (("prompt", "string", True), ("turn", "integer", True), ("style", "string", False))))).alias("s")).select("s.*")
    return link_tool_calls(calls, results, schemas)


QUERIES = {"op1_tool_calls": op1_tool_calls}

ORACLE_SQL = {
    "op1_tool_calls": """
WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn, text, CASE WHEN role = 'user' THEN 'reply' ELSE 'instruct' END AS name FROM conversations WHERE coalesce(role, '') <> 'assistant'),
r AS (SELECT DISTINCT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant'),
l(conv_id, turn, root, level) AS (
  SELECT conv_id, turn, turn, 0 FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, l.root, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv, coalesce(c.turn, r.turn) AS turn, c.turn IS NOT NULL AS is_call, r.turn IS NOT NULL AS is_result, c.text AS prompt, r.text AS content, name
      FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn),
k AS (SELECT j.*, conv || '-' || j.turn AS id, CASE WHEN is_call AND is_result THEN 'linked' WHEN is_call THEN 'pending' ELSE 'orphan' END AS status, root, level
      FROM j LEFT JOIN l ON j.is_call AND l.conv_id = j.conv AND l.turn = j.turn)
SELECT id AS call_id, status, CASE WHEN level > 0 THEN conv || '-' || (turn - 2) END AS parent_id, CASE WHEN is_call THEN conv || '-' || root END AS root_id,
       CAST(level AS BIGINT) AS level, coalesce(name, 'reply') = 'reply' AS valid, CASE WHEN name = 'instruct' THEN 'tool' ELSE '' END AS errors,
       '{' || CASE WHEN is_call THEN '"arguments":{"prompt":' || CAST(to_json(prompt) AS VARCHAR) || ',"turn":' || turn || '},' ELSE '' END || '"id":"' || id || '",'
       || CASE WHEN is_call THEN '"level":' || level || ',"name":"' || name || '",' ELSE '' END || CASE WHEN level > 0 THEN '"parent":"' || conv || '-' || (turn - 2) || '",' ELSE '' END
       || CASE WHEN is_result THEN '"result":' || CAST(to_json(content) AS VARCHAR) || ',' ELSE '' END || '"status":"' || status || '","valid":' || CASE WHEN name = 'instruct' THEN 'false' ELSE 'true' END || '}' AS json
FROM k"""
}
