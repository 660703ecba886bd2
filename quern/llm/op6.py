"""Query of the URL filter over ``pages``.

Beside the rules there is a list of canonical URLs, as a blocklist would give them: the addresses
of ``pages`` on hosts whose name has one of ``LISTED_WORDS``, and some that no page has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import read_table
from quern.llm.url_filter import canonical, split_url, url_filter

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LISTED_WORDS = ("casino", "bets", "pills", "loans")
#: Further canonical URLs that are blocked where no rule fits.
LISTED = ["spam.example.net/index.html", "ads.example.net/banner", "mirror.example.net/en/copy"]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(u, "block") for u in LISTED], "url_key string, verdict string")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = split_url(F.col("url"))
    found = pages.select(host.alias("host"), path.alias("path")).where(F.col("host").rlike("|".join(LISTED_WORDS)))
    listed = listed.union(found.select(canonical(F.col("host"), F.col("path")).alias("url_key"), F.lit("block").alias("verdict")).distinct())
    return url_filter(pages, rules, listed).drop("url")


QUERIES = {"op6_url_filter": op6_url_filter}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_LISTED = ", ".join(f"('{u}')" for u in LISTED)
ORACLE_SQL = {
    "op6_url_filter": rf"""
WITH rules(rh, rp, v) AS (VALUES {_RULES}), given(k) AS (VALUES {_LISTED}),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
listed AS (SELECT k FROM given UNION SELECT regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') FROM c WHERE regexp_matches(host, '{"|".join(LISTED_WORDS)}')),
d AS (SELECT c.page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM c JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY c.page_id)
SELECT c.page_id, host, path, d.rule,
       coalesce(d.v, CASE WHEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') IN (SELECT k FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN d ON c.page_id = d.page_id"""
}
