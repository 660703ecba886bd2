"""URL filter: a blocked Bloom filter over listed keys, then an exact hash join.

Listed entries are host/path rules (a rule fits its host and every subdomain when the
path starts with the rule's) and canonical URLs (fit one page address). Each address
offers the few keys under which an entry could list it: its host suffixes joined with the
path prefixes of the lengths that rules have, and its own canonical form. All keys are
probed against a blocked Bloom filter (one 256-bit block a key, eight bits in it); what
passes meets the entries in an equality join, so false positives leave no trace. Among
the rules that fit the longest wins; a canonical URL counts where no rule fits.

The filter is a table of at most ``MAX_BLOCKS`` blocks, so it is always small enough to be
broadcast and probed where the addresses are read. A list too long for it makes the filter
less selective, which the exact join bears; no result depends on it. Nothing is collected but
the distinct rule path lengths (at most ``MAX_LENGTHS`` integers).

Edge cases: a null URL or one without ``://`` has empty host and path and fits nothing;
repeated rows are judged alike; an empty list allows all; empty input gives an empty
result; columns of the input keep their values, whatever their names, and those called like
a result (host, path, rule, verdict) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower

MAX_LENGTHS = 4096
MAX_BLOCKS = 1 << 18  # 8 MB of bits
BITS_PER_KEY = 16


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://``; both empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(authority) + 1, F.length(rest))
    return ascii_lower(authority), F.regexp_extract(tail, r"^[^?#]*", 0)


def canonical(host: Column, path: Column) -> Column:
    """Scheme, ``www.``, query, fragment and closing slash dropped."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def _blocks(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")
    bits = F.xxhash64(key, F.lit(1))
    return block, [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(8)]


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w7) of the filter of the column ``key``."""
    block, masks = _blocks(F.col("key"), n_blocks)
    rows = keys.select(block.alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(masks)))
    return rows.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(8)))


def may_contain(candidates: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of ``candidates`` whose ``key`` the filter may hold."""
    block, masks = _blocks(F.col("key"), n_blocks)
    hit = F.lit(True)
    for i, m in enumerate(masks):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    return candidates.withColumn("block", block).join(F.broadcast(blocks), "block").where(hit).drop("block", *(f"w{i}" for i in range(8)))


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    rules: (host, path, verdict); listed: (url_key, verdict) with keys as of ``canonical``.
    """
    host, path = split_url(F.col(f"`{url_col}`"))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    base = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("page"), host.alias("host"), path.alias("path"))
    ruled = rules.select(F.concat("host", "path").alias("key"), F.col("verdict").alias("entry_verdict"), F.lit(1).alias("kind"), F.length("path").alias("n"))
    entries = ruled
    if listed is not None:
        entries = ruled.unionByName(listed.select(F.concat(F.lit("="), "url_key").alias("key"), F.col("verdict").alias("entry_verdict"), F.lit(0).alias("kind"), F.lit(-1).alias("n")))
    entries = entries.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("entry_verdict").alias("entry_verdict"), F.max("kind").alias("kind"), F.max("n").alias("n"))
    lengths = [r.n for r in ruled.where("n is not null").select("n").distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"rules have paths of more than {MAX_LENGTHS} lengths")
    n_blocks = min(MAX_BLOCKS, entries.count() * BITS_PER_KEY // 256 + 1)
    address = base.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*(F.lit(n) for n in sorted(lengths))).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    keys = F.array_union(keys, F.array(F.concat(F.lit("="), canonical(F.col("host"), F.col("path")))))
    candidates = address.select("host", "path", F.explode(keys).alias("key"))
    hits = may_contain(candidates, bloom_blocks(entries.select("key"), n_blocks), n_blocks).join(entries.drop("n"), "key")
    best = hits.groupBy("host", "path").agg(F.max(F.struct("kind", F.length("key").alias("long"), "key", "entry_verdict")).alias("best"))
    rule = F.when(F.col("best.kind") == 1, F.col("best.key"))
    return base.join(best, ["host", "path"], "left").select("page.*", "host", "path", rule.alias("rule"), F.coalesce("best.entry_verdict", F.lit("allow")).alias("verdict"))
