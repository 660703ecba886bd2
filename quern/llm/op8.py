"""Query of the WARC writer and data source over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import read_table, shared_dir
from quern.llm.warc import RECORD_PREFIX, manifest_files, read_warc, write_warc


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    manifest = write_warc(read_table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    files = manifest_files(manifest, path)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(RECORD_PREFIX) + 1}) AS bigint)")
    common = [number("record_id").alias("page_id")]
    responses = read_warc(spark, files).where(F.col("warc_type") == "response")
    revisits = read_warc(spark, files, payload=False).where(F.col("warc_type") == "revisit")
    return responses.select(*common, F.length("payload").cast("bigint").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to")).unionByName(
        revisits.select(*common, F.col("http_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))
    )


QUERIES = {"op8_warc": op8_warc}

# Base32: five hexadecimal digits of the SHA-1 are twenty bits, four letters.
ORACLE_SQL = {
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(p.h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.h = f.h"""
}
