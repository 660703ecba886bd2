"""Query of media columns over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import read_table, shared_dir
from quern.llm.media import media_features, media_headers, one_place, write_media


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "media")
    media = one_place(write_media(read_table(spark, sf_dir, "documents"), path, "doc_id", "text"))
    return media_features(media_headers(media, path), path).withColumnRenamed("id", "doc_id").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {"op2_media": op2_media}
