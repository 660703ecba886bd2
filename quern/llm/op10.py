"""Query of language identification over ``pages``; the text model learns from ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import read_table
from quern.llm.language import identify, train


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return identify(read_table(spark, sf_dir, "pages"), model).drop("url")


QUERIES = {"op10_language": op10_language}
