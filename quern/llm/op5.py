"""Query of source mixing over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import read_table
from quern.llm.mixing import mix

BLOCK_ROWS = 64


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents").select("doc_id", "source"), block_rows=BLOCK_ROWS)


QUERIES = {"op5_mixing": op5_mixing}
