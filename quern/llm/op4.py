"""Query of SimHash near-duplicate groups over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import read_table
from quern.llm.simhash import near_duplicate_groups


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


QUERIES = {"op4_simhash": op4_simhash}
