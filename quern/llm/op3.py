"""Query of token-id output over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import read_table
from quern.llm.token_ids import token_table

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), "doc_id", "text", END_ID)


QUERIES = {"op3_token_planes": op3_token_planes}
