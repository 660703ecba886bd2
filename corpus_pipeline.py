"""Corpus pipeline: quality, near duplicates, benchmark leaks, mixing, token ids.

``run`` applies the stages to ``documents``; each stage's rows are written as Parquet to the
session's shared folder and read again as the next one's. The mixing stage keeps all rows
and gives them the order of the mixture. That lies in the numbers of its files and the places of
the rows in them, and the last stage writes the token ids file by file without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize, read_table, shared_dir
from quern.llm.decontamination import contamination_report
from quern.llm.mixing import mix
from quern.llm.op3 import END_ID, tokenizer_path
from quern.llm.quality import score, train
from quern.llm.simhash import drop_near_duplicates
from quern.llm.token_ids import token_table

BLOCK_ROWS = 64
WINDOW = 10
CACHED_CHUNKS = 250_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents with a score under 0.5 go."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model, score_col="_score").where("_score >= 0.5").drop("_score")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group that links of 0.8 similarity and more connect (sets of
    five-word shingles) the smallest doc_id stays."""
    return drop_near_duplicates(docs, shingle=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item's window of ten words go."""
    report = contamination_report(docs, read_table(spark, sf_dir, "benchmark"), window=WINDOW)
    return report.where(~F.col("contaminated")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: rows in the order of a Pfair schedule, larger sources by the square root of their size.
    Partitions, and so the files written of them, follow each other in the mixture."""
    return mix(docs, block_rows=BLOCK_ROWS).sortWithinPartitions("position").select(*(F.col(f"`{c}`") for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in plane files, in the order of the mixture: doc_id, start, n_tokens, ids_crc32.

    ``docs`` is the mixture as read from its files."""
    return token_table(docs, tokenizer_path(), "doc_id", "text", END_ID, in_place=True, cached=CACHED_CHUNKS)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mixed),
    ("token ids", token_ids),
]

#: Training, near duplicates and tokens can't be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
