"""From raw documents to training shards: five stages, each on all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import inverted_index, mixing, near_copies, quality, shards
from tidewatch.llm.common import materialise, scratch_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Each row is judged by its own text: null and empty texts get the prior's score,
    repeated rows go or stay together, ids and further columns play no part. An
    empty table stays empty; without labels all rows stay.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), the one of least id.

    Fingerprint links come first, shared minima after them, and all are compared
    exactly. Texts that are null, empty or without words are one group; of repeated
    rows one stays, a null id only where its group has no other.
    """
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs.

    Rows are judged by their text: null and empty ones stay, repeated ones go or
    stay together. An empty benchmark leaves all rows.
    """
    return inverted_index.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    Null and empty texts have no words and are not taken; a null source is a source
    of its own, the last; repeated rows are documents of their own.
    """
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document stands in the compacted shards: doc_id, n_bytes, shard and its figures.

    Every row is placed: null and empty texts with no bytes, repeated rows each. An
    empty table has no shards.
    """
    return shards.placed(docs, scratch_path(spark, "corpus"))


STAGES = [
    ("quality", keep_good),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: Training by gradient descent has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
