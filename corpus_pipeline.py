"""From raw documents to packed training sequences, one table per stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes it as Parquet in the shared folder and the next stage reads that. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txrisk.llm import exact_dedup, language_id, mixing, ngram_join, packing
from txrisk.llm.common import scratch_table
from txrisk.llm.queries import language_model, tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language the model has learned."""
    return language_id.in_known_language(docs, language_model(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, one document stays."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.taken_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("source_mix", mixed),
    ("best_fit_packing", packed),
]

# kernels, hash orders and the genetic algorithm have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return docs
