"""A corpus from raw documents to packed sequences, in four stages.

Each stage takes all that the one before it kept: quality rules reject documents, the
Jaccard join leaves one document of each group of near copies, suffix arrays cut long
repeats out of the texts, and packing turns the rest into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from martloom.llm import jaccard_join, packing, quality, suffix_dedup
from martloom.llm.common import stage, table, tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(docs, tokenizer_file()))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("jaccard_join", jaccard_stage),
    ("suffix_dedup", repeats_stage),
    ("packing", packing_stage),
]

# certified cutoffs, min-hash paths, suffix arrays and tokenizers have no SQL form
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written down before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
