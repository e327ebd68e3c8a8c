"""Small helpers the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.sources.staging import stage, staging_root

__all__ = ["SPACE", "distinct_names", "scratch", "stage", "table", "tokenizer_file", "words_of"]

# the white space that separates words, as a Java and RE2 character class
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary files are; every executor has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path in shared storage."""
    return f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"


def words_of(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def distinct_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that df does not use yet."""
    used = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found
