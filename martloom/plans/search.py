"""Substring search by stored postings, and pages that continue after the last row seen.

A posting is one run of one to three characters of a name or id, in lower case, and the key
of the row that has it. A search looks up the runs of its text, keeps the keys that have all
of them, and checks the text itself on these few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, length: int) -> Column:
    """The different runs of so many characters."""
    places = F.sequence(F.lit(1), F.length(text) - (length - 1))
    found = F.transform(places, lambda i: F.substring(text, i, F.lit(length)))
    return F.when(F.length(text) >= length, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def postings(df: DataFrame, keys: Sequence[str], searched: Sequence[str]) -> DataFrame:
    """gram and keys for every run in the searched columns; NULLs have none."""
    texts = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in searched]
    every = F.array_distinct(F.flatten(F.array(*(grams(t, n) for t in texts for n in range(1, GRAM + 1)))))
    return df.select(F.explode(every).alias("gram"), *keys)


def write_postings(df: DataFrame, keys: Sequence[str], searched: Sequence[str], path: str, files: int | None = None) -> None:
    """Stored by gram, so that a search reads the few row groups of its grams.

    Without a number of `files` there are as many as the postings' size asks for.
    """
    found = postings(df, keys, searched)
    by = ["gram", *keys]
    dealt = found.repartitionByRange(*by) if files is None else found.repartitionByRange(files, *by)
    rows = dealt.sortWithinPartitions("gram")
    rows.write.mode("overwrite").parquet(path)


def _needed(needle: str) -> list[str]:
    size = min(GRAM, len(needle))
    return sorted({needle[i : i + size] for i in range(len(needle) - size + 1)})


def search(df: DataFrame, stored: DataFrame, keys: Sequence[str], searched: Sequence[str], needle: str) -> DataFrame:
    """Rows of df with the needle, in any case, in one of the searched columns.

    `stored` are the postings by `keys` of df, or of a table that has the searched columns
    once for all rows of df with the same keys. An empty needle is in all rows. Rows with a
    NULL key are not found by postings.
    """
    needle = needle.lower()
    if not needle:
        return df
    wanted = _needed(needle)
    hits = stored.where(F.col("gram").isin(*wanted)).groupBy(*keys).agg(F.count_distinct("gram").alias("met_"))
    hits = hits.where(F.col("met_") == len(wanted)).select(*keys)
    found = df.join(hits, list(keys), "left_semi")
    holds = F.lit(False)
    for column in searched:
        holds |= F.coalesce(F.lower(F.col(column).cast("string")).contains(needle), F.lit(False))
    return found.where(holds)


Order = Sequence[tuple[str, bool]]
"""Columns with True where they ascend."""


def after(order: Order, last: Sequence[object]) -> Column:
    """Rows that come after the row with these values; NULLs come first where ascending, else last."""
    found = F.lit(False)
    tied = F.lit(True)
    for (column, up), value in zip(order, last, strict=True):
        c = F.col(column)
        if value is None:
            later = c.isNotNull() if up else F.lit(False)
        else:
            later = (c > F.lit(value)) if up else (c.isNull() | (c < F.lit(value)))
        found |= tied & later
        tied &= c.eqNullSafe(F.lit(value))
    return F.coalesce(found, F.lit(False))


def next_page(df: DataFrame, order: Order, limit: int, last: Sequence[object] | None = None) -> DataFrame:
    """The first rows, or those after the last row of the page before; the order must be total.

    Spark keeps `limit` rows per task and sorts no others, however deep the page.
    """
    rows = df if last is None else df.where(after(order, last))
    by = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]
    return rows.orderBy(*by).limit(limit)
