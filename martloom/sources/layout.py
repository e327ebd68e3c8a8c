"""Marts laid out so that range filters skip most of a file.

Each filter column is cut into as many steps as its quantiles give. The bits of a row's steps
are interleaved into one number, and the table is sorted by it: rows that are close in every
column lie close together. Parquet keeps the least and greatest value of each column and row
group, so a pushed-down filter on any of the columns skips the groups that cannot match.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampType

from martloom.sources.staging import own_shuffles, stage

Range = tuple[object | None, object | None]
BITS = 6


def _number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, TimestampType):
        return F.unix_micros(column).cast("double")
    return F.col(column).cast("double")


def interleaved(steps: Sequence[Column], bits: int = BITS) -> Column:
    """One number from equally many bits of each step, the first column's highest bit first."""
    out = F.lit(0).cast("long")
    for bit in range(bits):
        for i, step in enumerate(steps):
            one = F.shiftright(step, bit).bitwiseAND(F.lit(1)).cast("long")
            out = out.bitwiseOR(F.shiftleft(one, bit * len(steps) + len(steps) - 1 - i))
    return out


def _step(number: Column, edges: Sequence[float]) -> Column:
    """How many of the edges lie below a number; 0 for NULL."""
    known = F.array(*map(F.lit, sorted(set(edges)))) if edges else F.array().cast("array<double>")
    below = F.size(F.filter(known, lambda edge: edge < number))
    return F.when(number.isNull(), 0).otherwise(below)


def write_filterable(
    df: DataFrame,
    path: str,
    columns: Sequence[str],
    files: int | None = None,
    row_group_bytes: int = 16 << 20,
    bits: int = BITS,
    stored: bool = False,
) -> None:
    """Write df to Parquet in the interleaved order of the columns.

    `files` tasks write a range of the order each, or as many as the size of df asks for. The quantiles that cut a column are at
    most 2 ** bits numbers, with 1 % of the rows as error: they shape the layout, no result
    depends on them. NULLs come first. df is read three times, so it is staged first unless it
    is a `stored` table already.
    """
    rows = df if stored else stage(df, "layout")
    numbers = {c: _number(rows, c) for c in columns}
    bounds = rows.select(*(n.alias(c) for c, n in numbers.items())).approxQuantile(
        list(columns), [i / (1 << bits) for i in range(1, 1 << bits)], 0.01
    )
    steps = [_step(number, edges) for number, edges in zip(numbers.values(), bounds, strict=True)]
    key = "order_"
    while key in rows.columns:
        key = f"_{key}"
    placed = rows.withColumn(key, interleaved(steps, bits))
    dealt = placed.repartitionByRange(key) if files is None else placed.repartitionByRange(files, key)
    ordered = dealt.sortWithinPartitions(key)
    with own_shuffles(rows.sparkSession):
        ordered.drop(key).write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def within(ranges: Mapping[str, Range]) -> Column:
    """All ranges hold; an end that is None is open, ends are included, NULL is in no range."""
    found = F.lit(True)
    for column, (low, high) in ranges.items():
        found &= F.col(column).isNotNull()
        if low is not None:
            found &= F.col(column) >= low
        if high is not None:
            found &= F.col(column) <= high
    return found


def read_filtered(
    spark: SparkSession, path: str, ranges: Mapping[str, Range], columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows of a stored mart inside all ranges; unknown columns are an error."""
    df = spark.read.parquet(path)
    unknown = sorted({*ranges, *(columns or [])} - set(df.columns))
    if unknown:
        raise KeyError(f"no such columns: {', '.join(unknown)}")
    rows = df.where(within(ranges)) if ranges else df
    return rows.select(*columns) if columns else rows
