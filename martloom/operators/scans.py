"""Running recurrences whose steps compose, so that a series is worked on in chunks.

A step of either recurrence is a map, and maps of one kind compose to a map of the same
kind: `x -> max(floor, x + add)` for levels that cannot fall below zero, `x -> keep * x +
add` for exponential smoothing. A chunk of a key's series (a year, say) becomes one map;
only the maps are ordered per key. No task holds more than a chunk, or a key's list of
chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.sources.staging import stage


def _same(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"{k}_" for k in keys})


def floored_level(
    df: DataFrame, keys: list[str], time: str, change: str, chunk: Column, opening: int = 0
) -> DataFrame:
    """Add level, the running sum of `change` that never falls below 0, and lost, what the floor cut off.

    `time` is unique within a key; `chunk` must not fall as time goes on. Level and lost
    have the type of `change`, which is exact for whole numbers and decimals. Rows without
    a time are left out; a null change counts as 0.
    """
    kind = df.schema[change].dataType
    zero = F.lit(0).cast(kind)
    rows = df.where(F.col(time).isNotNull()).withColumns(
        {"chunk_": chunk, "step_": F.coalesce(F.col(change), zero)}
    )
    inner = Window.partitionBy(*keys, "chunk_").orderBy(time)
    so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("sum_", F.sum("step_").over(so_far)).withColumns(
        {"low_": F.min("sum_").over(so_far), "low_before_": F.min("sum_").over(before)}
    )
    rows = stage(rows, "levels")
    # a chunk maps x to max(x + add, floor)
    add = F.sum("step_")
    chunks = rows.groupBy(*keys, "chunk_").agg(add.alias("add_"), (add - F.min("sum_")).alias("floor_"))
    outer = Window.partitionBy(*keys).orderBy("chunk_")
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("after_", F.sum("add_").over(outer.rowsBetween(Window.unboundedPreceding, 0)))
    base = F.coalesce(F.sum("add_").over(earlier), F.lit(0))
    lift = F.greatest(F.lit(opening), F.max(F.col("floor_") - F.col("after_")).over(earlier))
    starts = _renamed(chunks.select(*keys, F.col("chunk_").alias("at_"), (base + lift).alias("start_")), keys)
    joined = rows.join(starts, [*_same(keys), F.col("chunk_") == F.col("at_")])
    previous_sum = F.col("sum_") - F.col("step_")
    level = F.greatest(F.col("start_") + F.col("sum_"), F.col("sum_") - F.col("low_"))
    # greatest passes over the null of a chunk's first row
    previous = F.greatest(F.col("start_") + previous_sum, previous_sum - F.col("low_before_"))
    return joined.select(
        *df.columns,
        level.cast(kind).alias("level"),
        (level - previous - F.col("step_")).cast(kind).alias("lost"),
    )


def smoothed(df: DataFrame, keys: list[str], time: str, value: str, chunk: Column, alpha: float) -> DataFrame:
    """One row per key: smoothed, the exponential mean of the values in time order, and steps.

    The mean starts at the first value. Rows without a time or value are left out.
    """
    keep = F.lit(1 - alpha)
    rows = df.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(
        *keys, F.col(time).alias("time_"), F.col(value).cast("double").alias("value_"), chunk.alias("chunk_")
    )
    inner = Window.partitionBy(*keys, "chunk_").orderBy(F.desc("time_"))
    rows = rows.withColumn("later_", F.row_number().over(inner) - 1)
    # a chunk maps x to keep ** n * x + alpha * add
    chunks = rows.groupBy(*keys, "chunk_").agg(
        F.count(F.lit(1)).alias("n_"),
        F.sum(F.col("value_") * F.pow(keep, F.col("later_"))).alias("add_"),
        F.min_by("value_", "time_").alias("first_"),
    )
    outer = Window.partitionBy(*keys).orderBy(F.desc("chunk_"))
    later = outer.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("after_", F.coalesce(F.sum("n_").over(later), F.lit(0)))
    total = F.sum(F.col("add_") * F.pow(keep, F.col("after_")))
    first = F.min_by("first_", "chunk_") * F.pow(keep, F.sum("n_"))
    return chunks.groupBy(*keys).agg((F.lit(alpha) * total + first).alias("smoothed"), F.sum("n_").alias("steps"))
