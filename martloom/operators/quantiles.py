"""Exact quantiles of groups, without gathering a group.

Equal values are counted into one row first. Each round cuts a group's range of values into
buckets, counts the buckets (with partial sums in every task) and goes on with the one that
holds the wanted place, until it holds a single value. A round costs one small shuffle of
counted buckets; the range shrinks by `buckets` each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.sources.staging import stage


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of each value in each group: keys, value (long), held. Null values are left out."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys, F.col(value).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("held"))


def group_quantiles(
    values: DataFrame, keys: list[str], shares: dict[str, float], buckets: int = 64
) -> DataFrame:
    """Keys, rows and one column per share: the least value that so large a share does not exceed.

    `values` has keys, value (long) and held (how many rows hold it, at least 1); a value
    may come in several rows. Null keys are a group.
    """
    if not all(0 <= p <= 1 for p in shares.values()):
        raise ValueError("shares lie between 0 and 1")
    base = stage(values.select(*keys, "value", "held"), "counted")
    whole = base.groupBy(*keys).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.sum("held").alias("rows")
    )
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("share")) for n, p in shares.items())))
    state = whole.withColumn("want", wanted).select(
        *keys,
        "rows",
        "low",
        "high",
        F.col("want.name").alias("name"),
        # the place from 1 among the rows between low and high
        F.greatest(F.lit(1), F.ceil(F.col("want.share") * F.col("rows"))).cast("long").alias("place"),
    )
    state = stage(state, "ranges")
    done = state.where("low = high")
    while True:
        open_ranges = state.where("low < high")
        if open_ranges.isEmpty():
            break
        state = stage(_narrowed(base, open_ranges, keys, buckets), "ranges")
        done = done.unionByName(state.where("low = high"))
    columns = [F.max(F.when(F.col("name") == n, F.col("low"))).alias(n) for n in shares]
    return done.groupBy(*keys).agg(F.max("rows").alias("rows"), *columns)


def _narrowed(base: DataFrame, state: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The bucket of each range that holds its place, narrowed to the values seen in it."""
    ranges = state.withColumnsRenamed({k: f"{k}_" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    inside = base.join(ranges, same).where(F.col("value").between(F.col("low"), F.col("high")))
    # in decimals, as the widest range of longs has more than a long can count
    exact = {c: f"CAST({c} AS DECIMAL(20, 0))" for c in ("value", "low", "high")}
    inner = f"({exact['value']} - {exact['low']}) * {buckets} DIV ({exact['high']} - {exact['low']} + 1)"
    bucket = F.expr(f"CAST({inner} AS INT)")
    counts = inside.groupBy(*keys, "name", "place", "rows", bucket.alias("bucket")).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.sum("held").alias("held")
    )
    series = Window.partitionBy(*keys, "name").orderBy("bucket")
    upto = F.sum("held").over(series.rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("upto", upto).where(
        (F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("held") < F.col("place"))
    )
    place = F.col("place") - F.col("upto") + F.col("held")
    return found.select(*keys, "rows", "low", "high", "name", place.alias("place"))

