"""Ranks over a whole table without pulling it into one task.

A window ordered over everything would send every row to a single task. Here the
sort is Spark's own range sort: its output is staged with each row's partition and
position, and a row's global position is its position plus the rows in the
partitions before it. That per-partition table has one row per sort partition, which
is why it may be broadcast. Small inputs (a counted bound) use the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.config import ScaleRules
from martloom.sources.staging import stage, stage_result

_ROW_BITS = 33
# sorted values and counts take much less room so
_CODEC = "zstd"


def _long_form(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """One row per key and ranked column: metric number and value as double."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("metric"), F.col(c).cast("double").alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    return df.select(*key, F.explode(cells).alias("cell")).select(*key, "cell.*")


def _placed(ordered: DataFrame, weight: Column) -> tuple[DataFrame, DataFrame]:
    """Stage sorted rows with (part, row); also the total weight before each part."""
    staged = stage(
        ordered.withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("place", _ROW_BITS))
        .withColumn("row", F.col("place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))),
        "ranked",
        _CODEC,
    )
    parts = staged.groupBy("part").agg(F.sum(weight).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")
    )
    return staged, offsets


def _rows_below(base: DataFrame, names: list[str], rows: int) -> DataFrame:
    """How many rows lie below every different value of every named column."""
    counts = _long_form(base, names, []).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("held"))
    staged, offsets = _placed(counts.orderBy("metric", "value"), F.col("held"))
    earlier = (
        Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    )
    below = (
        F.col("offset")
        + F.coalesce(F.sum("held").over(earlier), F.lit(0))
        - F.col("metric") * F.lit(rows)
    )
    return staged.join(F.broadcast(offsets), "part").select("metric", "value", below.alias("below"))


def _with_cells(
    base: DataFrame, cells: DataFrame, key: list[str], outputs: list[str], together: list[str]
) -> DataFrame:
    """base with the counts of its cells, `outputs` by metric number, in one shuffle of both.

    A count takes half the bytes of the share that it gives.
    """
    row = "row"
    while row in {c.lower() for c in (*key, *outputs)}:
        row = f"_{row}"
    rest = [c for c in base.columns if c not in key]
    whole = F.struct(F.lit(True).alias("known"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    rows = base.select(*key, whole.alias(row), *[F.lit(None).cast("long").alias(o) for o in outputs])
    counts = cells.select(
        *key,
        F.lit(None).cast(rows.schema[row].dataType).alias(row),
        *[F.when(F.col("metric") == j, F.col("below")).alias(o) for j, o in enumerate(outputs)],
    )
    order = [*together, *[k for k in key if k not in together]]
    merged = (
        rows.unionAll(counts)
        .repartition(*together)
        .groupBy(*order)
        .agg(F.first(row, ignorenulls=True).alias(row), *[F.max(o).alias(o) for o in outputs])
    )
    return merged.select(*key, *[F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(rest)], *outputs)


def percent_ranks(
    df: DataFrame,
    columns: dict[str, str],
    key: list[str],
    scale: ScaleRules = ScaleRules(),
    together: list[str] | None = None,
) -> DataFrame:
    """Add percent_rank of each named column over all rows; `columns` maps output to input.

    Equal values share a rank, so only the distinct values are sorted, each with the
    number of rows that hold it. NULLs come first and share a rank; a single row has rank
    0. `key` identifies a row. Columns of few different values, counted, meet their ranks
    where the rows lie, so the rows of a frequent value are never brought together; only
    the other columns are joined by value. Their ranks and the rows then meet in one shuffle,
    by the key or by those of its columns that `together` names: a later join, group or window
    by these needs no shuffle of its own.
    """
    base = stage(df, "rank-input", _CODEC)
    n = base.count()
    names = list(columns.values())
    if n <= scale.one_task_rows:
        return base.withColumns(
            {
                out: F.percent_rank().over(Window.orderBy(F.col(src).cast("double")))
                for out, src in columns.items()
            }
        )
    spark = base.sparkSession
    ranks = stage_result(spark, lambda: _rows_below(base, names, n), "ranks", _CODEC)
    share = lambda below: F.col(below) / F.lit(float(max(n - 1, 1)))
    sizes = {r["metric"]: r["count"] for r in ranks.groupBy("metric").count().collect()}
    few = [i for i in range(len(names)) if sizes[i] <= scale.broadcast_values]
    many = [i for i in range(len(names)) if i not in few]
    outputs = list(columns)
    out = base
    if many:
        cells = _long_form(base, [names[i] for i in many], key)
        place = F.create_map(*[F.lit(x) for j, i in enumerate(many) for x in (i, j)])
        large = ranks.filter(F.col("metric").isin(*many)).withColumn("metric", place[F.col("metric")])
        ranked = cells.alias("c").join(
            large.alias("r"),
            (F.col("c.metric") == F.col("r.metric")) & F.col("c.value").eqNullSafe(F.col("r.value")),
        )
        met = stage(ranked.select(*[F.col(f"c.{k}").alias(k) for k in key], "c.metric", "r.below"), "cell-ranks", _CODEC)
        out = _with_cells(base, met, key, [outputs[i] for i in many], together or key)
        out = out.withColumns({outputs[i]: share(outputs[i]) for i in many})
    if few:
        small = stage(ranks.filter(F.col("metric").isin(*few)), "few-ranks")
        for i in few:
            mine = small.filter(F.col("metric") == i).select(
                F.col("value").alias("_value"), share("below").alias(outputs[i])
            )
            same = F.col(names[i]).cast("double").eqNullSafe(F.col("_value"))
            out = out.join(F.broadcast(mine), same, "inner").drop("_value")
    return out.select(*base.columns, *outputs)


def row_positions(
    df: DataFrame,
    orders: dict[str, tuple[str, bool]],
    key: str,
    scale: ScaleRules = ScaleRules(),
) -> tuple[DataFrame, int]:
    """Add 1-based global positions and return the row count.

    `orders` maps an output name to (column, ascending). Values compare as doubles; NULLs
    come first when ascending and last when descending. Ties break on the key, which must
    be unique, so the positions are the same in every run and at every size.
    """
    base = stage(df, "position-input")
    n = base.count()
    if n <= scale.one_task_rows:

        def place(name: str, up: bool) -> Column:
            value = F.col(name).cast("double")
            return F.row_number().over(
                Window.orderBy(value.asc_nulls_first() if up else value.desc_nulls_last(), key)
            )

        return base.withColumns({name: place(c, up) for name, (c, up) in orders.items()}), n
    signed = base.select(
        key,
        *[
            (F.col(c).cast("double") if up else -F.col(c).cast("double")).alias(name)
            for name, (c, up) in orders.items()
        ],
    )
    cells = _long_form(signed, list(orders), [key])
    # descending values are negated, so their NULLs have to be sent to the end
    falling = [i for i, (_, up) in enumerate(orders.values()) if not up]
    last = F.col("value").isNull() & F.col("metric").isin(*falling)
    staged, offsets = _placed(cells.orderBy("metric", last, "value", key), F.lit(1))
    position = F.col("offset") + F.col("row") + 1 - F.col("metric") * F.lit(n)
    wide = (
        staged.join(F.broadcast(offsets), "part")
        .withColumn("position", position)
        .groupBy(key)
        .agg(
            *[
                F.max(F.when(F.col("metric") == i, F.col("position"))).cast("int").alias(name)
                for i, name in enumerate(orders)
            ]
        )
    )
    return base.join(wide, key, "inner"), n


def ntile_of(position: Column | str, rows: int, buckets: int) -> Column:
    """The ntile bucket of a 1-based position: the first rows % buckets buckets get one more."""
    p = F.col(position) if isinstance(position, str) else position
    small, extra = divmod(rows, buckets)
    edge = extra * (small + 1)
    in_large = F.floor((p - 1) / F.lit(small + 1)) + 1
    if small == 0:
        return in_large.cast("int")
    in_small = F.floor((p - 1 - edge) / F.lit(small)) + 1 + extra
    return F.when(p <= edge, in_large).otherwise(in_small).cast("int")


def quantile_bin_of(position: Column | str, rows: int, bins: int) -> Column:
    """Equal-width bins of a position, edges at 1 + (rows - 1) * k / bins, right edge included."""
    p = F.col(position) if isinstance(position, str) else position
    if rows <= 1:
        return F.lit(1)
    steps = F.ceil((p - 1) * F.lit(bins) / F.lit(rows - 1))
    return F.greatest(F.lit(1), steps).cast("int")
