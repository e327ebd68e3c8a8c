"""Stock levels, coverage and reorder points from daily stock movements.

Movements have a branch, an ingredient, a date and whole quantities restocked and consumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.config import StockRules
from martloom.functions.numeric import fixed
from martloom.operators.quantiles import counted, group_quantiles
from martloom.operators.scans import floored_level
from martloom.plans.base import RESTAURANT

INGREDIENT = "ingredient_name"
KEYS = [RESTAURANT, INGREDIENT]


def daily_movements(movements: DataFrame) -> DataFrame:
    """One row per branch, ingredient and day with a movement; rows without a date are left out."""
    dated = movements.where(F.col("movement_date").isNotNull())
    return dated.groupBy(*KEYS, "movement_date").agg(
        F.sum(F.coalesce("restocked", F.lit(0))).cast("long").alias("restocked"),
        F.sum(F.coalesce("consumed", F.lit(0))).cast("long").alias("consumed"),
    )


def _state(rules: StockRules) -> Column:
    cover = F.col("days_of_cover")
    return (
        F.when(F.col("stock") == 0, "Out of Stock")
        .when(cover < rules.short_days, "Understock")
        .when(cover.isNull() | (cover > rules.long_days), "Overstock")
        .otherwise("Healthy")
    )


def stock_levels(movements: DataFrame, rules: StockRules = StockRules(), opening: int = 0) -> DataFrame:
    """Stock after each day with a movement, its cover in days, and how long it stays so.

    Stock never falls below zero: what could not be served is `unmet`. Cover divides the
    stock by the mean use of the last `use_days` calendar days; without use there is none.
    `held_until` is the day before the next movement, NULL for the last one.
    """
    daily = daily_movements(movements).withColumn("change", F.col("restocked") - F.col("consumed"))
    levels = floored_level(daily, KEYS, "movement_date", "change", F.year("movement_date"), opening)
    series = Window.partitionBy(*KEYS).orderBy(F.unix_date("movement_date"))
    recent = F.sum("consumed").over(series.rangeBetween(1 - rules.use_days, 0))
    return (
        levels.withColumns(
            {"recent": recent, "held_until": F.date_sub(F.lead("movement_date").over(series), 1)}
        )
        .select(
            *KEYS,
            "movement_date",
            "restocked",
            "consumed",
            F.col("level").alias("stock"),
            F.col("lost").alias("unmet"),
            fixed(F.col("recent") / F.lit(float(rules.use_days)), 4).alias("daily_use"),
            fixed(F.col("level") * F.lit(float(rules.use_days)) / F.nullif("recent", F.lit(0)), 2).alias("days_of_cover"),
            "held_until",
        )
        .withColumn("stock_state", _state(rules))
    )


def stock_alerts(levels: DataFrame) -> DataFrame:
    """Per branch and state: ingredients in it now, days spent in it, quantity not served in it."""
    now = F.col("held_until").isNull()
    days = F.datediff("held_until", "movement_date") + 1
    return levels.groupBy(RESTAURANT, "stock_state").agg(
        F.count(F.when(now, 1)).alias("ingredients_now"),
        F.sum(F.when(now, F.col("stock")).otherwise(0)).alias("stock_now"),
        F.coalesce(F.sum(days), F.lit(0)).cast("long").alias("days_in_state"),
        F.sum("unmet").alias("unmet"),
    )


def lead_time_demand(movements: DataFrame, rules: StockRules = StockRules()) -> DataFrame:
    """Counted demand of lead-time periods: keys, value, held.

    Periods follow each other without overlap, for each key from its first movement's to the
    last one in the table; those without a movement are counted as zero demand, not built.
    """
    period = F.floor(F.unix_date("movement_date") / F.lit(rules.lead_days)).alias("period")
    used = daily_movements(movements).groupBy(*KEYS, period).agg(F.sum("consumed").alias("used"))
    last = used.agg(F.max("period")).scalar()
    spans = used.groupBy(*KEYS).agg((last - F.min("period") + 1 - F.count(F.lit(1))).alias("held"))
    empty = spans.where("held > 0").select(*KEYS, F.lit(0).cast("long").alias("value"), "held")
    return counted(used, KEYS, "used").unionByName(empty)


def reorder_points(
    movements: DataFrame, inventory: DataFrame, levels: DataFrame, rules: StockRules = StockRules()
) -> DataFrame:
    """Demand quantiles of a lead time, whether the stock on hand covers them, and what to order.

    The quantity to order fills up to twice the reorder point. `threshold_gap` compares the
    inventory's fixed threshold with the point; NULL where the inventory has no such row.
    """
    points = group_quantiles(
        lead_time_demand(movements, rules), KEYS, {"median_demand": 0.5, "reorder_point": rules.service_level}
    )
    now = levels.where(F.col("held_until").isNull()).select(*KEYS, "stock")
    fixed_points = inventory.groupBy(*KEYS).agg(F.max("reorder_threshold").alias("reorder_threshold"))
    point = F.col("reorder_point")
    return (
        points.join(now, KEYS)
        .join(fixed_points, KEYS, "left")
        .select(
            *KEYS,
            F.col("rows").alias("periods"),
            "median_demand",
            "reorder_point",
            "stock",
            (F.col("stock") < point).alias("needs_order"),
            F.when(F.col("stock") < point, 2 * point - F.col("stock")).otherwise(0).cast("long").alias("order_quantity"),
            (F.col("reorder_threshold") - point).alias("threshold_gap"),
        )
    )
