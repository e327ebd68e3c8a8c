"""Unusual ratings per item and week, unusual revenue per branch and day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from martloom.config import OrderRules, RatingRules, SalesRules
from martloom.functions.dates import day, iso_week, iso_year, week_start
from martloom.functions.numeric import cents_decimal, exact_std, fixed, money_sum
from martloom.operators.joins import attach, counted_orders, split_on_null
from martloom.operators.timeseries import calendar_spine, trailing
from martloom.plans.base import ITEM, ORDER, RESTAURANT, sold_of
from martloom.sources.snapshot import Snapshot


def _std_over(column: str, frame: WindowSpec) -> Column:
    value = cents_decimal(column)
    return exact_std(
        F.sum(value).over(frame), F.sum(value * value).over(frame), F.count(column).over(frame)
    )


def rating_anomalies(
    snap: Snapshot, rules: RatingRules = RatingRules(), orders: OrderRules = OrderRules()
) -> DataFrame:
    keys = [RESTAURANT, ITEM, "week_start"]
    rated, _ = split_on_null(snap.ratings, ITEM)
    score = F.col("rating_score")
    weekly = (
        rated.withColumn("week_start", week_start("rating_timestamp"))
        .groupBy(*keys)
        .agg(
            F.count("rating_score").alias("rating_count"),
            fixed(F.avg("rating_score"), 2).alias("mean_rating"),
            fixed(F.coalesce(F.stddev_samp("rating_score"), F.lit(0.0)), 2).alias("std_rating"),
            F.min("rating_score").alias("min_rating"),
            F.max("rating_score").alias("max_rating"),
            F.sum(F.when(score <= rules.negative_score, 1).otherwise(0)).alias(
                "negative_ratings_count"
            ),
        )
    )
    volume = (
        sold_of(snap, orders)
        .groupBy(RESTAURANT, ITEM, week_start("order_timestamp").alias("week_start"))
        .agg(F.sum("quantity").alias("total_volume_sold"))
    )
    value = cents_decimal("mean_rating")
    weeks = F.count("mean_rating")
    history = weekly.groupBy(ITEM).agg(
        (F.sum(value).cast("double") / 100.0 / weeks).alias("item_mean"),
        F.coalesce(
            exact_std(F.sum(value), F.sum(value * value), weeks), F.lit(rules.lone_week_std)
        ).alias("item_std"),
    )
    scale = F.when(F.col("item_std") > 0, F.col("item_std")).otherwise(1.0)
    low = F.col("z_score") < rules.z_low
    poor = (F.col("mean_rating") <= rules.poor_mean) & (
        F.col("total_volume_sold") >= rules.busy_volume
    )
    angry = F.col("negative_rating_rate") > rules.negative_rate
    mart = (
        weekly.join(volume, keys, "left")
        .withColumn("total_volume_sold", F.coalesce("total_volume_sold", F.lit(0)))
        .join(history, ITEM, "inner")
        .withColumns(
            {
                "z_score": fixed((F.col("mean_rating") - F.col("item_mean")) / scale, 2),
                "negative_rating_rate": fixed(
                    F.col("negative_ratings_count") / F.col("rating_count"), 4
                ),
            }
        )
        .withColumns(
            {
                "is_rating_anomaly": low | poor | angry,
                "anomaly_reason": F.when(low, "Statistically Low Rating")
                .when(poor, "High Volume Poor Quality")
                .when(angry, "Excessive Negative Feedback")
                .otherwise("Normal"),
                "calendar_year": iso_year("week_start"),
                "calendar_week": iso_week("week_start"),
            }
        )
        .drop("item_mean", "item_std")
    )
    return attach(
        mart, snap.menu_items, ITEM, ["item_name", "source_category_id", "current_base_price"]
    )


def sales_anomalies(
    orders: DataFrame,
    restaurants: DataFrame,
    rules: SalesRules = SalesRules(),
    order_rules: OrderRules = OrderRules(),
    fill_days: bool = True,
    until: dt.date | None = None,
) -> DataFrame:
    """Daily revenue against the days before it.

    With fill_days a day without orders is a row with zero sales and the trailing frame
    counts calendar days; without it the frame counts days that had orders. No day after
    `until` is filled.
    """
    daily = (
        counted_orders(orders, order_rules)
        .groupBy(RESTAURANT, day("order_timestamp").alias("order_date"))
        .agg(
            F.count(ORDER).alias("daily_orders"),
            money_sum("total_amount").alias("daily_revenue"),
        )
    )
    if fill_days:
        daily = calendar_spine(daily, [RESTAURANT], "order_date", ["daily_orders", "daily_revenue"], until)
    frame = trailing([RESTAURANT], "order_date", rules.days)
    revenue = F.sum(cents_decimal("daily_revenue")).over(frame).cast("double") / 100.0
    known = F.col("rolling_mean_revenue").isNotNull()
    z = F.col("z_score_revenue")
    std = F.col("rolling_std_revenue")
    spike, drop = known & (z > rules.z_limit), known & (z < -rules.z_limit)
    empty = F.col("daily_orders") == 0
    mart = (
        daily.withColumns(
            {
                "rolling_mean_revenue": fixed(revenue / F.count("daily_revenue").over(frame), 2),
                "rolling_std_revenue": F.coalesce(
                    fixed(_std_over("daily_revenue", frame), 2), F.lit(1.0)
                ),
            }
        )
        .withColumn(
            "z_score_revenue",
            F.when(
                known,
                fixed(
                    (F.col("daily_revenue") - F.col("rolling_mean_revenue"))
                    / F.when(std > 0, std).otherwise(1.0),
                    2,
                ),
            ).otherwise(0.0),
        )
        .withColumns(
            {
                "is_spike_anomaly": spike,
                "is_drop_anomaly": drop,
                "is_zero_sales": empty,
                "anomaly_type": F.when(empty, "Zero Sales Alert")
                .when(spike, "Revenue Spike")
                .when(drop, "Revenue Drop")
                .otherwise("Normal"),
            }
        )
    )
    return attach(mart, restaurants, RESTAURANT, ["location_name", "city", "dining_type"])
