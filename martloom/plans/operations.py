"""Peak hours, location and channel performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.config import MenuRules, OrderRules
from martloom.functions.contracts import rush_period
from martloom.functions.dates import day_name, month_start
from martloom.functions.numeric import (
    cents,
    fixed,
    floored_ratio,
    from_cents,
    money_sum,
    safe_ratio,
)
from martloom.operators.joins import attach, counted_orders
from martloom.plans.base import CUSTOMER, ITEM, ORDER, RESTAURANT, sold_of
from martloom.sources.snapshot import Snapshot

PEAK_RANKS = 5


def peak_analysis(
    orders: DataFrame, restaurants: DataFrame, rules: OrderRules = OrderRules()
) -> DataFrame:
    """Orders and revenue per branch, weekday and hour; the five busiest levels are peak."""
    ts = F.col("order_timestamp")
    hourly = (
        counted_orders(orders, rules)
        .groupBy(
            RESTAURANT,
            F.dayofweek(ts).alias("day_number"),
            day_name(ts).alias("day_of_week"),
            F.hour(ts).alias("hour_of_day"),
        )
        .agg(
            F.count(ORDER).alias("total_orders"),
            money_sum("total_amount").alias("gross_revenue"),
            F.count("total_amount").alias("billed"),
        )
    )
    busiest = Window.partitionBy(RESTAURANT).orderBy(F.desc("total_orders"))
    details = ["location_name", "city", "dining_type", "seating_capacity"]
    return (
        attach(hourly, restaurants, RESTAURANT, details)
        .withColumn("avg_order_value", fixed(F.col("gross_revenue") / F.col("billed"), 2))
        .withColumn("rush_period", rush_period("hour_of_day"))
        .withColumn("capacity_utilization_pct", safe_ratio("total_orders", "seating_capacity"))
        .withColumn("restaurant_hour_rank", F.dense_rank().over(busiest))
        .withColumn("is_peak_hour", F.col("restaurant_hour_rank") <= PEAK_RANKS)
        .drop("billed")
    )


def location_performance(
    snap: Snapshot, rules: OrderRules = OrderRules(), menu: MenuRules = MenuRules()
) -> DataFrame:
    """Revenue, margin, ratings and waste per branch and month, for months with orders."""
    keys = [RESTAURANT, "order_month"]

    def monthly(df: DataFrame, ts: str) -> DataFrame:
        return df.withColumn("order_month", month_start(ts))

    counted = monthly(counted_orders(snap.orders, rules), "order_timestamp")
    # one distinct count per aggregate: two in one would triple the rows
    guests = counted.groupBy(*keys).agg(F.count_distinct(CUSTOMER).alias("unique_customers"))
    headers = (
        counted.groupBy(*keys)
        .agg(
            F.count_distinct(ORDER).alias("total_orders"),
            money_sum("subtotal_amount").alias("gross_revenue"),
            money_sum("discount_amount").alias("total_discount"),
            money_sum("total_amount").alias("total_net_revenue"),
            money_sum("tip_amount").alias("total_tips"),
        )
        .withColumn(
            "avg_order_value", fixed(F.col("total_net_revenue") / F.col("total_orders"), 2)
        )
    )
    lines = (
        monthly(sold_of(snap, rules), "order_timestamp")
        .groupBy(*keys)
        .agg(
            F.sum("quantity").alias("total_items_sold"),
            money_sum("line_contribution_margin").alias("contribution_margin"),
        )
    )
    ratings = (
        monthly(snap.ratings, "rating_timestamp")
        .groupBy(*keys)
        .agg(
            F.count("rating_score").alias("total_ratings"),
            fixed(F.avg("rating_score"), 2).alias("avg_rating"),
        )
    )
    cost = cents("cost_loss_amount")
    dish = F.col(ITEM).isNotNull()
    waste = (
        monthly(snap.wastage, "wastage_timestamp")
        .groupBy(*keys)
        .agg(
            F.sum(F.when(dish, cost).otherwise(0)).alias("dish_cents"),
            F.sum(F.when(~dish, cost).otherwise(0)).alias("raw_cents"),
        )
    )
    mart = headers
    for other in (guests, lines, ratings, waste):
        mart = mart.join(other, keys, "left")
    mart = mart.withColumns(
        {
            "margin_percentage": safe_ratio("contribution_margin", "total_net_revenue"),
            "total_ratings": F.coalesce("total_ratings", F.lit(0)),
            "avg_rating": F.coalesce("avg_rating", F.lit(menu.default_rating)),
            "dish_waste_cost": from_cents(F.coalesce("dish_cents", F.lit(0))),
            "raw_ingredient_waste_cost": from_cents(F.coalesce("raw_cents", F.lit(0))),
            "total_waste_cost": from_cents(
                F.coalesce(F.col("dish_cents") + F.col("raw_cents"), F.lit(0))
            ),
        }
    ).withColumn("waste_to_revenue_ratio", safe_ratio("total_waste_cost", "total_net_revenue"))
    details = [
        "location_name",
        "city",
        "state_region",
        "dining_type",
        "seating_capacity",
        "opening_date",
    ]
    month = Window.partitionBy("order_month")
    return (
        attach(mart, snap.restaurants, RESTAURANT, details)
        .withColumn(
            "revenue_rank", F.dense_rank().over(month.orderBy(F.desc("total_net_revenue")))
        )
        .withColumn(
            "margin_rank", F.dense_rank().over(month.orderBy(F.desc("contribution_margin")))
        )
        .drop("dish_cents", "raw_cents")
    )


def channel_performance(snap: Snapshot, rules: OrderRules = OrderRules()) -> DataFrame:
    """Orders, revenue, margin and order share per branch, channel and month."""
    keys = [RESTAURANT, "order_channel", "order_month"]
    headers = (
        counted_orders(snap.orders, rules)
        .withColumn("order_month", month_start("order_timestamp"))
        .groupBy(*keys)
        .agg(
            F.count(ORDER).alias("total_orders"),
            money_sum("subtotal_amount").alias("gross_amount"),
            money_sum("discount_amount").alias("discount_amount"),
            money_sum("total_amount").alias("net_revenue"),
            money_sum("tip_amount").alias("tip_amount"),
        )
    )
    lines = (
        sold_of(snap, rules)
        .withColumn("order_month", month_start("order_timestamp"))
        .groupBy(*keys)
        .agg(money_sum("line_contribution_margin").alias("contribution_margin"))
    )
    branch_month = F.sum("total_orders").over(Window.partitionBy(RESTAURANT, "order_month"))
    return (
        headers.join(lines, keys, "left")
        .withColumns(
            {
                "channel": F.col("order_channel"),
                "avg_order_value": fixed(F.col("net_revenue") / F.col("total_orders"), 2),
                "discount_rate": floored_ratio("discount_amount", "gross_amount"),
                "contribution_margin": F.coalesce("contribution_margin", F.lit(0.0)),
            }
        )
        .withColumn("margin_pct", safe_ratio("contribution_margin", "net_revenue"))
        .withColumn("order_share_pct", fixed(F.col("total_orders") / branch_month, 4))
    )
