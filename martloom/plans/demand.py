"""Daily demand history with the seasonal-naive baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.config import DemandRules, OrderRules
from martloom.functions.dates import day, day_name, is_weekend, split_label
from martloom.functions.numeric import fixed, money_sum
from martloom.operators.joins import attach
from martloom.operators.timeseries import all_prior, trailing
from martloom.plans.base import ITEM, ORDER, RESTAURANT, sold_of
from martloom.sources.snapshot import Snapshot


def demand_historical(
    snap: Snapshot, rules: DemandRules = DemandRules(), orders: OrderRules = OrderRules()
) -> DataFrame:
    """Demand per branch, item and day.

    The baseline is the mean of the last four rows on the same weekday, else of all
    earlier rows, else NULL: a first observation has no forecast.
    """
    keys = [RESTAURANT, ITEM]
    date = F.col("order_date")
    daily = (
        sold_of(snap, orders)
        .groupBy(*keys, day("order_timestamp").alias("order_date"))
        .agg(
            F.sum("quantity").alias("historical_demand"),
            money_sum("line_net_revenue").alias("gross_revenue"),
            F.count_distinct(ORDER).alias("order_count"),
        )
        .withColumns(
            {
                "day_of_week": day_name(date),
                "day_of_week_num": F.dayofweek(date),
                "day_of_month": F.dayofmonth(date),
                "month": F.month(date),
                "is_weekend": is_weekend(date),
                "split_window": split_label(date, rules.splits),
            }
        )
    )
    same_weekday = trailing([*keys, "day_of_week_num"], "order_date", rules.same_weekday_rows)
    earlier = all_prior(keys, "order_date")
    mart = daily.withColumn(
        "seasonal_naive_baseline",
        fixed(
            F.coalesce(
                F.avg("historical_demand").over(same_weekday),
                F.avg("historical_demand").over(earlier),
            ),
            2,
        ),
    ).withColumn(
        "baseline_absolute_error",
        fixed(F.abs(F.col("historical_demand") - F.col("seasonal_naive_baseline")), 2),
    )
    mart = attach(
        mart,
        snap.menu_items,
        ITEM,
        ["item_name", "source_category_id", "current_base_price", "is_seasonal"],
    )
    return attach(mart, snap.menu_categories, "source_category_id", ["category_name"])
