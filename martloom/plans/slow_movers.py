"""Slow-moving dishes: gaps between sales, smoothed sales rates and classes per branch and item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.config import OrderRules, SlowRules
from martloom.functions.dates import day
from martloom.functions.numeric import fixed
from martloom.operators.scans import smoothed
from martloom.plans.base import ITEM, RESTAURANT, sold_of
from martloom.sources.snapshot import Snapshot
from martloom.sources.staging import stage

KEYS = [RESTAURANT, ITEM]


def _offered(snap: Snapshot) -> DataFrame:
    """Every active item at every branch.

    Branches are numbered, an item goes to each number, and the two meet by number, so that
    tasks share the pairs evenly.
    """
    numbered = snap.restaurants.select(RESTAURANT, (F.row_number().over(Window.orderBy(RESTAURANT)) - 1).alias("number"))
    branches = stage(numbered, "branches")
    last = branches.agg(F.max("number")).scalar()
    items = snap.menu_items.where(F.coalesce("is_active", F.lit(True))).select(ITEM, "item_name")
    spread = items.withColumn("number", F.explode(F.sequence(F.lit(0), last)))
    return spread.join(branches, "number").select(*KEYS, "item_name")


def _class(rules: SlowRules) -> Column:
    quiet, gap = F.col("days_since_sale"), F.col("mean_gap")
    return (
        F.when(F.col("sale_days") == 0, "Never Sold")
        .when(quiet > rules.dormant_gaps * gap, "Dormant")
        .when(gap >= rules.slow_gap_days, "Slow")
        .when(F.col("trend") <= rules.declining, "Declining")
        .otherwise("Active")
    )


def slow_movers(snap: Snapshot, rules: SlowRules = SlowRules(), orders: OrderRules = OrderRules()) -> DataFrame:
    """How often and how much each item sells at each branch, and its class.

    The last gap is open: it ends with the data. `mean_gap` counts its days but not the gap,
    the estimate for a censored duration; NULL for a single day of sales that is the last.
    The smoothed gap takes the open gap in only where that is the longer. `smoothed_rate` is
    the smoothed quantity per smoothed gap, lessened by half of alpha for its bias; `trend`
    compares it with the mean rate since the first sale. `absences` are gaps longer than
    `absence_days`, the open one included. Branches or items unknown to the menu keep their
    sales without a name.
    """
    sales = sold_of(snap, orders).groupBy(*KEYS, day("order_timestamp").alias("sale_date"))
    daily = stage(sales.agg(F.sum("quantity").cast("long").alias("units")).where(F.col("sale_date").isNotNull()), "daily")
    end = daily.agg(F.max("sale_date")).scalar()
    series = Window.partitionBy(*KEYS).orderBy("sale_date")
    gapped = stage(daily.withColumn("gap", F.datediff("sale_date", F.lag("sale_date").over(series))), "gaps")
    chunk = F.year("sale_date")
    size = smoothed(gapped, KEYS, "sale_date", "units", chunk, rules.alpha)
    gaps = smoothed(gapped, KEYS, "sale_date", "gap", chunk, rules.alpha)
    long_gap = F.col("gap") > rules.absence_days
    totals = gapped.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("sale_days"),
        F.sum("units").alias("units"),
        F.min("sale_date").alias("first_sale"),
        F.max("sale_date").alias("last_sale"),
        F.sum(F.coalesce("gap", F.lit(0))).alias("gap_days"),
        F.count(F.when(long_gap, 1)).alias("long_gaps"),
        F.max("gap").alias("longest"),
    )
    stats = (
        totals.join(size.select(*KEYS, F.col("smoothed").alias("smoothed_units")), KEYS)
        .join(gaps.select(*KEYS, F.col("smoothed").alias("smoothed_gap")), KEYS, "left")
        .withColumn("days_since_sale", F.datediff(end, "last_sale"))
    )
    return _offered(snap).join(stats, KEYS, "full").select(*KEYS, "item_name", *_measures(rules)).withColumn("class", _class(rules))


def _measures(rules: SlowRules) -> list[Column]:
    quiet, gap = F.col("days_since_sale"), F.col("smoothed_gap")
    # without a gap of its own an item has only the open one
    own_gap = F.coalesce(F.when(quiet > gap, gap + rules.alpha * (quiet - gap)).otherwise(gap), F.nullif(quiet, F.lit(0)))
    rate = (1 - rules.alpha / 2) * F.col("smoothed_units") / own_gap
    closed = F.col("sale_days") - 1
    mean_gap = (F.col("gap_days") + quiet) / F.greatest(closed, F.lit(1))
    mean_rate = F.col("units") / (F.col("gap_days") + quiet + 1)
    return [
        F.coalesce("sale_days", F.lit(0)).cast("long").alias("sale_days"),
        F.coalesce("units", F.lit(0)).cast("long").alias("units"),
        F.col("last_sale").alias("last_sale"),
        quiet.alias("days_since_sale"),
        fixed(F.nullif(mean_gap, F.lit(0.0)), 4).alias("mean_gap"),
        F.greatest("longest", quiet).alias("longest_gap"),
        (F.coalesce("long_gaps", F.lit(0)) + F.when(quiet > rules.absence_days, 1).otherwise(0)).cast("long").alias("absences"),
        fixed(rate, 6).alias("smoothed_rate"),
        fixed(rate / mean_rate - 1, 4).alias("trend"),
    ]
