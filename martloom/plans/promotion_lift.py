"""Promotion lift against days without promotion, by matched cells.

An item-day is what one item sold at one branch on one day. Promoted item-days of a promotion
meet item-days without any promotion in the same cell: branch, weekday and price band. Both
are also looked up in the window of equal length before the promotion, so that the lift is a
difference in differences, weighted by the promoted days of each cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.config import OrderRules
from martloom.functions.contracts import promotion_trap_by_change
from martloom.functions.dates import day
from martloom.functions.numeric import cents, fixed, ratio
from martloom.plans.base import ITEM, RESTAURANT, sold_of
from martloom.sources.snapshot import Snapshot
from martloom.sources.staging import stage

PROMOTION = "source_promotion_id"
CELL = [RESTAURANT, "weekday", "price_band"]
GROUPS = ("treated_in", "treated_before", "control_in", "control_before")


@dataclass(frozen=True)
class LiftRules:
    """Width of a price band in money, and the normal quantile of the interval."""

    band_width: float = 5.0
    z: float = 1.96


def item_days(snap: Snapshot, rules: LiftRules = LiftRules(), orders: OrderRules = OrderRules()) -> DataFrame:
    """One row per branch, item and day with sales: units, margin in cents, cell, promotions.

    The price band is that of the item's list price; items without one share a NULL band.
    """
    sold = sold_of(snap, orders).groupBy(RESTAURANT, ITEM, day("order_timestamp").alias("sale_date")).agg(
        F.sum("quantity").cast("long").alias("units"),
        F.sum(cents("line_contribution_margin")).alias("margin"),
        F.array_sort(F.collect_set(PROMOTION)).alias("promotions"),
    )
    band = F.floor(F.col("current_base_price") / F.lit(rules.band_width)).alias("price_band")
    prices = snap.menu_items.select(ITEM, band)
    return (
        sold.where(F.col("sale_date").isNotNull())
        .join(prices, ITEM, "left")
        .withColumn("weekday", F.dayofweek("sale_date"))
    )


def _moments(value: str) -> list[Column]:
    x = F.col(value)
    return [
        F.sum(x).alias(f"{value}_sum"),
        F.sum(x.cast("decimal(18,0)") * x).cast("decimal(38,0)").alias(f"{value}_squares"),
    ]


def _summary(rows: DataFrame, group: str) -> DataFrame:
    """Counts and moments per promotion and cell, for one of the four groups."""
    found = rows.groupBy(PROMOTION, *CELL).agg(F.count(F.lit(1)).alias("n"), *_moments("units"), *_moments("margin"))
    return found.withColumn("grp", F.lit(group))


def _matching(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"{k}_" for k in keys})


def cell_moments(days: DataFrame, promotions: DataFrame) -> DataFrame:
    """Per promotion, cell and group: item-days and moments of units and margin.

    Controls are summed per cell and day before they meet a promotion's days, so that a
    join multiplies days, never sales.
    """
    length = F.datediff("end_date", "start_date") + 1
    windows = promotions.where("start_date IS NOT NULL AND end_date >= start_date").select(
        F.col(PROMOTION).alias("promotion_"),
        F.col("start_date").alias("first_day"),
        F.col("end_date").alias("last_day"),
        F.date_sub(F.col("start_date"), length).alias("before_day"),
    )
    promoted = days.select("*", F.explode("promotions").alias(PROMOTION))
    during = promoted.join(windows, F.col(PROMOTION) == F.col("promotion_")).where(
        F.col("sale_date").between(F.col("first_day"), F.col("last_day"))
    )
    during = stage(during.select(PROMOTION, *CELL, ITEM, "units", "margin"), "promoted")
    plain = days.where(F.size("promotions") == 0)

    # what the promoted items of a cell sold before, on days without promotion
    pairs = during.select(PROMOTION, *CELL, ITEM).distinct()
    pairs = _renamed(pairs.join(windows, F.col(PROMOTION) == F.col("promotion_")), [*CELL, ITEM])
    earlier = plain.join(pairs, _matching([*CELL, ITEM])).where(
        (F.col("sale_date") >= F.col("before_day")) & (F.col("sale_date") < F.col("first_day"))
    )

    # controls per cell and day, met by the days of both windows of the promotions in the cell
    daily = plain.groupBy(*CELL, "sale_date").agg(F.count(F.lit(1)).alias("n"), *_moments("units"), *_moments("margin"))
    cells = during.select(PROMOTION, *CELL).distinct().join(windows, F.col(PROMOTION) == F.col("promotion_"))
    spread = cells.select(
        PROMOTION,
        *[F.col(c).alias(f"{c}_") for c in CELL],
        "first_day",
        # only the cell's weekday: every seventh day from the first that falls on it
        F.explode(
            F.expr(
                "CASE WHEN date_add(before_day, pmod(weekday - dayofweek(before_day), 7)) <= last_day THEN "
                "sequence(date_add(before_day, pmod(weekday - dayofweek(before_day), 7)), last_day, INTERVAL 7 DAYS) END"
            )
        ).alias("day_"),
    )
    met = daily.join(spread, [*_matching(CELL), F.col("sale_date") == F.col("day_")])
    group = F.when(F.col("sale_date") < F.col("first_day"), "control_before").otherwise("control_in")
    sums = [F.sum(c).alias(c) for c in ("n", "units_sum", "units_squares", "margin_sum", "margin_squares")]
    controls = met.groupBy(PROMOTION, *CELL, group.alias("grp")).agg(*sums)
    return (
        _summary(during, "treated_in")
        .unionByName(_summary(earlier.select(PROMOTION, *CELL, "units", "margin"), "treated_before"))
        .unionByName(controls.select(PROMOTION, *CELL, "n", "units_sum", "units_squares", "margin_sum", "margin_squares", "grp"))
    )


def promotion_lift(
    snap: Snapshot, rules: LiftRules = LiftRules(), orders: OrderRules = OrderRules()
) -> DataFrame:
    """Lift of units and margin per item-day for every promotion, with its interval.

    A cell counts if all four groups have item-days in it; `matched_share` is the share of
    promoted item-days in such cells. The interval takes one variance per group, pooled over
    the cells, and is NULL where no cell of a group has two item-days. Promotions without
    any matched day, or without sales, have a NULL lift. `is_trap`: more units, less margin.
    """
    moments = stage(cell_moments(stage(item_days(snap, rules, orders), "item-days"), snap.promotions), "cells")

    def of(group: str, column: str) -> Column:
        return F.max(F.when(F.col("grp") == group, F.col(column)))

    columns = [
        of(g, c).alias(f"{g}_{c}") for g in GROUPS for c in ("n", "units_sum", "units_squares", "margin_sum", "margin_squares")
    ]
    wide = moments.groupBy(PROMOTION, *CELL).agg(*columns)
    complete = F.lit(True)
    for g in GROUPS:
        complete &= F.coalesce(F.col(f"{g}_n"), F.lit(0)) > 0
    weight = F.col("treated_in_n").cast("double")

    def mean(group: str, value: str) -> Column:
        return F.col(f"{group}_{value}_sum").cast("double") / F.col(f"{group}_n")

    def difference(value: str) -> Column:
        means = {g: mean(g, value) for g in GROUPS}
        return means["treated_in"] - means["treated_before"] - means["control_in"] + means["control_before"]

    sums = [F.sum("treated_in_n").alias("promoted_days"), F.sum(F.when(complete, F.col("treated_in_n"))).alias("matched_days")]
    for value in ("units", "margin"):
        sums.append(F.sum(F.when(complete, weight * difference(value))).alias(f"{value}_lift"))
    sums.append(F.sum(F.when(complete, weight * (mean("treated_in", "units") - difference("units")))).alias("units_base"))
    for g in GROUPS:
        n = F.col(f"{g}_n").cast("double")
        inner = F.col(f"{g}_units_squares").cast("double") - F.pow(F.col(f"{g}_units_sum").cast("double"), 2) / n
        sums += [
            F.sum(F.when(complete, inner)).alias(f"{g}_inner"),
            F.sum(F.when(complete, n - 1)).alias(f"{g}_free"),
            F.sum(F.when(complete, weight * weight / n)).alias(f"{g}_spread"),
        ]
    totals = wide.groupBy(PROMOTION).agg(*sums)
    days = F.col("matched_days").cast("double")
    variance = F.lit(0.0)
    for g in GROUPS:
        variance += ratio(f"{g}_inner", f"{g}_free") * F.col(f"{g}_spread")
    error = F.sqrt(variance) / days
    lift = F.col("units_lift") / days
    return (
        snap.promotions.select(PROMOTION, "campaign_name")
        .join(totals, PROMOTION, "left")
        .select(
            PROMOTION,
            "campaign_name",
            F.coalesce("promoted_days", F.lit(0)).alias("promoted_days"),
            F.coalesce("matched_days", F.lit(0)).alias("matched_days"),
            fixed(ratio(F.coalesce("matched_days", F.lit(0)), "promoted_days"), 4).alias("matched_share"),
            fixed(lift, 4).alias("unit_lift"),
            fixed(lift - rules.z * error, 4).alias("lift_low"),
            fixed(lift + rules.z * error, 4).alias("lift_high"),
            fixed(ratio("units_lift", "units_base"), 4).alias("relative_lift"),
            fixed(F.col("margin_lift") / days / 100, 2).alias("margin_lift"),
            promotion_trap_by_change("units_lift", "margin_lift").alias("is_trap"),
        )
    )
