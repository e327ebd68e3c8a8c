"""Weekly wastage against sales, with risk labels for this and the next week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.config import OrderRules, WasteRules
from martloom.functions.contracts import waste_ratios, waste_risk
from martloom.functions.dates import iso_week, iso_year, week_start
from martloom.functions.numeric import cents, from_cents, money_sum
from martloom.operators.joins import attach, split_on_null
from martloom.operators.timeseries import next_value_if
from martloom.plans.base import ITEM, RESTAURANT, sold_of
from martloom.sources.snapshot import Snapshot

_COLUMNS = [
    RESTAURANT,
    ITEM,
    "item_type",
    "ingredient_name",
    "week_start",
    "waste_quantity",
    "waste_cost",
    "primary_reason",
    "sold_quantity",
    "gross_revenue",
    "waste_cost_ratio",
    "waste_quantity_ratio",
    "extreme_operational_risk",
    "current_week_wastage_risk",
    "next_week_wastage_risk",
]


def _weekly_waste(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weekly quantity and cost; the primary reason is the costliest, then the first by name."""
    per_reason = rows.groupBy(*keys, "week_start", "wastage_reason").agg(
        F.sum(F.col("quantity_lost").cast("decimal(20,6)")).alias("q"), F.sum(cents("cost_loss_amount")).alias("c")
    )
    return per_reason.groupBy(*keys, "week_start").agg(
        F.sum("q").cast("double").alias("waste_quantity"),
        from_cents(F.sum("c")).alias("waste_cost"),
        F.min_by("wastage_reason", F.struct(-F.col("c"), F.col("wastage_reason"))).alias(
            "primary_reason"
        ),
    )


def wastage(
    snap: Snapshot, rules: WasteRules = WasteRules(), orders: OrderRules = OrderRules()
) -> DataFrame:
    dish_keys = [RESTAURANT, ITEM]
    dish_rows, raw_rows = split_on_null(
        snap.wastage.withColumn("week_start", week_start("wastage_timestamp")), ITEM
    )
    sales = (
        sold_of(snap, orders)
        .groupBy(*dish_keys, week_start("order_timestamp").alias("week_start"))
        .agg(
            F.sum("quantity").alias("sold_quantity"),
            money_sum("line_net_revenue").alias("gross_revenue"),
        )
    )
    dish = sales.join(_weekly_waste(dish_rows, dish_keys), [*dish_keys, "week_start"], "outer")
    dish = dish.withColumns(
        {
            "item_type": F.lit("PREPARED_DISH"),
            "ingredient_name": F.lit(None).cast("string"),
            "sold_quantity": F.coalesce("sold_quantity", F.lit(0)),
            "gross_revenue": F.coalesce("gross_revenue", F.lit(0.0)),
            "waste_quantity": F.coalesce("waste_quantity", F.lit(0.0)),
            "waste_cost": F.coalesce("waste_cost", F.lit(0.0)),
            "primary_reason": F.coalesce("primary_reason", F.lit("None")),
        }
    )
    cost_ratio, qty_ratio, extreme = waste_ratios(
        "waste_cost", "gross_revenue", "waste_quantity", "sold_quantity"
    )
    dish = dish.withColumns(
        {
            "waste_cost_ratio": cost_ratio,
            "waste_quantity_ratio": qty_ratio,
            "extreme_operational_risk": extreme,
        }
    ).withColumn(
        "current_week_wastage_risk",
        waste_risk("waste_cost_ratio", "waste_quantity_ratio", "extreme_operational_risk", rules),
    )
    dish = dish.withColumn(
        "next_week_wastage_risk",
        next_value_if("current_week_wastage_risk", "week_start", dish_keys, 7, 0),
    )
    raw = _weekly_waste(raw_rows, [RESTAURANT, "ingredient_name"]).withColumns(
        {
            ITEM: F.lit(None).cast(snap.wastage.schema[ITEM].dataType),
            "item_type": F.lit("RAW_INGREDIENT"),
            "sold_quantity": F.lit(0).cast("long"),
            "gross_revenue": F.lit(0.0),
            "waste_cost_ratio": F.lit(None).cast("double"),
            "waste_quantity_ratio": F.lit(None).cast("double"),
            "extreme_operational_risk": F.lit(False),
            "current_week_wastage_risk": F.lit(0),
            "next_week_wastage_risk": F.lit(0),
        }
    )
    dish = attach(
        dish.select(*_COLUMNS),
        snap.menu_items,
        ITEM,
        ["item_name", "source_category_id", "current_base_cost"],
    )
    both = dish.unionByName(raw.select(*_COLUMNS), allowMissingColumns=True)
    return both.withColumns(
        {"calendar_year": iso_year("week_start"), "calendar_week": iso_week("week_start")}
    )
