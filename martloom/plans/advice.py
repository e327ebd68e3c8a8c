"""Recommendations drawn from the marts, and what-if estimates over a grid of scenarios."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.config import WhatIfDefaults
from martloom.functions.numeric import fixed, money_sum, ratio
from martloom.plans.base import CUSTOMER, ITEM, RESTAURANT
from martloom.plans.pricing import EVENT
from martloom.sources.sinks import read_mart

PER_DOMAIN = 5
WASTE_SAVING = 0.30


def _advice(df: DataFrame, domain: str, priority: str, fields: dict[str, Column]) -> DataFrame:
    return df.select(
        fields["id"].alias("id"),
        F.lit(domain).alias("domain"),
        fields["target"].alias("target"),
        fields["observation"].alias("observation"),
        fields["evidence"].alias("evidence"),
        fields["interpretation"].alias("interpretation"),
        fields["recommendation"].alias("recommendation"),
        F.lit(priority).alias("priority"),
        fields["impact"].alias("expected_impact"),
    )


def _name(name: str, key: str) -> Column:
    return F.format_string("%s (%s)", F.col(name), F.col(key).cast("string"))


def menu_advice(menu: DataFrame, limit: int = PER_DOMAIN) -> DataFrame:
    """Best sellers that lose money, the largest loss first."""
    rows = (
        menu.filter(F.col("flag_high_selling_loss_making"))
        .orderBy("contribution_margin", ITEM, *([RESTAURANT] if RESTAURANT in menu.columns else []))
        .limit(limit)
    )
    return _advice(
        rows,
        "Menu Optimization",
        "Critical",
        {
            "id": F.concat(F.lit("REC-MENU-"), F.col(ITEM).cast("string")),
            "target": _name("item_name", ITEM),
            "observation": F.format_string(
                "%d units sold at a contribution margin of $%.2f",
                "total_quantity",
                "contribution_margin",
            ),
            "evidence": F.format_string(
                "Revenue $%.2f, unit cost $%.2f, margin $%.2f",
                "gross_revenue",
                "current_base_cost",
                "contribution_margin",
            ),
            "interpretation": F.lit("Demand is there, but each sale loses money"),
            "recommendation": F.lit("Raise the price by 10-15% or lower the food cost"),
            "impact": F.format_string("+$%.2f margin", F.abs("contribution_margin")),
        },
    )


def waste_advice(waste: DataFrame, limit: int = PER_DOMAIN) -> DataFrame:
    """Dishes with the costliest high-risk weeks; the estimate saves 30 % of the cost."""
    ten_thousandths = F.rint(F.col("waste_cost_ratio") * 10000).cast("long")
    mean_pct = ratio(F.sum(ten_thousandths), F.count("waste_cost_ratio")) / 100.0
    rows = (
        waste.filter((F.col("current_week_wastage_risk") == 1) & F.col(ITEM).isNotNull())
        .groupBy(ITEM, "item_name")
        .agg(
            money_sum("waste_cost").alias("waste_cost"),
            fixed(F.coalesce(mean_pct, F.lit(0.0)), 1).alias("mean_pct"),
        )
        .orderBy(F.desc("waste_cost"), ITEM)
        .limit(limit)
    )
    saving = fixed(F.col("waste_cost") * WASTE_SAVING, 2)
    return _advice(
        rows,
        "Operational Wastage",
        "High",
        {
            "id": F.concat(F.lit("REC-WASTE-"), F.col(ITEM).cast("string")),
            "target": _name("item_name", ITEM),
            "observation": F.format_string("$%.2f wasted in high-risk weeks", "waste_cost"),
            "evidence": F.format_string(
                "Waste cost $%.2f, mean cost ratio %.1f%%", "waste_cost", "mean_pct"
            ),
            "interpretation": F.lit("More is prepared than is sold in these weeks"),
            "recommendation": F.lit("Size daily batches by the demand forecast"),
            "impact": F.format_string("$%.2f saved at 30%% less waste", saving),
        },
    )


def retention_advice(rfm: DataFrame, limit: int = PER_DOMAIN) -> DataFrame:
    """The highest-spending customers at risk."""
    rows = (
        rfm.filter(F.col("rfm_segment") == "At Risk")
        .orderBy(F.desc("monetary_value"), CUSTOMER)
        .limit(limit)
    )
    return _advice(
        rows,
        "Customer Retention",
        "Medium",
        {
            "id": F.concat(F.lit("REC-CHURN-"), F.col(CUSTOMER).cast("string")),
            "target": _name("customer_name", CUSTOMER),
            "observation": F.format_string("No order for %d days", "recency_days"),
            "evidence": F.format_string(
                "%d orders, $%.2f spent, %d days inactive",
                "frequency",
                "monetary_value",
                "recency_days",
            ),
            "interpretation": F.lit("A good customer has stopped coming"),
            "recommendation": F.lit("Send a win-back offer on the preferred channel"),
            "impact": F.format_string("$%.2f of past spend at stake", "monetary_value"),
        },
    )


def recommendations(menu: DataFrame, waste: DataFrame, rfm: DataFrame) -> DataFrame:
    return menu_advice(menu).unionByName(waste_advice(waste)).unionByName(retention_advice(rfm))


@dataclass(frozen=True)
class Scenario:
    name: str
    price_change_pct: float
    discount_change_pct: float = 0.0
    waste_reduction_pct: float = 0.0


def latest_elasticity(pricing: DataFrame) -> DataFrame:
    """The elasticity of each item's latest price event that has one."""
    return (
        pricing.filter(F.col("elasticity").isNotNull())
        .groupBy(ITEM)
        .agg(F.max_by("elasticity", F.struct("effective_from", EVENT)).alias("elasticity"))
    )


def stored_inputs(spark: SparkSession, menu: str, pricing: str) -> tuple[DataFrame, DataFrame]:
    """The columns that `what_if` uses of the stored chain-wide menu mart and pricing mart."""
    items = [ITEM, "item_name", "current_base_price", "current_base_cost", "total_quantity"]
    return read_mart(spark, menu, items), read_mart(spark, pricing, [ITEM, EVENT, "effective_from", "elasticity"])


def what_if(
    menu: DataFrame,
    pricing: DataFrame,
    scenarios: Sequence[Scenario],
    defaults: WhatIfDefaults = WhatIfDefaults(),
) -> DataFrame:
    """Estimated price, volume, revenue and margin of every item under every scenario.

    `menu` is the chain-wide menu mart. Volume follows the item's elasticity to price and
    half as strongly to discounts; waste savings are a share of the baseline cost.
    """
    grid = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("scenario"),
                F.lit(float(s.price_change_pct)).alias("price_change_pct"),
                F.lit(float(s.discount_change_pct)).alias("discount_change_pct"),
                F.lit(float(s.waste_reduction_pct)).alias("waste_reduction_pct"),
            )
            for s in scenarios
        ]
    )

    def positive(column: str, fallback: float | int) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit(fallback * 0)), F.lit(fallback))

    base = (
        menu.join(latest_elasticity(pricing), ITEM, "left")
        .select(
            ITEM,
            "item_name",
            positive("current_base_price", defaults.price).alias("base_price"),
            positive("current_base_cost", defaults.cost).alias("base_cost"),
            positive("total_quantity", defaults.volume).alias("base_volume"),
            F.coalesce("elasticity", F.lit(defaults.elasticity)).alias("e"),
            F.explode(grid).alias("s"),
        )
        .select("*", "s.*")
        .drop("s")
    )
    price_move = F.col("price_change_pct") / 100.0
    change = F.col("e") * price_move - (F.col("e") * defaults.discount_pull) * (
        F.col("discount_change_pct") / 100.0
    )
    moved = base.withColumns(
        {
            "volume_change": change,
            "new_price": F.col("base_price") * (1.0 + price_move),
            "new_volume": F.greatest(
                F.lit(0).cast("long"), (F.col("base_volume") * (1.0 + change)).cast("long")
            ),
        }
    )
    old_revenue = F.col("base_price") * F.col("base_volume")
    old_margin = (F.col("base_price") - F.col("base_cost")) * F.col("base_volume")
    saved = (F.col("base_cost") * F.col("base_volume") * defaults.waste_share) * (
        F.col("waste_reduction_pct") / 100.0
    )
    new_revenue = F.col("new_price") * F.col("new_volume")
    new_margin = (F.col("new_price") - F.col("base_cost")) * F.col("new_volume") + saved
    return moved.select(
        ITEM,
        "item_name",
        "scenario",
        fixed("e", 3).alias("elasticity_applied"),
        fixed("base_price", 2).alias("base_price"),
        fixed("base_cost", 2).alias("base_cost"),
        "base_volume",
        fixed(old_revenue, 2).alias("revenue"),
        fixed(old_margin, 2).alias("contribution_margin"),
        fixed("new_price", 2).alias("estimated_price"),
        F.col("new_volume").alias("estimated_volume"),
        fixed(new_revenue, 2).alias("estimated_revenue"),
        fixed(new_margin, 2).alias("estimated_contribution_margin"),
        fixed(new_revenue - old_revenue, 2).alias("revenue_delta"),
        fixed(new_margin - old_margin, 2).alias("margin_delta"),
        fixed(F.col("volume_change") * 100, 2).alias("volume_delta_pct"),
    )
