"""Price elasticity around price changes, and promotion results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.config import ElasticityRules, OrderRules, PromotionRules
from martloom.functions.contracts import elasticity, promotion_trap, sensitivity
from martloom.functions.dates import day
from martloom.functions.numeric import fixed, floored_ratio, from_cents, money_sum, ratio
from martloom.operators.joins import attach, event_window_sales
from martloom.plans.base import CUSTOMER, ITEM, ORDER, RESTAURANT, sold_of
from martloom.sources.snapshot import Snapshot

EVENT = "source_pricing_history_id"


def pricing(
    snap: Snapshot, rules: ElasticityRules = ElasticityRules(), orders: OrderRules = OrderRules()
) -> DataFrame:
    """Quantity and mean price four weeks before and after each price version took effect."""
    events = snap.pricing_history.select(
        EVENT, ITEM, RESTAURANT, "base_price", day("effective_from").alias("event_day")
    )
    measured = event_window_sales(
        events, sold_of(snap, orders), pre_days=rules.pre_days, post_days=rules.post_days
    )

    def mean_price(side: str):
        return fixed(ratio(from_cents(f"{side}_cents"), f"{side}_lines"), 2)

    mart = (
        events.join(measured, EVENT, "left")
        .select(
            EVENT,
            ITEM,
            RESTAURANT,
            "base_price",
            F.col("event_day").alias("effective_from"),
            F.date_sub("event_day", rules.pre_days).alias("pre_window_start"),
            F.date_add("event_day", rules.post_days - 1).alias("post_window_end"),
            F.coalesce("pre_quantity", F.lit(0)).alias("pre_quantity"),
            F.coalesce(
                mean_price("pre"), fixed(F.col("base_price") * rules.prior_price_share, 2)
            ).alias("pre_price"),
            F.coalesce("post_quantity", F.lit(0)).alias("post_quantity"),
            F.coalesce(mean_price("post"), F.col("base_price")).alias("post_price"),
            (F.coalesce("promoted_lines", F.lit(0)) > 0).alias("promotion_overlap"),
        )
        .withColumn(
            "elasticity",
            elasticity("pre_quantity", "post_quantity", "pre_price", "post_price", rules),
        )
        .withColumn("sensitivity_class", sensitivity("elasticity", rules))
    )
    return attach(mart, snap.menu_items, ITEM, ["item_name"])


def promotions(
    snap: Snapshot, rules: PromotionRules = PromotionRules(), orders: OrderRules = OrderRules()
) -> DataFrame:
    """Redemptions, discount and margin per promotion and branch, with the trap flag."""
    key = "source_promotion_id"
    redeemed = sold_of(snap, orders).filter(F.col(key).isNotNull())
    # one distinct count per aggregate: two in one would triple the rows
    guests = redeemed.groupBy(F.col(key).alias("_key"), F.col(RESTAURANT).alias("_at")).agg(
        F.count_distinct(CUSTOMER).alias("unique_customers")
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(RESTAURANT).eqNullSafe(F.col("_at"))
    stats = (
        redeemed.groupBy(key, RESTAURANT)
        .agg(
            F.count("source_order_item_id").alias("redemption_count"),
            F.sum("quantity").alias("units_sold"),
            F.count_distinct(ORDER).alias("unique_orders"),
            money_sum("line_discount").alias("total_discount"),
            money_sum("line_net_revenue").alias("net_revenue"),
            money_sum("line_contribution_margin").alias("contribution_margin"),
        )
        .join(guests, same)
        .drop("_key", "_at")
        .withColumns(
            {
                "margin_percentage": floored_ratio("contribution_margin", "net_revenue"),
                "avg_discount_per_item": floored_ratio("total_discount", "units_sold", 2),
            }
        )
    )
    campaigns = snap.promotions.select(
        key,
        "campaign_name",
        "discount_type",
        "discount_value",
        "start_date",
        "end_date",
        "is_misleading",
    )
    return stats.join(campaigns, key, "inner").withColumn(
        "is_promotion_trap", promotion_trap(rules)
    )
