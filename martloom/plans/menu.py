"""Menu performance: scores, classes and flags per item, by branch or chain-wide."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.config import MenuRules, OrderRules, ScaleRules
from martloom.functions.contracts import composite_score, menu_class, menu_flags
from martloom.functions.dates import is_weekend
from martloom.functions.numeric import (
    cents,
    fixed,
    floored_ratio,
    from_cents,
    money_sum,
    safe_ratio,
    weight_sum,
)
from martloom.operators.joins import attach, counted_orders, split_on_null
from martloom.operators.ranking import percent_ranks
from martloom.plans.base import CUSTOMER, ITEM, ORDER, RESTAURANT, sold_of
from martloom.sources.snapshot import Snapshot

_RANKED = {
    "rank_qty": "total_quantity",
    "rank_rev": "gross_revenue",
    "rank_margin": "contribution_margin",
    "rank_profit_pct": "profitability_pct",
    "rank_rating": "avg_rating",
    "rank_repeat": "repeat_purchase_rate",
    "rank_waste": "wastage_pct",
    "rank_promo": "promotion_dependency",
    "rank_trend": "sales_trend_ratio",
}

_DESCRIBED = [
    "source_category_id",
    "item_name",
    "current_base_price",
    "current_base_cost",
    "is_seasonal",
    "prep_time_minutes",
]


def _sales(snap: Snapshot, keys: list[str], orders: OrderRules) -> DataFrame:
    """Sales, customers, repeat customers and trend from one pass over the lines.

    Lines collapse to one row per item and customer, then to one per item. A customer
    repeats when the smallest and the largest order id differ, which needs no distinct count.
    """
    seconds = F.col("order_timestamp").cast("double")
    middle = (
        counted_orders(snap.orders, orders)
        .agg((F.min(seconds) + (F.max(seconds) - F.min(seconds)) / 2.0).alias("middle"))
        .scalar()
    )
    quantity = F.col("quantity")
    promoted = F.when(F.col("source_promotion_id").isNotNull(), quantity).otherwise(0)
    weekend = F.when(is_weekend("order_timestamp"), quantity).otherwise(0)
    recent = F.when(seconds >= middle, quantity).otherwise(0)
    sums = {
        "quantity": quantity,
        "net_cents": cents("line_net_revenue"),
        "margin_cents": cents("line_contribution_margin"),
        "promo_quantity": promoted,
        "weekend_quantity": weekend,
        "recent_quantity": recent,
    }
    per_customer = (
        sold_of(snap, orders)
        .groupBy(*keys, CUSTOMER)
        .agg(
            *[F.sum(value).alias(name) for name, value in sums.items()],
            F.min("order_timestamp").alias("first_order_date"),
            F.max("order_timestamp").alias("last_order_date"),
            (F.min(ORDER) != F.max(ORDER)).alias("repeats"),
        )
    )
    per_item = per_customer.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.count(CUSTOMER).alias("total_customers"),
        F.count(F.when(F.col("repeats"), F.col(CUSTOMER))).alias("repeat_customers"),
        F.min("first_order_date").alias("first_order_date"),
        F.max("last_order_date").alias("last_order_date"),
    )
    return per_item.select(
        *keys,
        F.col("quantity").alias("total_quantity"),
        from_cents("net_cents").alias("gross_revenue"),
        from_cents("margin_cents").alias("contribution_margin"),
        "weekend_quantity",
        "promo_quantity",
        "total_customers",
        "first_order_date",
        "last_order_date",
        "repeat_customers",
        floored_ratio(
            "recent_quantity", F.col("quantity") - F.col("recent_quantity")
        ).alias("sales_trend_ratio"),
    )


def _item_stats(
    snap: Snapshot, keys: list[str], rules: MenuRules, orders: OrderRules
) -> DataFrame:
    dish_waste, _ = split_on_null(snap.wastage, ITEM)
    dish_ratings, _ = split_on_null(snap.ratings, ITEM)
    waste = dish_waste.groupBy(*keys).agg(
        weight_sum("quantity_lost").alias("waste_quantity"),
        money_sum("cost_loss_amount").alias("waste_cost"),
    )
    ratings = dish_ratings.groupBy(*keys).agg(
        F.count("rating_score").alias("rating_count"),
        fixed(F.avg("rating_score"), 2).alias("avg_rating"),
    )
    stats = _sales(snap, keys, orders).join(waste, keys, "left").join(ratings, keys, "left")
    moved = F.col("total_quantity") + F.col("waste_quantity")
    return (
        stats.withColumns(
            {
                "waste_quantity": F.coalesce("waste_quantity", F.lit(0.0)),
                "waste_cost": F.coalesce("waste_cost", F.lit(0.0)),
                "rating_count": F.coalesce("rating_count", F.lit(0)),
                "avg_rating": F.coalesce("avg_rating", F.lit(rules.default_rating)),
            }
        )
        .withColumns(
            {
                "profitability_pct": safe_ratio("contribution_margin", "gross_revenue", None),
                "weekend_share": safe_ratio("weekend_quantity", "total_quantity", None),
                "promotion_dependency": safe_ratio("promo_quantity", "total_quantity", None),
                "repeat_purchase_rate": safe_ratio("repeat_customers", "total_customers", None),
                "wastage_pct": safe_ratio("waste_quantity", moved, None),
                "active_days": F.datediff("last_order_date", "first_order_date") + 1,
            }
        )
    )


def _described(df: DataFrame, snap: Snapshot) -> DataFrame:
    """Rows with their item's name, prices and category, which the menu already holds together."""
    items = attach(snap.menu_items, snap.menu_categories, "source_category_id", ["category_name"])
    found = attach(df, items, ITEM, [*_DESCRIBED, "category_name"])
    return found.select("source_category_id", *[c for c in found.columns if c != "source_category_id"])


def menu_performance(
    snap: Snapshot,
    by_restaurant: bool = True,
    rules: MenuRules = MenuRules(),
    orders: OrderRules = OrderRules(),
    scale: ScaleRules = ScaleRules(),
) -> DataFrame:
    keys = [RESTAURANT, ITEM] if by_restaurant else [ITEM]
    # ranks leave an item's branches together, for its description and for the divergence below
    ranked = _described(percent_ranks(_item_stats(snap, keys, rules, orders), _RANKED, keys, scale, [ITEM]), snap)

    def pct(name: str):
        return F.col(name) * 100.0

    scored = ranked.withColumns(
        {
            "demand_score": fixed(0.5 * pct("rank_qty") + 0.5 * pct("rank_rev"), 2),
            "profitability_score": fixed(
                0.5 * pct("rank_margin") + 0.5 * pct("rank_profit_pct"), 2
            ),
            "customer_signal_score": fixed(0.6 * pct("rank_rating") + 0.4 * pct("rank_repeat"), 2),
            "wastage_health_score": fixed(100.0 - pct("rank_waste"), 2),
            "sales_trend_score": fixed(pct("rank_trend"), 2),
            "promotion_independence_score": fixed(100.0 - pct("rank_promo"), 2),
        }
    )
    graded = scored.withColumns(
        {
            "composite_score": composite_score(rules),
            "classification": menu_class(rules),
            **menu_flags(rules),
        }
    )
    across = Window.partitionBy(ITEM)
    divergent = (
        F.min("classification").over(across) != F.max("classification").over(across)
        if by_restaurant
        else F.lit(False)
    )
    return graded.withColumn("flag_location_divergence", divergent).drop(*_RANKED)
