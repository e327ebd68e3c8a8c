"""Business formulas as column builders."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from martloom.config import ElasticityRules, MenuRules, PromotionRules, WasteRules
from martloom.functions.numeric import as_col, fixed, ratio, safe_ratio

ColumnLike = Column | str


def _dec(value: ColumnLike) -> Column:
    return as_col(value).cast("decimal(18,4)")


def _half_even(value: Column) -> Column:
    return F.bround(value, 2).cast("double")


def line_net_revenue(quantity: ColumnLike, unit_price: ColumnLike, discount: ColumnLike) -> Column:
    gross = as_col(quantity).cast("decimal(10,0)") * _dec(unit_price)
    return _half_even(gross - _dec(discount))


def line_contribution_margin(net: ColumnLike, quantity: ColumnLike, unit_cost: ColumnLike) -> Column:
    return _half_even(_dec(net) - as_col(quantity).cast("decimal(10,0)") * _dec(unit_cost))


def order_total(
    subtotal: ColumnLike, discount: ColumnLike, tax: ColumnLike, tip: ColumnLike
) -> Column:
    return _half_even(_dec(subtotal) - _dec(discount) + _dec(tax) + _dec(tip))


def waste_ratios(
    waste_cost: ColumnLike, revenue: ColumnLike, waste_qty: ColumnLike, sold_qty: ColumnLike
) -> tuple[Column, Column, Column]:
    """Cost ratio, quantity ratio (NULL without a denominator) and the waste-without-sales flag."""
    extreme = (as_col(waste_qty) > 0) & (as_col(sold_qty) <= 0)
    return (
        safe_ratio(waste_cost, revenue, 4, None),
        safe_ratio(waste_qty, sold_qty, 4, None),
        extreme,
    )


def waste_risk(
    cost_ratio: ColumnLike, qty_ratio: ColumnLike, extreme: ColumnLike, rules: WasteRules
) -> Column:
    risky = (
        as_col(extreme)
        | (F.coalesce(as_col(cost_ratio), F.lit(0.0)) > rules.cost_ratio)
        | (F.coalesce(as_col(qty_ratio), F.lit(0.0)) > rules.quantity_ratio)
    )
    return F.when(risky, 1).otherwise(0)


def composite_score(rules: MenuRules = MenuRules()) -> Column:
    return fixed(reduce(add, [F.lit(w) * F.col(name) for name, w in rules.weights]), 2)


def menu_class(rules: MenuRules = MenuRules()) -> Column:
    demand = F.col("demand_score") >= rules.high
    profit = F.col("profitability_score") >= rules.high
    liked = F.col("customer_signal_score") >= rules.high
    lean = F.col("wastage_health_score") >= rules.low
    organic = F.col("promotion_independence_score") >= rules.low
    return (
        F.when(demand & profit & lean & organic, "Profit Driver")
        .when(demand & ~profit, "Volume Driver")
        .when(~demand & (profit | liked) & lean, "Hidden Opportunity")
        .otherwise("Low Performer")
    )


def menu_flags(rules: MenuRules = MenuRules()) -> dict[str, Column]:
    """The nine flags that need one row only; location divergence needs the item's other rows."""
    demand, profit = F.col("demand_score"), F.col("profitability_score")
    rating, health = F.col("avg_rating"), F.col("wastage_health_score")
    return {
        "flag_high_selling_loss_making": (demand >= rules.high)
        & ((F.col("contribution_margin") <= 0) | (profit <= rules.low)),
        "flag_profitable_rarely_purchased": (profit >= rules.high) & (demand <= rules.low),
        "flag_popular_high_wastage": (demand >= rules.high) & (health <= rules.low),
        "flag_high_rating_low_profitability": (rating >= rules.high_rating)
        & (profit <= rules.low),
        "flag_low_rating_high_sales": (rating <= rules.low_rating) & (demand >= rules.high),
        "flag_promotion_dependent": F.col("promotion_dependency") >= rules.promotion_share,
        "flag_weekend_only_pattern": F.col("weekend_share") >= rules.weekend_share,
        "flag_seasonal_item": F.coalesce(F.col("is_seasonal"), F.lit(False)),
        "flag_new_item_insufficient_history": F.col("active_days") < rules.new_item_days,
    }


def elasticity(
    pre_qty: ColumnLike,
    post_qty: ColumnLike,
    pre_price: ColumnLike,
    post_price: ColumnLike,
    rules: ElasticityRules = ElasticityRules(),
) -> Column:
    """Relative change of quantity over relative change of price, against the earlier window."""
    q0, q1, p0, p1 = (as_col(c) for c in (pre_qty, post_qty, pre_price, post_price))
    price_move = ratio(p1 - p0, p0)
    usable = (q0 > 0) & (p0 > 0) & (F.abs(price_move) > rules.min_price_move)
    return F.when(usable, fixed(ratio(ratio(q1 - q0, q0), price_move), 4))


def sensitivity(value: ColumnLike, rules: ElasticityRules = ElasticityRules()) -> Column:
    size = F.abs(as_col(value))
    return F.when(size >= rules.high, "High").when(size >= rules.moderate, "Moderate").otherwise("Low")


def promotion_trap(rules: PromotionRules = PromotionRules()) -> Column:
    margin = F.col("contribution_margin")
    costly = (margin <= 0) | (F.col("margin_percentage") < rules.min_margin)
    busy = F.col("redemption_count") >= rules.min_redemptions
    return (busy & costly) | (F.coalesce(F.col("is_misleading"), F.lit(False)) & (margin < 0))


def promotion_trap_by_change(volume_change: ColumnLike, margin_change: ColumnLike) -> Column:
    return (as_col(volume_change) > 0) & (as_col(margin_change) < 0)


def rfm_segment() -> Column:
    r, f = F.col("r_score"), F.col("f_score")
    return (
        F.when((r >= 4) & (f >= 4), "Champions")
        .when((r >= 3) & (f >= 3), "Loyal Customers")
        .when((r >= 4) & (f <= 2), "New & Promising")
        .when((r <= 2) & (f >= 3), "At Risk")
        .when((r <= 2) & (f <= 2), "Hibernating")
        .otherwise("Need Attention")
    )


def rush_period(hour: ColumnLike) -> Column:
    h = as_col(hour)
    return (
        F.when(h.between(7, 10), "Breakfast Rush")
        .when(h.between(12, 14), "Lunch Rush")
        .when(h.between(18, 21), "Dinner Rush")
        .when((h >= 22) | (h <= 4), "Late Night")
        .otherwise("Off-Peak")
    )
