"""Order totals from their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.config import OrderRules, SettlementRules
from martloom.functions.numeric import cents, from_cents

ORDER = "source_order_id"


def _share(base: Column, rate: float) -> Column:
    """A rate of whole cents, rounded half to even."""
    exact = base.cast("decimal(18,0)") * F.lit(str(rate)).cast("decimal(8,6)")
    return F.bround(exact, 0).cast("long")


def settle_orders(
    order_items: DataFrame,
    orders: DataFrame,
    rules: SettlementRules = SettlementRules(),
    order_rules: OrderRules = OrderRules(),
) -> DataFrame:
    """Subtotal, discount, tax, tip and total of every order; 0 for one without lines.

    Completed orders pay tax; completed orders on a tipped channel also tip. The base of
    both is what remains after the discount, never below zero.
    """
    sums = order_items.groupBy(ORDER).agg(
        F.sum(F.col("quantity").cast("long") * cents("unit_price_at_sale")).alias("subtotal"),
        F.sum(cents("line_discount")).alias("discount"),
    )
    completed = F.col("order_status") == order_rules.completed_status
    tipped = completed & F.col("order_channel").isin(*rules.tipped_channels)
    base = F.greatest(F.lit(0), F.col("subtotal") - F.col("discount"))
    headers = orders.select(ORDER, "order_status", "order_channel")
    found = headers.join(sums, ORDER, "left").fillna(0, ["subtotal", "discount"])
    settled = found.withColumns(
        {
            "tax": F.when(completed, _share(base, rules.tax_rate)).otherwise(0),
            "tip": F.when(tipped, _share(base, rules.tip_rate)).otherwise(0),
        }
    )
    total = F.col("subtotal") - F.col("discount") + F.col("tax") + F.col("tip")
    return settled.select(
        ORDER,
        "order_status",
        "order_channel",
        from_cents("subtotal").alias("subtotal_amount"),
        from_cents("discount").alias("discount_amount"),
        from_cents("tax").alias("tax_amount"),
        from_cents("tip").alias("tip_amount"),
        from_cents(total).alias("total_amount"),
    )
