"""Market basket: support, confidence and lift of item pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.config import ScaleRules
from martloom.functions.numeric import fixed
from martloom.operators.pairs import pair_counts
from martloom.plans.base import ITEM, ORDER
from martloom.sources.snapshot import Snapshot


def basket_analysis(
    snap: Snapshot, min_co_occurrence: int = 5, scale: ScaleRules = ScaleRules()
) -> DataFrame:
    """Pairs of items bought together, over all orders whatever their status."""
    members = snap.order_items.select(ORDER, ITEM).distinct()
    pairs, per_item, groups = pair_counts(members, ORDER, ITEM, min_co_occurrence, scale)
    total = F.greatest(groups.scalar(), F.lit(1)).cast("double")
    names = snap.menu_items.select(ITEM, "item_name")
    items = per_item.join(names, ITEM, "left")

    def side(letter: str) -> DataFrame:
        return items.select(
            F.col(ITEM).alias(f"item_{letter}_id"),
            F.col("item_order_count").alias(f"n_{letter}"),
            F.col("item_name").alias(f"item_{letter}_name"),
        )

    both = F.col("co_occurrence_count")
    n_a, n_b = F.col("n_a"), F.col("n_b")
    return (
        pairs.join(side("a"), "item_a_id")
        .join(side("b"), "item_b_id")
        .withColumn("total_baskets", total)
        .select(
            "item_a_id",
            "item_b_id",
            "co_occurrence_count",
            fixed(n_a / F.col("total_baskets"), 4).alias("support_a"),
            fixed(n_b / F.col("total_baskets"), 4).alias("support_b"),
            fixed(both / F.col("total_baskets"), 4).alias("support_ab"),
            fixed(both / n_a, 4).alias("confidence_a_to_b"),
            fixed(both / n_b, 4).alias("confidence_b_to_a"),
            fixed((both * F.col("total_baskets")) / (n_a * n_b), 4).alias("lift"),
            "item_a_name",
            "item_b_name",
        )
    )
