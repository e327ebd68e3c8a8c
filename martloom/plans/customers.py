"""Customer recency, frequency and money with quintile scores and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.config import OrderRules, ScaleRules
from martloom.functions.contracts import rfm_segment
from martloom.functions.dates import day
from martloom.functions.numeric import cents, fixed, from_cents
from martloom.operators.joins import counted_orders
from martloom.operators.ranking import ntile_of, row_positions
from martloom.plans.base import CUSTOMER, ORDER
from martloom.sources.snapshot import Snapshot


def customer_totals(orders: DataFrame, as_of_date=None) -> DataFrame:
    """One row per identified customer. Guests count for the reference date only."""
    dated = orders.withColumn("order_date", day("order_timestamp"))
    reference = dated.agg(F.max("order_date")).scalar() if as_of_date is None else as_of_date
    return (
        dated.filter(F.col(CUSTOMER).isNotNull())
        .groupBy(CUSTOMER)
        .agg(
            F.max("order_date").alias("last_order_date"),
            F.min("order_date").alias("first_order_date"),
            F.count_distinct(ORDER).alias("frequency"),
            F.sum(cents("total_amount")).alias("spent"),
        )
        .select(
            CUSTOMER,
            "last_order_date",
            "first_order_date",
            "frequency",
            from_cents("spent").alias("monetary_value"),
            F.datediff(reference, "last_order_date").alias("recency_days"),
            F.datediff(reference, "first_order_date").alias("customer_tenure_days"),
            fixed(from_cents("spent") / F.col("frequency"), 2).alias("avg_order_value"),
        )
    )


def customer_rfm(
    snap: Snapshot, orders: OrderRules = OrderRules(), scale: ScaleRules = ScaleRules()
) -> DataFrame:
    totals = customer_totals(counted_orders(snap.orders, orders))
    placed, n = row_positions(
        totals,
        {
            "r_pos": ("recency_days", False),
            "f_pos": ("frequency", True),
            "m_pos": ("monetary_value", True),
        },
        CUSTOMER,
        scale,
    )
    scored = (
        placed.withColumns({f"{s}_score": ntile_of(f"{s}_pos", n, 5) for s in "rfm"})
        .drop("r_pos", "f_pos", "m_pos")
        .withColumn("rfm_segment", rfm_segment())
    )
    people = snap.customers.select(
        CUSTOMER,
        F.concat_ws(" ", "first_name", "last_name").alias("customer_name"),
        "loyalty_tier",
        "preferred_channel",
        "home_city",
    )
    defaults = {
        "frequency": 0,
        "monetary_value": 0.0,
        "recency_days": 999,
        "rfm_segment": "Inactive",
        "r_score": 1,
        "f_score": 1,
        "m_score": 1,
    }
    joined = people.join(scored, CUSTOMER, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
