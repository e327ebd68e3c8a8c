"""Business formulas on literal rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from martloom.config import SplitDates, WasteRules
from martloom.functions import contracts as c
from martloom.functions import dates, numeric
from martloom.operators.settlement import settle_orders
from martloom.operators.timeseries import split_dates


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "cost, revenue, waste, sold, expected",
    [
        (7.5, 150.0, 2.5, 50.0, (0.05, 0.05, False, 0)),  # at the cost limit, not above
        (4.0, 64.0, 1.0, 40.0, (0.0625, 0.025, False, 1)),
        (1.0, 80.0, 5.0, 50.0, (0.0125, 0.1, False, 0)),  # at the quantity limit
        (1.0, 80.0, 6.0, 48.0, (0.0125, 0.125, False, 1)),
        (9.0, 0.0, 1.0, 50.0, (None, 0.02, False, 0)),
        (0.5, 0.0, 2.0, 0.0, (None, None, True, 1)),
        (0.0, 0.0, 0.0, 0.0, (None, None, False, 0)),
    ],
)
def test_waste_risk(spark, cost, revenue, waste, sold, expected):
    a, b, extreme = c.waste_ratios("cost", "revenue", "waste", "sold")
    df = spark.createDataFrame([(cost, revenue, waste, sold)], "cost double, revenue double, waste double, sold double")
    row = df.select(a.alias("a"), b.alias("b"), extreme.alias("e")).select(
        "a", "b", "e", c.waste_risk("a", "b", "e", WasteRules()).alias("r")
    ).first()
    assert tuple(row) == expected


def scores(spark, d, p, cu, w, t, pi):
    return spark.createDataFrame(
        [(float(d), float(p), float(cu), float(w), float(t), float(pi))],
        "demand_score double, profitability_score double, customer_signal_score double, "
        "wastage_health_score double, sales_trend_score double, promotion_independence_score double",
    )


def test_composite_score(spark):
    df = scores(spark, 40, 64, 20, 90, 30, 10)
    expected = 0.25 * 40 + 0.25 * 64 + 0.15 * 20 + 0.15 * 90 + 0.10 * 30 + 0.10 * 10
    assert df.select(c.composite_score()).first()[0] == expected


@pytest.mark.parametrize(
    "d, p, cu, w, pi, expected",
    [
        (75, 75, 0, 25, 25, "Profit Driver"),  # every gate at its threshold
        (75, 75, 0, 25, 24.9, "Low Performer"),
        (75, 75, 0, 24.9, 25, "Low Performer"),
        (75, 74.9, 99, 0, 0, "Volume Driver"),
        (74.9, 75, 0, 25, 0, "Hidden Opportunity"),
        (0, 74.9, 75, 25, 0, "Hidden Opportunity"),
        (0, 75, 75, 24.9, 99, "Low Performer"),
        (74.9, 74.9, 74.9, 99, 99, "Low Performer"),
    ],
)
def test_menu_class(spark, d, p, cu, w, pi, expected):
    assert scores(spark, d, p, cu, w, 50, pi).select(c.menu_class()).first()[0] == expected


@pytest.mark.parametrize(
    "q0, q1, p0, p1, value, label",
    [
        (40, 28, 8.0, 9.6, -1.5, "High"),  # at the upper limit
        (200, 170, 5.0, 6.0, -0.75, "Moderate"),  # at the lower limit
        (64, 72, 16.0, 12.0, -0.5, "Low"),
        (50, 60, 4.0, 5.0, 0.8, "Moderate"),
        (30, 12, 7.0, 7.0, None, "Low"),
        (30, 12, 0.0, 7.0, None, "Low"),
        (0, 12, 7.0, 8.0, None, "Low"),
    ],
)
def test_elasticity(spark, q0, q1, p0, p1, value, label):
    df = spark.createDataFrame([(q0, q1, p0, p1)], "q0 int, q1 int, p0 double, p1 double")
    row = df.select(c.elasticity("q0", "q1", "p0", "p1").alias("e")).select(
        "e", c.sensitivity("e").alias("s")
    ).first()
    assert (row["e"], row["s"]) == (value, label)


def test_promotion_trap_by_change(spark):
    changes = [(0.4, -0.01), (0.4, 0.0), (0.0, -0.3), (-0.1, -0.3), (0.02, 0.5)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(changes)], "i int, v double, m double")
    flags = [r[0] for r in df.orderBy("i").select(c.promotion_trap_by_change("v", "m")).collect()]
    assert flags == [v > 0 and m < 0 for v, m in changes]


def test_line_formulas(spark):
    df = spark.createDataFrame([(3, 7.35, 2.2, 4.1)], "q int, p double, d double, c double")
    row = df.withColumn("net", c.line_net_revenue("q", "p", "d")).select(
        "net", c.line_contribution_margin("net", "q", "c").alias("margin"),
        c.order_total("p", "d", F.lit(0.65), F.lit(1.1)).alias("total"),
    ).first()
    assert tuple(row) == (19.85, 7.55, 6.9)


def test_rounding_goes_by_decimal_text(spark):
    assert one(spark, numeric.fixed(F.lit(1.005), 2)) == 1.01
    assert one(spark, numeric.fixed(F.lit(-2.675), 2)) == -2.68


def test_ratios_without_denominator(spark):
    assert one(spark, numeric.safe_ratio(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, numeric.safe_ratio(F.lit(1.0), F.lit(0.0), default=None)) is None
    assert one(spark, numeric.floored_ratio(F.lit(3.0), F.lit(0.5))) == 3.0


def test_not_finite_becomes_null(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,)], "v double")
    assert [r[0] for r in rows.select(numeric.finite("v")).collect()] == [None, None, 1.5]


def test_exact_std_matches_sample_std(spark):
    rows = spark.createDataFrame([(1.10,), (2.20,), (4.45,)], "v double")
    v = numeric.cents_decimal("v")
    got, want = rows.agg(
        numeric.exact_std(F.sum(v), F.sum(v * v), F.count("v")), F.stddev_samp("v")
    ).first()
    assert abs(got - want) < 1e-12


def test_week_identity_across_a_year_end(spark):
    days = spark.createDataFrame(
        [(dt.date(2025, 12, 29),), (dt.date(2026, 1, 4),), (dt.date(2025, 1, 1),)], "d date"
    ).withColumn("w", dates.week_start("d"))
    rows = days.select("w", dates.iso_year("w"), dates.iso_week("w")).collect()
    assert [tuple(r) for r in rows] == [
        (dt.date(2025, 12, 29), 2026, 1),
        (dt.date(2025, 12, 29), 2026, 1),
        (dt.date(2024, 12, 30), 2025, 1),
    ]


def test_split_dates():
    year = split_dates(dt.date(2025, 1, 1), dt.date(2025, 12, 31))
    assert year == SplitDates("2025-08-31", "2025-10-31", "2025-11-30")
    month = split_dates(dt.date(2025, 3, 1), dt.date(2025, 3, 30))
    assert month == SplitDates("2025-03-20", "2025-03-25", "2025-03-27")


def test_settlement(spark):
    items = spark.createDataFrame(
        [(1, 2, 10.0, 1.0), (1, 1, 5.5, 0.0), (2, 1, 8.0, 0.0), (3, 1, 1.0, 5.0)],
        "source_order_id int, quantity int, unit_price_at_sale double, line_discount double",
    )
    orders = spark.createDataFrame(
        [(1, "Completed", "Dine-in"), (2, "Voided", "Dine-in"), (3, "Completed", "Takeaway"), (4, "Completed", "Dine-in")],
        "source_order_id int, order_status string, order_channel string",
    )
    rows = {r["source_order_id"]: r for r in settle_orders(items, orders).collect()}
    first = rows[1]
    assert (first["subtotal_amount"], first["discount_amount"]) == (25.5, 1.0)
    assert (first["tax_amount"], first["tip_amount"], first["total_amount"]) == (2.02, 3.68, 30.2)
    assert (rows[2]["tax_amount"], rows[2]["tip_amount"]) == (0.0, 0.0)
    assert rows[3]["tax_amount"] == 0.0
    # an order without lines is settled too
    assert (rows[4]["subtotal_amount"], rows[4]["tip_amount"], rows[4]["total_amount"]) == (0.0, 0.0, 0.0)


def test_small_weights_add_up(spark):
    rows = spark.createDataFrame([(0.004,)] * 10, "v double")
    assert rows.select(numeric.weight_sum("v")).first()[0] == 0.04
