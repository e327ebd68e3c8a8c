"""Composable recurrences, group quantiles, stock and slow movers against plain versions."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from martloom.config import StockRules
from martloom.operators.quantiles import counted, group_quantiles
from martloom.operators.scans import floored_level, smoothed
from martloom.plans import slow_movers, stock
from martloom.sources.snapshot import Snapshot

DAY = dt.date(2024, 1, 1)


@pytest.mark.parametrize("width", [1, 3, 1_000])
def test_floored_level_equals_a_walk(spark, width):
    rng = random.Random(width)
    rows, expected = [], {}
    for key in ["a", None, "b"]:
        level = 5
        for t in range(60):
            change = rng.choice([None, -7, -3, 0, 2, 6])
            before = level
            level = max(0, level + (change or 0))
            rows.append((key, t, change))
            expected[key, t] = (level, level - before - (change or 0))
    rows.append(("a", None, 100))
    df = spark.createDataFrame(rows, "k string, t int, change long").repartition(7)
    found = floored_level(df, ["k"], "t", "change", F.floor(F.col("t") / width), opening=5)
    assert {(r.k, r.t): (r.level, r.lost) for r in found.collect()} == expected


def test_floored_level_of_decimals_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1, "0.10"), ("a", 2, "-0.30"), ("a", 3, "0.05")], "k string, t int, c string")
    df = df.withColumn("c", F.col("c").cast("decimal(10,2)"))
    found = floored_level(df, ["k"], "t", "c", F.lit(0)).orderBy("t").collect()
    assert [(str(r.level), str(r.lost)) for r in found] == [("0.10", "0.00"), ("0.00", "0.20"), ("0.05", "0.00")]
    assert floored_level(df.limit(0), ["k"], "t", "c", F.lit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 4, 500])
def test_smoothing_in_chunks_equals_the_recurrence(spark, width):
    rng = random.Random(width)
    rows, expected = [], {}
    for key in range(4):
        mean = None
        for t in range(key * 13 + 1):
            x = rng.uniform(0, 50)
            mean = x if mean is None else mean + 0.2 * (x - mean)
            rows.append((key, t, x))
        expected[key] = (mean, key * 13 + 1)
    rows += [(1, None, 3.0), (1, 99, None), (9, 1, None)]
    df = spark.createDataFrame(rows, "k int, t int, x double").repartition(5)
    found = {r.k: (r.smoothed, r.steps) for r in smoothed(df, ["k"], "t", "x", F.floor(F.col("t") / width), 0.2).collect()}
    assert found.keys() == expected.keys()
    for key, (mean, steps) in expected.items():
        assert math.isclose(found[key][0], mean) and found[key][1] == steps


SHARES = {"least": 0.0, "low": 0.25, "mid": 0.5, "high": 0.95, "most": 1.0}


def plain_quantiles(values):
    ordered = sorted(values)
    return tuple(ordered[max(1, math.ceil(p * len(ordered))) - 1] for p in SHARES.values())


@pytest.mark.parametrize("buckets", [2, 64])
def test_group_quantiles_are_exact(spark, buckets):
    rng = random.Random(buckets)
    groups = {
        "one": [7],
        "same": [3] * 50,
        None: [rng.randint(-10, 10) for _ in range(300)],
        "wide": [rng.randint(-(2**62), 2**62) for _ in range(200)] + [2**63 - 1, -(2**63)],
        "skewed": [0] * 500 + [rng.randint(1, 10**9) for _ in range(40)],
        "near": [10**17 + i for i in range(130)],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("one", None)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(6)
    found = group_quantiles(counted(df, ["k"], "v"), ["k"], SHARES, buckets).collect()
    assert {r.k: tuple(r[n] for n in SHARES) for r in found} == {k: plain_quantiles(v) for k, v in groups.items()}
    assert {r.k: r.rows for r in found} == {k: len(v) for k, v in groups.items()}


def test_quantiles_of_a_hot_group_are_counted_in_many_tasks(spark):
    """One group with most rows and many values: no task reads more than its share of them."""
    df = spark.range(200_000).select(
        F.when(F.col("id") % 100 == 0, F.col("id") % 7).otherwise(0).alias("k"), (F.hash("id") % 50_000).cast("long").alias("v")
    )
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        values = counted(df, ["k"], "v")
        sizes = values.groupBy(F.spark_partition_id().alias("p")).count().collect()
        found = {r.k: r.mid for r in group_quantiles(values, ["k"], {"mid": 0.5}).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = df.where("k = 0").toPandas().v.sort_values()
    assert found[0] == rows.iloc[math.ceil(0.5 * len(rows)) - 1]
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 0.5 * sum(r["count"] for r in sizes)


def test_no_values_have_no_quantiles(spark):
    empty = spark.createDataFrame([("a", None)], "k string, v long")
    assert group_quantiles(counted(empty, ["k"], "v"), ["k"], {"mid": 0.5}).count() == 0
    with pytest.raises(ValueError):
        group_quantiles(counted(empty, ["k"], "v"), ["k"], {"mid": 1.5})


def movements(spark, rows):
    return spark.createDataFrame(
        [(1, g, None if d is None else DAY + dt.timedelta(days=d), i, o) for g, d, i, o in rows],
        "source_restaurant_id long, ingredient_name string, movement_date date, restocked int, consumed int",
    )


def test_stock_states_and_cover(spark):
    rows = [
        ("flour", 0, 50, 0), ("flour", 10, 0, 28), ("flour", 11, 0, 30), ("flour", 11, None, 2), ("flour", 400, 280, 28),
        ("salt", 0, 9, 1), ("salt", None, 99, 0),
    ]
    found = {(r.ingredient_name, (r.movement_date - DAY).days): r for r in stock.stock_levels(movements(spark, rows)).collect()}
    assert {k: (r.stock, r.unmet, r.days_of_cover, r.stock_state) for k, r in found.items()} == {
        ("flour", 0): (50, 0, None, "Overstock"),
        ("flour", 10): (22, 0, 22.0, "Healthy"),
        ("flour", 11): (0, 10, 0.0, "Out of Stock"),
        ("flour", 400): (252, 0, 252.0, "Overstock"),
        ("salt", 0): (8, 0, 224.0, "Overstock"),
    }
    assert found["flour", 10].held_until == DAY + dt.timedelta(days=10) and found["salt", 0].held_until is None
    levels = stock.stock_levels(movements(spark, rows))
    alerts = {r.stock_state: r for r in stock.stock_alerts(levels).collect()}
    assert alerts["Overstock"].ingredients_now == 2 and alerts["Overstock"].days_in_state == 10
    assert alerts["Out of Stock"].days_in_state == 389 and alerts["Out of Stock"].unmet == 10


def test_reorder_points_count_periods_without_demand(spark):
    # periods of 5 days: demand 6, none, 4 for flour, and one period for salt
    start = -(DAY - dt.date(1970, 1, 1)).days % 5
    rows = [("flour", start, 20, 2), ("flour", start + 4, 0, 4), ("flour", start + 10, 0, 4), ("salt", start + 12, 30, 9)]
    moved = movements(spark, rows)
    rules = StockRules(lead_days=5, service_level=0.9)
    inventory = spark.createDataFrame([(1, "flour", 7.0)], "source_restaurant_id long, ingredient_name string, reorder_threshold double")
    levels = stock.stock_levels(moved, rules)
    found = {r.ingredient_name: r for r in stock.reorder_points(moved, inventory, levels, rules).collect()}
    flour, salt = found["flour"], found["salt"]
    assert (flour.periods, flour.median_demand, flour.reorder_point, flour.stock) == (3, 4, 6, 10)
    assert (flour.needs_order, flour.order_quantity, flour.threshold_gap) == (False, 0, 1.0)
    assert (salt.periods, salt.reorder_point, salt.needs_order, salt.threshold_gap) == (1, 9, False, None)


def test_slow_movers_classes(spark):
    at = lambda d: dt.datetime.combine(DAY, dt.time(12)) + dt.timedelta(days=d)
    sold = {"daily": range(0, 101), "monthly": range(0, 101, 33), "gone": range(0, 20, 2), "once": [100]}
    orders, lines, n = [], [], 0
    for item, days in sold.items():
        for d in days:
            n += 1
            orders.append((n, 1, at(d), "Completed"))
            lines.append((n, n, item, 2))
    n += 1
    orders.append((n, 1, at(50), "Voided"))
    lines.append((n, n, "never", 5))
    snap = Snapshot(
        {
            "orders": spark.createDataFrame(orders, "source_order_id int, source_restaurant_id int, order_timestamp timestamp, order_status string"),
            "order_items": spark.createDataFrame(lines, "source_order_item_id int, source_order_id int, source_menu_item_id string, quantity int"),
            "restaurants": spark.createDataFrame([(1,), (2,)], "source_restaurant_id int"),
            "menu_items": spark.createDataFrame(
                [(i, i.upper(), True) for i in [*sold, "never"]] + [("off", "OFF", False)],
                "source_menu_item_id string, item_name string, is_active boolean",
            ),
        }
    )
    found = {(r.source_restaurant_id, r.source_menu_item_id): r for r in slow_movers.slow_movers(snap).collect()}
    assert len(found) == 10 and all(found[2, i]["class"] == "Never Sold" for i in [*sold, "never"])
    assert [found[1, i]["class"] for i in ["daily", "monthly", "gone", "once", "never"]] == [
        "Active", "Slow", "Dormant", "Active", "Never Sold",
    ]
    gone, daily = found[1, "gone"], found[1, "daily"]
    # nine closed gaps of two days and an open one of 82
    assert (gone.sale_days, gone.days_since_sale, gone.longest_gap, gone.absences) == (10, 82, 82, 1)
    assert gone.mean_gap == round((18 + 82) / 9, 4)
    assert math.isclose(gone.smoothed_rate, round(0.95 * 2 / (2 + 0.1 * 80), 6))
    assert (daily.mean_gap, daily.smoothed_rate) == (1.0, 1.9)
    assert found[1, "once"].mean_gap is None and found[1, "once"].smoothed_rate is None
