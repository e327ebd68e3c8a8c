"""Promotion lift, drift, range filters, roll-ups, search and pages against plain versions."""

from __future__ import annotations

import datetime as dt
import glob
import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from martloom.plans import drift, promotion_lift, rollups, search
from martloom.sources.layout import interleaved, read_filtered, within, write_filterable
from martloom.sources.snapshot import Snapshot

MONDAY = dt.date(2024, 1, 1)


def lift_snapshot(spark):
    """Two items of one price band at one branch, on Mondays; promotion 1 runs in weeks 10 to 13."""
    units = {"a": {}, "b": {}}
    for week in range(6, 14):
        units["a"][week] = 10 if week < 10 else 18
        units["b"][week] = 5 if week < 10 else 7
    units["b"][8] = 9
    orders, lines, n = [], [], 0
    for item, weeks in units.items():
        for week, quantity in weeks.items():
            n += 1
            day = MONDAY + dt.timedelta(weeks=week)
            orders.append((n, 1, dt.datetime.combine(day, dt.time(12)), "Completed"))
            promo = 1 if item == "a" and week >= 10 else None
            lines.append((n, n, item, quantity, promo, 3.0 * quantity - (60.0 if promo else 0.0)))
    # a promotion outside its window, on an item without a price
    n += 1
    orders.append((n, 1, dt.datetime.combine(MONDAY, dt.time(9)), "Completed"))
    lines.append((n, n, "c", 4, 2, 1.0))
    start = MONDAY + dt.timedelta(weeks=10)
    promotions = [(1, "real", start, start + dt.timedelta(days=27)), (2, "late", start, start), (3, "none", None, None)]
    return Snapshot(
        {
            "orders": spark.createDataFrame(orders, "source_order_id int, source_restaurant_id int, order_timestamp timestamp, order_status string"),
            "order_items": spark.createDataFrame(
                lines,
                "source_order_item_id int, source_order_id int, source_menu_item_id string, quantity int, "
                "source_promotion_id int, line_contribution_margin double",
            ),
            "menu_items": spark.createDataFrame([("a", 11.0), ("b", 12.0)], "source_menu_item_id string, current_base_price double"),
            "promotions": spark.createDataFrame(promotions, "source_promotion_id int, campaign_name string, start_date date, end_date date"),
        }
    )


def test_promotion_lift_is_a_difference_in_differences(spark):
    found = {r.source_promotion_id: r for r in promotion_lift.promotion_lift(lift_snapshot(spark)).collect()}
    real = found[1]
    # item a: 18 - 10; controls are all days without promotion: b and, before, a as well
    before = [10] * 4 + [5, 5, 9, 5]
    control = 7 - sum(before) / 8
    assert (real.promoted_days, real.matched_days, real.matched_share) == (4, 4, 1.0)
    assert real.unit_lift == round(8 - control, 4)
    # one variance per group: only the earlier controls vary
    variance = sum((x - sum(before) / 8) ** 2 for x in before) / 7 * 4 * 4 / 8
    assert math.isclose(real.lift_high - real.unit_lift, 1.96 * math.sqrt(variance) / 4, abs_tol=2e-4)
    assert real.is_trap and real.margin_lift < 0
    for unmatched in (2, 3):
        r = found[unmatched]
        assert (r.promoted_days, r.matched_days, r.unit_lift, r.lift_low, r.is_trap) == (0, 0, None, None, None)


def drift_rows(spark):
    rng = random.Random(4)
    rows = []
    for i in range(6_000):
        win = "TRAIN" if i < 4_000 else "LATER" if i < 5_000 else "SAME"
        x = rng.gauss(10 if win != "LATER" else 13, 3)
        rows.append((win, MONDAY + dt.timedelta(weeks=i // 500), None if i % 50 == 0 else x, "new" if win == "LATER" and i % 4 == 0 else rng.choice("ab")))
    rows += [("SAME", MONDAY, float("nan"), None)] * 30
    return spark.createDataFrame(rows, "win string, week date, x double, kind string")


def test_drift_by_rows_and_by_sketches(spark):
    df = drift_rows(spark).cache()
    exact = {(r.feature, r.win): r for r in drift.stability(df, "win", ["x"], ["kind"]).collect()}
    near = {(r.feature, r.win): r for r in drift.stability_of_sketches(drift.weekly_sketches(df, "win", "week", ["x"])).collect()}
    assert exact["x", "TRAIN"].psi == 0 and exact["kind", "TRAIN"].drift == "Stable"
    assert exact["x", "LATER"].drift == "Major" and exact["x", "SAME"].drift == "Stable"
    # 250 unseen among 1,000 against the floor
    assert exact["kind", "LATER"].psi > (0.25 - 0.0001) * math.log(0.25 / 0.0001) - 0.01
    assert exact["x", "SAME"].row_count == 1_030 and exact["kind", "SAME"].bins == 4
    for win in ("TRAIN", "LATER", "SAME"):
        assert near["x", win].row_count == exact["x", win].row_count
        assert abs(near["x", win].psi - exact["x", win].psi) <= 0.05
    # edges come from training rows alone
    shifted = df.where("win = 'TRAIN'").unionByName(df.where("win <> 'TRAIN'").withColumn("x", F.col("x") + 1_000))
    moved = {(r.feature, r.win): r.psi for r in drift.stability(shifted, "win", ["x"]).collect()}
    assert moved["x", "TRAIN"] == 0 and moved["x", "SAME"] > 5


def test_sketch_ranks_stay_within_their_error(spark):
    rules = drift.DriftRules()
    df = spark.range(200_000).select(F.lit("TRAIN").alias("win"), F.expr("date_add(DATE '2024-01-01', CAST(id % 300 AS INT))").alias("week"), F.rand(3).alias("x"))
    df = df.cache()
    merged = drift.weekly_sketches(df, "win", "week", ["x"], rules).agg(F.kll_merge_agg_double("sketch", F.lit(rules.sketch_size)).alias("s"))
    places = [i / 20 for i in range(1, 20)]
    edges = merged.select(F.kll_sketch_get_quantile_double("s", F.array(*map(F.lit, places))).alias("q")).first().q
    held = df.agg(*(F.avg((F.col("x") <= q).cast("int")) for q in edges)).first()
    assert max(abs(h - p) for h, p in zip(held, places, strict=True)) <= 0.015


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = [
        (i, rng.uniform(0, 100), rng.choice([None, 1.0, 2.5, 4.0]), MONDAY + dt.timedelta(days=rng.randint(0, 700)), "x" * 40)
        for i in range(40_000)
    ]
    df = spark.createDataFrame(rows, "id int, price double, rating double, day date, filler string")
    path = str(tmp_path_factory.mktemp("layout") / "mart")
    write_filterable(df, path, ["price", "rating", "day"], files=8, row_group_bytes=32 << 10)
    return df.cache(), path


def scanned_rows(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scans = plan.collectLeaves()
    return sum(scans.apply(i).metrics().apply("numOutputRows").value() for i in range(scans.size()))


@pytest.mark.parametrize(
    "ranges",
    [
        {"price": (40.0, 45.0)},
        {"day": (dt.date(2025, 6, 1), dt.date(2025, 7, 1))},
        {"rating": (2.0, 3.0), "price": (None, 10.0), "day": (None, dt.date(2024, 3, 1))},
    ],
)
def test_range_filters_skip_row_groups(spark, laid_out, ranges):
    df, path = laid_out
    found = read_filtered(spark, path, ranges)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in df.where(within(ranges)).collect())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = read_filtered(spark, path, ranges)
        assert "PushedFilters: [IsNotNull" in again._jdf.queryExecution().toString()
        assert scanned_rows(again) < 0.5 * 40_000
        assert scanned_rows(read_filtered(spark, path, {})) == 40_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_layout_keeps_rows_and_names(spark, laid_out):
    df, path = laid_out
    assert spark.read.parquet(path).columns == df.columns and spark.read.parquet(path).count() == 40_000
    assert len(glob.glob(f"{path}/*.parquet")) == 8
    assert sum(pq.ParquetFile(f).num_row_groups for f in glob.glob(f"{path}/*.parquet")) > 16
    with pytest.raises(KeyError):
        read_filtered(spark, path, {"unknown": (1, 2)})
    bits = spark.range(1).select(interleaved([F.lit(0b101), F.lit(0b011)], 3)).first()[0]
    assert bits == 0b100111


def test_rollups_count_customers_of_any_period(spark):
    rng = random.Random(2)
    rows = [
        (i, i % 3, rng.randint(1, 4_000) if i % 9 else None, dt.datetime(2024, rng.randint(1, 12), 5), "Voided" if i % 50 == 0 else "Completed")
        for i in range(30_000)
    ]
    orders = spark.createDataFrame(rows, "source_order_id int, source_restaurant_id int, source_customer_id int, order_timestamp timestamp, order_status string")
    sketches = rollups.customer_sketches(orders).cache()
    assert sketches.count() == 36
    for first, last in [(None, None), ("2024-03-01", "2024-03-01"), ("2024-05-01", "2024-10-01")]:
        for by in ([], ["source_restaurant_id"]):
            found = {tuple(r[c] for c in by): r for r in rollups.active_customers(sketches, by, first, last).collect()}
            exact, counted = {}, {}
            for _, branch, customer, at, status in rows:
                month = f"{at:%Y-%m-01}"
                if status == "Voided" or (first and not first <= month <= last):
                    continue
                key = (branch,) if by else ()
                counted[key] = counted.get(key, 0) + 1
                exact.setdefault(key, set()).add(customer)
            assert {k: r.orders for k, r in found.items()} == counted
            for key, people in exact.items():
                n = len(people - {None})
                assert abs(found[key].customers - n) <= 0.08 * n + 1


NAMES = ["Spicy Wrap", "wrap", "RAP", None, "", "ab", "Crème Brûlée", "a b c", "wra", "p w r a p", "100% beef", "x_y"]


@pytest.mark.parametrize("needle", ["wrap", "ra", "a", "RAP", "è", "% b", "_", "zzz", "", "2", "a b c", "wrapwrap"])
def test_search_equals_contains(spark, needle):
    df = spark.createDataFrame([(i % 3, i, n) for i, n in enumerate(NAMES)], "shop int, id int, name string")
    stored = search.postings(df, ["shop", "id"], ["name", "id"])
    found = {r.id for r in search.search(df, stored, ["shop", "id"], ["name", "id"], needle).collect()}
    low = needle.lower()
    assert found == {i for i, n in enumerate(NAMES) if low in (n or "").lower() or low in str(i)}


def test_stored_search_reads_its_grams_alone(spark, tmp_path):
    df = spark.range(20_000).select("id", F.concat(F.lit("item "), F.md5(F.col("id").cast("string"))).alias("name"))
    search.write_postings(df, ["id"], ["name"], str(tmp_path / "p"), files=4)
    stored = spark.read.parquet(str(tmp_path / "p"))
    query = search.search(df, stored, ["id"], ["name"], "beef")
    plan = query._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram, [bee,eef])" in plan
    assert {r.id for r in query.collect()} == {r.id for r in df.where("name like '%beef%'").collect()}


@pytest.mark.parametrize("order", [[("x", True), ("id", True)], [("x", False), ("id", True)], [("y", False), ("x", True), ("id", False)]])
def test_pages_continue_after_the_last_row(spark, order):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for i in range(53)]
    df = spark.createDataFrame(rows, "id int, x int, y string").repartition(4).cache()
    pages, last = [], None
    while True:
        page = search.next_page(df, order, 10, last)
        assert "Offset" not in page._jdf.queryExecution().optimizedPlan().toString()
        found = page.collect()
        if not found:
            break
        pages += found
        last = tuple(found[-1][c] for c, _ in order)
    by = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]
    assert [r.id for r in pages] == [r.id for r in df.orderBy(*by).collect()]


def test_layout_and_postings_have_as_many_files_as_their_size_asks_for(spark, tmp_path):
    df = spark.range(0, 60_000, 1, 8).select(
        "id", (F.col("id") % 25).alias("branch"), F.concat(F.lit("dish "), F.col("id")).alias("name"),
        F.xxhash64("id").cast("double").alias("price"),
    )
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        write_filterable(df, str(tmp_path / "m"), ["price", "id"])
        # a posting by item alone serves the rows of every branch
        search.write_postings(df.select("id", "name"), ["id"], ["name"], str(tmp_path / "p"))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for name, rows in (("m", 60_000), ("p", None)):
        stored = spark.read.parquet(str(tmp_path / name))
        assert len(stored.inputFiles()) > 4
        assert rows is None or stored.count() == rows
    found = search.search(df, spark.read.parquet(str(tmp_path / "p")), ["id"], ["name"], "H 123")
    assert found.count() == df.where("name LIKE '%h 123%'").count() > 0


def test_menu_ranges_leave_only_the_stored_mart(spark, small_dir):
    import os

    from martloom.catalog.insights import insights
    from martloom.sources.staging import staging_root

    root = staging_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    found = insights()["menu_ranges"](spark, small_dir)
    assert {n.split("-")[0] for n in set(os.listdir(root)) - before} == {"menu"}
    assert found.count() == len(found.collect())
