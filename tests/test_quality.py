"""Profiling and cleaning on a snapshot with each defect once."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import domain
from martloom.operators import profile, quarantine
from martloom.plans.runner import run_cleaning
from martloom.sources.schemas import TABLES, quarantine_schema
from martloom.sources.snapshot import Snapshot


@pytest.fixture(scope="module")
def dirty(spark):
    data = domain.rows()
    orders = data["orders"] + [
        data["orders"][0],
        domain.order(6, 1, 1, dt.datetime(2031, 1, 1)),
        domain.order(7, 9, 1, domain.ts(2)),
        domain.order(8, 1, 99, domain.ts(2)),
        {**domain.order(9, 1, None, domain.ts(2)), "total_amount": 50.0},
    ]
    items = data["order_items"] + [
        data["order_items"][0],
        domain.line(20, 1, 1, 1, -5.0, 1.0),
        domain.line(21, 1, 1, 0, 5.0, 1.0),
        domain.line(22, 6, 1, 1, 5.0, 1.0),
        domain.line(23, 1, 77, 1, 5.0, 1.0),
        {**domain.line(24, 1, 1, 1, 5.0, 1.0), "line_net_revenue": 9.0},
    ]
    ratings = data["ratings"] + [{"source_rating_id": "RAT-00000009", "rating_score": 7}]
    return domain.snapshot(spark, orders=orders, order_items=items, ratings=ratings)


def measured(df):
    return {r["measure"]: r["value"] for r in df.collect()}


def test_reasons(dirty):
    cleaned = quarantine.clean_snapshot(dirty)
    counts = {
        (r["table_name"], r["quarantine_reason"]): r["row_count"]
        for r in quarantine.reason_counts(cleaned.quarantined).collect()
    }
    assert counts == {
        ("orders", "DUPLICATE_ORDER_ID"): 1,
        ("orders", "FUTURE_TIMESTAMP"): 1,
        ("orders", "ORPHANED_RESTAURANT_ID"): 1,
        ("orders", "ORPHANED_CUSTOMER_ID"): 1,
        ("order_items", "DUPLICATE_ORDER_ITEM_ID"): 1,
        ("order_items", "INVALID_NEGATIVE_PRICE"): 1,
        ("order_items", "INVALID_ZERO_QUANTITY"): 1,
        ("order_items", "ORPHANED_ORDER_PARENT"): 1,
        ("order_items", "ORPHANED_MENU_ITEM"): 1,
        ("ratings", "INVALID_RATING_SCORE_BOUNDS"): 1,
    }
    stored = quarantine.stamp(cleaned.quarantined["orders"])
    assert stored.columns == quarantine_schema("orders").fieldNames()


def test_report(dirty):
    report = {
        r["table_name"]: r
        for r in quarantine.quality_report(quarantine.clean_snapshot(dirty)).collect()
    }
    assert set(report) == {*TABLES, "ALL"}
    orders = report["orders"]
    assert (orders["raw_rows"], orders["clean_rows"], orders["quarantined_rows"]) == (10, 6, 4)
    assert (orders["cleanliness_rate_pct"], orders["overall_status"]) == (60.0, "PASSED_WITH_QUARANTINE")
    assert report["inventory"]["cleanliness_rate_pct"] == 100.0
    assert report["customers"]["overall_status"] == "CLEAN"
    whole = report["ALL"]
    assert whole["raw_rows"] == whole["clean_rows"] + whole["quarantined_rows"]


def test_cleaning_run_writes_both_sides(spark, dirty, tmp_path):
    clean, bad = str(tmp_path / "clean"), str(tmp_path / "bad")
    report = {r["table_name"]: r for r in run_cleaning(dirty, clean, bad).collect()}
    assert report["order_items"]["quarantined_rows"] == 5
    snap = Snapshot.load(spark, clean)
    assert (snap.orders.count(), snap.order_items.count(), snap.customers.count()) == (6, 8, 4)
    stored = spark.read.parquet(f"{bad}/orders_quarantine.parquet")
    assert stored.columns == quarantine_schema("orders").fieldNames()
    assert stored.count() == 4


def test_profiles(dirty):
    orders = measured(profile.orders_profile(dirty.orders))
    assert orders == {
        "rows": 10.0, "guest_orders": 2.0, "guest_pct": 20.0, "future_timestamps": 1.0,
        "settlement_mismatches": 1.0,
    }
    items = measured(profile.order_items_profile(dirty.order_items))
    assert (items["negative_prices"], items["zero_quantities"]) == (1.0, 1.0)
    assert (items["net_revenue_mismatches"], items["margin_mismatches"]) == (1.0, 1.0)
    ratings = measured(profile.ratings_profile(dirty.ratings))
    assert (ratings["out_of_range"], ratings["missing_text"]) == (1.0, 4.0)
    reasons = {r["wastage_reason"]: r["total_cost"] for r in profile.wastage_profile(dirty.wastage).collect()}
    assert reasons == {"Expired": 13.25, "Spillage": 5.5}
    status = {r["value"]: r["row_count"] for r in profile.breakdown(dirty.orders, "order_status").collect()}
    assert status == {"Completed": 8, "Cancelled": 1, "Voided": 1}


def test_keys(dirty):
    row = profile.duplicate_keys(dirty.orders, "source_order_id").first()
    assert (row["row_count"], row["distinct_keys"], row["duplicate_count"]) == (10, 9, 1)
    fk = {r["constraint"]: (r["total_foreign_keys_checked"], r["orphaned_count"]) for r in
          profile.referential_integrity(dirty).collect()}
    assert fk == {
        "order_items_to_orders": (13, 0),
        "order_items_to_menu_items": (13, 1),
        "orders_to_restaurants": (10, 1),
        "orders_to_customers": (8, 1),
    }
    key, pattern = profile.identifier_pattern("orders")
    bad = dirty.orders.withColumn(key, F.when(F.col("source_customer_id").isNull(), "ORD-1").otherwise(F.col(key)))
    row = profile.validate_identifiers(bad, key, pattern).first()
    assert (row["rows_checked"], row["invalid_ids"]) == (10, 2)
    with pytest.raises(KeyError):
        profile.identifier_pattern("nonsense")


def test_schema_defects(spark, dirty):
    assert profile.validate_schema("orders", dirty.orders).count() == 0
    broken = (
        dirty.orders.drop("payment_method")
        .withColumn("total_amount", F.col("total_amount").cast("string"))
        .withColumn("extra", F.lit(1))
        .withColumn("order_channel", F.when(F.col("source_customer_id").isNotNull(), "Dine-in"))
    )
    found = {(r["column_name"], r["defect"]) for r in profile.validate_schema("orders", broken).collect()}
    assert found == {
        ("payment_method", "MISSING_FIELD"),
        ("total_amount", "TYPE_MISMATCH"),
        ("extra", "UNEXPECTED_FIELD"),
        ("order_channel", "NULL_IN_REQUIRED_FIELD"),
    }


def test_column_profile(dirty):
    got = {r["column_name"]: r for r in profile.column_profile(dirty.orders).collect()}
    assert (got["source_customer_id"]["null_count"], got["source_customer_id"]["null_pct"]) == (2, 20.0)
    assert got["order_timestamp"]["data_type"] == "timestamp"


def test_constraints(spark):
    promos = domain.table(spark, "promotions", [
        {"source_promotion_id": "a", "discount_type": "Percentage", "discount_value": -1.0},
        {"source_promotion_id": "b", "discount_type": "Bogus", "start_date": dt.date(2025, 2, 2)},
    ])
    rules = quarantine.constraint_rules("promotions")
    got = {r["rule"]: r["violations"] for r in quarantine.rule_violations(promos, rules).collect()}
    assert got == {"INVALID_DISCOUNT_TYPE": 1, "INVALID_DISCOUNT_VALUE": 1, "INVALID_INTERVAL": 1}
    waste = domain.table(spark, "wastage", [{"quantity_lost": 0.0, "unit_of_measure": "kg", "wastage_reason": "Expired"}])
    rows = quarantine.rule_violations(waste, quarantine.constraint_rules("wastage")).collect()
    assert {r["rule"]: r["violations"] for r in rows}["INVALID_WASTE_QUANTITY"] == 1


def test_operational_flags(dirty):
    lines = dirty.order_items.join(
        dirty.orders.dropDuplicates(["source_order_id"]).select("source_order_id", "order_status", "source_customer_id"),
        "source_order_id",
    )
    rows = {r["source_order_item_id"]: r for r in profile.operational_flags(lines).collect()}
    assert rows["ITEM-00000004"]["flag_not_fulfilled"]
    assert rows["ITEM-00000003"]["flag_guest"]
    assert rows["ITEM-00000005"]["flag_negative_margin"]


def shuffle_files(spark):
    """How many shuffle files lie on the disks of this session."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).isShuffle() for i in range(blocks.size()))


def test_staging_leaves_no_shuffle_files(spark):
    import os
    import time
    from concurrent.futures import ThreadPoolExecutor

    from martloom.sources.staging import stage, stage_result, staging_root, staging_scope

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, held = spark.conf.get(setting), shuffle_files(spark)
    grouped = [spark.range(1_000).groupBy((F.col("id") % n).alias("k")).count() for n in (7, 11, 13, 17)]
    root = staging_root(spark).removeprefix("file:")
    there = set(os.listdir(root))
    with staging_scope(spark):
        with ThreadPoolExecutor(4) as pool:
            staged = list(pool.map(lambda df: stage(df, "grouped"), grouped))
        last = stage_result(spark, lambda: stage(spark.range(5), "passing").repartition(3, "id"), "last")
        assert {n.split("-")[0] for n in set(os.listdir(root)) - there} == {"grouped", "last"}
        tries = 50
        while shuffle_files(spark) > held and (tries := tries - 1):
            time.sleep(0.1)
        assert shuffle_files(spark) <= held
        assert [df.count() for df in staged] == [7, 11, 13, 17]
        assert sorted(r.id for r in last.collect()) == [0, 1, 2, 3, 4]
    assert not {n for n in set(os.listdir(root)) - there if n.startswith("last")}
    assert spark.conf.get(setting) == before


def test_staged_tables_go_with_their_scope(spark, tmp_path):
    import os

    from martloom.sources.staging import stage, staging_root, staging_scope

    root = staging_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    with staging_scope(spark):
        outer = stage(spark.range(5), "outer")
        with staging_scope(spark):
            assert stage(spark.range(3), "inner").count() == 3
        assert {n.split("-")[0] for n in set(os.listdir(root)) - before} == {"outer"}
        assert outer.count() == 5
    assert set(os.listdir(root)) == before
