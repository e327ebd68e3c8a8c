"""The marts on a hand-written snapshot with string keys."""

from __future__ import annotations

import datetime as dt

import pytest

import domain
from martloom.plans import anomalies, basket, customers, demand, menu, operations, pricing, waste
from martloom.plans.base import with_stored_sales
from martloom.plans.runner import MARTS, run_marts
from martloom.sources import sinks
from martloom.sources.schemas import TABLES, all_schemas, quarantine_schema
from martloom.sources.snapshot import Snapshot, completeness, load_table


@pytest.fixture(scope="module")
def snap(spark):
    return domain.snapshot(spark)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_menu_performance(snap):
    got = by(menu.menu_performance(snap), "source_restaurant_id", "source_menu_item_id")
    assert len(got) == 4
    soup = got["REST-0001", "DISH-0001"]
    assert (soup["total_quantity"], soup["gross_revenue"], soup["contribution_margin"]) == (4, 64.7, 32.7)
    assert (soup["total_customers"], soup["repeat_customers"]) == (1, 1)
    assert (soup["waste_quantity"], soup["waste_cost"], soup["rating_count"]) == (0.75, 7.25, 2)
    assert soup["avg_rating"] == 3.5
    assert soup["promotion_dependency"] == 0.75
    assert soup["active_days"] == 10
    assert got["REST-0002", "DISH-0003"]["avg_rating"] == 4.0
    assert all(r["flag_new_item_insufficient_history"] for r in got.values())


def test_menu_performance_chain(snap):
    got = by(menu.menu_performance(snap, by_restaurant=False), "source_menu_item_id")
    assert {k[0] for k in got} == {"DISH-0001", "DISH-0002", "DISH-0003"}
    assert got["DISH-0003",]["waste_cost"] == 10.0
    assert got["DISH-0002",]["total_quantity"] == 3


def test_customer_rfm(snap):
    got = by(customers.customer_rfm(snap), "source_customer_id")
    ann = got["CUST-00000001",]
    assert (ann["frequency"], ann["monetary_value"], ann["recency_days"]) == (2, 35.0, 3)
    assert (ann["customer_name"], ann["avg_order_value"]) == ("Ann Lee", 17.5)
    assert got["CUST-00000002",]["customer_name"] == "Ann"
    for idle in ("CUST-00000003", "CUST-00000004"):
        r = got[idle,]
        assert (r["rfm_segment"], r["recency_days"], r["r_score"]) == ("Inactive", 999, 1)


def test_basket(snap):
    (row,) = basket.basket_analysis(snap, min_co_occurrence=1).filter("item_a_id = 'DISH-0001'").collect()
    assert (row["item_b_name"], row["co_occurrence_count"], row["support_ab"]) == ("Pasta", 1, 0.5)
    assert (row["confidence_a_to_b"], row["confidence_b_to_a"], row["lift"]) == (1.0, 0.5, 1.0)


def test_peak(snap):
    got = by(operations.peak_analysis(snap.orders, snap.restaurants), "source_restaurant_id", "hour_of_day")
    assert {k: r["rush_period"] for k, r in got.items()} == {
        ("REST-0001", 8): "Breakfast Rush",
        ("REST-0001", 13): "Lunch Rush",
        ("REST-0001", 19): "Dinner Rush",
        ("REST-0002", 23): "Late Night",
    }
    first = got["REST-0001", 8]
    assert (first["day_of_week"], first["capacity_utilization_pct"]) == ("Monday", 0.1)


def test_location_and_channel(snap):
    got = by(operations.location_performance(snap), "source_restaurant_id")
    one = got["REST-0001",]
    assert (one["total_orders"], one["unique_customers"], one["total_items_sold"]) == (3, 1, 6)
    assert (one["dish_waste_cost"], one["raw_ingredient_waste_cost"]) == (17.25, 0.0)
    assert (one["revenue_rank"], one["margin_rank"]) == (1, 1)
    assert got["REST-0002",]["raw_ingredient_waste_cost"] == 1.5
    channel = by(operations.channel_performance(snap), "source_restaurant_id", "channel")
    assert channel["REST-0001", "Dine-in"]["order_share_pct"] == 1.0
    assert channel["REST-0002", "Takeaway"]["contribution_margin"] == 2.5


def test_wastage(snap):
    got = by(waste.wastage(snap), "source_restaurant_id", "source_menu_item_id", "ingredient_name", "week_start")
    soup = got["REST-0001", "DISH-0001", None, dt.date(2025, 3, 3)]
    assert (soup["primary_reason"], soup["waste_cost"], soup["sold_quantity"]) == ("Spillage", 7.25, 2)
    assert soup["current_week_wastage_risk"] == 1
    cake = got["REST-0001", "DISH-0003", None, dt.date(2025, 3, 10)]
    assert (cake["extreme_operational_risk"], cake["waste_cost_ratio"]) == (True, None)
    salt = got["REST-0002", None, "salt", dt.date(2025, 3, 3)]
    assert (salt["item_type"], salt["current_week_wastage_risk"]) == ("RAW_INGREDIENT", 0)


def test_next_week_means_the_next_calendar_week(spark):
    late = {"source_restaurant_id": "REST-0001", "source_menu_item_id": "DISH-0001",
            "quantity_lost": 5.0, "cost_loss_amount": 50.0, "wastage_reason": "Expired"}
    rows = [
        {**late, "source_wastage_id": f"WASTE-{i:08d}", "wastage_timestamp": when}
        for i, when in enumerate([domain.ts(3), domain.ts(10), domain.ts(31)])
    ]
    mart = waste.wastage(domain.snapshot(spark, wastage=rows)).filter("source_menu_item_id = 'DISH-0001'")
    assert [r["next_week_wastage_risk"] for r in mart.orderBy("week_start").collect()] == [1, 0, 0]


def test_pricing(snap):
    got = by(pricing.pricing(snap), "source_pricing_history_id")
    change = got["PRC-000002",]
    assert (change["pre_quantity"], change["post_quantity"]) == (2, 2)
    assert (change["pre_price"], change["post_price"]) == (21.0, 21.0)
    assert (change["elasticity"], change["sensitivity_class"]) == (None, "Low")
    assert change["promotion_overlap"]
    quiet = got["PRC-000003",]
    assert (quiet["pre_quantity"], quiet["pre_price"], quiet["post_price"]) == (0, 8.55, 9.0)
    assert not quiet["promotion_overlap"]


def test_promotions(snap):
    got = by(pricing.promotions(snap), "source_promotion_id", "source_restaurant_id")
    assert set(got) == {
        ("PROMO-0001", "REST-0001"), ("PROMO-0002", "REST-0001"), ("PROMO-0002", "REST-0002"),
    }
    trap = got["PROMO-0002", "REST-0002"]
    assert (trap["contribution_margin"], trap["is_promotion_trap"]) == (-5.5, True)
    assert not got["PROMO-0002", "REST-0001"]["is_promotion_trap"]


def test_rating_anomalies(snap):
    (row,) = anomalies.rating_anomalies(snap).collect()
    assert (row["mean_rating"], row["std_rating"], row["negative_rating_rate"]) == (3.5, 2.12, 0.5)
    assert (row["z_score"], row["anomaly_reason"]) == (0.0, "Excessive Negative Feedback")
    assert (row["calendar_year"], row["calendar_week"], row["total_volume_sold"]) == (2025, 10, 2)


def sales_orders(spark, days, amount):
    rows = [
        domain.order(i, 1, None, domain.ts(d), total=amount(d)) for i, d in enumerate(days, 1)
    ]
    return domain.table(spark, "orders", rows)


def test_one_sales_spike(spark, snap):
    amounts = {d: 80.0 + 20.0 * (d % 2) for d in range(1, 17)} | {14: 640.0}
    orders = sales_orders(spark, amounts, amounts.__getitem__)
    rows = anomalies.sales_anomalies(orders, snap.restaurants).orderBy("order_date").collect()
    first, spike = rows[0], rows[13]
    assert (first["rolling_mean_revenue"], first["z_score_revenue"], first["anomaly_type"]) == (None, 0.0, "Normal")
    before = [amounts[d] for d in range(1, 14)]
    assert spike["rolling_mean_revenue"] == round(sum(before) / len(before), 2)
    assert [r["anomaly_type"] for r in rows if r["is_spike_anomaly"]] == ["Revenue Spike"]


def test_days_without_orders(spark, snap):
    orders = sales_orders(spark, [1, 2, 5], lambda d: 100.0)
    filled = anomalies.sales_anomalies(orders, snap.restaurants).orderBy("order_date").collect()
    assert [r["anomaly_type"] for r in filled][2:4] == ["Zero Sales Alert"] * 2
    assert anomalies.sales_anomalies(orders, snap.restaurants, fill_days=False).count() == 3


def test_demand(snap):
    got = by(demand.demand_historical(snap), "source_menu_item_id", "order_date")
    first = got["DISH-0001", dt.date(2025, 3, 3)]
    assert (first["seasonal_naive_baseline"], first["split_window"]) == (None, "TRAIN")
    third = got["DISH-0001", dt.date(2025, 3, 12)]
    assert (third["seasonal_naive_baseline"], third["baseline_absolute_error"]) == (1.0, 1.0)
    assert third["category_name"] == "Entrees"


def test_stored_sales_give_the_same_marts(snap):
    stored = with_stored_sales(snap)
    plan = stored.sold._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Join" not in plan
    for build in (operations.channel_performance, waste.wastage):
        assert build(stored).exceptAll(build(snap)).count() == 0


def test_snapshot_round_trip_and_runner(spark, snap, tmp_path):
    root, out = str(tmp_path / "snap"), str(tmp_path / "marts")
    for name, df in snap.tables().items():
        df.write.parquet(f"{root}/{name}.parquet")
    assert all(completeness(spark, root).values())
    loaded = Snapshot.load(spark, root)
    assert loaded.orders.count() == 5
    summary = run_marts(loaded, out)
    assert set(summary) == set(MARTS)
    assert summary["mart_customer_rfm"].rows == 4
    assert all(sinks.available_marts(spark, out, list(MARTS)).values())
    path = f"{out}/mart_customer_rfm.parquet"
    meta = sinks.mart_metadata(spark, path)
    assert (meta["rows"], "rfm_segment" in meta["column_names"]) == (4, True)
    scan = sinks.read_mart(spark, path, ["source_customer_id"], 2, ["source_customer_id"])
    assert [r[0] for r in scan.collect()] == ["CUST-00000001", "CUST-00000002"]
    with pytest.raises(KeyError):
        sinks.read_mart(spark, path, ["nonsense"])
    with pytest.raises(ValueError, match="order"):
        sinks.export_csv(scan, str(tmp_path / "csv"), 1)
    everything = sinks.read_mart(spark, path)
    for limit, rows in ((None, 4), (1, 1)):
        sinks.export_csv(everything, str(tmp_path / "csv"), limit, ["source_customer_id"])
        assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == rows


def test_missing_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_table(spark, str(tmp_path), "orders")
    with pytest.raises(KeyError):
        load_table(spark, str(tmp_path), "nonsense")
    assert not any(completeness(spark, str(tmp_path)).values())


def test_schemas(spark):
    schemas = all_schemas()
    assert tuple(schemas) == TABLES and len(TABLES) == 11
    assert schemas["orders"]["source_customer_id"].nullable
    assert quarantine_schema("orders").fieldNames()[-2:] == ["quarantine_reason", "quarantined_at"]
