"""Contests, comparison, serving and advice."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import domain
from martloom.plans import advice, compare, features, models, serving
from martloom.plans.models import Entry, Verdict


def entry(name, **validation):
    return Entry(name, {}, validation, 0.0, None)


def test_ties_go_to_the_second_metric():
    a, b = entry("a", rmse=1.0, mae=0.9), entry("b", rmse=1.0, mae=0.5)
    assert models.best([a, b], "rmse", "mae", larger=False).name == "b"
    c, d = entry("c", roc_auc=0.8, f1=0.4), entry("d", roc_auc=0.8, f1=0.6)
    assert models.best([c, d], "roc_auc", "f1", larger=True).name == "d"
    assert models.best([a, entry("e", rmse=0.5, mae=9.0)], "rmse", "mae", larger=False).name == "e"


def test_scores_are_exact(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (0.0, 2.0)], "y double, prediction double")
    got = models.regression_scores("y")(df)
    assert got == {"rmse": 1.290994, "mae": 1.0, "r2": -0.071429, "mape": 0.5}


def demand_rows(spark):
    rng = random.Random(1)
    rows = []
    for item in range(4):
        for week in range(60):
            rows.append((dt.date(2025, 1, 6) + dt.timedelta(weeks=week), item, 1, "c", 10 * item + rng.randint(0, 3)))
    weekly = spark.createDataFrame(
        rows, "order_date date, source_menu_item_id int, source_restaurant_id int, source_category_id string, historical_demand int"
    ).withColumn("gross_revenue", F.col("historical_demand") * 2.0)
    return features.weekly_demand_features(weekly)


def test_demand_contest(spark):
    verdict = models.demand_contest(demand_rows(spark))
    best = min(verdict.entries, key=lambda e: (e.validation["rmse"], e.validation["mae"]))
    assert verdict.champion is best and len(verdict.entries) == 3
    assert verdict.test["rmse"] < 5
    rows = verdict.predictions
    assert rows.columns == [
        "week_start_date", "menu_item_id", "restaurant_id", "actual_quantity", "predicted_quantity",
        "absolute_error", "split", "pipeline",
    ]
    assert rows.count() == 240 and rows.filter("predicted_quantity < 0").count() == 0
    meta = verdict.metadata(spark, "demand_forecast")
    assert serving.champion(meta, "demand_forecast").first()["algorithm"] == best.name
    assert meta.filter("test_metrics is not null").count() == 1


def test_lags_never_see_the_row_itself(spark):
    rows = demand_rows(spark).filter("menu_item_id = 3").orderBy("week_start_date").collect()
    assert (rows[0]["lag_1w_quantity"], rows[0]["rolling_4w_avg_quantity"]) == (0.0, 0.0)
    for before, now in zip(rows, rows[1:]):
        assert now["lag_1w_quantity"] == before["weekly_quantity"]


def test_segment_contest_names_clusters_by_recency(spark):
    rng = random.Random(4)
    rows = [
        (k * 100 + i, k * 80.0 + rng.random(), 40.0 - 10 * k + rng.random(), 400.0 - 100 * k + rng.random())
        for k in range(4) for i in range(20)
    ]
    people = spark.createDataFrame(rows, "customer_id int, recency_days double, frequency double, monetary_total double")
    verdict = models.segment_contest(people, with_mixture=True)
    assert len(verdict.entries) == 3 and verdict.champion.validation["silhouette_score"] > 0.8
    names = {r["customer_id"] // 100: r["segment_label"] for r in verdict.predictions.collect()}
    assert names == {0: "Champions", 1: "Loyal", 2: "At Risk", 3: "Lost"}


def test_churn_panel_and_contest(spark):
    rng = random.Random(6)
    orders = []
    for customer in range(60):
        step = 10 if customer % 2 else 130
        day = rng.randint(0, 100)
        while day < 500:
            orders.append(domain.order(len(orders), 1, customer + 1, dt.datetime(2025, 1, 1) + dt.timedelta(days=day)))
            day += step + rng.randint(0, 5)
    df = domain.table(spark, "orders", orders)
    cuts = {"2025-06-30": "TRAIN", "2025-09-30": "VALIDATION", "2025-12-31": "TEST"}
    panel = features.churn_panel(df, cuts)
    for r in panel.collect():
        mine = [o["order_timestamp"].date() for o in orders if o["source_customer_id"] == r["customer_id"]]
        past = [d for d in mine if d <= r["cutoff"]]
        ahead = [d for d in mine if 0 < (d - r["cutoff"]).days <= 60]
        assert r["recency_days"] == (r["cutoff"] - max(past)).days
        assert (r["frequency"], r["churn_label"]) == (len(past), 0 if ahead else 1)
    verdict = models.churn_contest(panel)
    assert verdict.champion.validation["roc_auc"] > 0.6
    with pytest.raises(ValueError, match="one class"):
        models.churn_contest(panel.filter("churn_label = 0"))
    assert {r["split"] for r in verdict.predictions.select("split").distinct().collect()} == set(cuts.values())


def test_one_failing_task_does_not_stop_the_rest():
    good = Verdict(entry("x"), [], {}, None)

    def fail():
        raise ValueError("no data")

    done, errors = models.run_tasks({"a": lambda: good, "b": fail})
    assert (list(done), errors) == (["a"], {"b": "ValueError: no data"})
    assert models.run_status(done, errors) == "PARTIAL"
    assert models.run_status(done, {}) == "SUCCESS"


def test_compare_regression(spark):
    schema = "week_start_date string, menu_item_id int, restaurant_id int, actual_quantity double, predicted_quantity double, split string"
    unseen = compare.UNSEEN
    a = spark.createDataFrame([("w", 1, 1, 10.0, 10.0, unseen), ("w", 2, 1, 5.0, 9.0, unseen), ("w", 3, 1, 5.0, 5.0, "TRAIN")], schema)
    b = spark.createDataFrame([("w", 1, 1, 10.0, 10.5, unseen), ("w", 2, 1, 5.0, 5.0, unseen), ("w", 3, 1, 5.0, 1.0, "TRAIN")], schema)
    rows = {r["menu_item_id"]: r for r in compare.compare_regression(a, b).collect()}
    assert set(rows) == {1, 2}
    assert (rows[1]["match"], rows[1]["numerical_difference"], rows[1]["pipeline_winner"]) == (True, 0.5, "a")
    assert (rows[2]["match"], rows[2]["pipeline_winner"]) == (False, "b")
    summary = compare.regression_summary(compare.compare_regression(a, b)).first()
    assert (summary["agreement_pct"], summary["a_rmse"], summary["a_wins"]) == (50.0, 2.828427, False)
    assert compare.compare_regression(a, b, split=None).count() == 3
    whole = compare.overall_agreement([
        compare.regression_summary(compare.compare_regression(a, b, split=None)),
        compare.regression_summary(compare.compare_regression(a, b)),
    ]).first()
    assert (whole["tasks"], whole["overall_agreement_pct"]) == (2, 41.67)


def test_compare_classes(spark):
    schema = "k int, actual_label int, predicted_label int, p double, split string"
    a = spark.createDataFrame([(1, 1, 1, 0.9, compare.UNSEEN), (2, 0, 1, 0.6, compare.UNSEEN), (3, 1, 0, 0.1, compare.UNSEEN)], schema)
    b = spark.createDataFrame([(1, 1, 0, 0.2, compare.UNSEEN), (2, 0, 0, 0.1, compare.UNSEEN), (3, 1, 0, 0.1, compare.UNSEEN)], schema)
    compared = compare.compare_classes(a, b, ["k"], "p", ("old", "new"))
    rows = {r["k"]: (r["match"], r["numerical_difference"], r["pipeline_winner"]) for r in compared.collect()}
    assert rows == {1: (False, 0.7, "old"), 2: (False, 0.5, "new"), 3: (True, 0.0, "neither")}
    row = compare.class_summary(compared, "churn_risk", ("old", "new")).first()
    assert (row["old_accuracy"], row["new_accuracy"], row["old_wins"]) == (0.333333, 0.333333, True)


def test_metric_differences(spark):
    rows = [("a", "f1", 0.9), ("b", "f1", 0.75), ("a", "runtime", 12.5), ("b", "runtime", 4.2)]
    df = spark.createDataFrame(rows, "name string, metric string, value double")
    got = {r["metric"]: (r["difference"], r["agreement"]) for r in compare.metric_differences(df, "a", "b").collect()}
    assert got == {"f1": (0.15, 0.85), "runtime": (8.3, None)}


@pytest.fixture(scope="module")
def marts(spark):
    from martloom.plans import customers, menu, operations, pricing, waste

    snap = domain.snapshot(spark)
    return {
        "menu": menu.menu_performance(snap),
        "chain": menu.menu_performance(snap, False),
        "rfm": customers.customer_rfm(snap),
        "waste": waste.wastage(snap),
        "pricing": pricing.pricing(snap),
        "location": operations.location_performance(snap),
        "items": snap.menu_items,
    }


def test_pages_are_disjoint_and_filtered(marts):
    order = ["source_restaurant_id", "source_menu_item_id"]
    keys = [
        [tuple(r)[:2] for r in serving.page(marts["menu"].select(*order), order, at, 2).collect()]
        for at in (0, 2, 4)
    ]
    assert [len(k) for k in keys] == [2, 2, 0] and not set(keys[0]) & set(keys[1])
    assert serving.menu_filter(marts["menu"], search="SOU").count() == 1
    assert serving.menu_filter(marts["menu"], category="Entrees", restaurant="REST-0002").count() == 2
    assert serving.menu_filter(marts["menu"], flag="seasonal_item").count() == 0
    assert serving.customer_search(marts["rfm"], search="lee").count() == 1


def test_customers_with_predictions(spark, marts):
    churn = spark.createDataFrame(
        [("CUST-00000001", dt.date(2025, 1, 1), 0.1, 0), ("CUST-00000001", dt.date(2025, 6, 1), 0.9, 1)],
        "customer_id string, cutoff date, churn_probability double, predicted_label int",
    )
    segments = spark.createDataFrame([("CUST-00000002", "Lost")], "customer_id string, segment_label string")
    rows = {r["source_customer_id"]: r for r in serving.customers_enriched(marts["rfm"], churn, segments).collect()}
    assert len(rows) == 4
    assert rows["CUST-00000001"]["churn_probability"] == 0.9
    assert rows["CUST-00000002"]["ml_segment"] == "Lost"
    assert rows["CUST-00000003"]["churn_label"] is None


def test_risk_items(spark, marts):
    rows = spark.createDataFrame(
        [("DISH-0001", 0, 0.2), ("DISH-0001", 1, 0.6), ("DISH-0009", 0, 0.3)],
        "menu_item_id string, predicted_label int, risk_probability double",
    )
    got = [tuple(r) for r in serving.top_risk_items(rows, marts["items"]).collect()]
    assert set(got) == {
        ("DISH-0001", "Soup", 0.4, 1, "HIGH RISK", 1),
        ("DISH-0009", "DISH-0009", 0.3, 0, "ELEVATED", 0),
    }
    assert tuple(serving.risk_summary(rows).first()) == (3, 1, 0.3667, 33.33)


def test_waste_lists(marts):
    rows = serving.high_risk_items(marts["waste"]).collect()
    assert [(r["item_name"], r["waste_cost"]) for r in rows] == [("Cake", 10.0), ("Soup", 7.25)]
    text = {r["id"]: r for r in advice.waste_advice(marts["waste"]).collect()}
    assert "$3.00 saved" in text["REC-WASTE-DISH-0003"]["expected_impact"]


def test_what_if(spark, marts):
    grid = [advice.Scenario("same", 0.0), advice.Scenario("up", 10.0, 0.0, 50.0), advice.Scenario("free", 300.0)]
    rows = {(r["source_menu_item_id"], r["scenario"]): r for r in advice.what_if(marts["chain"], marts["pricing"], grid).collect()}
    assert len(rows) == 9
    same = rows["DISH-0001", "same"]
    assert (same["base_volume"], same["revenue_delta"], same["margin_delta"]) == (4, 0.0, 0.0)
    up = rows["DISH-0001", "up"]
    assert (up["elasticity_applied"], up["estimated_price"], up["estimated_volume"]) == (-0.85, 23.1, 3)
    assert up["volume_delta_pct"] == -8.5
    assert up["estimated_contribution_margin"] == round((23.1 - 8.0) * 3 + 8.0 * 4 * 0.05 * 0.5, 2)
    assert rows["DISH-0001", "free"]["estimated_volume"] == 0


def test_many_categories_and_gaps_keep_every_row(spark):
    """More categories than a tree has bins, and rows with missing numbers."""
    rows = [
        (dt.date(2025, 1, 6) + dt.timedelta(days=7 * (i % 52)), i % 7, f"r{i % 400}", f"c{i % 150}" if i % 9 else None, float(i % 13) if i % 5 else None, i % 11)
        for i in range(2_000)
    ]
    schema = "week_start_date date, menu_item_id int, restaurant_id string, category_id string, n double, y int"
    df = spark.createDataFrame(rows, schema).withColumn("split", F.when(F.month("week_start_date") <= 8, "TRAIN").otherwise("VALIDATION"))
    prepared = models.prepare(df, ["n"], ["category_id", "restaurant_id"], "y")
    assert prepared.count() == len(rows)
    entry_ = models.regressors("y")[1].estimator.fit(prepared.filter("split = 'TRAIN'"))
    assert entry_.transform(prepared).filter("prediction is not null").count() == len(rows)


def test_weighted_scores_equal_the_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    cells = {(0.0, 0.0): 50, (0.0, 1.0): 7, (1.0, 0.0): 4, (1.0, 1.0): 9}
    rows = [(label, predicted) for (label, predicted), n in cells.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    found = models.weighted_scores(cells)
    for name, metric in (("f1", "f1"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("accuracy", "accuracy")):
        want = MulticlassClassificationEvaluator(metricName=metric).evaluate(df)
        assert abs(found[name] - want) < 1e-6


def waste_rows(spark, risky):
    rows = [
        (dt.date(2025, 7, 7) + dt.timedelta(weeks=week), item, 1, "c", 0.01, 0.02, int(risky(item, week)))
        for item in range(4) for week in range(24)
    ]
    mart = spark.createDataFrame(
        rows,
        "week_start date, source_menu_item_id int, source_restaurant_id int, source_category_id string, "
        "waste_cost_ratio double, waste_quantity_ratio double, next_week_wastage_risk int",
    )
    return features.waste_features(mart)


@pytest.mark.parametrize("label", [0, 1])
def test_waste_contest_with_one_class_in_training(spark, label):
    # later weeks, which are not trained on, hold the other class for one item
    verdict = models.waste_contest(waste_rows(spark, lambda item, week: label ^ (item == 0 and week > 10)))
    assert verdict.champion.name == "OneClass" and set(verdict.champion.validation) >= {"roc_auc", "f1"}
    rows = verdict.predictions.collect()
    assert len(rows) == 96 and {r["predicted_label"] for r in rows} == {label}
    assert {r["risk_probability"] for r in rows} == {float(label)}
    meta = verdict.metadata(spark, "wastage_risk")
    assert serving.champion(meta, "wastage_risk").first()["algorithm"] == "OneClass"
    assert [r["test_metrics"]["accuracy"] for r in meta.collect()] == [0.75]


def test_waste_contest_when_no_window_holds_any_risk(spark):
    verdict = models.waste_contest(waste_rows(spark, lambda item, week: False))
    assert verdict.test["accuracy"] == 1.0
    assert {r["predicted_label"] for r in verdict.predictions.collect()} == {0}
