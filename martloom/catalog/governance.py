"""Contract checks over all entities, stored quarantine, whole model runs and stored what-ifs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.catalog import serving_sql
from martloom.catalog.domain_sql import text, with_domain
from martloom.catalog.quality_sql import quarantine_orders
from martloom.config import DemandRules, SplitDates
from martloom.functions.dates import split_label
from martloom.functions.numeric import money_sum
from martloom.operators import profile, quarantine
from martloom.plans import advice, compare, customers, demand, features, menu, ml_runner, models, pricing, runner, serving, waste
from martloom.sources.schemas import KEYS, table_schema
from martloom.sources.sinks import read_mart, write_mart
from martloom.sources.snapshot import Snapshot, table_path
from martloom.sources.staging import staging_root

R, I = "source_restaurant_id", "source_menu_item_id"
LAST_YEAR = 2000
SPLITS = SplitDates("2000-06-30", "2000-12-31", "2001-03-31")
_SPLITS = (SPLITS.train_end, SPLITS.validation_end, SPLITS.test_end)
PANEL = {"1999-06-30": "TRAIN", "1999-12-31": "TRAIN", "2000-06-30": "VALIDATION", "2000-12-31": "TEST"}
SCENARIOS = [advice.Scenario("cheaper", -10.0), advice.Scenario("dearer", 5.0, 0.0, 20.0)]

# how the star's numbers become contract identifiers: prefix and digits
FORMS = {
    "customers": ("CUST", 8),
    "restaurants": ("REST", 4),
    "menu_items": ("DISH", 4),
    "promotions": ("PROMO", 4),
    "orders": ("ORD", 8),
    "order_items": ("ITEM", 8),
    "ratings": ("RAT", 8),
    "wastage": ("WASTE", 8),
}


def _folder(df: DataFrame, label: str) -> str:
    return f"{staging_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def identifier_checks(snap: Snapshot) -> DataFrame:
    """Keys in the contract's form against its patterns; every 13th lacks its prefix, every 17th is NULL."""
    parts = []
    for entity, (prefix, digits) in FORMS.items():
        key, pattern = profile.identifier_pattern(entity)
        number = F.col(key).cast("long")
        name = F.when(number % 13 == 0, F.format_string(f"%0{digits}d", number)).when(
            number % 17 != 0, F.format_string(f"{prefix}-%0{digits}d", number)
        )
        rows = getattr(snap, entity).select(name.alias(key))
        parts.append(profile.validate_identifiers(rows, key, pattern).withColumn("table_name", F.lit(entity)))
    return _together(parts)


def _spoilt(snap: Snapshot) -> dict[str, DataFrame]:
    """All tables with rules, each with some rows made to break them."""

    def worse(df: DataFrame, column: str, key: str, step: int, value: object) -> DataFrame:
        kind = df.schema[column].dataType
        return df.withColumn(column, F.when(F.col(key) % step == 0, F.lit(value).cast(kind)).otherwise(F.col(column)))

    order, item = "source_order_id", "source_menu_item_id"
    return {
        "customers": worse(snap.customers, "loyalty_tier", KEYS["customers"], 10, "Diamond"),
        "restaurants": worse(snap.restaurants, "seating_capacity", R, 4, 0),
        "menu_categories": snap.menu_categories,
        "menu_items": worse(worse(snap.menu_items, "current_base_price", item, 9, -1.0), "spiciness_level", item, 8, 5),
        "pricing_history": snap.pricing_history.withColumn(
            "effective_to", F.when(F.col(item) % 3 == 0, F.col("effective_from")).otherwise(F.col("effective_to"))
        ),
        "promotions": worse(snap.promotions, "discount_value", "source_promotion_id", 2, -5.0),
        "orders": worse(snap.orders, "total_amount", order, 21, -0.01),
        "inventory": worse(snap.inventory, "current_stock_quantity", KEYS["inventory"], 6, -2.0),
        "wastage": worse(snap.wastage, "cost_loss_amount", KEYS["wastage"], 5, -1.0),
    }


def entity_constraints(snap: Snapshot) -> DataFrame:
    """Violations of every rule of every table that has rules."""
    return _together(
        [
            quarantine.rule_violations(df, quarantine.constraint_rules(name)).withColumn("table_name", F.lit(name))
            for name, df in _spoilt(snap).items()
        ]
    )


def schema_checks(snap: Snapshot) -> DataFrame:
    """Orders by the contract but for a missing, an extra and a mistyped column, and NULLs."""
    declared = {f.name: f.dataType for f in table_schema("orders").fields}
    rows = snap.orders.select(*[F.col(c).cast(t).alias(c) for c, t in declared.items() if c != "tip_amount"])
    rows = rows.withColumns(
        {
            "tax_amount": F.col("tax_amount").cast("string"),
            "order_status": F.when(F.col("source_order_id").cast("long") % 7 != 0, F.col("order_status")),
            "table_number": F.lit(1),
        }
    )
    return profile.validate_schema("orders", rows)


def stored_quarantine(snap: Snapshot) -> DataFrame:
    """A whole cleaning run: the reasons in the quarantine files of the orders."""
    root = _folder(snap.orders, "cleaning")
    runner.run_cleaning(snap, f"{root}/clean", f"{root}/quarantine", LAST_YEAR)
    stored = read_mart(snap.orders.sparkSession, table_path(f"{root}/quarantine", "orders_quarantine"))
    stamped = stored.where(F.col("quarantined_at").isNotNull())
    return stamped.groupBy("quarantine_reason").agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("orders").alias("table_name"), "quarantine_reason", "row_count"
    )


def comparison_sample(snap: Snapshot) -> DataFrame:
    """The first hundred compared forecasts by key."""
    weekly = features.weekly_demand_features(demand.demand_historical(snap, DemandRules(splits=SPLITS)))

    def forecast(column: str) -> DataFrame:
        return weekly.select(
            *compare.DEMAND_KEYS,
            F.col("weekly_quantity").cast("double").alias("actual_quantity"),
            F.round(F.col(column), 2).alias("predicted_quantity"),
            F.lit(0.0).alias("absolute_error"),
            split_label("week_start_date", SPLITS).alias("split"),
        )

    compared = compare.compare_regression(forecast("lag_1w_quantity"), forecast("lag_1w_revenue"), split=None)
    return serving.comparison_sample(compared, compare.DEMAND_KEYS).select(
        F.col("week_start_date").cast("string").alias("week_start_date"), "menu_item_id", "restaurant_id", "actual_quantity"
    )


def _close(a: Column, b: Column, within: float) -> Column:
    return F.coalesce(F.max(F.abs(a - b)), F.lit(0.0)) <= within


def model_run(snap: Snapshot) -> DataFrame:
    """Train all four tasks in one call, store them, and judge what is read back.

    Per task and split: predictions, the sum of what was to be predicted, and whether the
    stored errors and labels follow from the stored predictions. `champions` are counted in
    the stored metadata and looked up for the task's summary.
    """
    spark, out = snap.orders.sparkSession, _folder(snap.orders, "models")
    rfm = features.churn_features(customers.customer_rfm(snap))
    weekly = features.weekly_demand_features(demand.demand_historical(snap, DemandRules(splits=SPLITS)))
    wasted = features.waste_features(waste.wastage(snap))
    panel = features.churn_panel(snap.orders, PANEL)
    status, rows, errors = ml_runner.run_all(spark, weekly, wasted, panel, rfm, out, SPLITS)
    if errors:
        raise RuntimeError(str(errors))
    stored = {task: read_mart(spark, ml_runner.prediction_path(out, task)) for task in rows}
    count = F.count(F.lit(1)).alias("predictions")
    gap = F.col("actual_quantity") - F.col("predicted_quantity")
    parts = [
        stored["demand"]
        .groupBy("split")
        .agg(count, F.sum("actual_quantity").alias("actual"), _close(F.abs(gap), F.col("absolute_error"), 0.011).alias("consistent"))
        .withColumn("task", F.lit("demand"))
    ]
    for task, score in (("wastage_risk", "risk_probability"), ("churn", "churn_probability")):
        # a stored label is 1 where its rounded probability exceeds one half
        label = (F.col(score) > 0.5).cast("int")
        near = F.abs(F.col(score) - 0.5) < 0.0001
        follows = F.coalesce(F.max(F.when(~near, F.abs(label - F.col("predicted_label")))), F.lit(0)) == 0
        parts.append(
            stored[task]
            .groupBy("split")
            .agg(count, F.sum("actual_label").cast("double").alias("actual"), follows.alias("consistent"))
            .withColumn("task", F.lit(task))
        )
    named = F.count_if(F.col("segment_label").isNull() | F.col("cluster_id").isNull()) == 0
    parts.append(
        stored["segmentation"]
        .agg(count, money_sum("monetary_total").alias("actual"), named.alias("consistent"))
        .withColumns({"task": F.lit("segmentation"), "split": F.lit("ALL")})
    )
    metadata = ml_runner.read_metadata(spark, out)
    summary = compare.with_champions(_together(parts), metadata)
    known = metadata.select("task", "algorithm").distinct().withColumnsRenamed({"task": "task_", "algorithm": "algorithm_"})
    joined = summary.join(known, (F.col("task") == F.col("task_")) & (F.col("champion") == F.col("algorithm_")), "left")
    return joined.select(
        "task", "split", "predictions", F.round("actual", 2).alias("actual"), "consistent",
        F.col("algorithm_").isNotNull().alias("has_champion"), F.lit(status).alias("status"),
    )


def what_if_stored(snap: Snapshot) -> DataFrame:
    """What-if estimates from stored marts, of which only the columns in use are read."""
    spark, root = snap.orders.sparkSession, _folder(snap.orders, "marts")
    write_mart(menu.menu_performance(snap, False), table_path(root, "menu"))
    write_mart(pricing.pricing(snap), table_path(root, "pricing"))
    return advice.what_if(*advice.stored_inputs(spark, table_path(root, "menu"), table_path(root, "pricing")), SCENARIOS)


def governance() -> dict[str, tuple[Callable[[Snapshot], DataFrame], str]]:
    """Builders over the snapshot and the kind of item each takes."""
    return {
        "identifier_checks": (identifier_checks, "part"),
        "entity_constraints": (entity_constraints, "part"),
        "schema_checks": (schema_checks, "part"),
        "stored_quarantine": (stored_quarantine, "part"),
        "comparison_sample": (comparison_sample, "brand"),
        "model_run": (model_run, "brand"),
        "what_if_stored": (what_if_stored, "brand"),
    }


def _identifiers_sql() -> str:
    keys = {
        "customers": ("c_custkey", "customer"),
        "restaurants": ("n_nationkey", "nation"),
        "menu_items": ("p_partkey", "part"),
        "promotions": ("DISTINCT CAST(round(l_discount * 100) AS INTEGER)", "lineitem WHERE round(l_discount * 100) >= 5"),
        "orders": ("o_orderkey", "orders"),
        "order_items": ("l_orderkey * 10 + l_linenumber", "lineitem"),
        "ratings": ("l_orderkey * 10 + l_linenumber", "lineitem WHERE l_returnflag = 'A'"),
        "wastage": ("l_orderkey * 10 + l_linenumber", "lineitem WHERE l_returnflag = 'R'"),
    }
    return " UNION ALL ".join(
        f"SELECT '{entity}' AS table_name, COUNT(*) AS rows_checked, "
        f"COUNT(*) FILTER (k % 13 = 0 OR k % 17 = 0 OR k >= {10 ** FORMS[entity][1]}) AS invalid_ids FROM (SELECT {key} AS k FROM {source})"
        for entity, (key, source) in keys.items()
    )


def _constraints_sql() -> str:
    def count(table: str, rule: str, condition: str, source: str) -> str:
        return f"SELECT '{table}' AS table_name, '{rule}' AS rule, COUNT(*) FILTER ({condition}) AS violations FROM {source}"

    lines, waste_rows = "lines", "d_waste"
    none = "false"
    rules = [
        ("customers", "INVALID_LOYALTY_TIER", "c_custkey % 10 = 0", "customer"),
        ("restaurants", "INVALID_DINING_TYPE", none, "d_restaurants"),
        ("restaurants", "INVALID_SEATING_CAPACITY", f"{R} % 4 = 0", "d_restaurants"),
        ("menu_categories", "INVALID_CATEGORY_NAME", "true", "(SELECT DISTINCT p_type FROM part)"),
        ("menu_items", "INVALID_SPICINESS_LEVEL", f"{I} % 8 = 0", "d_menu"),
        ("menu_items", "INVALID_BASE_PRICE", f"{I} % 9 = 0", "d_menu"),
        ("menu_items", "INVALID_BASE_COST", none, "d_menu"),
        ("pricing_history", "INVALID_INTERVAL", f"{I} % 3 = 0 OR effective_to <= effective_from", "d_prices"),
        ("promotions", "INVALID_DISCOUNT_TYPE", none, "d_promotions"),
        ("promotions", "INVALID_DISCOUNT_VALUE", "source_promotion_id % 2 = 0", "d_promotions"),
        ("promotions", "INVALID_INTERVAL", "end_date < start_date", "d_promotions"),
        ("orders", "INVALID_ORDER_CHANNEL", "order_channel NOT IN ('Dine-in', 'Takeaway', 'Delivery Direct', 'Delivery Aggregator')", "d_orders"),
        ("orders", "INVALID_ORDER_STATUS", none, "d_orders"),
        ("orders", "INVALID_PAYMENT_METHOD", none, "d_orders"),
        ("orders", "INVALID_TOTAL_AMOUNT", "source_order_id % 21 = 0 OR total_amount < 0", "d_orders"),
        ("inventory", "INVALID_INGREDIENT_CATEGORY", none, "d_inventory"),
        ("inventory", "INVALID_UNIT_OF_MEASURE", none, "d_inventory"),
        ("inventory", "INVALID_STOCK_QUANTITY", f"({R} * 100 + CAST(substring(ingredient_name, 5) AS INTEGER)) % 6 = 0", "d_inventory"),
        ("inventory", "INVALID_PURCHASE_COST", none, "d_inventory"),
        ("wastage", "INVALID_UNIT_OF_MEASURE", none, waste_rows),
        ("wastage", "INVALID_WASTAGE_REASON", none, waste_rows),
        ("wastage", "INVALID_COST_LOSS", "(l_orderkey * 10 + l_linenumber) % 5 = 0", f"{lines} WHERE l_returnflag = 'R'"),
        ("wastage", "INVALID_WASTE_QUANTITY", "quantity_lost <= 0", waste_rows),
    ]
    domain = with_domain("orders", "waste", "inventory", "promotions", "prices", "menu", "restaurants")
    return domain + " " + " UNION ALL ".join(count(*r) for r in rules)


def _run_sql() -> str:
    a, b, c = (f"DATE '{d}'" for d in _SPLITS)

    def split(week: str) -> str:
        return (
            f"CASE WHEN {week} <= {a} THEN 'TRAIN' WHEN {week} <= {b} THEN 'VALIDATION' "
            f"WHEN {week} <= {c} THEN 'TEST' ELSE 'UNSEEN_COMPARISON' END"
        )

    week = split("CAST(week_start_date AS DATE)")
    return f"""
SELECT task, split, n AS predictions, CAST(round(actual, 2) AS DOUBLE) AS actual, TRUE AS consistent, TRUE AS has_champion,
  'SUCCESS' AS status FROM (
  SELECT 'demand' AS task, {week} AS split, COUNT(*) AS n, CAST(SUM(weekly_quantity) AS DOUBLE) AS actual
  FROM ({serving_sql.weekly_demand_features(_SPLITS)}) GROUP BY 2
  UNION ALL SELECT 'wastage_risk', {week}, COUNT(*), CAST(SUM(next_week_wastage_risk) AS DOUBLE)
  FROM ({serving_sql.waste_features()}) GROUP BY 2
  UNION ALL SELECT 'churn', split, COUNT(*), CAST(SUM(churn_label) AS DOUBLE) FROM ({serving_sql.churn_panel(PANEL)}) GROUP BY 2
  UNION ALL SELECT 'segmentation', 'ALL', COUNT(*), CAST(SUM(CAST(monetary_total AS DECIMAL(18, 2))) AS DOUBLE)
  FROM ({serving_sql.churn_features()}))"""


def governance_oracles() -> dict[str, str]:
    return {
        "identifier_checks": _identifiers_sql(),
        "entity_constraints": _constraints_sql(),
        "schema_checks": """
SELECT * FROM (VALUES ('tip_amount', 'MISSING_FIELD', 'expected double'), ('tax_amount', 'TYPE_MISMATCH', 'expected double, found string'),
  ('table_number', 'UNEXPECTED_FIELD', 'not in the contract')) t(column_name, defect, detail)
UNION ALL SELECT 'order_status', 'NULL_IN_REQUIRED_FIELD', COUNT(*) || ' nulls' FROM orders WHERE o_orderkey % 7 = 0 HAVING COUNT(*) > 0""",
        "stored_quarantine": quarantine_orders(),
        "comparison_sample": f"""
SELECT {text("week_start_date")} AS week_start_date, menu_item_id, restaurant_id, CAST(weekly_quantity AS DOUBLE) AS actual_quantity
FROM ({serving_sql.weekly_demand_features(_SPLITS)}) ORDER BY week_start_date, menu_item_id, restaurant_id LIMIT 100""",
        "model_run": _run_sql(),
        "what_if_stored": serving_sql.serving_oracles(_SPLITS, SCENARIOS)["what_if_grid"],
    }
