"""Further operators as queries: loading, sinks, rules, hard inputs, and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.catalog.domain_sql import fixed, money, text, with_domain
from martloom.catalog.mart_sql import channel_performance as channel_sql
from martloom.catalog.mart_sql import customer_rfm_ctes
from martloom.catalog.serving_sql import churn_features, churn_panel
from martloom.config import ScaleRules
from martloom.functions import contracts
from martloom.functions.numeric import finite, money_sum
from martloom.operators import joins, profile, quarantine, ranking
from martloom.plans import compare, customers, features, ml_runner, models, operations, serving
from martloom.sources import sinks
from martloom.sources.schemas import TABLES, table_schema
from martloom.sources.snapshot import Snapshot, completeness, table_path
from martloom.sources.staging import staging_root

R, I, C = "source_restaurant_id", "source_menu_item_id", "source_customer_id"
LAST_YEAR = 2000
CHAMPION_CUTOFFS = {"1999-06-30": "TRAIN", "2000-06-30": "VALIDATION", "2000-12-31": "TEST"}
SPREAD = ScaleRules(one_task_rows=0, small_basket=3, block_items=3)


def _folder(df: DataFrame, label: str) -> str:
    return f"{staging_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"


def _contract(name: str, df: DataFrame) -> DataFrame:
    """A table with the declared columns and types; columns it lacks are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table_schema(name).fields
        ]
    )


def loaded_tables(snap: Snapshot) -> DataFrame:
    """Write every table, check that all are there, and load them by their schemas."""
    root = _folder(snap.orders, "raw")
    for name, df in snap.tables().items():
        _contract(name, df).write.parquet(table_path(root, name))
    spark = snap.orders.sparkSession
    found = completeness(spark, root)
    loaded = Snapshot.load(spark, root)
    out = None
    for name in TABLES:
        row = getattr(loaded, name).agg(F.count(F.lit(1)).alias("row_count"))
        row = row.select(F.lit(name).alias("table_name"), "row_count", F.lit(found[name]).alias("present"))
        out = row if out is None else out.unionByName(row)
    return out


def exported_rows(snap: Snapshot) -> DataFrame:
    """A stored mart's metadata, and the rows of its full export read back."""
    mart = operations.channel_performance(snap)
    spark, root = mart.sparkSession, _folder(mart, "export")
    written = sinks.write_mart(mart, table_path(root, "mart"), ["order_month"])
    about = sinks.mart_metadata(spark, table_path(root, "mart"))
    there = sinks.available_marts(spark, root, ["mart", "other"])
    sinks.export_csv(mart, f"{root}/csv")
    exported = spark.read.option("header", True).csv(f"{root}/csv")
    return exported.agg(F.count(F.lit(1)).alias("exported_rows")).select(
        "exported_rows",
        F.lit(written).cast("long").alias("written_rows"),
        F.lit(about["rows"]).cast("long").alias("stored_rows"),
        F.lit(about["columns"] - len(mart.columns)).cast("long").alias("extra_columns"),
        F.lit(there["mart"] and not there["other"]).alias("available"),
    )


def interval_rules(snap: Snapshot) -> DataFrame:
    """The dated rules of price versions, promotions and waste, on rows made to break them."""
    broken = {
        "pricing_history": snap.pricing_history.withColumn(
            "effective_to",
            F.when(F.col(I) % 7 == 0, F.col("effective_from")).otherwise(F.col("effective_to")),
        ),
        "promotions": snap.promotions.withColumn(
            "end_date",
            F.when(F.col("source_promotion_id") % 2 == 0, F.date_sub("start_date", 1)).otherwise(F.col("end_date")),
        ),
        "wastage": snap.wastage.withColumn(
            "quantity_lost", F.col("quantity_lost") - F.when(F.col(R) == 3, 2.0).otherwise(0.0)
        ),
    }
    out = None
    for name, rules in quarantine.chronology_rules().items():
        found = quarantine.rule_violations(broken[name], rules).withColumn("table_name", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def orphans_without_parents(snap: Snapshot) -> DataFrame:
    """Orders and lines whose parent is NULL, and repeated rows without a key."""
    order, item = "source_order_id", "source_order_item_id"

    def without(column: str, base: str, step: int):
        return F.when(F.col(base) % step != 0, F.col(column))

    orders = snap.orders.select(
        without(order, order, 500).alias(order),
        without(R, order, 7).alias(R),
        C,
        "order_timestamp",
    )
    lines = snap.order_items.select(
        item,
        without(order, item, 6).alias(order),
        without(I, item, 5).alias(I),
        "quantity",
        "unit_price_at_sale",
        "created_at",
    )
    changed = snap.with_tables(orders=orders, order_items=lines)
    judged = quarantine.clean_orders(changed, LAST_YEAR)
    items = quarantine.clean_order_items(changed, snap.orders)
    return quarantine.reason_counts({"orders": judged.quarantined, "order_items": items.quarantined})


def inverted_promotions(snap: Snapshot) -> DataFrame:
    """Promotions that end before they start match nothing; an open end matches all after it."""
    turned = F.col("source_promotion_id") % 2 == 0
    offers = snap.promotions.withColumns(
        {
            "start_date": F.when(turned, F.col("end_date")).otherwise(F.col("start_date")),
            "end_date": F.when(turned, F.col("start_date")).otherwise(F.lit("9999-12-31").cast("date")),
        }
    )
    facts = snap.order_items.select(
        "source_order_id", I, "quantity", F.col("unit_price_at_sale").alias("unit_price"), F.lit(1).alias("offer")
    ).join(snap.orders.select("source_order_id", "order_timestamp", "order_channel"), "source_order_id")
    matched = joins.match_promotion(facts, offers, date="order_timestamp")
    return matched.groupBy("source_promotion_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("offer").alias("offers")
    )


def null_positions(scale: ScaleRules) -> Callable[[Snapshot], DataFrame]:
    """Global positions and percent ranks of a column with NULLs and many ties."""

    def build(snap: Snapshot) -> DataFrame:
        key = F.col("source_order_id")
        rows = snap.orders.select(
            "source_order_id",
            F.when(key % 3 != 0, key % 1000).alias("value"),
        )
        placed, _ = ranking.row_positions(
            rows, {"rising": ("value", True), "falling": ("value", False)}, "source_order_id", scale
        )
        ranked = ranking.percent_ranks(placed, {"share": "value"}, ["source_order_id"], scale)
        return ranked.select(
            "source_order_id",
            F.col("rising").cast("long").alias("rising"),
            F.col("falling").cast("long").alias("falling"),
            F.round("share", 9).alias("share"),
        )

    return build


def line_formulas(snap: Snapshot) -> DataFrame:
    """Net revenue, margin and order total by the contract formulas."""
    net = contracts.line_net_revenue("quantity", "unit_price_at_sale", "line_discount")
    margin = contracts.line_contribution_margin("net", "quantity", "unit_cost_at_sale")
    lines = snap.order_items.withColumn("net", net).withColumn("margin", margin)
    by_order = lines.groupBy("source_order_id").agg(money_sum("net").alias("net"), money_sum("margin").alias("margin"))
    total = contracts.order_total("subtotal_amount", "discount_amount", "tax_amount", "tip_amount")
    joined = snap.orders.join(by_order, "source_order_id").withColumn("total", total)
    return joined.groupBy("order_channel", "order_status").agg(
        money_sum("net").alias("net"), money_sum("margin").alias("margin"), money_sum("total").alias("total")
    )


def finite_values(snap: Snapshot) -> DataFrame:
    """Divisions by zero and zero by zero become NULL, the rest stays."""
    part = (F.col("quantity") % 3).cast("double")
    value = F.try_divide(part, (F.col("quantity") % 2).cast("double"))
    value = F.when(F.col("quantity") % 2 == 0, F.when(part == 0, float("nan")).otherwise(float("inf"))).otherwise(value)
    kept = finite(value)
    return snap.order_items.groupBy("quantity").agg(
        F.count(F.lit(1)).alias("row_count"), F.count(kept).alias("finite_count"), money_sum(kept).alias("total")
    )


def metric_gaps(snap: Snapshot) -> DataFrame:
    """Two payment methods as two runs: their metrics side by side."""
    done = F.avg((F.col("order_status") == "Completed").cast("double"))
    rows = snap.orders.groupBy(F.col("payment_method").alias("name")).agg(
        F.count(F.lit(1)).cast("double").alias("orders"), F.round(done, 6).alias("f1")
    )
    long = rows.select("name", F.lit("orders").alias("metric"), F.col("orders").alias("value")).unionByName(
        rows.select("name", F.lit("f1").alias("metric"), F.col("f1").alias("value"))
    )
    gaps = compare.metric_differences(
        long.withColumn("name", F.regexp_replace(F.lower("name"), " ", "_")), "cash", "credit_card"
    )
    return gaps.select("metric", "cash_value", "credit_card_value", "difference", "agreement")


def enriched_customers(snap: Snapshot) -> DataFrame:
    """The customer page with a churn score and a segment per customer."""
    rfm = customers.customer_rfm(snap)
    gone = F.round(F.col("recency_days") / (F.col("recency_days") + 100), 4)
    scores = rfm.filter(F.col(C) % 3 != 0).select(
        F.col(C).alias("customer_id"),
        gone.alias("churn_probability"),
        (F.col("recency_days") > 100).cast("int").alias("predicted_label"),
    )
    segments = rfm.filter(F.col(C) % 4 != 0).select(
        F.col(C).alias("customer_id"), F.concat(F.lit("S"), F.col("f_score")).alias("segment_label")
    )
    rows = serving.customers_enriched(rfm, scores, segments)
    found = serving.customer_search(rows, "At Risk", "customer")
    shown = [C, "customer_name", "monetary_value", "churn_probability", "churn_label", "ml_segment"]
    return serving.page(found, [F.desc("monetary_value"), C], 0, 200).select(*shown)


def stored_champions(snap: Snapshot) -> DataFrame:
    """Train two tasks, store them, and read champions and prediction counts back.

    The rows of a task's predictions are those of its features: none is skipped.
    """
    spark, out = snap.orders.sparkSession, _folder(snap.orders, "models")
    rfm = features.churn_features(customers.customer_rfm(snap))
    panel = features.churn_panel(snap.orders, CHAMPION_CUTOFFS)
    tasks = {
        "segmentation": lambda: models.segment_contest(rfm),
        "churn": lambda: models.churn_contest(panel),
    }
    status, _, errors = ml_runner.run_models(spark, tasks, out)
    if errors:
        raise RuntimeError(str(errors))
    metadata = ml_runner.read_metadata(spark, out)
    parts = []
    for task, source in (("segmentation", rfm), ("churn", panel)):
        stored = spark.read.parquet(ml_runner.prediction_path(out, task))
        winner = serving.champion(metadata, task).agg(F.count("algorithm").alias("champions"))
        counts = stored.agg(F.count(F.lit(1)).alias("predictions")).withColumns(
            {
                "task": F.lit(task),
                "status": F.lit(status),
                "rows": source.agg(F.count(F.lit(1))).scalar(),
                "champions": winner.scalar(),
            }
        )
        parts.append(counts)
    return parts[0].unionByName(parts[1]).select("task", "status", "rows", "predictions", "champions")


def checks() -> dict[str, tuple[Callable[[Snapshot], DataFrame], str]]:
    """Builders over the snapshot and the kind of item each takes."""
    return {
        "loaded_tables": (loaded_tables, "part"),
        "exported_rows": (exported_rows, "part"),
        "interval_rules": (interval_rules, "part"),
        "orphans_without_parents": (orphans_without_parents, "part"),
        "inverted_promotions": (inverted_promotions, "brand"),
        "null_positions": (null_positions(ScaleRules()), "part"),
        "null_positions_spread": (null_positions(SPREAD), "part"),
        "line_formulas": (line_formulas, "part"),
        "finite_values": (finite_values, "part"),
        "metric_gaps": (metric_gaps, "part"),
        "enriched_customers": (enriched_customers, "part"),
        "stored_champions": (stored_champions, "part"),
    }


def _loaded_sql() -> str:
    sources = {
        "customers": "customer",
        "restaurants": "nation",
        "menu_categories": "(SELECT DISTINCT p_type FROM part)",
        "menu_items": "part",
        "pricing_history": "d_prices",
        "promotions": "d_promotions",
        "orders": "orders",
        "order_items": "lineitem",
        "ratings": "d_ratings",
        "inventory": "d_inventory",
        "wastage": "d_waste",
    }
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, COUNT(*) AS row_count, true AS present FROM {source}"
        for name, source in sources.items()
    )
    return with_domain("ratings", "waste", "inventory", "promotions", "prices") + " " + rows


def _positions_sql() -> str:
    return f"""
WITH r AS (
  SELECT o_orderkey AS source_order_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 1000 END AS value FROM orders)
SELECT source_order_id,
  row_number() OVER (ORDER BY value NULLS FIRST, source_order_id) AS rising,
  row_number() OVER (ORDER BY value DESC NULLS LAST, source_order_id) AS falling,
  round(percent_rank() OVER (ORDER BY value NULLS FIRST), 9) AS share
FROM r"""


def check_oracles() -> dict[str, str]:
    count = lambda cond: f"COUNT(CASE WHEN {cond} THEN 1 END)"
    cents = lambda expr: money(f"CAST(SUM(CAST(round({expr} * 100) AS BIGINT)) AS BIGINT) / 100.0")
    return {
        "loaded_tables": _loaded_sql(),
        "exported_rows": f"""
SELECT n AS exported_rows, n AS written_rows, n AS stored_rows, CAST(0 AS BIGINT) AS extra_columns, true AS available
FROM (SELECT COUNT(*) AS n FROM ({channel_sql()}))""",
        "interval_rules": with_domain("prices", "promotions", "waste")
        + f"""
SELECT 'INVALID_INTERVAL' AS rule, {count("effective_to <= effective_from OR " + I + " % 7 = 0")} AS violations,
  'pricing_history' AS table_name FROM d_prices
UNION ALL SELECT 'INVALID_INTERVAL', {count("source_promotion_id % 2 = 0")}, 'promotions' FROM d_promotions
UNION ALL SELECT 'INVALID_WASTE_QUANTITY', {count("quantity_lost - CASE WHEN " + R + " = 3 THEN 2 ELSE 0 END <= 0")},
  'wastage' FROM d_waste""",
        "orphans_without_parents": with_domain("orders", "items")
        + f""",
o AS (
  SELECT CASE WHEN source_order_id % 500 <> 0 THEN source_order_id END AS k, order_timestamp,
    CASE WHEN year(order_timestamp) > {LAST_YEAR} THEN 'FUTURE_TIMESTAMP'
      WHEN source_order_id % 7 = 0 THEN 'ORPHANED_RESTAURANT_ID' END AS defect,
    row_number() OVER (PARTITION BY CASE WHEN source_order_id % 500 <> 0 THEN source_order_id END
      ORDER BY order_timestamp, CASE WHEN source_order_id % 7 <> 0 THEN {R} END NULLS FIRST, {C} NULLS FIRST) AS place
  FROM d_orders),
j AS (
  SELECT CASE WHEN place > MIN(CASE WHEN defect IS NULL THEN place END) OVER (PARTITION BY k)
    THEN 'DUPLICATE_ORDER_ID' ELSE defect END AS reason FROM o),
i AS (
  SELECT CASE WHEN unit_price_at_sale < 0 THEN 'INVALID_NEGATIVE_PRICE' WHEN quantity <= 0 THEN 'INVALID_ZERO_QUANTITY'
    WHEN source_order_item_id % 6 = 0 THEN 'ORPHANED_ORDER_PARENT'
    WHEN source_order_item_id % 5 = 0 THEN 'ORPHANED_MENU_ITEM' END AS defect,
    source_order_item_id AS k, row_number() OVER (PARTITION BY source_order_item_id ORDER BY created_at,
      CASE WHEN source_order_item_id % 6 <> 0 THEN source_order_id END, {I}, quantity, unit_price_at_sale) AS place
  FROM d_items),
ji AS (
  SELECT CASE WHEN place > MIN(CASE WHEN defect IS NULL THEN place END) OVER (PARTITION BY k)
    THEN 'DUPLICATE_ORDER_ITEM_ID' ELSE defect END AS reason FROM i)
SELECT 'orders' AS table_name, reason AS quarantine_reason, COUNT(*) AS row_count FROM j WHERE reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'order_items', reason, COUNT(*) FROM ji WHERE reason IS NOT NULL GROUP BY 2""",
        "inverted_promotions": with_domain("items", "orders", "promotions", item="brand")
        + f""",
p AS (
  SELECT source_promotion_id, {I}, applicable_channel, start_date FROM d_promotions WHERE source_promotion_id % 2 = 1),
f AS (
  SELECT i.{I}, order_channel, order_date, ROW_NUMBER() OVER () AS n
  FROM d_items i JOIN d_orders o ON i.source_order_id = o.source_order_id),
m AS (
  SELECT f.n, MIN(source_promotion_id) AS pid FROM f JOIN p
    ON order_date >= start_date AND (p.{I} = f.{I} OR applicable_channel = order_channel) GROUP BY 1)
SELECT pid AS source_promotion_id, COUNT(*) AS row_count, COUNT(*) AS offers
FROM f LEFT JOIN m ON f.n = m.n GROUP BY 1""",
        "null_positions": _positions_sql(),
        "null_positions_spread": _positions_sql(),
        "line_formulas": with_domain("items", "orders")
        + f""",
l AS (
  SELECT source_order_id, SUM(line_net_revenue) AS net, SUM(line_contribution_margin) AS margin FROM d_items GROUP BY 1)
SELECT order_channel, order_status, {cents("net")} AS net, {cents("margin")} AS margin, {cents("total_amount")} AS total
FROM d_orders o JOIN l ON o.source_order_id = l.source_order_id GROUP BY 1, 2""",
        "finite_values": with_domain("items")
        + """
SELECT quantity, COUNT(*) AS row_count, CASE WHEN quantity % 2 = 0 THEN 0 ELSE COUNT(*) END AS finite_count,
  CASE WHEN quantity % 2 = 1 THEN CAST(COUNT(*) * (quantity % 3) AS DOUBLE) END AS total
FROM d_items GROUP BY quantity""",
        "metric_gaps": with_domain("orders")
        + f""",
r AS (
  SELECT CAST(COUNT(CASE WHEN payment_method = 'Cash' THEN 1 END) AS DOUBLE) AS a,
    CAST(COUNT(CASE WHEN payment_method = 'Credit Card' THEN 1 END) AS DOUBLE) AS b,
    round(AVG(CASE WHEN payment_method = 'Cash' THEN CASE WHEN order_status = 'Completed' THEN 1.0 ELSE 0.0 END END), 6) AS c,
    round(AVG(CASE WHEN payment_method = 'Credit Card' THEN CASE WHEN order_status = 'Completed' THEN 1.0 ELSE 0.0 END END), 6) AS d
  FROM d_orders)
SELECT 'orders' AS metric, a AS cash_value, b AS credit_card_value, a - b AS difference, CAST(NULL AS DOUBLE) AS agreement FROM r
UNION ALL SELECT 'f1', c, d, {fixed("c - d", 6)}, {fixed("1.0 - abs(c - d)", 6)} FROM r""",
        "stored_champions": f"""
SELECT task, 'SUCCESS' AS status, n AS rows, n AS predictions, CAST(1 AS BIGINT) AS champions FROM (
  SELECT 'segmentation' AS task, COUNT(*) AS n FROM ({churn_features()})
  UNION ALL SELECT 'churn', COUNT(*) FROM ({churn_panel(CHAMPION_CUTOFFS)}))""",
        "enriched_customers": with_domain("orders", "customers")
        + ","
        + customer_rfm_ctes()
        + f"""
SELECT {C}, customer_name, monetary_value,
  CASE WHEN {C} % 3 <> 0 THEN round(recency_days / (recency_days + 100.0), 4) END AS churn_probability,
  CASE WHEN {C} % 3 <> 0 THEN CAST(recency_days > 100 AS INTEGER) END AS churn_label,
  CASE WHEN {C} % 4 <> 0 THEN 'S' || {text("f_score")} END AS ml_segment
FROM rfm WHERE rfm_segment = 'At Risk' AND (lower(customer_name) LIKE '%customer%' OR {text(C)} LIKE '%customer%')
ORDER BY monetary_value DESC, {C} LIMIT 200""",
    }
