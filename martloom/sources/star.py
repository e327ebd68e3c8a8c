"""The source tables read off a star schema (orders, lineitem, part, customer, nation).

Keys keep their integer type. Derived amounts use whole-cent integer arithmetic, so
they are the same in every engine. `item` picks what plays the menu item: the part
itself or the part's brand, which is the coarser grain for baskets and prices.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martloom.sources.snapshot import Snapshot

RESTAURANTS = 25
WASTE_REASONS = (
    "Expired",
    "Over-preparation",
    "Cooking Error",
    "Equipment Failure",
    "Customer Returned",
    "Spillage",
)


_STAR_DDL = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
}


def read_star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One star table with its declared schema, so no job reads footers first."""
    return spark.read.schema(_STAR_DDL[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def star_lines(spark: SparkSession, sf_dir: str, item: str = "part") -> DataFrame:
    """lineitem with amounts in cents and the item key."""
    lines = read_star(spark, sf_dir, "lineitem")
    if item == "brand":
        brands = read_star(spark, sf_dir, "part").selectExpr(
            "p_partkey AS l_partkey", "CAST(substring(p_brand, 7) AS BIGINT) AS item"
        )
        lines = lines.join(brands, "l_partkey", "inner")
    else:
        lines = lines.withColumn("item", F.col("l_partkey"))
    return (
        lines.withColumns(
            {
                "ext": F.expr("CAST(rint(l_extendedprice * 100) AS BIGINT)"),
                "pct": F.expr("CAST(rint(l_discount * 100) AS INT)"),
                "qty": F.expr("CAST(l_quantity AS INT)"),
                "shipped": F.expr("CAST(l_shipdate AS TIMESTAMP)"),
            }
        )
        .withColumn("price", F.expr("ext div qty"))
        .withColumn("cost", F.expr("(price * (40 + l_partkey % 65)) div 100"))
        .withColumn("disc", F.expr("(ext * pct + 50) div 100"))
    )


def star_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read_star(spark, sf_dir, "orders")
        .withColumns(
            {
                "total": F.expr("CAST(rint(o_totalprice * 100) AS BIGINT)"),
                "placed": F.expr(
                    "timestampadd(HOUR, CAST(o_orderkey % 24 AS INT), CAST(o_orderdate AS TIMESTAMP))"
                ),
            }
        )
        .withColumn("disc", F.expr("(total * (o_orderkey % 5) + 50) div 100"))
        .withColumns(
            {
                "tax": F.expr(
                    "CASE WHEN o_orderstatus = 'F' THEN ((total - disc) * 825 + 5000) div 10000 ELSE 0 END"
                ),
                "tip": F.expr(
                    "CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') "
                    "THEN ((total - disc) * 15 + 50) div 100 ELSE 0 END"
                ),
            }
        )
        .selectExpr(
            "o_orderkey AS source_order_id",
            f"o_orderkey % {RESTAURANTS} AS source_restaurant_id",
            "CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS source_customer_id",
            "placed AS order_timestamp",
            "o_orderpriority AS order_channel",
            "CASE o_orderstatus WHEN 'P' THEN 'Voided' WHEN 'O' THEN 'Cancelled' "
            "ELSE 'Completed' END AS order_status",
            "total / 100.0D AS subtotal_amount",
            "disc / 100.0D AS discount_amount",
            "tax / 100.0D AS tax_amount",
            "tip / 100.0D AS tip_amount",
            "(total - disc + tax + tip) / 100.0D AS total_amount",
            "CASE o_orderkey % 3 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Credit Card' "
            "ELSE 'Debit Card' END AS payment_method",
            "placed AS created_at",
        )
    )


def _order_items(lines: DataFrame) -> DataFrame:
    return lines.selectExpr(
        "l_orderkey * 10 + l_linenumber AS source_order_item_id",
        "l_orderkey AS source_order_id",
        "item AS source_menu_item_id",
        "qty AS quantity",
        "price / 100.0D AS unit_price_at_sale",
        "cost / 100.0D AS unit_cost_at_sale",
        "disc / 100.0D AS line_discount",
        "CASE WHEN pct >= 5 THEN pct END AS source_promotion_id",
        "(price * qty - disc) / 100.0D AS line_net_revenue",
        "(price * qty - disc - cost * qty) / 100.0D AS line_contribution_margin",
        "CAST(NULL AS STRING) AS special_instructions",
        "shipped AS created_at",
    )


def _ratings(lines: DataFrame) -> DataFrame:
    score = "CAST(1 + qty % 5 AS INT)"
    return lines.filter("l_returnflag = 'A'").selectExpr(
        "l_orderkey * 10 + l_linenumber AS source_rating_id",
        f"l_orderkey % {RESTAURANTS} AS source_restaurant_id",
        "l_orderkey AS source_order_id",
        "CAST(NULL AS BIGINT) AS source_customer_id",
        "CASE WHEN l_tax > 0 THEN item END AS source_menu_item_id",
        f"{score} AS rating_score",
        f"{score} AS food_rating",
        f"{score} AS service_rating",
        f"{score} AS ambiance_rating",
        "CAST(NULL AS STRING) AS review_text",
        "shipped AS rating_timestamp",
        "TRUE AS is_verified_purchase",
        "shipped AS created_at",
    )


def _wastage(lines: DataFrame) -> DataFrame:
    reasons = ", ".join(f"'{r}'" for r in WASTE_REASONS)
    return lines.filter("l_returnflag = 'R'").selectExpr(
        "l_orderkey * 10 + l_linenumber AS source_wastage_id",
        f"l_orderkey % {RESTAURANTS} AS source_restaurant_id",
        "CASE WHEN l_linestatus = 'F' THEN item END AS source_menu_item_id",
        "CASE WHEN l_linestatus = 'O' THEN concat('ING-', l_suppkey % 40) END AS ingredient_name",
        "shipped AS wastage_timestamp",
        "(qty * 10) / 100.0D AS quantity_lost",
        "'kg' AS unit_of_measure",
        "(ext div 200) / 100.0D AS cost_loss_amount",
        f"element_at(array({reasons}), CAST(1 + l_linenumber % 6 AS INT)) AS wastage_reason",
        "CAST(NULL AS STRING) AS reported_by",
        "shipped AS created_at",
    )


def _inventory(lines: DataFrame) -> DataFrame:
    per_key = lines.groupBy(
        F.expr(f"l_orderkey % {RESTAURANTS}").alias("r"), F.expr("l_suppkey % 40").alias("g")
    ).agg(
        F.expr("SUM(CASE WHEN l_returnflag = 'N' THEN qty ELSE 0 END)").alias("stock"),
        F.expr("SUM(CASE WHEN l_returnflag = 'R' THEN qty ELSE 0 END)").alias("used"),
        F.expr("MAX(shipped)").alias("last_seen"),
    )
    return per_key.selectExpr(
        "r * 100 + g AS source_inventory_id",
        "r AS source_restaurant_id",
        "concat('ING-', g) AS ingredient_name",
        "CASE WHEN g % 2 = 0 THEN 'Produce' ELSE 'Dry Goods' END AS ingredient_category",
        "CAST(stock AS DOUBLE) AS current_stock_quantity",
        "'kg' AS unit_of_measure",
        "CAST(used AS DOUBLE) AS reorder_threshold",
        "CAST(used * 2 AS DOUBLE) AS reorder_quantity",
        "(100 + g) / 100.0D AS unit_purchase_cost",
        "CAST(last_seen AS DATE) AS last_restock_date",
        "last_seen AS created_at",
        "last_seen AS updated_at",
    )


def _promotions(lines: DataFrame) -> DataFrame:
    per_bucket = lines.filter("pct >= 5").groupBy("pct").agg(F.min("shipped").alias("first_day"))
    return per_bucket.selectExpr(
        "pct AS source_promotion_id",
        "concat('Discount ', pct) AS campaign_name",
        "CAST(NULL AS STRING) AS promo_code",
        "CASE WHEN pct % 2 = 0 THEN 'Percentage' ELSE 'Fixed Amount' END AS discount_type",
        "CAST(pct AS DOUBLE) AS discount_value",
        "date_add(CAST(first_day AS DATE), pct * 50) AS start_date",
        "date_add(CAST(first_day AS DATE), pct * 50 + 700) AS end_date",
        "0.0D AS minimum_order_amount",
        "CAST(NULL AS STRING) AS source_category_id",
        "CASE WHEN pct % 2 = 1 THEN CAST(pct AS BIGINT) END AS source_menu_item_id",
        "CASE pct WHEN 6 THEN '1-URGENT' WHEN 8 THEN '2-HIGH' WHEN 10 THEN '5-LOW' END "
        "AS applicable_channel",
        "TRUE AS is_active",
        "pct >= 9 AS is_misleading",
        "first_day AS created_at",
    )


def _pricing_history(lines: DataFrame) -> DataFrame:
    """One version per item and quarter; lengths vary, so versions overlap and leave gaps."""
    per_quarter = (
        lines.groupBy("item", F.expr("date_trunc('quarter', shipped)").alias("start"))
        .agg(
            F.expr("SUM(price) div COUNT(*)").alias("price"),
            F.expr("SUM(cost) div COUNT(*)").alias("cost"),
        )
        .withColumn("quarter", F.expr("(year(start) - 1990) * 4 + quarter(start)"))
        .withColumn("later", F.lead("start").over(Window.partitionBy("item").orderBy("start")))
    )
    return per_quarter.selectExpr(
        "item * 1000 + quarter AS source_pricing_history_id",
        "item AS source_menu_item_id",
        f"CASE WHEN quarter % 3 = 0 THEN item % {RESTAURANTS} END AS source_restaurant_id",
        "price / 100.0D AS base_price",
        "cost / 100.0D AS base_cost",
        "start AS effective_from",
        "CASE WHEN later IS NOT NULL THEN "
        "timestampadd(DAY, CAST(70 + (item * 13 + quarter) % 50 AS INT), start) END AS effective_to",
        "'Quarterly review' AS change_reason",
        "start AS created_at",
    )


def _menu_items(spark: SparkSession, sf_dir: str, item: str) -> DataFrame:
    part = read_star(spark, sf_dir, "part").withColumn(
        "retail", F.expr("CAST(rint(p_retailprice * 100) AS BIGINT)")
    )
    if item == "brand":
        rows = (
            part.groupBy("p_brand")
            .agg(
                F.expr("SUM(retail) div COUNT(*)").alias("retail"),
                F.min("p_type").alias("p_type"),
                F.min("p_size").alias("p_size"),
            )
            .selectExpr(
                "CAST(substring(p_brand, 7) AS BIGINT) AS item",
                "p_brand AS label",
                "p_type",
                "p_size",
                "retail",
            )
        )
    else:
        rows = part.selectExpr("p_partkey AS item", "p_name AS label", "p_type", "p_size", "retail")
    return rows.selectExpr(
        "item AS source_menu_item_id",
        "p_type AS source_category_id",
        "label AS item_name",
        "CAST(NULL AS STRING) AS description",
        "retail / 100.0D AS current_base_price",
        "((retail * 60) div 100) / 100.0D AS current_base_cost",
        "p_size AS prep_time_minutes",
        "item % 5 = 0 AS is_seasonal",
        "TRUE AS is_active",
        "CAST(p_size % 5 AS INT) AS spiciness_level",
        "CAST(NULL AS STRING) AS allergens",
        "TIMESTAMP '1994-01-01 00:00:00' AS created_at",
    )


def _menu_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = read_star(spark, sf_dir, "part").select("p_type").distinct()
    return kinds.selectExpr(
        "p_type AS source_category_id",
        "lower(p_type) AS category_name",
        "CAST(NULL AS STRING) AS description",
        "CAST(length(p_type) AS INT) AS display_order",
        "TRUE AS is_active",
        "TIMESTAMP '1994-01-01 00:00:00' AS created_at",
    )


def _restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_star(spark, sf_dir, "nation")
    region = read_star(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).selectExpr(
        "CAST(n_nationkey AS BIGINT) AS source_restaurant_id",
        "concat('Branch ', n_name) AS location_name",
        "n_name AS city",
        "r_name AS state_region",
        "CAST(n_nationkey AS STRING) AS postal_code",
        "CAST(40 + (n_nationkey * 7) % 60 AS INT) AS seating_capacity",
        "CASE n_nationkey % 3 WHEN 0 THEN 'Fast Casual' WHEN 1 THEN 'Casual Dining' "
        "ELSE 'Fine Dining' END AS dining_type",
        "CAST(NULL AS STRING) AS manager_name",
        "date_add(DATE '1990-01-01', CAST(n_nationkey * 30 AS INT)) AS opening_date",
        "CAST(NULL AS DOUBLE) AS latitude",
        "CAST(NULL AS DOUBLE) AS longitude",
        "TRUE AS is_active",
        "TIMESTAMP '1990-01-01 00:00:00' AS created_at",
    )


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_star(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS source_customer_id",
        "substring(c_name, 1, 8) AS first_name",
        "substring(c_name, 10) AS last_name",
        "CAST(NULL AS STRING) AS email",
        "CAST(NULL AS STRING) AS phone",
        "date_add(DATE '1994-01-01', CAST(c_custkey % 365 AS INT)) AS registration_date",
        "CASE WHEN c_acctbal < 0 THEN 'None' WHEN c_acctbal < 2000 THEN 'Bronze' "
        "WHEN c_acctbal < 5000 THEN 'Silver' WHEN c_acctbal < 8000 THEN 'Gold' "
        "ELSE 'Platinum' END AS loyalty_tier",
        "c_mktsegment AS preferred_channel",
        "concat('NATION_', c_nationkey) AS home_city",
        "TRUE AS is_active",
        "TIMESTAMP '1994-01-01 00:00:00' AS created_at",
    )


def star_snapshot(spark: SparkSession, sf_dir: str, item: str = "part") -> Snapshot:
    lines = cache(lambda: star_lines(spark, sf_dir, item))
    return Snapshot(
        {
            "customers": lambda: _customers(spark, sf_dir),
            "restaurants": lambda: _restaurants(spark, sf_dir),
            "menu_categories": lambda: _menu_categories(spark, sf_dir),
            "menu_items": lambda: _menu_items(spark, sf_dir, item),
            "pricing_history": lambda: _pricing_history(lines()),
            "promotions": lambda: _promotions(lines()),
            "orders": lambda: star_orders(spark, sf_dir),
            "order_items": lambda: _order_items(lines()),
            "ratings": lambda: _ratings(lines()),
            "inventory": lambda: _inventory(lines()),
            "wastage": lambda: _wastage(lines()),
        }
    )


def event_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as order headers: the event type plays the branch, the value the bill."""
    return read_star(spark, sf_dir, "events").selectExpr(
        "event_id AS source_order_id",
        "event_type AS source_restaurant_id",
        "user_id AS source_customer_id",
        "CAST(ts AS TIMESTAMP) AS order_timestamp",
        "'Dine-in' AS order_channel",
        "'Completed' AS order_status",
        "value AS total_amount",
    )


def event_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = read_star(spark, sf_dir, "events").select("event_type").distinct()
    return kinds.selectExpr(
        "event_type AS source_restaurant_id",
        "concat('Branch ', event_type) AS location_name",
        "event_type AS city",
        "'Fast Casual' AS dining_type",
        "CAST(20 + length(event_type) AS INT) AS seating_capacity",
    )


def stock_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock going in and out per branch, ingredient and day: lines not returned restock twice over."""
    return star_lines(spark, sf_dir).selectExpr(
        f"l_orderkey % {RESTAURANTS} AS source_restaurant_id",
        "concat('ING-', l_suppkey % 40) AS ingredient_name",
        "CAST(shipped AS DATE) AS movement_date",
        "CASE WHEN l_returnflag = 'N' THEN 2 * qty ELSE 0 END AS restocked",
        "CASE WHEN l_returnflag <> 'N' THEN qty ELSE 0 END AS consumed",
    )
