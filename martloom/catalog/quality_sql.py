"""Oracle SQL of the joins and the quality operators."""

from __future__ import annotations

from martloom.catalog.domain_sql import fixed, money, text, whole, with_domain
from martloom.catalog.mart_sql import channel_performance

R, I = "source_restaurant_id", "source_menu_item_id"
LAST_YEAR = 2000


def order_lines_join() -> str:
    return (
        with_domain("items", "orders", "menu", "promotions")
        + f"""
SELECT category_name, campaign_name, order_channel, order_status, COUNT(*) AS row_count,
  {whole('SUM(quantity)')} AS units, {money('SUM(line_net_revenue)')} AS net_revenue
FROM d_items i JOIN d_menu m ON i.{I} = m.{I}
LEFT JOIN d_promotions p ON i.source_promotion_id = p.source_promotion_id
JOIN d_orders o ON i.source_order_id = o.source_order_id GROUP BY 1, 2, 3, 4"""
    )


def null_split_routing() -> str:
    cost = money("SUM(cost_loss_amount)")
    return (
        with_domain("waste", "menu", "inventory")
        + f"""
SELECT source_category_id AS kind, COUNT(*) AS row_count, {cost} AS cost, 'dish' AS path
FROM d_waste w JOIN d_menu m ON w.{I} = m.{I} GROUP BY 1
UNION ALL
SELECT coalesce(ingredient_category, 'unknown'), COUNT(*), {cost}, 'raw'
FROM d_waste w LEFT JOIN d_inventory v
  ON w.{R} = v.{R} AND w.ingredient_name = v.ingredient_name
WHERE w.{I} IS NULL GROUP BY 1"""
    )


def valid_order_filter() -> str:
    return (
        with_domain("orders")
        + f"""
SELECT order_status, {text("CAST(date_trunc('month', order_date) AS DATE)")} AS order_month,
  dayofweek(order_date) IN (0, 5, 6) AS weekend, COUNT(*) AS orders,
  {money('SUM(total_amount)')} AS revenue
FROM valid_orders GROUP BY 1, 2, 3"""
    )


def asof_price() -> str:
    return (
        with_domain("items", "orders", "prices", item="brand")
        + f""",
f AS (
  SELECT i.{I}, quantity, order_timestamp AS t FROM d_items i
  JOIN d_orders o ON i.source_order_id = o.source_order_id),
k AS (SELECT DISTINCT {I}, t FROM f),
hit AS (
  SELECT k.{I}, k.t, arg_min(ROW(base_price, base_cost), ROW(effective_from, source_pricing_history_id)) AS v
  FROM k JOIN d_prices p ON k.{I} = p.{I} AND effective_from <= t
    AND (effective_to IS NULL OR effective_to > t)
  GROUP BY 1, 2),
latest AS (
  SELECT {I}, arg_max(ROW(base_price, base_cost), ROW(effective_from, source_pricing_history_id)) AS v
  FROM d_prices GROUP BY 1)
SELECT f.{I}, coalesce(hit.v, latest.v)[1] AS list_price, coalesce(hit.v, latest.v)[2] AS list_cost,
  COUNT(*) AS row_count, {whole('SUM(quantity)')} AS units
FROM f LEFT JOIN hit ON f.{I} = hit.{I} AND f.t = hit.t LEFT JOIN latest ON f.{I} = latest.{I}
GROUP BY 1, 2, 3"""
    )


def promo_match() -> str:
    return (
        with_domain("items", "orders", "promotions", item="brand")
        + f""",
f AS (
  SELECT source_order_item_id, i.source_order_id, i.{I}, quantity, unit_price_at_sale AS p,
    order_channel, order_date, ROW_NUMBER() OVER () AS n
  FROM d_items i JOIN d_orders o ON i.source_order_id = o.source_order_id),
m AS (
  SELECT f.n, MIN(source_promotion_id) AS pid FROM f JOIN d_promotions d
    ON order_date BETWEEN start_date AND end_date
    AND (d.{I} = f.{I} OR applicable_channel = order_channel)
  GROUP BY 1),
x AS (
  SELECT f.order_channel, m.pid AS source_promotion_id,
    CASE discount_type WHEN 'Fixed Amount' THEN least(CAST(discount_value AS DECIMAL(18,2)), p * quantity)
      WHEN 'Percentage' THEN round_even(CAST(p * quantity * CAST(discount_value AS DECIMAL(10,2)) * 0.01 AS DECIMAL(30,6)), 2)
      ELSE 0 END AS line_discount
  FROM f LEFT JOIN m ON f.n = m.n LEFT JOIN d_promotions d ON m.pid = d.source_promotion_id)
SELECT source_promotion_id, order_channel, COUNT(*) AS row_count,
  {money('CAST(SUM(CAST(round(line_discount * 100) AS BIGINT)) AS BIGINT) / 100.0')} AS discount
FROM x GROUP BY 1, 2"""
    )


def _profile(table: str, columns: list[tuple[str, str, str]]) -> str:
    parts = [
        f"SELECT '{name}' AS column_name, '{kind}' AS data_type, COUNT(*) AS row_count, "
        f"COUNT(*) - COUNT({expr}) AS null_count FROM {table}"
        for name, kind, expr in columns
    ]
    return (
        ", c AS (" + " UNION ALL ".join(parts) + ") SELECT *, "
        f"{fixed('CAST(null_count AS DOUBLE) / row_count * 100.0', 2)} AS null_pct FROM c"
    )


def profile_columns() -> str:
    amounts = ["subtotal_amount", "discount_amount", "tax_amount", "tip_amount", "total_amount"]
    columns = [
        ("source_order_id", "bigint", "source_order_id"),
        ("source_restaurant_id", "bigint", "source_restaurant_id"),
        ("source_customer_id", "bigint", "source_customer_id"),
        ("order_timestamp", "timestamp", "order_timestamp"),
        ("order_channel", "string", "order_channel"),
        ("order_status", "string", "order_status"),
        *[(a, "double", a) for a in amounts],
        ("payment_method", "string", "payment_method"),
        ("created_at", "timestamp", "order_timestamp"),
    ]
    return with_domain("orders") + _profile("d_orders", columns)


def profile_columns_ratings() -> str:
    columns = [
        ("source_rating_id", "bigint", "1"),
        ("source_restaurant_id", "bigint", R),
        ("source_order_id", "bigint", "1"),
        ("source_customer_id", "bigint", "NULL"),
        ("source_menu_item_id", "bigint", I),
        *[(c, "int", "rating_score") for c in
          ("rating_score", "food_rating", "service_rating", "ambiance_rating")],
        ("review_text", "string", "NULL"),
        ("rating_timestamp", "timestamp", "rating_timestamp"),
        ("is_verified_purchase", "boolean", "1"),
        ("created_at", "timestamp", "rating_timestamp"),
    ]
    return with_domain("ratings") + _profile("d_ratings", columns)


def _measures(rows: dict[str, str], table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS measure, CAST({expr} AS DOUBLE) AS value FROM {table}"
        for name, expr in rows.items()
    )


def profile_orders() -> str:
    count = lambda cond: f"COUNT(CASE WHEN {cond} THEN 1 END)"
    guests = count("source_customer_id IS NULL")
    rows = {
        "rows": "COUNT(*)",
        "guest_orders": guests,
        "guest_pct": fixed(f"CAST({guests} AS DOUBLE) / COUNT(*) * 100.0", 2),
        "future_timestamps": count(f"year(order_timestamp) > {LAST_YEAR}"),
        "settlement_mismatches": count(
            "abs(total_amount - (subtotal_amount - discount_amount + tax_amount + tip_amount)) > 0.02"
        ),
    }
    return with_domain("orders") + " " + _measures(rows, "d_orders")


def profile_order_items() -> str:
    count = lambda cond: f"COUNT(CASE WHEN {cond} THEN 1 END)"
    rows = {
        "rows": "COUNT(*)",
        "negative_prices": count("unit_price_at_sale < 0"),
        "zero_quantities": count("quantity <= 0"),
        "negative_margins": count("line_contribution_margin < 0"),
        "net_revenue_mismatches": count(
            "abs(line_net_revenue - (quantity * unit_price_at_sale - line_discount)) > 0.02"
        ),
        "margin_mismatches": count(
            "abs(line_contribution_margin - (line_net_revenue - quantity * unit_cost_at_sale)) > 0.02"
        ),
    }
    return with_domain("items") + " " + _measures(rows, "d_items")


def profile_ratings() -> str:
    rows = {
        "rows": "COUNT(*)",
        "out_of_range": "COUNT(CASE WHEN rating_score NOT BETWEEN 1 AND 5 THEN 1 END)",
        "missing_text": "COUNT(*)",
    }
    return with_domain("ratings") + " " + _measures(rows, "d_ratings")


def fk_checks() -> str:
    def check(name: str, child: str, column: str, parent: str, skip: str = "") -> str:
        orphan = f"COUNT(CASE WHEN {column} IS NULL OR {column} NOT IN (SELECT {column} FROM {parent}) THEN 1 END)"
        return (
            f'SELECT \'{name}\' AS "constraint", COUNT(*) AS total_foreign_keys_checked, '
            f"{orphan} AS orphaned_count, {orphan} = 0 AS is_clean FROM {child} {skip}"
        )

    return (
        with_domain("items", "orders", "menu", "restaurants", "customers")
        + " "
        + " UNION ALL ".join(
            [
                check("order_items_to_orders", "d_items", "source_order_id", "d_orders"),
                check("order_items_to_menu_items", "d_items", I, "d_menu"),
                check("orders_to_restaurants", "d_orders", R, "d_restaurants"),
                check(
                    "orders_to_customers", "d_orders", "source_customer_id", "d_customers",
                    "WHERE source_customer_id IS NOT NULL",
                ),
            ]
        )
    )


def fk_orphans() -> str:
    return (
        with_domain("items", "orders")
        + """
SELECT 'items_to_counted_orders' AS "constraint", COUNT(*) AS total_foreign_keys_checked,
  COUNT(*) - COUNT(o.source_order_id) AS orphaned_count,
  COUNT(*) = COUNT(o.source_order_id) AS is_clean
FROM d_items i LEFT JOIN valid_orders o ON i.source_order_id = o.source_order_id"""
    )


def quarantine_orders() -> str:
    return (
        with_domain("orders")
        + f"""
SELECT 'orders' AS table_name, 'FUTURE_TIMESTAMP' AS quarantine_reason, COUNT(*) AS row_count
FROM d_orders WHERE year(order_timestamp) > {LAST_YEAR} HAVING COUNT(*) > 0"""
    )


def _judged_lines() -> str:
    """Lines with their reason: rank within the id by time, then by all columns."""
    columns = (
        "created_at source_order_item_id source_order_id source_menu_item_id quantity "
        "unit_price_at_sale unit_cost_at_sale line_discount source_promotion_id "
        "line_net_revenue line_contribution_margin"
    )
    place = ", ".join(f"i.{c} NULLS FIRST" for c in columns.split())
    return (
        with_domain("items", "orders", "ratings", "waste", "inventory", "promotions", "prices",
                    "menu", "restaurants", "customers")
        + f""",
good AS (SELECT * FROM d_orders WHERE year(order_timestamp) <= {LAST_YEAR}),
tagged AS (
  SELECT i.*, CASE WHEN unit_price_at_sale < 0 THEN 'INVALID_NEGATIVE_PRICE'
      WHEN quantity <= 0 THEN 'INVALID_ZERO_QUANTITY'
      WHEN g.source_order_id IS NULL THEN 'ORPHANED_ORDER_PARENT'
      WHEN m.source_menu_item_id IS NULL THEN 'ORPHANED_MENU_ITEM' END AS defect,
    ROW_NUMBER() OVER (PARTITION BY i.source_order_item_id ORDER BY {place}) AS place
  FROM d_items i LEFT JOIN good g ON i.source_order_id = g.source_order_id
  LEFT JOIN d_menu m ON i.source_menu_item_id = m.source_menu_item_id),
judged AS (
  SELECT *, CASE WHEN place > MIN(CASE WHEN defect IS NULL THEN place END)
      OVER (PARTITION BY source_order_item_id) THEN 'DUPLICATE_ORDER_ITEM_ID' ELSE defect END
      AS quarantine_reason
  FROM tagged)"""
    )


_SHOWN = f"source_order_item_id, {I}, quantity, CAST(line_net_revenue AS DOUBLE) AS line_net_revenue"


def quarantine_lines() -> str:
    return _judged_lines() + f"""
SELECT {_SHOWN}, quarantine_reason FROM judged WHERE quarantine_reason IS NOT NULL"""


def clean_lines() -> str:
    return _judged_lines() + f"""
SELECT {_SHOWN} FROM judged WHERE quarantine_reason IS NULL"""


def quality_reconciliation() -> str:
    whole_tables = {
        "customers": "customer",
        "restaurants": "nation",
        "menu_categories": "(SELECT DISTINCT p_type FROM part)",
        "menu_items": "part",
        "pricing_history": "d_prices",
        "promotions": "d_promotions",
        "ratings": "d_ratings",
        "inventory": "d_inventory",
        "wastage": "d_waste",
    }
    passed = " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, COUNT(*) AS clean_rows, 0 AS bad FROM {source}"
        for name, source in whole_tables.items()
    )
    return _judged_lines() + f""",
counts AS (
  {passed}
  UNION ALL SELECT 'orders', COUNT(CASE WHEN year(order_timestamp) <= {LAST_YEAR} THEN 1 END),
    COUNT(CASE WHEN year(order_timestamp) > {LAST_YEAR} THEN 1 END) FROM d_orders
  UNION ALL SELECT 'order_items', COUNT(CASE WHEN quarantine_reason IS NULL THEN 1 END),
    COUNT(quarantine_reason) FROM judged),
total AS (
  SELECT coalesce(table_name, 'ALL') AS table_name, {whole('SUM(clean_rows)')} AS clean_rows,
    {whole('SUM(bad)')} AS quarantined_rows FROM counts GROUP BY ROLLUP (table_name))
SELECT table_name, clean_rows + quarantined_rows AS raw_rows, clean_rows, quarantined_rows,
  {fixed('CAST(clean_rows AS DOUBLE) / (clean_rows + quarantined_rows) * 100.0', 3)}
    AS cleanliness_rate_pct,
  CASE WHEN quarantined_rows > 0 THEN 'PASSED_WITH_QUARANTINE' ELSE 'CLEAN' END AS overall_status
FROM total"""


def constraint_rules() -> str:
    count = lambda cond: f"COUNT(CASE WHEN {cond} THEN 1 END)"
    rows = {
        "INVALID_ORDER_CHANNEL": count(
            "order_channel NOT IN ('Dine-in', 'Takeaway', 'Delivery Direct', 'Delivery Aggregator')"
        ),
        "INVALID_ORDER_STATUS": count(
            "order_status NOT IN ('Completed', 'Cancelled', 'Refunded', 'Voided')"
        ),
        "INVALID_PAYMENT_METHOD": count(
            "payment_method NOT IN ('Credit Card', 'Debit Card', 'Cash', 'Digital Wallet', 'Gift Card')"
        ),
        "INVALID_TOTAL_AMOUNT": count("total_amount < 0"),
    }
    return with_domain("orders") + " " + " UNION ALL ".join(
        f"SELECT '{name}' AS rule, {expr} AS violations FROM d_orders" for name, expr in rows.items()
    )


def quality_oracles() -> dict[str, str]:
    return {
        "order_lines_join": order_lines_join(),
        "null_split_routing": null_split_routing(),
        "valid_order_filter": valid_order_filter(),
        "stored_sales": with_domain("sold")
        + f""" SELECT order_channel, COUNT(*) AS row_count, {whole('SUM(quantity)')} AS units,
  {money('SUM(line_net_revenue)')} AS net_revenue FROM sold GROUP BY 1""",
        "stored_mart_scan": f"SELECT {R}, channel, net_revenue FROM ({channel_performance()})",
        "asof_price": asof_price(),
        "promo_match": promo_match(),
        "profile_columns": profile_columns(),
        "profile_columns_ratings": profile_columns_ratings(),
        "duplicate_keys": """
SELECT COUNT(*) AS row_count, COUNT(DISTINCT l_orderkey * 10 + l_linenumber) AS distinct_keys,
  COUNT(*) - COUNT(DISTINCT l_orderkey * 10 + l_linenumber) AS duplicate_count FROM lineitem""",
        "profile_orders": profile_orders(),
        "order_status_breakdown": with_domain("orders")
        + " SELECT order_status AS value, COUNT(*) AS row_count FROM d_orders GROUP BY 1",
        "profile_order_items": profile_order_items(),
        "profile_ratings": profile_ratings(),
        "profile_wastage": with_domain("waste")
        + f""" SELECT wastage_reason, COUNT(*) AS row_count,
  {money('SUM(cost_loss_amount)')} AS total_cost FROM d_waste GROUP BY 1""",
        "invalid_identifiers": """
SELECT COUNT(*) AS rows_checked, COUNT(CASE WHEN NOT regexp_full_match(substring(c_name, 10),
  '[0-9]{8}[02468]') THEN 1 END) AS invalid_ids FROM customer""",
        "fk_checks": fk_checks(),
        "fk_orphans": fk_orphans(),
        "quarantine_orders": quarantine_orders(),
        "quarantine_lines": quarantine_lines(),
        "clean_lines": clean_lines(),
        "quality_reconciliation": quality_reconciliation(),
        "chronology_rules": with_domain("items", "orders")
        + """
SELECT 'LINE_BEFORE_ORDER' AS rule, COUNT(CASE WHEN CAST(l_shipdate AS TIMESTAMP) < order_timestamp
  THEN 1 END) AS violations FROM lineitem JOIN d_orders ON l_orderkey = source_order_id""",
        "constraint_rules": constraint_rules(),
        "operational_flags": with_domain("items", "orders")
        + """
SELECT order_status IN ('Cancelled', 'Voided') AS flag_not_fulfilled,
  source_customer_id IS NULL AS flag_guest, line_contribution_margin < 0 AS flag_negative_margin,
  COUNT(*) AS row_count
FROM d_items i JOIN d_orders o ON i.source_order_id = o.source_order_id GROUP BY 1, 2, 3""",
    }
