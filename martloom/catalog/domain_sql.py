"""The source tables as SQL over the star schema, for the oracle queries."""

from __future__ import annotations

_LINES = """
lines0 AS (
  SELECT l.*, {item} AS item,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS ext,
    CAST(round(l_discount * 100) AS INTEGER) AS pct,
    CAST(l_quantity AS INTEGER) AS qty,
    CAST(l_shipdate AS TIMESTAMP) AS shipped
  FROM lineitem l {join}),
lines AS (
  SELECT *, (price * (40 + l_partkey % 65)) // 100 AS cost, (ext * pct + 50) // 100 AS disc
  FROM (SELECT *, ext // qty AS price FROM lines0))"""

_ORDERS = """
orders0 AS (
  SELECT *, (total * (o_orderkey % 5) + 50) // 100 AS disc FROM (
    SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS total,
      CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS placed
    FROM orders)),
orders1 AS (
  SELECT *,
    CASE WHEN o_orderstatus = 'F' THEN ((total - disc) * 825 + 5000) // 10000 ELSE 0 END AS tax,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
      THEN ((total - disc) * 15 + 50) // 100 ELSE 0 END AS tip
  FROM orders0),
d_orders AS (
  SELECT o_orderkey AS source_order_id, o_orderkey % 25 AS source_restaurant_id,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS source_customer_id,
    placed AS order_timestamp, CAST(placed AS DATE) AS order_date,
    o_orderpriority AS order_channel,
    CASE o_orderstatus WHEN 'P' THEN 'Voided' WHEN 'O' THEN 'Cancelled' ELSE 'Completed' END
      AS order_status,
    CAST(total / 100.0 AS DECIMAL(18,2)) AS subtotal_amount,
    CAST(disc / 100.0 AS DECIMAL(18,2)) AS discount_amount,
    CAST(tax / 100.0 AS DECIMAL(18,2)) AS tax_amount,
    CAST(tip / 100.0 AS DECIMAL(18,2)) AS tip_amount,
    CAST((total - disc + tax + tip) / 100.0 AS DECIMAL(18,2)) AS total_amount,
    CASE o_orderkey % 3 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Credit Card' ELSE 'Debit Card' END
      AS payment_method
  FROM orders1),
valid_orders AS (SELECT * FROM d_orders WHERE order_status <> 'Voided')"""

_ITEMS = """
d_items AS (
  SELECT l_orderkey * 10 + l_linenumber AS source_order_item_id, l_orderkey AS source_order_id,
    item AS source_menu_item_id, shipped AS created_at, qty AS quantity,
    CAST(price / 100.0 AS DECIMAL(18,2)) AS unit_price_at_sale,
    CAST(cost / 100.0 AS DECIMAL(18,2)) AS unit_cost_at_sale,
    CAST(disc / 100.0 AS DECIMAL(18,2)) AS line_discount,
    CASE WHEN pct >= 5 THEN pct END AS source_promotion_id,
    CAST((price * qty - disc) / 100.0 AS DECIMAL(18,2)) AS line_net_revenue,
    CAST((price * qty - disc - cost * qty) / 100.0 AS DECIMAL(18,2)) AS line_contribution_margin
  FROM lines)"""

_SOLD = """
sold AS (
  SELECT i.*, o.source_restaurant_id, o.source_customer_id, o.order_timestamp, o.order_date,
    o.order_channel
  FROM d_items i JOIN valid_orders o ON i.source_order_id = o.source_order_id)"""

_RATINGS = """
d_ratings AS (
  SELECT l_orderkey % 25 AS source_restaurant_id,
    CASE WHEN l_tax > 0 THEN item END AS source_menu_item_id,
    1 + qty % 5 AS rating_score, shipped AS rating_timestamp
  FROM lines WHERE l_returnflag = 'A')"""

_WASTE = """
d_waste AS (
  SELECT l_orderkey % 25 AS source_restaurant_id,
    CASE WHEN l_linestatus = 'F' THEN item END AS source_menu_item_id,
    CASE WHEN l_linestatus = 'O' THEN 'ING-' || CAST(l_suppkey % 40 AS VARCHAR) END
      AS ingredient_name,
    shipped AS wastage_timestamp, CAST((qty * 10) / 100.0 AS DECIMAL(18,2)) AS quantity_lost,
    CAST((ext // 200) / 100.0 AS DECIMAL(18,2)) AS cost_loss_amount,
    CASE l_linenumber % 6 WHEN 0 THEN 'Expired' WHEN 1 THEN 'Over-preparation'
      WHEN 2 THEN 'Cooking Error' WHEN 3 THEN 'Equipment Failure'
      WHEN 4 THEN 'Customer Returned' ELSE 'Spillage' END AS wastage_reason
  FROM lines WHERE l_returnflag = 'R')"""

_INVENTORY = """
d_inventory AS (
  SELECT r AS source_restaurant_id, 'ING-' || CAST(g AS VARCHAR) AS ingredient_name,
    CASE WHEN g % 2 = 0 THEN 'Produce' ELSE 'Dry Goods' END AS ingredient_category,
    CAST(stock AS DOUBLE) AS current_stock_quantity, CAST(used AS DOUBLE) AS reorder_threshold,
    CAST(used * 2 AS DOUBLE) AS reorder_quantity, (100 + g) / 100.0 AS unit_purchase_cost
  FROM (
    SELECT l_orderkey % 25 AS r, l_suppkey % 40 AS g,
      SUM(CASE WHEN l_returnflag = 'N' THEN qty ELSE 0 END) AS stock,
      SUM(CASE WHEN l_returnflag = 'R' THEN qty ELSE 0 END) AS used
    FROM lines GROUP BY 1, 2))"""

_PROMOTIONS = """
d_promotions AS (
  SELECT pct AS source_promotion_id, 'Discount ' || CAST(pct AS VARCHAR) AS campaign_name,
    CASE WHEN pct % 2 = 0 THEN 'Percentage' ELSE 'Fixed Amount' END AS discount_type,
    CAST(pct AS DOUBLE) AS discount_value,
    CAST(MIN(shipped) AS DATE) + pct * 50 AS start_date,
    CAST(MIN(shipped) AS DATE) + (pct * 50 + 700) AS end_date,
    CASE WHEN pct % 2 = 1 THEN CAST(pct AS BIGINT) END AS source_menu_item_id,
    CASE pct WHEN 6 THEN '1-URGENT' WHEN 8 THEN '2-HIGH' WHEN 10 THEN '5-LOW' END
      AS applicable_channel,
    pct >= 9 AS is_misleading
  FROM lines WHERE pct >= 5 GROUP BY pct)"""

_PRICES = """
d_prices AS (
  SELECT item * 1000 + q AS source_pricing_history_id, item AS source_menu_item_id,
    CASE WHEN q % 3 = 0 THEN item % 25 END AS source_restaurant_id,
    price / 100.0 AS base_price, cost / 100.0 AS base_cost, start AS effective_from,
    CASE WHEN later IS NOT NULL
      THEN start + to_days(CAST(70 + (item * 13 + q) % 50 AS INTEGER)) END AS effective_to
  FROM (
    SELECT *, (year(start) - 1990) * 4 + quarter(start) AS q,
      LEAD(start) OVER (PARTITION BY item ORDER BY start) AS later
    FROM (
      SELECT item, CAST(date_trunc('quarter', shipped) AS TIMESTAMP) AS start,
        CAST(SUM(price) AS BIGINT) // COUNT(*) AS price,
        CAST(SUM(cost) AS BIGINT) // COUNT(*) AS cost
      FROM lines GROUP BY 1, 2)))"""

_MENU_ROWS = {
    "part": "SELECT p_partkey AS item, p_name AS label, p_type, p_size, "
    "CAST(round(p_retailprice * 100) AS BIGINT) AS retail FROM part",
    "brand": "SELECT CAST(substring(p_brand, 7) AS BIGINT) AS item, p_brand AS label, "
    "MIN(p_type) AS p_type, MIN(p_size) AS p_size, "
    "CAST(SUM(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) // COUNT(*) AS retail "
    "FROM part GROUP BY p_brand",
}

_MENU = """
d_menu AS (
  SELECT item AS source_menu_item_id, p_type AS source_category_id, label AS item_name,
    retail / 100.0 AS current_base_price, ((retail * 60) // 100) / 100.0 AS current_base_cost,
    p_size AS prep_time_minutes, item % 5 = 0 AS is_seasonal, lower(p_type) AS category_name
  FROM ({rows}))"""

_RESTAURANTS = """
d_restaurants AS (
  SELECT CAST(n_nationkey AS BIGINT) AS source_restaurant_id, 'Branch ' || n_name AS location_name,
    n_name AS city, r_name AS state_region, CAST(40 + (n_nationkey * 7) % 60 AS INTEGER)
      AS seating_capacity,
    CASE n_nationkey % 3 WHEN 0 THEN 'Fast Casual' WHEN 1 THEN 'Casual Dining'
      ELSE 'Fine Dining' END AS dining_type,
    DATE '1990-01-01' + CAST(n_nationkey * 30 AS INTEGER) AS opening_date
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

_CUSTOMERS = """
d_customers AS (
  SELECT c_custkey AS source_customer_id,
    substring(c_name, 1, 8) || ' ' || substring(c_name, 10) AS customer_name,
    CASE WHEN c_acctbal < 0 THEN 'None' WHEN c_acctbal < 2000 THEN 'Bronze'
      WHEN c_acctbal < 5000 THEN 'Silver' WHEN c_acctbal < 8000 THEN 'Gold' ELSE 'Platinum' END
      AS loyalty_tier,
    c_mktsegment AS preferred_channel, 'NATION_' || CAST(c_nationkey AS VARCHAR) AS home_city
  FROM customer)"""

_EVENTS = """
e_orders AS (
  SELECT event_id AS source_order_id, event_type AS source_restaurant_id, ts AS order_timestamp,
    CAST(ts AS DATE) AS order_date, CAST(value AS DECIMAL(18,2)) AS total_amount FROM events),
e_branches AS (
  SELECT DISTINCT event_type AS source_restaurant_id, 'Branch ' || event_type AS location_name,
    event_type AS city, 'Fast Casual' AS dining_type,
    CAST(20 + length(event_type) AS INTEGER) AS seating_capacity
  FROM events)"""

_PARTS = {
    "items": _ITEMS,
    "orders": _ORDERS,
    "sold": _SOLD,
    "ratings": _RATINGS,
    "waste": _WASTE,
    "inventory": _INVENTORY,
    "promotions": _PROMOTIONS,
    "prices": _PRICES,
    "menu": _MENU,
    "restaurants": _RESTAURANTS,
    "customers": _CUSTOMERS,
    "events": _EVENTS,
}
_NEEDS = {
    "items": ["lines"],
    "sold": ["lines", "items", "orders"],
    "ratings": ["lines"],
    "waste": ["lines"],
    "inventory": ["lines"],
    "promotions": ["lines"],
    "prices": ["lines"],
}


def with_domain(*names: str, item: str = "part") -> str:
    """A WITH clause (ending in a comma-free CTE) that defines the named source tables."""
    join = "JOIN part p ON l.l_partkey = p.p_partkey" if item == "brand" else ""
    key = "CAST(substring(p_brand, 7) AS BIGINT)" if item == "brand" else "l_partkey"
    wanted: list[str] = []
    for name in names:
        for part in [*_NEEDS.get(name, []), name]:
            if part not in wanted:
                wanted.append(part)
    texts = []
    for part in wanted:
        if part == "lines":
            texts.append(_LINES.format(item=key, join=join))
        elif part == "menu":
            texts.append(_MENU.format(rows=_MENU_ROWS[item]))
        else:
            texts.append(_PARTS[part])
    return "WITH " + ",".join(texts)


def money(expr: str) -> str:
    """An exact decimal total as double."""
    return f"CAST({expr} AS DOUBLE)"


def fixed(expr: str, digits: int) -> str:
    """Round on the decimal text of a number."""
    as_text = f"CAST(CAST({expr} AS DOUBLE) AS VARCHAR)"
    return f"CAST(round(CAST({as_text} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def whole(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def text(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"
