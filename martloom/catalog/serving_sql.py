"""Oracle SQL of features, comparison and serving."""

from __future__ import annotations

from martloom.catalog import mart_sql as m
from martloom.catalog.domain_sql import fixed, money, text, whole, with_domain

R, I, C = "source_restaurant_id", "source_menu_item_id", "source_customer_id"


def _split(date: str, splits: tuple[str, str, str]) -> str:
    return (
        f"CASE WHEN {date} <= DATE '{splits[0]}' THEN 'TRAIN' WHEN {date} <= DATE '{splits[1]}' "
        f"THEN 'VALIDATION' WHEN {date} <= DATE '{splits[2]}' THEN 'TEST' ELSE 'UNSEEN_COMPARISON' END"
    )


def _week(ts: str) -> str:
    return f"CAST(date_trunc('week', {ts}) AS DATE)"


_LAST4 = "OVER (PARTITION BY menu_item_id, restaurant_id ORDER BY wk ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"
_BY_WEEK = "OVER (PARTITION BY menu_item_id, restaurant_id ORDER BY wk)"


def _stat(expr: str, full: bool) -> str:
    if full:
        expr = f"CASE WHEN COUNT(*) {_LAST4} = 4 THEN {expr} END"
    return fixed(f"coalesce(CAST({expr} AS DOUBLE), 0.0)", 6)


def _lag(column: str, n: int) -> str:
    return f"coalesce(CAST(LAG({column}, {n}) {_BY_WEEK} AS DOUBLE), 0.0)"


def _demand_lags(full: bool) -> str:
    revenue = f"SUM(CAST(round(weekly_revenue * 100) AS BIGINT)) {_LAST4}"
    mean = f"CAST({revenue} AS DOUBLE) / 100.0 / COUNT(*) {_LAST4}"
    return f"""{_lag('weekly_quantity', 1)} AS lag_1w_quantity,
    {_lag('weekly_quantity', 4)} AS lag_4w_quantity,
    {_stat(f'AVG(weekly_quantity) {_LAST4}', full)} AS rolling_4w_avg_quantity,
    {_stat(f'stddev_samp(weekly_quantity) {_LAST4}', full)} AS rolling_4w_std_quantity,
    {_lag('weekly_revenue', 1)} AS lag_1w_revenue, {_lag('weekly_revenue', 4)} AS lag_4w_revenue,
    {_stat(mean, full)} AS rolling_4w_avg_revenue,
    CAST(week(wk) AS DOUBLE) AS week_of_year, CAST(month(wk) AS DOUBLE) AS month"""


def demand_feature_ctes(splits: tuple[str, str, str]) -> str:
    return m.demand_ctes(splits) + f""",
wd AS (
  SELECT {_week('order_date')} AS wk, {I} AS menu_item_id, {R} AS restaurant_id,
    source_category_id AS category_id, {whole('SUM(historical_demand)')} AS weekly_quantity,
    {money('SUM(CAST(gross_revenue AS DECIMAL(18,2)))')} AS weekly_revenue
  FROM demand0 GROUP BY ALL),
feats AS (SELECT *, {_demand_lags(False)}, 0.0::DOUBLE AS dow_avg_quantity, 0.0::DOUBLE AS is_weekend FROM wd)""".replace(
        "demand0", "demand"
    )


def weekly_demand_features(splits: tuple[str, str, str]) -> str:
    return with_domain("sold", "menu", item="brand") + "," + demand_feature_ctes(splits) + f"""
SELECT * EXCLUDE (wk), {text('wk')} AS week_start_date FROM feats"""


def weekly_demand_features_full(splits: tuple[str, str, str]) -> str:
    return with_domain("items", "orders", "menu", item="brand") + f""",
al AS (
  SELECT i.{I} AS menu_item_id, o.{R} AS restaurant_id, order_date, quantity, line_net_revenue
  FROM d_items i JOIN d_orders o ON i.source_order_id = o.source_order_id),
wd AS (
  SELECT {_week('order_date')} AS wk, menu_item_id, restaurant_id, source_category_id AS category_id,
    {whole('SUM(quantity)')} AS weekly_quantity, {money('SUM(line_net_revenue)')} AS weekly_revenue
  FROM al LEFT JOIN d_menu ON menu_item_id = {I} GROUP BY ALL),
dw AS (
  SELECT menu_item_id, restaurant_id, {fixed('AVG(mq)', 6)} AS dow_avg FROM (
    SELECT menu_item_id, restaurant_id, dayofweek(order_date) AS dow, AVG(quantity) AS mq FROM al
    WHERE order_date <= DATE '{splits[0]}' GROUP BY 1, 2, 3) GROUP BY 1, 2),
fe AS (SELECT *, {_demand_lags(True)} FROM wd)
SELECT fe.* EXCLUDE (wk), {text('wk')} AS week_start_date, coalesce(dow_avg, 0.0) AS dow_avg_quantity,
  0.0::DOUBLE AS is_weekend, {_split('wk', splits)} AS split
FROM fe LEFT JOIN dw USING (menu_item_id, restaurant_id)"""


def _waste_lags(full: bool) -> str:
    return f"""{_lag('cost_ratio', 1)} AS lag_1w_cost_ratio,
    {_stat(f'AVG(cost_ratio) {_LAST4}', full)} AS lag_4w_avg_cost_ratio,
    {_lag('quantity_ratio', 1)} AS lag_1w_quantity_ratio,
    {_stat(f'AVG(quantity_ratio) {_LAST4}', full)} AS lag_4w_avg_quantity_ratio,
    {_stat(f'SUM(wastage_risk_label) {_LAST4}', full)} AS rolling_4w_waste_events,
    CAST(week(wk) AS DOUBLE) AS week_of_year, CAST(month(wk) AS DOUBLE) AS month"""


_LABEL = (
    "CASE WHEN coalesce(cost_ratio, 0.0) > 0.05 OR coalesce(quantity_ratio, 0.0) > 0.10 "
    "THEN 1 ELSE 0 END AS wastage_risk_label"
)


def waste_feature_ctes() -> str:
    return m.waste_ctes() + f""",
wl AS (SELECT *, {_LABEL} FROM (
  SELECT wk, {I} AS menu_item_id, {R} AS restaurant_id, source_category_id AS category_id,
    waste_cost_ratio AS cost_ratio, waste_quantity_ratio AS quantity_ratio, next_week_wastage_risk
  FROM waste WHERE {I} IS NOT NULL)),
wfeats AS (SELECT *, {_waste_lags(False)} FROM wl)"""


def waste_features() -> str:
    return with_domain("sold", "waste", "menu", item="brand") + "," + waste_feature_ctes() + f"""
SELECT * EXCLUDE (wk), {text('wk')} AS week_start_date FROM wfeats"""


def waste_features_full(splits: tuple[str, str, str]) -> str:
    keys = "wk, menu_item_id, restaurant_id"
    return with_domain("items", "orders", "waste", item="brand") + f""",
dw AS (
  SELECT {_week('wastage_timestamp')} AS wk, {I} AS menu_item_id, {R} AS restaurant_id,
    {money('SUM(quantity_lost)')} AS waste_quantity, {money('SUM(cost_loss_amount)')} AS waste_cost
  FROM d_waste WHERE {I} IS NOT NULL GROUP BY ALL),
sw AS (
  SELECT {_week('order_date')} AS wk, i.{I} AS menu_item_id, o.{R} AS restaurant_id,
    {whole('SUM(quantity)')} AS sold_quantity, {money('SUM(line_net_revenue)')} AS gross_revenue
  FROM d_items i JOIN d_orders o ON i.source_order_id = o.source_order_id GROUP BY ALL),
j AS (
  SELECT dw.*, coalesce(sold_quantity, 0) AS sold_quantity, coalesce(gross_revenue, 0.0) AS gross_revenue
  FROM dw LEFT JOIN sw USING ({keys})),
r AS (
  SELECT *, {_LABEL} FROM (
    SELECT *, CASE WHEN gross_revenue > 0 THEN {fixed('waste_cost / gross_revenue', 6)} ELSE 0.0 END AS cost_ratio,
      CASE WHEN sold_quantity > 0 THEN {fixed('waste_quantity / sold_quantity', 6)} ELSE 0.0 END AS quantity_ratio
    FROM j))
SELECT * EXCLUDE (wk), {text('wk')} AS week_start_date, {_waste_lags(True)},
  {_split('wk', splits)} AS split FROM r"""


def churn_features() -> str:
    return with_domain("orders", "customers") + "," + m.customer_rfm_ctes() + f"""
SELECT {C} AS customer_id, CAST(recency_days AS DOUBLE) AS recency_days,
  CAST(frequency AS DOUBLE) AS frequency, monetary_value AS monetary_total,
  coalesce(avg_order_value, 0.0) AS avg_order_value, CAST(r_score AS DOUBLE) AS r_score,
  CAST(f_score AS DOUBLE) AS f_score, CAST(m_score AS DOUBLE) AS m_score,
  CAST(r_score + f_score + m_score AS DOUBLE) AS rfm_score,
  CASE WHEN recency_days > 60 THEN 1 ELSE 0 END AS churn_label FROM rfm"""


def churn_at_ctes(date: str) -> str:
    bins = lambda p: f"greatest(1, CAST(ceil((({p} - 1) * 5) / CAST(n - 1 AS DOUBLE)) AS INTEGER))"
    return f"""
ct AS (
  SELECT {C}, CAST(DATE '{date}' - MAX(order_date) AS INTEGER) AS recency_days,
    COUNT(DISTINCT source_order_id) AS frequency, {money('SUM(total_amount)')} AS monetary_value
  FROM d_orders
  WHERE order_status = 'Completed' AND order_date <= DATE '{date}' AND {C} IS NOT NULL GROUP BY 1),
cp AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY frequency, {C}) AS fp,
    ROW_NUMBER() OVER (ORDER BY monetary_value, {C}) AS mp, COUNT(*) OVER () AS n FROM ct),
ce AS (
  SELECT quantile_cont(recency_days, 0.2) AS e1, quantile_cont(recency_days, 0.4) AS e2,
    quantile_cont(recency_days, 0.6) AS e3, quantile_cont(recency_days, 0.8) AS e4 FROM ct),
cs AS (
  SELECT cp.*, 5 - (CASE WHEN e1 < recency_days THEN 1 ELSE 0 END + CASE WHEN e2 < recency_days THEN 1 ELSE 0 END
      + CASE WHEN e3 < recency_days THEN 1 ELSE 0 END + CASE WHEN e4 < recency_days THEN 1 ELSE 0 END) AS r,
    {bins('fp')} AS f, {bins('mp')} AS m FROM cp, ce),
churn AS (
  SELECT c.{C} AS customer_id, CAST(coalesce(recency_days, 9999) AS DOUBLE) AS recency_days,
    CAST(coalesce(frequency, 0) AS DOUBLE) AS frequency, coalesce(monetary_value, 0.0) AS monetary_total,
    coalesce(monetary_value / frequency, 0.0) AS avg_order_value,
    CAST(coalesce(r, 0) AS DOUBLE) AS r_score, CAST(coalesce(f, 0) AS DOUBLE) AS f_score,
    CAST(coalesce(m, 0) AS DOUBLE) AS m_score, CAST(coalesce(r + f + m, 0) AS DOUBLE) AS rfm_score,
    CASE WHEN recency_days IS NULL OR recency_days > 60 THEN 1 ELSE 0 END AS churn_label,
    'TRAIN' AS split
  FROM d_customers c LEFT JOIN cs ON c.{C} = cs.{C})"""


def churn_features_at(date: str) -> str:
    return with_domain("orders", "customers") + "," + churn_at_ctes(date) + " SELECT * FROM churn"


def churn_panel(cutoffs: dict[str, str]) -> str:
    rows = ", ".join(f"(DATE '{d}', '{s}')" for d, s in cutoffs.items())
    return with_domain("orders") + f""",
cut AS (SELECT * FROM (VALUES {rows}) t(cutoff, split)),
p AS (
  SELECT {C} AS customer_id, cutoff, split,
    MAX(CASE WHEN order_date <= cutoff THEN order_date END) AS last,
    MIN(CASE WHEN order_date <= cutoff THEN order_date END) AS first,
    COUNT(CASE WHEN order_date <= cutoff THEN 1 END) AS n,
    {money('SUM(CASE WHEN order_date <= cutoff THEN total_amount END)')} AS spent,
    COUNT(CASE WHEN order_date > cutoff AND order_date <= cutoff + 60 THEN 1 END) AS later
  FROM valid_orders, cut WHERE {C} IS NOT NULL GROUP BY 1, 2, 3)
SELECT customer_id, {text('cutoff')} AS cutoff, CAST(cutoff - last AS DOUBLE) AS recency_days,
  CAST(n AS DOUBLE) AS frequency, spent AS monetary_total, {fixed('spent / n', 2)} AS avg_order_value,
  CAST(cutoff - first AS DOUBLE) AS customer_tenure_days,
  CASE WHEN later > 0 THEN 0 ELSE 1 END AS churn_label, split
FROM p WHERE n > 0"""


def order_settlement() -> str:
    share = lambda rate: f"CAST(round_even(CAST(base * {rate} AS DECIMAL(30,6)), 2) AS DECIMAL(18,2))"
    return with_domain("items", "orders") + f""",
s AS (
  SELECT source_order_id, SUM(quantity * unit_price_at_sale) AS sub, SUM(line_discount) AS disc
  FROM d_items GROUP BY 1),
b AS (
  SELECT *, greatest(CAST(0 AS DECIMAL(30,2)), sub - disc) AS base
  FROM (
    SELECT o.source_order_id, order_status, order_channel,
      CAST(coalesce(sub, 0) AS DECIMAL(30,2)) AS sub, CAST(coalesce(disc, 0) AS DECIMAL(30,2)) AS disc
    FROM d_orders o LEFT JOIN s ON s.source_order_id = o.source_order_id)),
t AS (
  SELECT *, CASE WHEN order_status = 'Completed' THEN {share('0.0825')} ELSE 0 END AS tax,
    CASE WHEN order_status = 'Completed' AND order_channel IN ('1-URGENT', '2-HIGH')
      THEN {share('0.15')} ELSE 0 END AS tip FROM b)
SELECT source_order_id, order_status, order_channel, {money('sub')} AS subtotal_amount,
  {money('disc')} AS discount_amount, {money('tax')} AS tax_amount, {money('tip')} AS tip_amount,
  {money('sub - disc + tax + tip')} AS total_amount FROM t"""


_KEYS = "wk, menu_item_id, restaurant_id"


def _forecast_ctes(splits: tuple[str, str, str]) -> str:
    make = lambda c: f"""
  SELECT {_KEYS}, CAST(weekly_quantity AS DOUBLE) AS actual_quantity, {fixed(c, 2)} AS p,
    {_split('wk', splits)} AS split FROM feats"""
    return demand_feature_ctes(splits) + f""",
fa AS ({make('lag_1w_quantity')}),
fb AS ({make('rolling_4w_avg_quantity')}),
cr AS (
  SELECT {text('fa.wk')} AS week_start_date, fa.menu_item_id, fa.restaurant_id, fa.actual_quantity,
    fa.p AS a_prediction, fb.p AS b_prediction, fa.split,
    {fixed('abs(fa.p - fb.p)', 4)} AS numerical_difference
  FROM fa JOIN fb ON fa.wk = fb.wk AND fa.menu_item_id = fb.menu_item_id
    AND fa.restaurant_id = fb.restaurant_id),
cmp AS (
  SELECT *, numerical_difference / ((abs(a_prediction) + abs(b_prediction)) / 2.0 + 1e-9) <= 0.10 AS "match",
    CASE WHEN abs(a_prediction - actual_quantity) <= abs(b_prediction - actual_quantity)
      THEN 'a' ELSE 'b' END AS pipeline_winner FROM cr)"""


_REG_SUMMARY = f"""
  SELECT COUNT(*) AS total_records_compared,
    {fixed('AVG(CASE WHEN "match" THEN 1.0::DOUBLE ELSE 0.0 END) * 100.0', 2)} AS agreement_pct,
    {fixed('sqrt(AVG((a_prediction - actual_quantity) * (a_prediction - actual_quantity)))', 6)} AS a_rmse,
    {fixed('AVG(abs(a_prediction - actual_quantity))', 6)} AS a_mae,
    {fixed('sqrt(AVG((b_prediction - actual_quantity) * (b_prediction - actual_quantity)))', 6)} AS b_rmse,
    {fixed('AVG(abs(b_prediction - actual_quantity))', 6)} AS b_mae, 'demand_forecast' AS task
  FROM cmp WHERE split = 'UNSEEN_COMPARISON'"""


def _risk_ctes(splits: tuple[str, str, str]) -> str:
    make = lambda c: f"""
  SELECT {_KEYS}, next_week_wastage_risk AS actual_label,
    CASE WHEN {fixed(c, 6)} > 0.05 THEN 1 ELSE 0 END AS l, {fixed(f'least(1.0, {c})', 4)} AS p,
    {_split('wk', splits)} AS split FROM wfeats0"""
    raw = f"coalesce(CAST(AVG(cost_ratio) {_LAST4} AS DOUBLE), 0.0)"
    return waste_feature_ctes() + f""",
wfeats0 AS (SELECT * REPLACE ({raw} AS lag_4w_avg_cost_ratio) FROM wfeats),
ra AS ({make('lag_1w_cost_ratio')}),
rb AS ({make('lag_4w_avg_cost_ratio')}),
cc AS (
  SELECT {text('ra.wk')} AS week_start_date, ra.menu_item_id, ra.restaurant_id, ra.actual_label,
    ra.l AS a_predicted_label, ra.p AS a_risk_probability, ra.split,
    rb.l AS b_predicted_label, rb.p AS b_risk_probability, ra.l = rb.l AS "match",
    {fixed('abs(ra.p - rb.p)', 4)} AS numerical_difference,
    CASE WHEN ra.l = ra.actual_label THEN 'a' WHEN rb.l = ra.actual_label THEN 'b' ELSE 'neither' END
      AS pipeline_winner
  FROM ra JOIN rb ON ra.wk = rb.wk AND ra.menu_item_id = rb.menu_item_id
    AND ra.restaurant_id = rb.restaurant_id
  WHERE ra.split = 'UNSEEN_COMPARISON')"""


_CLASS_SUMMARY = f"""
  SELECT COUNT(*) AS total_records_compared,
    {fixed('AVG(CASE WHEN "match" THEN 1.0::DOUBLE ELSE 0.0 END) * 100.0', 2)} AS agreement_pct,
    {fixed('AVG(CASE WHEN a_predicted_label = actual_label THEN 1.0::DOUBLE ELSE 0.0 END)', 6)} AS a_accuracy,
    {fixed('AVG(CASE WHEN b_predicted_label = actual_label THEN 1.0::DOUBLE ELSE 0.0 END)', 6)} AS b_accuracy,
    'wastage_risk' AS task
  FROM cc"""


def _segment_ctes(date: str) -> str:
    return m.customer_rfm_ctes() + "," + churn_at_ctes(date) + f""",
sg AS (
  SELECT rfm.{C}, rfm_segment AS a_segment_label,
    CASE WHEN h.r_score = 0 THEN 'Inactive' WHEN h.r_score >= 4 AND h.f_score >= 4 THEN 'Champions'
      WHEN h.r_score >= 3 AND h.f_score >= 3 THEN 'Loyal Customers'
      WHEN h.r_score >= 4 AND h.f_score <= 2 THEN 'New & Promising'
      WHEN h.r_score <= 2 AND h.f_score >= 3 THEN 'At Risk'
      WHEN h.r_score <= 2 AND h.f_score <= 2 THEN 'Hibernating' ELSE 'Need Attention' END AS b_segment_label
  FROM rfm JOIN churn h ON rfm.{C} = h.customer_id)"""


def comparison_oracles(splits: tuple[str, str, str]) -> dict[str, str]:
    demand = with_domain("sold", "menu", item="brand") + "," + _forecast_ctes(splits)
    risk = with_domain("sold", "waste", "menu", item="brand") + "," + _risk_ctes(splits)
    segments = with_domain("orders", "customers") + "," + _segment_ctes(splits[0])
    overall = (
        with_domain("sold", "waste", "menu", "customers", item="brand")
        + "," + _forecast_ctes(splits) + "," + _risk_ctes(splits) + "," + _segment_ctes(splits[0])
    )
    return {
        "agreement_regression": demand + " SELECT * FROM cmp",
        "agreement_regression_summary": demand
        + f" SELECT *, a_rmse <= b_rmse AS a_wins FROM ({_REG_SUMMARY})",
        "agreement_classes": risk + " SELECT * FROM cc",
        "agreement_classes_summary": risk
        + f" SELECT *, a_accuracy >= b_accuracy AS a_wins FROM ({_CLASS_SUMMARY})",
        "segment_contingency": segments
        + ' SELECT a_segment_label, b_segment_label, COUNT(*) AS "count" FROM sg GROUP BY 1, 2',
        "overall_agreement": overall
        + f""" SELECT COUNT(*) AS tasks, {whole('SUM(n)')} AS total_records_compared,
  {fixed('AVG(pct)', 2)} AS overall_agreement_pct
FROM (
  SELECT total_records_compared AS n, agreement_pct AS pct FROM ({_REG_SUMMARY})
  UNION ALL SELECT total_records_compared, agreement_pct FROM ({_CLASS_SUMMARY})
  UNION ALL SELECT COUNT(*),
    {fixed('AVG(CASE WHEN a_segment_label = b_segment_label THEN 1.0::DOUBLE ELSE 0.0 END) * 100.0', 2)} FROM sg)""",
    }


def feature_oracles(splits: tuple[str, str, str], cutoffs: dict[str, str]) -> dict[str, str]:
    return {
        "weekly_demand_features": weekly_demand_features(splits),
        "weekly_demand_features_full": weekly_demand_features_full(splits),
        "waste_features": waste_features(),
        "waste_features_full": waste_features_full(splits),
        "churn_features": churn_features(),
        "churn_features_at": churn_features_at(splits[0]),
        "churn_features_at_spread": churn_features_at(splits[0]),
        "churn_panel_features": churn_panel(cutoffs),
        "chronological_split": with_domain("orders")
        + f""" SELECT {_split('order_date', splits)} AS split, COUNT(*) AS orders,
  {text('MIN(order_date)')} AS first_day, {text('MAX(order_date)')} AS last_day
FROM valid_orders GROUP BY 1""",
        "order_settlement": order_settlement(),
    }


def _sub(sql: str) -> str:
    return f"({sql})"


def _total(column: str) -> str:
    return money(f"SUM(CAST(round({column} * 100) AS BIGINT))") + f" / 100.0 AS {column}"


def serving_oracles(splits: tuple[str, str, str], scenarios: list) -> dict[str, str]:
    location, channel = _sub(m.location_performance()), _sub(m.channel_performance())
    rfm, waste = _sub(m.customer_rfm()), _sub(m.wastage())
    orders = with_domain("orders", "restaurants")
    peak = _sub(m.peak_analysis("valid_orders", "d_restaurants", orders))
    sales = _sub(m.sales_anomalies(orders, "valid_orders", "d_restaurants", False))
    menu = _sub(m.menu_performance(True))
    demand = with_domain("sold", "menu", item="brand") + "," + _forecast_ctes(splits)
    risk = with_domain("sold", "waste", "menu", item="brand") + "," + _risk_ctes(splits)
    pct = lambda n: f"CASE WHEN rev > 0 THEN {fixed(f'{n} / rev * 100.0', 2)} ELSE 0.0 END"
    cents = lambda c: f"CAST(SUM(CAST(round({c} * 100) AS BIGINT)) AS BIGINT)"
    error = "abs(actual_quantity - b_prediction)"
    grid = ", ".join(
        f"('{s.name}', {s.price_change_pct}::DOUBLE, {s.discount_change_pct}::DOUBLE, {s.waste_reduction_pct}::DOUBLE)"
        for s in scenarios
    )
    return {
        "filter_options": f"""
SELECT DISTINCT 'location' AS "option", CAST({R} AS VARCHAR) AS value, location_name AS label FROM {location}
UNION SELECT DISTINCT 'category', p_type, lower(p_type) FROM part
UNION SELECT DISTINCT 'channel', order_channel, order_channel FROM {channel}""",
        "exec_kpis": f"""
SELECT rev AS total_revenue, n AS total_orders, cm AS contribution_margin, wc AS total_waste_cost,
  {fixed('rev / n', 2)} AS average_order_value, {pct('cm')} AS margin_percentage,
  {pct('wc')} AS waste_to_revenue_ratio, (SELECT COUNT(*) FROM {rfm}) AS active_customers,
  (SELECT COUNT(*) FROM {sales} WHERE is_spike_anomaly OR is_drop_anomaly) AS detected_anomalies_count
FROM (
  SELECT {cents('gross_revenue')} / 100.0 AS rev, {whole('SUM(total_orders)')} AS n,
    {cents('contribution_margin')} / 100.0 AS cm, {cents('total_waste_cost')} / 100.0 AS wc
  FROM {location})""",
        "menu_page": f"""
SELECT {R}, {I}, item_name, composite_score, classification FROM {menu}
WHERE category_name = 'economy' AND classification = 'Low Performer'
  AND (lower(item_name) LIKE '%in%' OR CAST({I} AS VARCHAR) LIKE '%in%')
ORDER BY composite_score DESC, {R}, {I} LIMIT 50 OFFSET 20""",
        "menu_class_counts": f"SELECT classification, COUNT(*) AS row_count FROM {menu} GROUP BY 1",
        "customer_page": f"""
SELECT * FROM {rfm} WHERE rfm_segment = 'At Risk' AND lower(customer_name) LIKE '%customer%'
ORDER BY monetary_value DESC, {C} LIMIT 25 OFFSET 5""",
        "segment_counts": f"SELECT rfm_segment, COUNT(*) AS row_count FROM {rfm} GROUP BY 1",
        "heatmap": f"""
SELECT day_of_week, hour_of_day, {whole('SUM(total_orders)')} AS total_orders FROM {peak} GROUP BY 1, 2""",
        "channel_breakdown": f"""
SELECT channel, {whole('SUM(total_orders)')} AS total_orders, {_total('net_revenue')},
  {_total('contribution_margin')} FROM {channel} GROUP BY 1""",
        "location_ranking": f"""
SELECT *, {fixed('contribution_margin / gross_revenue * 100.0', 2)} AS margin_pct FROM (
  SELECT {R}, location_name, city, dining_type, {whole('SUM(total_orders)')} AS total_orders,
    {_total('gross_revenue')}, {_total('contribution_margin')}, {_total('total_waste_cost')}
  FROM {location} GROUP BY 1, 2, 3, 4)""",
        "demand_curve": demand
        + f"""
SELECT week_start_date, split, {_total('actual_quantity')},
  {cents('b_prediction')} / 100.0 AS predicted_quantity,
  {fixed(f'{cents(fixed(error, 2))} / 100.0 / COUNT(*)', 4)} AS absolute_error
FROM cmp GROUP BY 1, 2""",
        "sensitivity_counts": f"""
SELECT sensitivity_class, COUNT(*) AS row_count FROM {_sub(m.pricing())} GROUP BY 1""",
        "waste_by_reason": f"""
SELECT primary_reason, {_total('waste_cost')}, {_total('waste_quantity')} FROM {waste} GROUP BY 1""",
        "high_risk_items": f"""
SELECT {I}, item_name, {_total('waste_cost')}, {_total('waste_quantity')},
  {whole('SUM(sold_quantity)')} AS sold_quantity
FROM (SELECT * FROM {waste}) w WHERE current_week_wastage_risk = 1 GROUP BY 1, 2
ORDER BY SUM(CAST(round(w.waste_cost * 100) AS BIGINT)) DESC, {I} LIMIT 20""",
        "weekly_waste_trend": f"""
SELECT calendar_year, calendar_week, {_total('waste_cost')}, {_total('waste_quantity')}
FROM {waste} GROUP BY 1, 2""",
        "risk_summary": risk
        + f"""
SELECT COUNT(*) AS total_evaluated, {whole('SUM(l)')} AS predicted_high_risk_count,
  {fixed('AVG(p)', 4)} AS avg_risk_probability, {fixed('AVG(l) * 100.0', 2)} AS high_risk_rate_pct
FROM rb""",
        "top_risk_items": risk
        + f""",
tr AS (
  SELECT menu_item_id, CAST(SUM(CAST(round(p * 10000) AS BIGINT)) AS BIGINT) / COUNT(*) / 10000.0 AS mr,
    {whole('SUM(l)')} AS alerts FROM rb GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25)
SELECT menu_item_id, item_name, {fixed('mr', 4)} AS risk_probability,
  CASE WHEN mr >= 0.5 OR alerts > 0 THEN 1 ELSE 0 END AS predicted_label,
  CASE WHEN mr >= 0.5 OR alerts > 0 THEN 'HIGH RISK' ELSE 'ELEVATED' END AS predicted_risk_status,
  alerts AS high_risk_alerts_count
FROM tr LEFT JOIN d_menu ON menu_item_id = {I}""",
        "promotion_summary": f"""
SELECT source_promotion_id, campaign_name, discount_type, is_promotion_trap,
  {whole('SUM(units_sold)')} AS units_sold, {_total('net_revenue')}, {_total('total_discount')},
  {_total('contribution_margin')} FROM {_sub(m.promotions())} GROUP BY 1, 2, 3, 4""",
        "top_pairs": f"""
SELECT * FROM {_sub(m.basket_analysis())}
ORDER BY lift DESC, co_occurrence_count DESC, item_a_id, item_b_id LIMIT 50""",
        "sales_anomaly_feed": f"""
SELECT * FROM {sales} WHERE is_spike_anomaly OR is_drop_anomaly
ORDER BY abs(z_score_revenue) DESC, order_date, {R} LIMIT 100""",
        "rating_anomaly_feed": f"""
SELECT * FROM {_sub(m.rating_anomalies('brand'))} WHERE is_rating_anomaly
ORDER BY z_score, week_start, {R}, {I} LIMIT 100""",
        "recommendations": _recommendations(menu, waste, rfm),
        "what_if_grid": _what_if(grid),
    }


def _recommendations(menu: str, waste: str, rfm: str) -> str:
    return f"""
(SELECT 'REC-MENU-' || {I} AS id, 'Menu Optimization' AS domain, item_name || ' (' || {I} || ')' AS target,
  printf('%d units sold at a contribution margin of $%.2f', total_quantity, contribution_margin) AS observation,
  printf('Revenue $%.2f, unit cost $%.2f, margin $%.2f', gross_revenue, current_base_cost, contribution_margin) AS evidence,
  'Demand is there, but each sale loses money' AS interpretation,
  'Raise the price by 10-15% or lower the food cost' AS recommendation, 'Critical' AS priority,
  printf('+$%.2f margin', abs(contribution_margin)) AS expected_impact
FROM {menu} WHERE flag_high_selling_loss_making ORDER BY contribution_margin, {I}, {R} LIMIT 5)
UNION ALL
(SELECT 'REC-WASTE-' || {I}, 'Operational Wastage', item_name || ' (' || {I} || ')',
  printf('$%.2f wasted in high-risk weeks', c),
  printf('Waste cost $%.2f, mean cost ratio %.1f%%', c, pct),
  'More is prepared than is sold in these weeks',
  'Size daily batches by the demand forecast', 'High',
  printf('$%.2f saved at 30%% less waste', {fixed('c * CAST(0.30 AS DOUBLE)', 2)})
FROM (
  SELECT {I}, item_name, CAST(SUM(CAST(round(waste_cost * 100) AS BIGINT)) AS BIGINT) / 100.0 AS c,
    {fixed('coalesce(CAST(SUM(CAST(round(waste_cost_ratio * 10000) AS BIGINT)) AS DOUBLE) / COUNT(waste_cost_ratio) / 100.0, 0.0)', 1)} AS pct
  FROM {waste} WHERE current_week_wastage_risk = 1 AND {I} IS NOT NULL GROUP BY 1, 2)
ORDER BY c DESC, {I} LIMIT 5)
UNION ALL
(SELECT 'REC-CHURN-' || {C}, 'Customer Retention', customer_name || ' (' || {C} || ')',
  printf('No order for %d days', recency_days),
  printf('%d orders, $%.2f spent, %d days inactive', frequency, monetary_value, recency_days),
  'A good customer has stopped coming',
  'Send a win-back offer on the preferred channel', 'Medium',
  printf('$%.2f of past spend at stake', monetary_value)
FROM {rfm} WHERE rfm_segment = 'At Risk' ORDER BY monetary_value DESC, {C} LIMIT 5)"""


def _what_if(grid: str) -> str:
    menu, pricing = _sub(m.menu_performance(False, "brand")), _sub(m.pricing())
    rounded = {
        "elasticity_applied": ("e", 3),
        "base_price": ("p", 2),
        "base_cost": ("k", 2),
        "revenue": ("p * v", 2),
        "contribution_margin": ("(p - k) * v", 2),
        "estimated_price": ("np", 2),
        "estimated_revenue": ("np * nv", 2),
        "estimated_contribution_margin": ("(np - k) * nv + saved", 2),
        "revenue_delta": ("np * nv - p * v", 2),
        "margin_delta": ("((np - k) * nv + saved) - (p - k) * v", 2),
        "volume_delta_pct": ("dq * 100", 2),
    }
    shown = ", ".join(f"{fixed(expr, n)} AS {name}" for name, (expr, n) in rounded.items())
    return f"""
WITH g AS (SELECT * FROM (VALUES {grid}) t(scenario, dp, dd, wr)),
el AS (
  SELECT {I}, arg_max(elasticity, ROW(effective_from, source_pricing_history_id)) AS e
  FROM {pricing} WHERE elasticity IS NOT NULL GROUP BY 1),
b AS (
  SELECT u.{I}, item_name, scenario, coalesce(nullif(current_base_price, 0), 15.0) AS p,
    coalesce(nullif(current_base_cost, 0), 6.0) AS k, coalesce(nullif(total_quantity, 0), 1000) AS v,
    coalesce(e, CAST(-0.85 AS DOUBLE)) AS e, dp, dd, wr
  FROM {menu} u LEFT JOIN el ON u.{I} = el.{I}, g),
q AS (SELECT *, e * (dp / 100.0) - (e * 0.5::DOUBLE) * (dd / 100.0) AS dq FROM b),
n AS (
  SELECT *, p * (1.0 + dp / 100.0) AS np, greatest(0, CAST(trunc(v * (1.0 + dq)) AS BIGINT)) AS nv,
    (k * v * 0.05::DOUBLE) * (wr / 100.0) AS saved FROM q)
SELECT {I}, item_name, scenario, v AS base_volume, nv AS estimated_volume, {shown} FROM n"""
