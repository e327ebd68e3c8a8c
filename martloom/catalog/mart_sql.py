"""Oracle SQL of the twelve marts."""

from __future__ import annotations

from martloom.catalog.domain_sql import fixed, money, text, whole, with_domain

R, I = "source_restaurant_id", "source_menu_item_id"


def _week(ts: str) -> str:
    return f"CAST(date_trunc('week', {ts}) AS DATE)"


def _month(ts: str) -> str:
    return f"CAST(date_trunc('month', {ts}) AS DATE)"


def channel_performance() -> str:
    return (
        with_domain("sold")
        + f""",
h AS (
  SELECT {R}, order_channel, {_month('order_timestamp')} AS m, COUNT(*) AS total_orders,
    {money('SUM(subtotal_amount)')} AS gross_amount, {money('SUM(discount_amount)')} AS discount_amount,
    {money('SUM(total_amount)')} AS net_revenue, {money('SUM(tip_amount)')} AS tip_amount
  FROM valid_orders GROUP BY ALL),
l AS (
  SELECT {R}, order_channel, {_month('order_timestamp')} AS m,
    {money('SUM(line_contribution_margin)')} AS cm
  FROM sold GROUP BY ALL)
SELECT h.{R}, h.order_channel, h.order_channel AS channel, {text('h.m')} AS order_month,
  total_orders, gross_amount, discount_amount, net_revenue, tip_amount,
  {fixed('net_revenue / total_orders', 2)} AS avg_order_value,
  {fixed('discount_amount / greatest(1.0, gross_amount)', 4)} AS discount_rate,
  coalesce(cm, 0.0) AS contribution_margin,
  CASE WHEN net_revenue > 0 THEN {fixed('coalesce(cm, 0.0) / net_revenue', 4)} ELSE 0.0 END AS margin_pct,
  {fixed(f'CAST(total_orders AS DOUBLE) / SUM(total_orders) OVER (PARTITION BY h.{R}, h.m)', 4)} AS order_share_pct
FROM h LEFT JOIN l ON h.{R} = l.{R} AND h.order_channel = l.order_channel AND h.m = l.m"""
    )


def peak_analysis(orders: str, branches: str, prefix: str) -> str:
    ts = "order_timestamp"
    return (
        prefix
        + f""",
h AS (
  SELECT {R}, CAST(dayofweek({ts}) + 1 AS INTEGER) AS day_number, dayname({ts}) AS day_of_week,
    CAST(hour({ts}) AS INTEGER) AS hour_of_day, COUNT(*) AS total_orders,
    {money('SUM(total_amount)')} AS gross_revenue
  FROM {orders} GROUP BY ALL),
k AS (
  SELECT h.*, dense_rank() OVER (PARTITION BY {R} ORDER BY total_orders DESC) AS restaurant_hour_rank
  FROM h)
SELECT k.*, location_name, city, dining_type, seating_capacity,
  {fixed('gross_revenue / total_orders', 2)} AS avg_order_value,
  CASE WHEN hour_of_day BETWEEN 7 AND 10 THEN 'Breakfast Rush'
    WHEN hour_of_day BETWEEN 12 AND 14 THEN 'Lunch Rush'
    WHEN hour_of_day BETWEEN 18 AND 21 THEN 'Dinner Rush'
    WHEN hour_of_day >= 22 OR hour_of_day <= 4 THEN 'Late Night' ELSE 'Off-Peak' END AS rush_period,
  CASE WHEN seating_capacity > 0
    THEN {fixed('CAST(total_orders AS DOUBLE) / seating_capacity', 4)} ELSE 0.0 END
    AS capacity_utilization_pct,
  restaurant_hour_rank <= 5 AS is_peak_hour
FROM k LEFT JOIN {branches} b ON k.{R} = b.{R}""".replace(
            "SELECT k.*,", f"SELECT k.{R}, day_number, day_of_week, hour_of_day, total_orders, "
            "gross_revenue, restaurant_hour_rank,"
        )
    )


def location_performance() -> str:
    return (
        with_domain("sold", "ratings", "waste", "restaurants")
        + f""",
h AS (
  SELECT {R}, {_month('order_timestamp')} AS m, COUNT(DISTINCT source_order_id) AS total_orders,
    COUNT(DISTINCT source_customer_id) AS unique_customers,
    {money('SUM(subtotal_amount)')} AS gross_revenue,
    {money('SUM(discount_amount)')} AS total_discount,
    {money('SUM(total_amount)')} AS total_net_revenue, {money('SUM(tip_amount)')} AS total_tips
  FROM valid_orders GROUP BY ALL),
l AS (
  SELECT {R}, {_month('order_timestamp')} AS m, {whole('SUM(quantity)')} AS total_items_sold,
    {money('SUM(line_contribution_margin)')} AS contribution_margin FROM sold GROUP BY ALL),
t AS (
  SELECT {R}, {_month('rating_timestamp')} AS m, COUNT(*) AS total_ratings,
    {fixed('AVG(rating_score)', 2)} AS avg_rating FROM d_ratings GROUP BY ALL),
w AS (
  SELECT {R}, {_month('wastage_timestamp')} AS m,
    SUM(CASE WHEN {I} IS NOT NULL THEN cost_loss_amount ELSE 0 END) AS dish,
    SUM(CASE WHEN {I} IS NULL THEN cost_loss_amount ELSE 0 END) AS raw FROM d_waste GROUP BY ALL),
j AS (
  SELECT h.*, total_items_sold, contribution_margin, coalesce(total_ratings, 0) AS total_ratings,
    coalesce(avg_rating, 4.0) AS avg_rating, {money('coalesce(dish, 0)')} AS dish_waste_cost,
    {money('coalesce(raw, 0)')} AS raw_ingredient_waste_cost,
    {money('coalesce(dish + raw, 0)')} AS total_waste_cost
  FROM h LEFT JOIN l ON h.{R} = l.{R} AND h.m = l.m
  LEFT JOIN t ON h.{R} = t.{R} AND h.m = t.m LEFT JOIN w ON h.{R} = w.{R} AND h.m = w.m)
SELECT j.{R}, {text('m')} AS order_month, total_orders, unique_customers, gross_revenue,
  total_discount, total_net_revenue, total_tips,
  {fixed('total_net_revenue / total_orders', 2)} AS avg_order_value, total_items_sold,
  contribution_margin, total_ratings, avg_rating, dish_waste_cost, raw_ingredient_waste_cost,
  total_waste_cost,
  CASE WHEN total_net_revenue > 0 THEN {fixed('contribution_margin / total_net_revenue', 4)}
    ELSE 0.0 END AS margin_percentage,
  CASE WHEN total_net_revenue > 0 THEN {fixed('total_waste_cost / total_net_revenue', 4)}
    ELSE 0.0 END AS waste_to_revenue_ratio,
  location_name, city, state_region, dining_type, seating_capacity,
  {text('opening_date')} AS opening_date,
  dense_rank() OVER (PARTITION BY m ORDER BY total_net_revenue DESC) AS revenue_rank,
  dense_rank() OVER (PARTITION BY m ORDER BY contribution_margin DESC NULLS LAST) AS margin_rank
FROM j LEFT JOIN d_restaurants r ON j.{R} = r.{R}"""
    )


def customer_rfm_ctes() -> str:
    return f"""
cust AS (
  SELECT source_customer_id, MAX(order_date) AS last_order_date, MIN(order_date) AS first_order_date,
    COUNT(DISTINCT source_order_id) AS frequency, {money('SUM(total_amount)')} AS monetary_value
  FROM valid_orders WHERE source_customer_id IS NOT NULL GROUP BY 1),
dated AS (
  SELECT cust.*, CAST(ref - last_order_date AS INTEGER) AS recency_days,
    CAST(ref - first_order_date AS INTEGER) AS customer_tenure_days,
    {fixed('monetary_value / frequency', 2)} AS avg_order_value
  FROM cust, (SELECT MAX(order_date) AS ref FROM valid_orders)),
scored AS (
  SELECT *, ntile(5) OVER (ORDER BY recency_days DESC, source_customer_id) AS r,
    ntile(5) OVER (ORDER BY frequency, source_customer_id) AS f,
    ntile(5) OVER (ORDER BY monetary_value, source_customer_id) AS m
  FROM dated),
rfm AS (
  SELECT c.source_customer_id, customer_name, loyalty_tier, preferred_channel, home_city,
    last_order_date, first_order_date, coalesce(frequency, 0) AS frequency,
    coalesce(monetary_value, 0.0) AS monetary_value, coalesce(recency_days, 999) AS recency_days,
    customer_tenure_days, avg_order_value, CAST(coalesce(r, 1) AS INTEGER) AS r_score,
    CAST(coalesce(f, 1) AS INTEGER) AS f_score, CAST(coalesce(m, 1) AS INTEGER) AS m_score,
    CASE WHEN r IS NULL THEN 'Inactive' WHEN r >= 4 AND f >= 4 THEN 'Champions'
      WHEN r >= 3 AND f >= 3 THEN 'Loyal Customers' WHEN r >= 4 AND f <= 2 THEN 'New & Promising'
      WHEN r <= 2 AND f >= 3 THEN 'At Risk' WHEN r <= 2 AND f <= 2 THEN 'Hibernating'
      ELSE 'Need Attention' END AS rfm_segment
  FROM d_customers c LEFT JOIN scored s ON c.source_customer_id = s.source_customer_id)"""


def customer_rfm() -> str:
    return (
        with_domain("orders", "customers")
        + ","
        + customer_rfm_ctes()
        + f"""
SELECT * REPLACE ({text('last_order_date')} AS last_order_date,
  {text('first_order_date')} AS first_order_date) FROM rfm"""
    )


def menu_ctes(by_restaurant: bool) -> str:
    keys = f"{R}, {I}" if by_restaurant else I
    on = lambda a, b: f"{a}.{I} = {b}.{I}" + (f" AND {a}.{R} = {b}.{R}" if by_restaurant else "")
    ratio = lambda n, d: f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) ELSE 0.0 END"
    rank = lambda c: f"percent_rank() OVER (ORDER BY {c}) * 100.0"
    divergence = (
        f"MIN(classification) OVER (PARTITION BY cl.{I}) <> MAX(classification) OVER (PARTITION BY cl.{I})"
        if by_restaurant
        else "FALSE"
    )
    return f"""
mid AS (SELECT MIN(epoch(order_timestamp)) + (MAX(epoch(order_timestamp)) - MIN(epoch(order_timestamp))) / 2.0 AS t
  FROM valid_orders),
s AS (
  SELECT {keys}, {whole('SUM(quantity)')} AS total_quantity,
    {money('SUM(line_net_revenue)')} AS gross_revenue,
    {money('SUM(line_contribution_margin)')} AS contribution_margin,
    {whole("SUM(CASE WHEN dayofweek(order_timestamp) IN (0, 5, 6) THEN quantity ELSE 0 END)")} AS weekend_quantity,
    {whole('SUM(CASE WHEN source_promotion_id IS NOT NULL THEN quantity ELSE 0 END)')} AS promo_quantity,
    COUNT(DISTINCT source_customer_id) AS total_customers,
    MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date,
    {whole('SUM(CASE WHEN epoch(order_timestamp) >= t THEN quantity ELSE 0 END)')} AS recent
  FROM sold, mid GROUP BY {keys}),
rep AS (
  SELECT {keys}, COUNT(CASE WHEN n >= 2 THEN source_customer_id END) AS repeat_customers FROM (
    SELECT {keys}, source_customer_id, COUNT(DISTINCT source_order_id) AS n FROM sold
    GROUP BY {keys}, source_customer_id) GROUP BY {keys}),
w AS (
  SELECT {keys}, {money('SUM(quantity_lost)')} AS waste_quantity,
    {money('SUM(cost_loss_amount)')} AS waste_cost
  FROM d_waste WHERE {I} IS NOT NULL GROUP BY {keys}),
g AS (
  SELECT {keys}, COUNT(*) AS rating_count, {fixed('AVG(rating_score)', 2)} AS avg_rating
  FROM d_ratings WHERE {I} IS NOT NULL GROUP BY {keys}),
base AS (
  SELECT s.* EXCLUDE (recent), repeat_customers,
    {fixed('recent / greatest(1.0, CAST(total_quantity - recent AS DOUBLE))', 4)} AS sales_trend_ratio,
    coalesce(waste_quantity, 0.0) AS waste_quantity, coalesce(waste_cost, 0.0) AS waste_cost,
    coalesce(rating_count, 0) AS rating_count, coalesce(avg_rating, 4.0) AS avg_rating
  FROM s LEFT JOIN rep ON {on('s', 'rep')} LEFT JOIN w ON {on('s', 'w')} LEFT JOIN g ON {on('s', 'g')}),
st AS (
  SELECT base.*, {ratio('contribution_margin', 'gross_revenue')} AS profitability_pct,
    {ratio('weekend_quantity', 'total_quantity')} AS weekend_share,
    {ratio('promo_quantity', 'total_quantity')} AS promotion_dependency,
    {ratio('repeat_customers', 'total_customers')} AS repeat_purchase_rate,
    {ratio('waste_quantity', '(total_quantity + waste_quantity)')} AS wastage_pct,
    CAST(last_order_date - first_order_date + 1 AS INTEGER) AS active_days
  FROM base),
rk AS (
  SELECT *, {rank('total_quantity')} AS rq, {rank('gross_revenue')} AS rr,
    {rank('contribution_margin')} AS rm, {rank('profitability_pct')} AS rp,
    {rank('avg_rating')} AS rt, {rank('repeat_purchase_rate')} AS rc, {rank('wastage_pct')} AS rw,
    {rank('promotion_dependency')} AS rd, {rank('sales_trend_ratio')} AS rs
  FROM st),
sc AS (
  SELECT * EXCLUDE (rq, rr, rm, rp, rt, rc, rw, rd, rs),
    {fixed('0.5 * rq + 0.5 * rr', 2)} AS demand_score,
    {fixed('0.5 * rm + 0.5 * rp', 2)} AS profitability_score,
    {fixed('0.6 * rt + 0.4 * rc', 2)} AS customer_signal_score,
    {fixed('100.0 - rw', 2)} AS wastage_health_score, {fixed('rs', 2)} AS sales_trend_score,
    {fixed('100.0 - rd', 2)} AS promotion_independence_score
  FROM rk),
cl AS (
  SELECT *,
    {fixed("CAST(0.25 AS DOUBLE) * demand_score + CAST(0.25 AS DOUBLE) * profitability_score + CAST(0.15 AS DOUBLE) * customer_signal_score + CAST(0.15 AS DOUBLE) * wastage_health_score + CAST(0.10 AS DOUBLE) * sales_trend_score + CAST(0.10 AS DOUBLE) * promotion_independence_score", 2)} AS composite_score,
    CASE WHEN demand_score >= 75 AND profitability_score >= 75 AND wastage_health_score >= 25
        AND promotion_independence_score >= 25 THEN 'Profit Driver'
      WHEN demand_score >= 75 AND profitability_score < 75 THEN 'Volume Driver'
      WHEN demand_score < 75 AND (profitability_score >= 75 OR customer_signal_score >= 75)
        AND wastage_health_score >= 25 THEN 'Hidden Opportunity'
      ELSE 'Low Performer' END AS classification
  FROM sc),
menu AS (
  SELECT cl.*, source_category_id, item_name, current_base_price, current_base_cost, is_seasonal,
    prep_time_minutes, category_name,
    demand_score >= 75 AND (contribution_margin <= 0 OR profitability_score <= 25)
      AS flag_high_selling_loss_making,
    profitability_score >= 75 AND demand_score <= 25 AS flag_profitable_rarely_purchased,
    demand_score >= 75 AND wastage_health_score <= 25 AS flag_popular_high_wastage,
    avg_rating >= 4.2 AND profitability_score <= 25 AS flag_high_rating_low_profitability,
    avg_rating <= 3.0 AND demand_score >= 75 AS flag_low_rating_high_sales,
    promotion_dependency >= 0.5 AS flag_promotion_dependent,
    weekend_share >= 0.6 AS flag_weekend_only_pattern,
    coalesce(is_seasonal, FALSE) AS flag_seasonal_item,
    active_days < 30 AS flag_new_item_insufficient_history,
    {divergence} AS flag_location_divergence
  FROM cl LEFT JOIN d_menu d ON cl.{I} = d.{I})"""


def menu_performance(by_restaurant: bool = True, item: str = "part") -> str:
    return (
        with_domain("sold", "ratings", "waste", "menu", item=item)
        + ","
        + menu_ctes(by_restaurant)
        + f"""
SELECT * REPLACE ({text('first_order_date')} AS first_order_date,
  {text('last_order_date')} AS last_order_date) FROM menu"""
    )


def basket_analysis(min_count: int = 5, item: str = "brand") -> str:
    ratio = lambda n, d: fixed(f"CAST({n} AS DOUBLE) / {d}", 4)
    return (
        with_domain("items", "menu", item=item)
        + f""",
members AS (SELECT DISTINCT source_order_id AS o, {I} AS i FROM d_items),
multi AS (SELECT o FROM members GROUP BY o HAVING COUNT(*) >= 2),
kept AS (SELECT m.* FROM members m JOIN multi USING (o)),
n AS (SELECT i, COUNT(*) AS n FROM kept GROUP BY i),
total AS (SELECT CAST(greatest(COUNT(*), 1) AS DOUBLE) AS t FROM multi),
pairs AS (
  SELECT a.i AS item_a_id, b.i AS item_b_id, COUNT(*) AS co_occurrence_count
  FROM kept a JOIN kept b ON a.o = b.o AND a.i < b.i GROUP BY 1, 2 HAVING COUNT(*) >= {min_count})
SELECT item_a_id, item_b_id, co_occurrence_count, {ratio('na.n', 't')} AS support_a,
  {ratio('nb.n', 't')} AS support_b, {ratio('co_occurrence_count', 't')} AS support_ab,
  {ratio('co_occurrence_count', 'na.n')} AS confidence_a_to_b,
  {ratio('co_occurrence_count', 'nb.n')} AS confidence_b_to_a,
  {fixed('(co_occurrence_count * t) / (na.n * nb.n)', 4)} AS lift,
  ma.item_name AS item_a_name, mb.item_name AS item_b_name
FROM total, pairs JOIN n na ON item_a_id = na.i JOIN n nb ON item_b_id = nb.i
LEFT JOIN d_menu ma ON item_a_id = ma.{I} LEFT JOIN d_menu mb ON item_b_id = mb.{I}"""
    )


def waste_ctes() -> str:
    both = f"{R}, {I}"
    total = lambda c: money(f"SUM({c})")

    def weekly(keys: str, cond: str) -> str:
        return f"""
  SELECT {keys}, wk, {total('q')} AS waste_quantity, {total('c')} AS waste_cost,
    arg_min(wastage_reason, ROW(-c, wastage_reason)) AS primary_reason
  FROM (
    SELECT {keys}, {_week('wastage_timestamp')} AS wk, wastage_reason, SUM(quantity_lost) AS q,
      SUM(cost_loss_amount) AS c
    FROM d_waste WHERE {cond} GROUP BY ALL)
  GROUP BY {keys}, wk"""

    return f"""
dw AS ({weekly(both, f'{I} IS NOT NULL')}),
rw AS ({weekly(f'{R}, ingredient_name', f'{I} IS NULL')}),
sw AS (
  SELECT {both}, {_week('order_timestamp')} AS wk, {whole('SUM(quantity)')} AS sold_quantity,
    {money('SUM(line_net_revenue)')} AS gross_revenue FROM sold GROUP BY ALL),
du AS (
  SELECT coalesce(sw.{R}, dw.{R}) AS {R}, coalesce(sw.{I}, dw.{I}) AS {I},
    coalesce(sw.wk, dw.wk) AS wk, coalesce(waste_quantity, 0.0) AS waste_quantity,
    coalesce(waste_cost, 0.0) AS waste_cost, coalesce(primary_reason, 'None') AS primary_reason,
    coalesce(sold_quantity, 0) AS sold_quantity, coalesce(gross_revenue, 0.0) AS gross_revenue
  FROM sw FULL JOIN dw ON sw.{R} = dw.{R} AND sw.{I} = dw.{I} AND sw.wk = dw.wk),
dr AS (
  SELECT *,
    CASE WHEN gross_revenue > 0 THEN {fixed('waste_cost / gross_revenue', 4)} END AS waste_cost_ratio,
    CASE WHEN sold_quantity > 0 THEN {fixed('waste_quantity / sold_quantity', 4)} END
      AS waste_quantity_ratio,
    waste_quantity > 0 AND sold_quantity <= 0 AS extreme_operational_risk
  FROM du),
dl AS (
  SELECT *, CASE WHEN extreme_operational_risk OR coalesce(waste_cost_ratio, 0.0) > 0.05
    OR coalesce(waste_quantity_ratio, 0.0) > 0.10 THEN 1 ELSE 0 END AS current_week_wastage_risk
  FROM dr),
waste AS (
  SELECT dl.{R}, dl.{I}, 'PREPARED_DISH' AS item_type, CAST(NULL AS VARCHAR) AS ingredient_name, wk,
    waste_quantity, waste_cost, primary_reason, sold_quantity, gross_revenue, waste_cost_ratio,
    waste_quantity_ratio, extreme_operational_risk, current_week_wastage_risk,
    CASE WHEN LEAD(wk) OVER z = wk + 7 THEN LEAD(current_week_wastage_risk) OVER z ELSE 0 END
      AS next_week_wastage_risk,
    item_name, source_category_id, current_base_cost
  FROM dl LEFT JOIN d_menu m ON dl.{I} = m.{I}
  WINDOW z AS (PARTITION BY dl.{R}, dl.{I} ORDER BY wk)
  UNION ALL
  SELECT {R}, NULL, 'RAW_INGREDIENT', ingredient_name, wk, waste_quantity, waste_cost,
    primary_reason, 0, 0.0, NULL, NULL, FALSE, 0, 0, NULL, NULL, NULL FROM rw)"""


def wastage(item: str = "part") -> str:
    return (
        with_domain("sold", "waste", "menu", item=item)
        + ","
        + waste_ctes()
        + f"""
SELECT * EXCLUDE (wk), {text('wk')} AS week_start, CAST(isoyear(wk) AS INTEGER) AS calendar_year,
  CAST(week(wk) AS INTEGER) AS calendar_week FROM waste"""
    )


def pricing_ctes() -> str:
    pre = "order_date < d"
    mean = lambda c: fixed(
        f"CAST(SUM(CASE WHEN {c} THEN unit_price_at_sale END) AS DOUBLE) / COUNT(CASE WHEN {c} THEN 1 END)", 2
    )
    qty = lambda c: f"CAST(coalesce(SUM(CASE WHEN {c} THEN quantity END), 0) AS BIGINT)"
    return f"""
ev AS (SELECT *, CAST(effective_from AS DATE) AS d FROM d_prices),
mt AS (
  SELECT source_pricing_history_id, {qty(pre)} AS pre_quantity, {mean(pre)} AS pre_mean,
    {qty('order_date >= d')} AS post_quantity, {mean('order_date >= d')} AS post_mean,
    COUNT(source_promotion_id) > 0 AS promotion_overlap
  FROM ev LEFT JOIN sold s ON ev.{I} = s.{I} AND (ev.{R} IS NULL OR ev.{R} = s.{R})
    AND order_date BETWEEN d - 28 AND d + 27
  GROUP BY 1),
pp AS (
  SELECT ev.source_pricing_history_id, {I}, {R}, base_price, d, pre_quantity, post_quantity,
    promotion_overlap, coalesce(pre_mean, {fixed('base_price * CAST(0.95 AS DOUBLE)', 2)}) AS pre_price,
    coalesce(post_mean, base_price) AS post_price
  FROM ev JOIN mt USING (source_pricing_history_id)),
el AS (
  SELECT *, CASE WHEN pre_quantity > 0 AND pre_price > 0
      AND abs((post_price - pre_price) / pre_price) > 1e-6
    THEN {fixed('(CAST(post_quantity - pre_quantity AS DOUBLE) / pre_quantity) / ((post_price - pre_price) / pre_price)', 4)}
    END AS elasticity
  FROM pp),
prices AS (
  SELECT el.*, CASE WHEN abs(elasticity) >= 1.5 THEN 'High' WHEN abs(elasticity) >= 0.75
    THEN 'Moderate' ELSE 'Low' END AS sensitivity_class, item_name
  FROM el LEFT JOIN d_menu m ON el.{I} = m.{I})"""


def pricing(item: str = "brand") -> str:
    return (
        with_domain("sold", "prices", "menu", item=item)
        + ","
        + pricing_ctes()
        + f"""
SELECT * EXCLUDE (d), {text('d')} AS effective_from, {text('d - 28')} AS pre_window_start,
  {text('d + 27')} AS post_window_end FROM prices"""
    )


def promotions_ctes() -> str:
    return f"""
ps AS (
  SELECT source_promotion_id, {R}, COUNT(*) AS redemption_count,
    {whole('SUM(quantity)')} AS units_sold, COUNT(DISTINCT source_order_id) AS unique_orders,
    COUNT(DISTINCT source_customer_id) AS unique_customers,
    {money('SUM(line_discount)')} AS total_discount, {money('SUM(line_net_revenue)')} AS net_revenue,
    {money('SUM(line_contribution_margin)')} AS contribution_margin
  FROM sold WHERE source_promotion_id IS NOT NULL GROUP BY 1, 2),
pm AS (
  SELECT *, {fixed('contribution_margin / greatest(1.0, net_revenue)', 4)} AS margin_percentage,
    {fixed('total_discount / greatest(1.0, CAST(units_sold AS DOUBLE))', 2)} AS avg_discount_per_item
  FROM ps),
promo AS (
  SELECT pm.*, campaign_name, discount_type, discount_value, start_date, end_date, is_misleading,
    (redemption_count >= 50 AND (contribution_margin <= 0 OR margin_percentage < 0.10))
      OR (is_misleading AND contribution_margin < 0) AS is_promotion_trap
  FROM pm JOIN d_promotions USING (source_promotion_id))"""


def promotions() -> str:
    return (
        with_domain("sold", "promotions")
        + ","
        + promotions_ctes()
        + f"""
SELECT * REPLACE ({text('start_date')} AS start_date, {text('end_date')} AS end_date) FROM promo"""
    )


def _exact_std(col: str, over: str) -> str:
    c = f"CAST(round({col} * 100) AS HUGEINT)"
    n = f"COUNT({col}) {over}"
    return (
        f"CASE WHEN {n} > 1 THEN sqrt(CAST({n} * SUM({c} * {c}) {over} - SUM({c}) {over} * SUM({c}) {over} "
        f"AS DOUBLE) / CAST({n} * ({n} - 1) AS DOUBLE)) / 100.0 END"
    )


def rating_anomalies(item: str = "part") -> str:
    over = f"OVER (PARTITION BY {I})"
    return (
        with_domain("sold", "ratings", "menu", item=item)
        + f""",
wr AS (
  SELECT {R}, {I}, {_week('rating_timestamp')} AS wk, COUNT(*) AS rating_count,
    {fixed('AVG(rating_score)', 2)} AS mean_rating,
    {fixed('coalesce(stddev_samp(rating_score), 0.0)', 2)} AS std_rating,
    MIN(rating_score) AS min_rating, MAX(rating_score) AS max_rating,
    COUNT(CASE WHEN rating_score <= 2 THEN 1 END) AS negative_ratings_count
  FROM d_ratings WHERE {I} IS NOT NULL GROUP BY ALL),
v AS (
  SELECT {R}, {I}, {_week('order_timestamp')} AS wk, {whole('SUM(quantity)')} AS vol
  FROM sold GROUP BY ALL),
j AS (
  SELECT wr.*, coalesce(vol, 0) AS total_volume_sold FROM wr
  LEFT JOIN v ON wr.{R} = v.{R} AND wr.{I} = v.{I} AND wr.wk = v.wk),
b AS (
  SELECT j.*, CAST(SUM(CAST(round(mean_rating * 100) AS BIGINT)) {over} AS DOUBLE) / 100.0
      / COUNT(*) {over} AS im,
    coalesce({_exact_std('mean_rating', over)}, 0.5) AS sd
  FROM j),
z AS (
  SELECT *, {fixed('(mean_rating - im) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END', 2)} AS z_score,
    {fixed('CAST(negative_ratings_count AS DOUBLE) / rating_count', 4)} AS negative_rating_rate FROM b)
SELECT z.* EXCLUDE (wk, im, sd), {text('wk')} AS week_start,
  CAST(isoyear(wk) AS INTEGER) AS calendar_year, CAST(week(wk) AS INTEGER) AS calendar_week,
  z_score < -1.5 OR (mean_rating <= 3.0 AND total_volume_sold >= 20) OR negative_rating_rate > 0.30
    AS is_rating_anomaly,
  CASE WHEN z_score < -1.5 THEN 'Statistically Low Rating'
    WHEN mean_rating <= 3.0 AND total_volume_sold >= 20 THEN 'High Volume Poor Quality'
    WHEN negative_rating_rate > 0.30 THEN 'Excessive Negative Feedback' ELSE 'Normal' END
    AS anomaly_reason,
  item_name, source_category_id, current_base_price
FROM z LEFT JOIN d_menu m ON z.{I} = m.{I}"""
    )


def sales_ctes(orders: str, branches: str, fill: bool) -> str:
    over = f"OVER (PARTITION BY {R} ORDER BY order_date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"
    spine = f"""
daily AS (
  SELECT sp.{R}, CAST(sp.d AS DATE) AS order_date, coalesce(daily_orders, 0) AS daily_orders,
    coalesce(daily_revenue, 0.0) AS daily_revenue
  FROM (
    SELECT {R}, unnest(generate_series(MIN(order_date), (SELECT MAX(order_date) FROM daily0),
      INTERVAL 1 DAY)) AS d FROM daily0 GROUP BY 1) sp
  LEFT JOIN daily0 x ON sp.{R} = x.{R} AND CAST(sp.d AS DATE) = x.order_date)"""
    return f"""
daily0 AS (
  SELECT {R}, order_date, COUNT(*) AS daily_orders, {money('SUM(total_amount)')} AS daily_revenue
  FROM {orders} GROUP BY ALL),{spine if fill else 'daily AS (SELECT * FROM daily0)'},
rl AS (
  SELECT *,
    {fixed(f'CAST(SUM(CAST(round(daily_revenue * 100) AS HUGEINT)) {over} AS DOUBLE) / 100.0 / COUNT(*) {over}', 2)}
      AS rolling_mean_revenue,
    coalesce({fixed(_exact_std('daily_revenue', over), 2)}, 1.0) AS rolling_std_revenue
  FROM daily),
zs AS (
  SELECT *, CASE WHEN rolling_mean_revenue IS NOT NULL THEN
      {fixed('(daily_revenue - rolling_mean_revenue) / CASE WHEN rolling_std_revenue > 0 THEN rolling_std_revenue ELSE 1.0 END', 2)}
    ELSE 0.0 END AS z_score_revenue FROM rl),
sales AS (
  SELECT zs.*, rolling_mean_revenue IS NOT NULL AND z_score_revenue > 2.5 AS is_spike_anomaly,
    rolling_mean_revenue IS NOT NULL AND z_score_revenue < -2.5 AS is_drop_anomaly,
    daily_orders = 0 AS is_zero_sales,
    CASE WHEN daily_orders = 0 THEN 'Zero Sales Alert'
      WHEN rolling_mean_revenue IS NOT NULL AND z_score_revenue > 2.5 THEN 'Revenue Spike'
      WHEN rolling_mean_revenue IS NOT NULL AND z_score_revenue < -2.5 THEN 'Revenue Drop'
      ELSE 'Normal' END AS anomaly_type,
    location_name, city, dining_type
  FROM zs LEFT JOIN {branches} r ON zs.{R} = r.{R})"""


def sales_anomalies(prefix: str, orders: str, branches: str, fill: bool) -> str:
    return (
        prefix
        + ","
        + sales_ctes(orders, branches, fill)
        + f"""
SELECT * REPLACE ({text('order_date')} AS order_date) FROM sales"""
    )


def demand_ctes(splits: tuple[str, str, str]) -> str:
    keys = f"{R}, {I}"
    return f"""
dd AS (
  SELECT {keys}, order_date, {whole('SUM(quantity)')} AS historical_demand,
    {money('SUM(line_net_revenue)')} AS gross_revenue,
    COUNT(DISTINCT source_order_id) AS order_count
  FROM sold GROUP BY ALL),
df AS (
  SELECT *, dayname(order_date) AS day_of_week, CAST(dayofweek(order_date) + 1 AS INTEGER) AS day_of_week_num,
    CAST(day(order_date) AS INTEGER) AS day_of_month, CAST(month(order_date) AS INTEGER) AS month,
    dayofweek(order_date) IN (0, 5, 6) AS is_weekend,
    CASE WHEN order_date <= DATE '{splits[0]}' THEN 'TRAIN' WHEN order_date <= DATE '{splits[1]}'
      THEN 'VALIDATION' WHEN order_date <= DATE '{splits[2]}' THEN 'TEST'
      ELSE 'UNSEEN_COMPARISON' END AS split_window
  FROM dd),
db AS (
  SELECT *, {fixed(f'''coalesce(
      AVG(historical_demand) OVER (PARTITION BY {keys}, day_of_week_num ORDER BY order_date
        ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
      AVG(historical_demand) OVER (PARTITION BY {keys} ORDER BY order_date
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))''', 2)} AS seasonal_naive_baseline
  FROM df),
demand AS (
  SELECT db.*, {fixed('abs(historical_demand - seasonal_naive_baseline)', 2)} AS baseline_absolute_error,
    source_category_id, item_name, current_base_price, is_seasonal, category_name
  FROM db LEFT JOIN d_menu m ON db.{I} = m.{I})"""


def demand_historical(splits: tuple[str, str, str], item: str) -> str:
    return (
        with_domain("sold", "menu", item=item)
        + ","
        + demand_ctes(splits)
        + f"""
SELECT * REPLACE ({text('order_date')} AS order_date) FROM demand"""
    )
