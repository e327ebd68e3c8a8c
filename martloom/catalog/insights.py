"""Stock, slow movers and other insights as queries, and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DateType, TimestampType
from pyspark.sql import functions as F

from martloom.catalog.domain_sql import fixed, text, with_domain
from martloom.catalog.mart_sql import menu_performance as menu_sql
from martloom.config import OrderRules, SlowRules, SplitDates, StockRules
from martloom.functions.dates import split_label
from martloom.plans import drift, menu, promotion_lift, rollups, search, slow_movers, stock
from martloom.plans.base import ITEM, RESTAURANT, sold_of
from martloom.session import tune
from martloom.sources.layout import read_filtered, write_filterable
from martloom.sources.sinks import read_mart, write_mart
from martloom.sources.staging import stage, stage_result, staging_root, staging_scope
from martloom.sources.star import star_snapshot, stock_movements

Query = Callable[[SparkSession, str], DataFrame]
R, I = "source_restaurant_id", "source_menu_item_id"


def _texts(df: DataFrame) -> DataFrame:
    """Dates as ISO text, the form both engines print alike."""
    timed = [f.name for f in df.schema.fields if isinstance(f.dataType, (DateType, TimestampType))]
    return df.withColumns({c: F.col(c).cast("string") for c in timed}) if timed else df


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(stock.stock_levels(stock_movements(tune(spark), sf_dir)))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.stock_alerts(stock.stock_levels(stock_movements(tune(spark), sf_dir)))


def _reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    movements = stage(stock_movements(tune(spark), sf_dir), "movements")
    levels = stock.stock_levels(movements)
    return stock.reorder_points(movements, star_snapshot(spark, sf_dir).inventory, levels)


def _slow(item: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _texts(slow_movers.slow_movers(star_snapshot(tune(spark), sf_dir, item)))

    return run


BANDS = promotion_lift.LiftRules(band_width=100.0)
SPLITS = SplitDates("2000-06-30", "2000-12-31", "2001-03-31")
NUMBERS = ["quantity", "unit_price_at_sale", "promoted_discount"]
CATEGORIES = ["order_channel", "order_year"]
PERIOD = ("1999-07-01", "2000-06-01")
MENU_RANGES = {
    "current_base_price": (920.0, 960.0),
    "avg_rating": (2.0, 4.5),
    "wastage_pct": (None, 0.05),
    "last_order_date": ("1999-01-01", None),
}
MENU_COLUMNS = [RESTAURANT, ITEM, "current_base_price", "avg_rating", "wastage_pct", "composite_score"]
MENU_ORDER = [("composite_score", False), (RESTAURANT, True), (ITEM, True)]


def _folder(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"


def _lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotion_lift.promotion_lift(star_snapshot(tune(spark), sf_dir, "brand"), BANDS)


def _drift_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sold lines with their window and week; the discount is known for promoted lines alone."""
    sold = sold_of(star_snapshot(tune(spark), sf_dir, "brand"), OrderRules())
    return sold.withColumns(
        {
            "win": split_label(F.to_date("order_timestamp"), SPLITS),
            "week": F.to_date(F.date_trunc("week", "order_timestamp")),
            "order_year": F.year("order_timestamp"),
            "promoted_discount": F.when(F.col("source_promotion_id").isNotNull(), F.col("line_discount")),
        }
    )


def _stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.stability(_drift_rows(spark, sf_dir), "win", NUMBERS, CATEGORIES)


def _sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly sketches, stored and read back, against the exact index."""
    rows = stage(_drift_rows(spark, sf_dir), "drift")
    path = _folder(spark, "sketches")
    write_mart(drift.weekly_sketches(rows, "win", "week", NUMBERS), path)
    near = drift.stability_of_sketches(read_mart(spark, path)).select("feature", "win", F.col("psi").alias("near"))
    exact = drift.stability(rows, "win", NUMBERS).select("feature", "win", "row_count", "psi")
    # a share of a bin errs by twice the rank error at most
    close = F.abs(F.col("near") - F.col("psi")) <= 0.03
    return exact.join(near, ["feature", "win"]).select("feature", "win", "row_count", close.alias("close"))


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a year per branch from stored monthly sketches, against the exact count."""
    orders = star_snapshot(tune(spark), sf_dir).orders
    path = _folder(spark, "customers")
    write_mart(rollups.customer_sketches(orders), path)
    about = rollups.active_customers(read_mart(spark, path), [RESTAURANT], *PERIOD)
    month = F.trunc(F.to_date("order_timestamp"), "month")
    exact = (
        orders.where((F.col("order_status") != "Voided") & month.between(*PERIOD))
        .groupBy(RESTAURANT)
        .agg(F.count_distinct("source_customer_id").alias("exact_customers"))
    )
    # five standard errors of the sketch, and one for rounding
    close = F.abs(F.col("customers") - F.col("exact_customers")) <= 1 + 0.08 * F.col("exact_customers")
    return about.join(exact, RESTAURANT).select(RESTAURANT, "orders", "exact_customers", close.alias("close"))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, rating, waste and date ranges on the menu mart, stored in interleaved order."""
    snap = star_snapshot(tune(spark), sf_dir)
    path = _folder(spark, "menu")
    with staging_scope(spark):
        dated = {"last_order_date": F.to_date("last_order_date")}
        mart = stage_result(spark, lambda: menu.menu_performance(snap).withColumns(dated), "mart", "zstd")
        write_filterable(mart, path, list(MENU_RANGES), stored=True)
    ranges = MENU_RANGES | {"last_order_date": (F.to_date(F.lit("1999-01-01")), None)}
    return read_filtered(spark, path, ranges, MENU_COLUMNS)


def _found_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of items whose name or id has a text, by postings and the first page's last row."""
    snap = star_snapshot(tune(spark), sf_dir)
    # an item has its name in every branch: one posting serves all of them
    keys, searched = [ITEM], ["item_name", ITEM]
    path = _folder(spark, "postings")
    search.write_postings(snap.menu_items, keys, searched, path)
    rows = menu.menu_performance(snap).where("category_name = 'economy' AND classification = 'Low Performer'")
    rows = stage(rows.select(RESTAURANT, *searched, "composite_score", "classification"), "menu")
    found = search.search(rows, read_mart(spark, path), keys, searched, "in")
    names = [c for c, _ in MENU_ORDER]
    first = search.next_page(found, MENU_ORDER, 20).select(*names).collect()
    last = tuple(first[-1]) if first else None
    page = search.next_page(found, MENU_ORDER, 50, last)
    return page.select(RESTAURANT, ITEM, "item_name", "composite_score", "classification")


def insights() -> dict[str, Query]:
    return {
        "stock_levels": _levels,
        "stock_alerts": _alerts,
        "reorder_points": _reorder,
        "slow_movers": _slow("part"),
        "slow_movers_brands": _slow("brand"),
        "promotion_lift": _lift,
        "drift_index": _stability,
        "drift_sketches": _sketched,
        "customer_rollups": _rollup,
        "menu_ranges": _ranges,
        "menu_search_page": _found_page,
    }


def _levels_sql(rules: StockRules = StockRules()) -> str:
    """Common tables up to lv: the stock after each day with a movement, one day after the other."""
    domain = with_domain("lines").replace("WITH ", "WITH RECURSIVE ", 1)
    return domain + f""",
mv AS (
  SELECT l_orderkey % 25 AS r, 'ING-' || CAST(l_suppkey % 40 AS VARCHAR) AS g, CAST(shipped AS DATE) AS d,
    CAST(SUM(CASE WHEN l_returnflag = 'N' THEN 2 * qty ELSE 0 END) AS BIGINT) AS restocked,
    CAST(SUM(CASE WHEN l_returnflag <> 'N' THEN qty ELSE 0 END) AS BIGINT) AS consumed
  FROM lines GROUP BY ALL),
seq AS (SELECT *, row_number() OVER (PARTITION BY r, g ORDER BY d) AS n FROM mv),
walk AS (
  SELECT r, g, n, greatest(restocked - consumed, 0) AS stock, greatest(consumed - restocked, 0) AS unmet FROM seq WHERE n = 1
  UNION ALL
  SELECT s.r, s.g, s.n, greatest(w.stock + s.restocked - s.consumed, 0), greatest(s.consumed - s.restocked - w.stock, 0)
  FROM walk w JOIN seq s ON s.r = w.r AND s.g = w.g AND s.n = w.n + 1),
held AS (
  SELECT s.*, w.stock, w.unmet, lead(d) OVER (PARTITION BY s.r, s.g ORDER BY d) - 1 AS until,
    SUM(consumed) OVER (PARTITION BY s.r, s.g ORDER BY d
      RANGE BETWEEN INTERVAL {rules.use_days - 1} DAYS PRECEDING AND CURRENT ROW) AS recent
  FROM seq s JOIN walk w ON s.r = w.r AND s.g = w.g AND s.n = w.n),
lv AS (
  SELECT *, CASE WHEN stock = 0 THEN 'Out of Stock' WHEN cover < {rules.short_days} THEN 'Understock'
    WHEN cover IS NULL OR cover > {rules.long_days} THEN 'Overstock' ELSE 'Healthy' END AS state
  FROM (SELECT *, {fixed(f"stock * {float(rules.use_days)} / nullif(recent, 0)", 2)} AS cover FROM held))"""


def _reorder_sql(rules: StockRules = StockRules()) -> str:
    lead = rules.lead_days
    return _levels_sql(rules).replace("lv AS (", "lv AS MATERIALIZED (", 1) + f""",
periods AS (
  SELECT r, g, (d - DATE '1970-01-01') // {lead} AS p, SUM(consumed) AS used FROM mv GROUP BY ALL),
spans AS (SELECT r, g, unnest(range(MIN(p), (SELECT MAX(p) FROM periods) + 1)) AS p FROM periods GROUP BY r, g),
points AS (
  SELECT s.r, s.g, COUNT(*) AS periods, quantile_disc(CAST(coalesce(used, 0) AS BIGINT), 0.5) AS median_demand,
    quantile_disc(CAST(coalesce(used, 0) AS BIGINT), {rules.service_level}) AS point
  FROM spans s LEFT JOIN periods u ON s.r = u.r AND s.g = u.g AND s.p = u.p GROUP BY ALL),
inv AS (
  SELECT l_orderkey % 25 AS r, 'ING-' || CAST(l_suppkey % 40 AS VARCHAR) AS g,
    CAST(SUM(CASE WHEN l_returnflag = 'R' THEN qty ELSE 0 END) AS DOUBLE) AS threshold FROM lines GROUP BY ALL)
SELECT q.r AS {R}, q.g AS ingredient_name, periods, median_demand, point AS reorder_point, CAST(stock AS BIGINT) AS stock,
  stock < point AS needs_order, CAST(CASE WHEN stock < point THEN 2 * point - stock ELSE 0 END AS BIGINT) AS order_quantity,
  threshold - point AS threshold_gap
FROM points q JOIN lv ON lv.r = q.r AND lv.g = q.g AND until IS NULL LEFT JOIN inv ON inv.r = q.r AND inv.g = q.g"""


def _slow_sql(item: str, rules: SlowRules = SlowRules()) -> str:
    a = rules.alpha
    return with_domain("items", "orders", "sold", "menu", "restaurants", item=item) + f""",
daily AS (SELECT {R} AS r, {I} AS i, order_date AS d, CAST(SUM(quantity) AS BIGINT) AS units FROM sold GROUP BY ALL),
gapped AS (SELECT *, d - lag(d) OVER (PARTITION BY r, i ORDER BY d) AS gap FROM daily),
lists AS (
  SELECT r, i, COUNT(*) AS sale_days, CAST(SUM(units) AS BIGINT) AS units, MIN(d) AS first, MAX(d) AS last,
    CAST(SUM(coalesce(gap, 0)) AS BIGINT) AS gap_days, COUNT(*) FILTER (gap > {rules.absence_days}) AS long_gaps, MAX(gap) AS longest,
    list(CAST(units AS DOUBLE) ORDER BY d) AS sizes, list(CAST(gap AS DOUBLE) ORDER BY d) FILTER (gap IS NOT NULL) AS gaps
  FROM gapped GROUP BY r, i),
smooth AS (
  SELECT *, (SELECT MAX(d) FROM daily) - last AS quiet,
    list_reduce(sizes, lambda m, x: m + {a} * (x - m)) AS size,
    CASE WHEN len(gaps) > 0 THEN list_reduce(gaps, lambda m, x: m + {a} * (x - m)) END AS gap
  FROM lists),
rated AS (
  SELECT *, {1 - a / 2} * size / coalesce(CASE WHEN quiet > gap THEN gap + {a} * (quiet - gap) ELSE gap END, nullif(quiet, 0)) AS rate,
    CAST(gap_days + quiet AS DOUBLE) / greatest(sale_days - 1, 1) AS mean_gap,
    CAST(units AS DOUBLE) / (gap_days + quiet + 1) AS mean_rate
  FROM smooth),
offered AS (SELECT {R} AS r, {I} AS i, item_name FROM d_restaurants CROSS JOIN d_menu),
joined AS (
  SELECT coalesce(o.r, s.r) AS r, coalesce(o.i, s.i) AS i, item_name, coalesce(sale_days, 0) AS sale_days,
    CAST(coalesce(units, 0) AS BIGINT) AS units, last, quiet, {fixed("nullif(mean_gap, 0)", 4)} AS mean_gap,
    greatest(longest, quiet) AS longest_gap,
    CAST(coalesce(long_gaps, 0) + CASE WHEN quiet > {rules.absence_days} THEN 1 ELSE 0 END AS BIGINT) AS absences,
    {fixed("rate", 6)} AS smoothed_rate, {fixed("rate / mean_rate - 1", 4)} AS trend
  FROM offered o FULL JOIN rated s ON o.r = s.r AND o.i = s.i)
SELECT r AS {R}, i AS {I}, item_name, sale_days, units, {text("last")} AS last_sale, CAST(quiet AS INTEGER) AS days_since_sale,
  mean_gap, CAST(longest_gap AS INTEGER) AS longest_gap, absences, smoothed_rate, trend,
  CASE WHEN sale_days = 0 THEN 'Never Sold' WHEN quiet > {rules.dormant_gaps} * mean_gap THEN 'Dormant'
    WHEN mean_gap >= {rules.slow_gap_days} THEN 'Slow' WHEN trend <= {rules.declining} THEN 'Declining' ELSE 'Active' END AS class
FROM joined"""


def _lift_sql(rules: promotion_lift.LiftRules = BANDS) -> str:
    groups = promotion_lift.GROUPS
    columns = ",\n    ".join(
        f"COUNT(*) FILTER (g = '{g}') AS n_{g}, AVG(units) FILTER (g = '{g}') AS u_{g}, AVG(margin) FILTER (g = '{g}') AS m_{g}, "
        f"SUM(units * units) FILTER (g = '{g}') - SUM(units) FILTER (g = '{g}') ** 2 / COUNT(*) FILTER (g = '{g}') AS i_{g}"
        for g in groups
    )
    whole = " AND ".join(f"n_{g} > 0" for g in groups)
    variance = " + ".join(
        f"SUM(i_{g}) FILTER ({whole}) / nullif(SUM(n_{g} - 1) FILTER ({whole}), 0) * SUM(n_treated_in ** 2 / n_{g}) FILTER ({whole})"
        for g in groups
    )

    def change(letter: str) -> str:
        t, b, c, d = (f"{letter}_{g}" for g in groups)
        return f"({t} - {b} - {c} + {d})"

    return with_domain("items", "orders", "sold", "promotions", "menu", item="brand") + f""",
days AS (
  SELECT {R} AS r, s.{I} AS i, order_date AS d, CAST(SUM(quantity) AS DOUBLE) AS units,
    CAST(SUM(line_contribution_margin) AS DOUBLE) * 100 AS margin, list(DISTINCT source_promotion_id) AS promos,
    dayofweek(order_date) AS wd, any_value(floor(current_base_price / {rules.band_width})) AS band
  FROM sold s LEFT JOIN d_menu m ON s.{I} = m.{I} GROUP BY ALL),
plain AS (SELECT * FROM days WHERE len([p FOR p IN promos IF p IS NOT NULL]) = 0),
during AS (
  SELECT p.source_promotion_id AS p, x.* FROM (SELECT *, unnest(promos) AS promo FROM days) x
  JOIN d_promotions p ON promo = p.source_promotion_id AND d BETWEEN start_date AND end_date),
windows AS (SELECT source_promotion_id AS p, start_date, end_date, start_date - CAST(end_date - start_date + 1 AS INTEGER) AS before FROM d_promotions),
groups AS (
  SELECT p, r, wd, band, 'treated_in' AS g, units, margin FROM during
  UNION ALL
  SELECT t.p, t.r, t.wd, t.band, 'treated_before', units, margin FROM (SELECT DISTINCT p, r, wd, band, i FROM during) t
  JOIN windows w ON t.p = w.p JOIN plain x ON x.r = t.r AND x.wd = t.wd AND x.band = t.band AND x.i = t.i
    AND d >= before AND d < start_date
  UNION ALL
  SELECT t.p, t.r, t.wd, t.band, CASE WHEN d < start_date THEN 'control_before' ELSE 'control_in' END, units, margin
  FROM (SELECT DISTINCT p, r, wd, band FROM during) t
  JOIN windows w ON t.p = w.p JOIN plain x ON x.r = t.r AND x.wd = t.wd AND x.band = t.band AND d BETWEEN before AND end_date),
cells AS (SELECT p, r, wd, band, {columns} FROM groups GROUP BY ALL),
totals AS (
  SELECT p, SUM(n_treated_in) AS promoted, SUM(n_treated_in) FILTER ({whole}) AS matched,
    SUM(n_treated_in * {change("u")}) FILTER ({whole}) AS lift, SUM(n_treated_in * {change("m")}) FILTER ({whole}) AS gain,
    SUM(n_treated_in * (u_treated_in - {change("u")})) FILTER ({whole}) AS base, sqrt({variance}) AS error
  FROM cells GROUP BY p)
SELECT source_promotion_id, campaign_name, CAST(coalesce(promoted, 0) AS BIGINT) AS promoted_days,
  CAST(coalesce(matched, 0) AS BIGINT) AS matched_days, {fixed("coalesce(matched, 0) / promoted", 4)} AS matched_share,
  {fixed("lift / matched", 4)} AS unit_lift, {fixed(f"(lift - {rules.z} * error) / matched", 4)} AS lift_low,
  {fixed(f"(lift + {rules.z} * error) / matched", 4)} AS lift_high, {fixed("lift / nullif(base, 0)", 4)} AS relative_lift,
  {fixed("gain / matched / 100", 2)} AS margin_lift, lift > 0 AND gain < 0 AS is_trap
FROM d_promotions LEFT JOIN totals ON p = source_promotion_id"""


def _drift_ctes() -> str:
    a, b, c = (f"DATE '{d}'" for d in (SPLITS.train_end, SPLITS.validation_end, SPLITS.test_end))
    return with_domain("items", "orders", "sold", item="brand") + f""",
rows AS (
  SELECT *, CASE WHEN order_date <= {a} THEN 'TRAIN' WHEN order_date <= {b} THEN 'VALIDATION'
    WHEN order_date <= {c} THEN 'TEST' ELSE 'UNSEEN_COMPARISON' END AS win,
    CASE WHEN source_promotion_id IS NOT NULL THEN line_discount END AS promoted_discount, year(order_date) AS order_year
  FROM sold)"""


def _drift_sql(rules: drift.DriftRules = drift.DriftRules()) -> str:
    numbers = " UNION ALL ".join(
        f"SELECT win, '{c}' AS feature, CAST(round({c} * {rules.scale}) AS BIGINT) AS x, NULL AS c FROM rows" for c in NUMBERS
    )
    words = " UNION ALL ".join(f"SELECT win, '{c}', NULL, CAST({c} AS VARCHAR) FROM rows" for c in CATEGORIES)
    numeric = ", ".join(f"'{c}'" for c in NUMBERS)
    shares = ", ".join(str(i / rules.bins) for i in range(1, rules.bins))
    return _drift_ctes() + f""",
cells AS ({numbers} UNION ALL {words}),
edges AS (SELECT feature, list_distinct(quantile_disc(x, [{shares}])) AS edges FROM cells WHERE win = 'TRAIN' AND x IS NOT NULL GROUP BY 1),
seen AS (SELECT DISTINCT feature, c FROM cells WHERE win = 'TRAIN' AND c IS NOT NULL),
binned AS (
  SELECT cells.feature, win, CASE WHEN x IS NULL AND cells.c IS NULL THEN 'missing'
      WHEN cells.feature IN ({numeric}) THEN CAST(len([e FOR e IN edges IF e < x]) AS VARCHAR)
      WHEN seen.c IS NULL THEN 'unseen' ELSE '=' || seen.c END AS bin
  FROM cells LEFT JOIN edges ON cells.feature = edges.feature LEFT JOIN seen ON cells.feature = seen.feature AND cells.c = seen.c),
held AS (SELECT feature, win, bin, COUNT(*) AS n FROM binned GROUP BY ALL),
totals AS (SELECT feature, win, SUM(n) AS total FROM held GROUP BY ALL),
grid AS (
  SELECT t.feature, t.win, t.total, coalesce(h.n, 0) / t.total AS a, coalesce(e.n, 0) / (SELECT total FROM totals x WHERE x.feature = t.feature AND x.win = 'TRAIN') AS e
  FROM totals t JOIN (SELECT DISTINCT feature, bin FROM held) b ON b.feature = t.feature
  LEFT JOIN held h ON h.feature = t.feature AND h.win = t.win AND h.bin = b.bin
  LEFT JOIN held e ON e.feature = t.feature AND e.win = 'TRAIN' AND e.bin = b.bin),
psi AS (
  SELECT feature, win, CAST(any_value(total) AS BIGINT) AS row_count, COUNT(*) AS bins,
    {fixed(f"SUM((greatest(a, {rules.floor}) - greatest(e, {rules.floor})) * ln(greatest(a, {rules.floor}) / greatest(e, {rules.floor})))", 4)} AS psi
  FROM grid GROUP BY ALL)
SELECT *, CASE WHEN psi >= {rules.major} THEN 'Major' WHEN psi >= {rules.moderate} THEN 'Moderate' ELSE 'Stable' END AS drift FROM psi"""


def _menu_rows(where: str) -> str:
    conditions = []
    for column, (low, high) in MENU_RANGES.items():
        value = f"CAST({column} AS VARCHAR)" if "date" in column else column
        conditions += [f"{value} >= {low!r}"] * (low is not None) + [f"{value} <= {high!r}"] * (high is not None)
    return f"SELECT {', '.join(MENU_COLUMNS)} FROM ({where}) WHERE {' AND '.join(conditions)}"


def insight_oracles() -> dict[str, str]:
    use = float(StockRules().use_days)
    return {
        "stock_levels": _levels_sql()
        + f"""
SELECT r AS {R}, g AS ingredient_name, {text("d")} AS movement_date, restocked, consumed, CAST(stock AS BIGINT) AS stock,
  CAST(unmet AS BIGINT) AS unmet, {fixed(f"recent / {use}", 4)} AS daily_use, cover AS days_of_cover,
  {text("until")} AS held_until, state AS stock_state FROM lv""",
        "stock_alerts": _levels_sql()
        + f"""
SELECT r AS {R}, state AS stock_state, COUNT(*) FILTER (until IS NULL) AS ingredients_now,
  CAST(SUM(CASE WHEN until IS NULL THEN stock ELSE 0 END) AS BIGINT) AS stock_now,
  CAST(coalesce(SUM(until - d + 1), 0) AS BIGINT) AS days_in_state, CAST(SUM(unmet) AS BIGINT) AS unmet
FROM lv GROUP BY ALL""",
        "reorder_points": _reorder_sql(),
        "slow_movers": _slow_sql("part"),
        "slow_movers_brands": _slow_sql("brand"),
        "promotion_lift": _lift_sql(),
        "drift_index": _drift_sql(),
        "drift_sketches": _drift_ctes()
        + " SELECT unnest(["
        + ", ".join(f"'{c}'" for c in NUMBERS)
        + "]) AS feature, win, row_count, TRUE AS close FROM (SELECT win, COUNT(*) AS row_count FROM rows GROUP BY 1)",
        "customer_rollups": with_domain("orders")
        + f"""
SELECT {R}, COUNT(*) AS orders, COUNT(DISTINCT source_customer_id) AS exact_customers, TRUE AS close FROM valid_orders
WHERE date_trunc('month', order_date) BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}' GROUP BY 1""",
        "menu_ranges": _menu_rows(menu_sql(True)),
        "menu_search_page": f"""
SELECT {R}, {I}, item_name, composite_score, classification FROM ({menu_sql(True)})
WHERE category_name = 'economy' AND classification = 'Low Performer'
  AND (lower(item_name) LIKE '%in%' OR CAST({I} AS VARCHAR) LIKE '%in%')
ORDER BY composite_score DESC, {R}, {I} LIMIT 50 OFFSET 20""",
    }
