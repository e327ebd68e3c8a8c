"""Features and labels for demand, wastage and churn models.

Every feature of a row uses earlier rows only. Where the label of a row is a formula of
same-row columns, those columns are left out of the feature list.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from martloom.config import ChurnRules, OrderRules, ScaleRules, SplitDates, WasteRules
from martloom.functions.dates import day, iso_week, split_label, week_start
from martloom.functions.numeric import cents, fixed, from_cents, money_sum, ratio, safe_ratio, weight_sum
from martloom.operators.joins import counted_orders, split_on_null
from martloom.operators.ranking import quantile_bin_of, row_positions
from martloom.operators.timeseries import if_full, series, trailing
from martloom.plans.base import CUSTOMER, ITEM, ORDER, RESTAURANT
from martloom.plans.customers import customer_totals
from martloom.sources.snapshot import Snapshot

_SERIES = ["menu_item_id", "restaurant_id"]
_WEEK = "week_start_date"

DEMAND_FEATURES = [
    "lag_1w_quantity",
    "lag_4w_quantity",
    "rolling_4w_avg_quantity",
    "rolling_4w_std_quantity",
    "lag_1w_revenue",
    "lag_4w_revenue",
    "rolling_4w_avg_revenue",
    "dow_avg_quantity",
    "week_of_year",
    "month",
    "is_weekend",
]
WASTE_LAG_FEATURES = [
    "lag_1w_cost_ratio",
    "lag_4w_avg_cost_ratio",
    "lag_1w_quantity_ratio",
    "lag_4w_avg_quantity_ratio",
    "rolling_4w_waste_events",
    "week_of_year",
    "month",
]
CHURN_FEATURES = [
    "recency_days",
    "frequency",
    "monetary_total",
    "avg_order_value",
    "customer_tenure_days",
]


def _or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def _calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "week_of_year": iso_week(_WEEK).cast("double"),
            "month": F.month(_WEEK).cast("double"),
        }
    )


def _demand_lags(weekly: DataFrame, full: bool) -> DataFrame:
    by_week = series(_SERIES, _WEEK)
    last_four = trailing(_SERIES, _WEEK, 4)

    def stat(value: Column) -> Column:
        return _or_zero(if_full(value, last_four, 4) if full else value)

    return _calendar(
        weekly.withColumns(
            {
                "lag_1w_quantity": _or_zero(F.lag("weekly_quantity", 1).over(by_week)),
                "lag_4w_quantity": _or_zero(F.lag("weekly_quantity", 4).over(by_week)),
                "rolling_4w_avg_quantity": stat(F.avg("weekly_quantity").over(last_four)),
                "rolling_4w_std_quantity": stat(F.stddev_samp("weekly_quantity").over(last_four)),
                "lag_1w_revenue": _or_zero(F.lag("weekly_revenue", 1).over(by_week)),
                "lag_4w_revenue": _or_zero(F.lag("weekly_revenue", 4).over(by_week)),
                "rolling_4w_avg_revenue": stat(_mean_money("weekly_revenue", last_four)),
            }
        )
    )


def _mean_money(column: str, frame: WindowSpec) -> Column:
    return ratio(from_cents(F.sum(cents(column)).over(frame)), F.count(column).over(frame))


def weekly_demand_features(demand: DataFrame) -> DataFrame:
    """From the daily demand mart: weekly sums with lags over the rows that exist."""
    weekly = demand.groupBy(
        week_start("order_date").alias(_WEEK),
        F.col(ITEM).alias("menu_item_id"),
        F.col(RESTAURANT).alias("restaurant_id"),
        F.col("source_category_id").alias("category_id"),
    ).agg(
        F.sum("historical_demand").alias("weekly_quantity"),
        money_sum("gross_revenue").alias("weekly_revenue"),
    )
    return _demand_lags(weekly, full=False).withColumns(
        {"dow_avg_quantity": F.lit(0.0), "is_weekend": F.lit(0.0)}
    )


def weekly_demand_features_full(snap: Snapshot, splits: SplitDates = SplitDates()) -> DataFrame:
    """From the tables, all order statuses: trailing statistics only over four full rows.

    The weekday mean is learnt on the training window, so later weeks never see themselves.
    """
    lines = snap.order_items.select(ORDER, ITEM, "quantity", "line_net_revenue").join(
        snap.orders.select(ORDER, RESTAURANT, "order_timestamp"), ORDER, "inner"
    )
    named = lines.withColumnsRenamed({ITEM: "menu_item_id", RESTAURANT: "restaurant_id"})
    categories = snap.menu_items.select(
        F.col(ITEM).alias("menu_item_id"), F.col("source_category_id").alias("category_id")
    )
    weekly = (
        named.groupBy(week_start("order_timestamp").alias(_WEEK), *_SERIES)
        .agg(
            F.sum("quantity").alias("weekly_quantity"),
            money_sum("line_net_revenue").alias("weekly_revenue"),
        )
        .join(categories, "menu_item_id", "left")
    )
    weekday_means = (
        named.filter(day("order_timestamp") <= F.lit(splits.train_end).cast("date"))
        .groupBy(*_SERIES, F.dayofweek("order_timestamp").alias("dow"))
        .agg(F.avg("quantity").alias("mean_quantity"))
        .groupBy(*_SERIES)
        .agg(fixed(F.avg("mean_quantity"), 6).alias("dow_avg_quantity"))
    )
    return (
        _demand_lags(weekly, full=True)
        .join(weekday_means, _SERIES, "left")
        .withColumns(
            {
                "dow_avg_quantity": _or_zero(F.col("dow_avg_quantity")),
                "is_weekend": F.lit(0.0),
                "split": split_label(_WEEK, splits),
            }
        )
    )


def _waste_lags(df: DataFrame, rules: WasteRules, full: bool) -> DataFrame:
    by_week = series(_SERIES, _WEEK)
    last_four = trailing(_SERIES, _WEEK, 4)

    def stat(value: Column) -> Column:
        return _or_zero(if_full(value, last_four, 4) if full else value)

    risky = (F.coalesce("cost_ratio", F.lit(0.0)) > rules.cost_ratio) | (
        F.coalesce("quantity_ratio", F.lit(0.0)) > rules.quantity_ratio
    )
    labelled = df.withColumn("wastage_risk_label", F.when(risky, 1).otherwise(0))
    return _calendar(
        labelled.withColumns(
            {
                "lag_1w_cost_ratio": _or_zero(F.lag("cost_ratio", 1).over(by_week)),
                "lag_4w_avg_cost_ratio": stat(F.avg("cost_ratio").over(last_four)),
                "lag_1w_quantity_ratio": _or_zero(F.lag("quantity_ratio", 1).over(by_week)),
                "lag_4w_avg_quantity_ratio": stat(F.avg("quantity_ratio").over(last_four)),
                "rolling_4w_waste_events": stat(F.sum("wastage_risk_label").over(last_four)),
            }
        )
    )


def waste_features(mart: DataFrame, rules: WasteRules = WasteRules()) -> DataFrame:
    """Dish rows of the wastage mart with lagged ratios and the next week's risk as target."""
    dish, _ = split_on_null(mart, ITEM)
    named = dish.select(
        F.col("week_start").alias(_WEEK),
        F.col(ITEM).alias("menu_item_id"),
        F.col(RESTAURANT).alias("restaurant_id"),
        F.col("source_category_id").alias("category_id"),
        F.col("waste_cost_ratio").alias("cost_ratio"),
        F.col("waste_quantity_ratio").alias("quantity_ratio"),
        "next_week_wastage_risk",
    )
    return _waste_lags(named, rules, full=False)


def waste_features_full(
    snap: Snapshot, splits: SplitDates = SplitDates(), rules: WasteRules = WasteRules()
) -> DataFrame:
    """Weeks with dish waste only, sales of all statuses, ratio 0 without sales."""
    dish, _ = split_on_null(snap.wastage, ITEM)
    keys = [_WEEK, *_SERIES]
    named = {ITEM: "menu_item_id", RESTAURANT: "restaurant_id"}
    waste = (
        dish.withColumn(_WEEK, week_start("wastage_timestamp"))
        .withColumnsRenamed(named)
        .groupBy(*keys)
        .agg(
            weight_sum("quantity_lost").alias("waste_quantity"),
            money_sum("cost_loss_amount").alias("waste_cost"),
        )
    )
    sold = (
        snap.order_items.join(snap.orders.select(ORDER, RESTAURANT, "order_timestamp"), ORDER)
        .withColumn(_WEEK, week_start("order_timestamp"))
        .withColumnsRenamed(named)
        .groupBy(*keys)
        .agg(
            F.sum("quantity").alias("sold_quantity"),
            money_sum("line_net_revenue").alias("gross_revenue"),
        )
    )
    joined = waste.join(sold, keys, "left").withColumns(
        {
            "sold_quantity": F.coalesce("sold_quantity", F.lit(0)),
            "gross_revenue": F.coalesce("gross_revenue", F.lit(0.0)),
        }
    )
    ratios = joined.withColumns(
        {
            "cost_ratio": safe_ratio("waste_cost", "gross_revenue", 6),
            "quantity_ratio": safe_ratio("waste_quantity", "sold_quantity", 6),
        }
    )
    return _waste_lags(ratios, rules, full=True).withColumn("split", split_label(_WEEK, splits))


def churn_features(rfm: DataFrame, rules: ChurnRules = ChurnRules()) -> DataFrame:
    """The RFM mart as features, with silence beyond the horizon as label.

    The label is a formula of recency: for description only, see churn_panel for training.
    """
    return rfm.select(
        F.col(CUSTOMER).alias("customer_id"),
        F.col("recency_days").cast("double").alias("recency_days"),
        F.col("frequency").cast("double").alias("frequency"),
        F.col("monetary_value").alias("monetary_total"),
        F.coalesce("avg_order_value", F.lit(0.0)).alias("avg_order_value"),
        *[F.col(f"{s}_score").cast("double").alias(f"{s}_score") for s in "rfm"],
        (F.col("r_score") + F.col("f_score") + F.col("m_score")).cast("double").alias("rfm_score"),
        F.when(F.col("recency_days") > rules.horizon_days, 1).otherwise(0).alias("churn_label"),
    )


def churn_features_at(
    snap: Snapshot,
    snapshot_date: str,
    rules: ChurnRules = ChurnRules(),
    orders: OrderRules = OrderRules(),
    scale: ScaleRules = ScaleRules(),
) -> DataFrame:
    """Completed orders up to a date, with quantile-bin scores.

    Recency scores come from its quintile cut points, frequency and money from equal bins
    of their order (ties by customer). Customers without orders get 0 and label 1.
    """
    at = F.lit(snapshot_date).cast("date")
    completed = snap.orders.filter(
        (F.col("order_status") == orders.completed_status) & (day("order_timestamp") <= at)
    )
    totals = customer_totals(completed, at)
    placed, n = row_positions(
        totals, {"f_pos": ("frequency", True), "m_pos": ("monetary_value", True)}, CUSTOMER, scale
    )
    cuts = placed.agg(
        F.percentile("recency_days", F.array(*[F.lit(k / 5) for k in range(1, 5)]))
    ).scalar()
    recency = F.col("recency_days").cast("double")
    r_score = F.lit(5) - reduce(
        add, [F.when(cuts.getItem(k) < recency, 1).otherwise(0) for k in range(4)]
    )
    scored = placed.withColumns(
        {
            "r_score": r_score.cast("int"),
            "f_score": quantile_bin_of("f_pos", n, 5),
            "m_score": quantile_bin_of("m_pos", n, 5),
            "churn_label": F.when(F.col("recency_days") > rules.horizon_days, 1).otherwise(0),
        }
    )
    joined = snap.customers.select(CUSTOMER).join(scored, CUSTOMER, "left")
    return joined.select(
        F.col(CUSTOMER).alias("customer_id"),
        F.coalesce("recency_days", F.lit(9999)).cast("double").alias("recency_days"),
        _or_zero(F.col("frequency")).alias("frequency"),
        _or_zero(F.col("monetary_value")).alias("monetary_total"),
        _or_zero(ratio("monetary_value", "frequency")).alias("avg_order_value"),
        *[_or_zero(F.col(f"{s}_score")).alias(f"{s}_score") for s in "rfm"],
        _or_zero(F.col("r_score") + F.col("f_score") + F.col("m_score")).alias("rfm_score"),
        F.coalesce("churn_label", F.lit(1)).alias("churn_label"),
        F.lit("TRAIN").alias("split"),
    )


def churn_panel(
    orders: DataFrame,
    cutoffs: dict[str, str],
    rules: ChurnRules = ChurnRules(),
    order_rules: OrderRules = OrderRules(),
) -> DataFrame:
    """One row per customer and cutoff: features up to it, label from the days after it.

    `cutoffs` maps a date to its split. A customer appears at a cutoff once there is an
    order before it; the label is 1 when none follows within the horizon.
    """
    dates = F.array(*[F.lit(c).cast("date") for c in cutoffs])
    placed = day("order_timestamp")
    seen = (
        counted_orders(orders, order_rules)
        .filter(F.col(CUSTOMER).isNotNull())
        .select(
            CUSTOMER,
            placed.alias("order_date"),
            cents("total_amount").alias("spent"),
            F.explode(
                F.filter(dates, lambda c: F.date_add(c, rules.horizon_days) >= placed)
            ).alias("cutoff"),
        )
    )
    before = F.col("order_date") <= F.col("cutoff")
    split = F.create_map(*[F.lit(x) for pair in cutoffs.items() for x in pair])
    return (
        seen.groupBy(CUSTOMER, "cutoff")
        .agg(
            F.max(F.when(before, F.col("order_date"))).alias("last"),
            F.min(F.when(before, F.col("order_date"))).alias("first"),
            F.count_if(before).alias("frequency"),
            F.sum(F.when(before, F.col("spent"))).alias("spent"),
            F.count_if(~before).alias("later_orders"),
        )
        .filter(F.col("frequency") > 0)
        .select(
            F.col(CUSTOMER).alias("customer_id"),
            "cutoff",
            F.datediff("cutoff", "last").cast("double").alias("recency_days"),
            F.col("frequency").cast("double").alias("frequency"),
            from_cents("spent").alias("monetary_total"),
            fixed(from_cents("spent") / F.col("frequency"), 2).alias("avg_order_value"),
            F.datediff("cutoff", "first").cast("double").alias("customer_tenure_days"),
            F.when(F.col("later_orders") > 0, 0).otherwise(1).alias("churn_label"),
            F.element_at(split, F.col("cutoff").cast("string")).alias("split"),
        )
    )
