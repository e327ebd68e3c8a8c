"""Roll-ups, pages and feeds over the marts. Every ordered result ends in a key tie-break."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.functions.numeric import cents, fixed, from_cents, money_sum, ratio, safe_ratio
from martloom.plans.base import CUSTOMER, ITEM, RESTAURANT
from martloom.sources.sinks import read_mart
from martloom.sources.snapshot import table_path


def _sum(*columns: str) -> list[Column]:
    return [money_sum(c).alias(c) for c in columns]


def _within(df: DataFrame, restaurant: object | None) -> DataFrame:
    return df if restaurant is None else df.filter(F.col(RESTAURANT) == restaurant)


def filter_options(location: DataFrame, menu: DataFrame, channel: DataFrame) -> DataFrame:
    """Distinct branches, categories and channels present in the marts."""

    def options(df: DataFrame, kind: str, value: str, label: str) -> DataFrame:
        return (
            df.select(F.col(value).cast("string").alias("value"), F.col(label).alias("label"))
            .filter(F.col("value").isNotNull())
            .distinct()
            .select(F.lit(kind).alias("option"), "value", "label")
        )

    return (
        options(location, "location", RESTAURANT, "location_name")
        .unionByName(options(menu, "category", "source_category_id", "category_name"))
        .unionByName(options(channel, "channel", "order_channel", "order_channel"))
    )


def stored_mart(spark: SparkSession, root: str, name: str, columns: list[str]) -> DataFrame:
    """The needed columns of a mart that the runner has written."""
    return read_mart(spark, table_path(root, name), columns)


def executive_summary(location: DataFrame, customers: DataFrame, sales: DataFrame) -> DataFrame:
    """One row of headline figures; customers are only counted."""
    people = customers.agg(F.count(F.lit(1))).scalar()
    unusual = sales.agg(
        F.count_if(F.col("is_spike_anomaly") | F.col("is_drop_anomaly"))
    ).scalar()
    total = location.agg(
        money_sum("gross_revenue").alias("total_revenue"),
        F.sum("total_orders").alias("total_orders"),
        money_sum("contribution_margin").alias("contribution_margin"),
        money_sum("total_waste_cost").alias("total_waste_cost"),
    )

    def share(column: str) -> Column:
        quotient = fixed(ratio(column, "total_revenue") * 100.0, 2)
        return F.when(F.col("total_revenue") > 0, quotient).otherwise(0.0)

    return total.withColumns(
        {
            "average_order_value": safe_ratio("total_revenue", "total_orders", 2),
            "margin_percentage": share("contribution_margin"),
            "waste_to_revenue_ratio": share("total_waste_cost"),
            "active_customers": people,
            "detected_anomalies_count": unusual,
        }
    )


def menu_filter(
    menu: DataFrame,
    category: object | None = None,
    restaurant: object | None = None,
    classification: str | None = None,
    flag: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Menu rows that meet all given criteria; search is a case-blind part of name or id."""
    rows = _within(menu, restaurant)
    if category is not None:
        rows = rows.filter(
            (F.col("source_category_id") == category) | (F.col("category_name") == category)
        )
    if classification is not None:
        rows = rows.filter(F.col("classification") == classification)
    if flag is not None:
        rows = rows.filter(F.col(flag if flag.startswith("flag_") else f"flag_{flag}"))
    if search:
        needle = search.lower()
        rows = rows.filter(
            F.lower("item_name").contains(needle)
            | F.lower(F.col(ITEM).cast("string")).contains(needle)
        )
    return rows


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    """A slice of the ordered rows; the order must be total for pages to be disjoint."""
    return df.orderBy(*order).offset(offset).limit(limit)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))


def customers_enriched(
    rfm: DataFrame, churn: DataFrame | None = None, segments: DataFrame | None = None
) -> DataFrame:
    """RFM rows with the customer's churn risk and segment, where predicted.

    A customer scored at several cutoffs shows the latest.
    """
    out = rfm
    if churn is not None:
        latest = churn.groupBy(F.col("customer_id").alias(CUSTOMER)).agg(
            F.max_by(
                F.struct("churn_probability", F.col("predicted_label").alias("churn_label")),
                "cutoff" if "cutoff" in churn.columns else "churn_probability",
            ).alias("c")
        )
        out = out.join(latest.select(CUSTOMER, "c.*"), CUSTOMER, "left")
    if segments is not None:
        named = segments.select(
            F.col("customer_id").alias(CUSTOMER), F.col("segment_label").alias("ml_segment")
        )
        out = out.join(named, CUSTOMER, "left")
    return out


def customer_search(customers: DataFrame, segment: str | None = None, search: str | None = None):
    rows = customers if segment is None else customers.filter(F.col("rfm_segment") == segment)
    if search:
        needle = search.lower()
        rows = rows.filter(
            F.lower("customer_name").contains(needle)
            | F.lower(F.col(CUSTOMER).cast("string")).contains(needle)
        )
    return rows


def hourly_heatmap(peak: DataFrame, restaurant: object | None = None) -> DataFrame:
    return (
        _within(peak, restaurant)
        .groupBy("day_of_week", "hour_of_day")
        .agg(F.sum("total_orders").alias("total_orders"))
    )


def channel_breakdown(channel: DataFrame, restaurant: object | None = None) -> DataFrame:
    return (
        _within(channel, restaurant)
        .groupBy("channel")
        .agg(
            F.sum("total_orders").alias("total_orders"),
            *_sum("net_revenue", "contribution_margin"),
        )
    )


def location_ranking(location: DataFrame) -> DataFrame:
    """Branches by revenue, with margin per cent of gross revenue."""
    margin = fixed(ratio("contribution_margin", "gross_revenue") * 100.0, 2)
    return (
        location.groupBy(RESTAURANT, "location_name", "city", "dining_type")
        .agg(
            F.sum("total_orders").alias("total_orders"),
            *_sum("gross_revenue", "contribution_margin", "total_waste_cost"),
        )
        .withColumn("margin_pct", margin)
        .orderBy(F.desc("gross_revenue"), RESTAURANT)
    )


def demand_curve(predictions: DataFrame) -> DataFrame:
    """Actual, predicted and mean absolute error per week and split."""
    error = ratio(from_cents(F.sum(cents("absolute_error"))), F.count("absolute_error"))
    return (
        predictions.groupBy("week_start_date", "split")
        .agg(*_sum("actual_quantity", "predicted_quantity"), fixed(error, 4).alias("absolute_error"))
        .orderBy("week_start_date", "split")
    )


def waste_by_reason(waste: DataFrame, restaurant: object | None = None) -> DataFrame:
    return (
        _within(waste, restaurant)
        .groupBy("primary_reason")
        .agg(*_sum("waste_cost", "waste_quantity"))
    )


def high_risk_items(waste: DataFrame, limit: int = 20) -> DataFrame:
    """The items with the costliest high-risk weeks."""
    return (
        waste.filter(F.col("current_week_wastage_risk") == 1)
        .groupBy(ITEM, "item_name")
        .agg(*_sum("waste_cost", "waste_quantity"), F.sum("sold_quantity").alias("sold_quantity"))
        .orderBy(F.desc("waste_cost"), ITEM)
        .limit(limit)
    )


def weekly_waste(waste: DataFrame, restaurant: object | None = None) -> DataFrame:
    return (
        _within(waste, restaurant)
        .groupBy("calendar_year", "calendar_week")
        .agg(*_sum("waste_cost", "waste_quantity"))
        .orderBy("calendar_year", "calendar_week")
    )


def risk_summary(predictions: DataFrame) -> DataFrame:
    """Rows scored, alerts, mean probability and alert rate."""
    return predictions.agg(
        F.count(F.lit(1)).alias("total_evaluated"),
        F.coalesce(F.sum("predicted_label"), F.lit(0)).alias("predicted_high_risk_count"),
        fixed(F.coalesce(F.avg("risk_probability"), F.lit(0.0)), 4).alias("avg_risk_probability"),
        F.coalesce(fixed(F.avg("predicted_label") * 100.0, 2), F.lit(0.0)).alias(
            "high_risk_rate_pct"
        ),
    )


def top_risk_items(
    predictions: DataFrame, menu_items: DataFrame, decision: float = 0.5, limit: int = 25
) -> DataFrame:
    """Items by mean risk; HIGH RISK from the decision threshold or any alert on."""
    ten_thousandths = F.rint(F.col("risk_probability") * 10000).cast("long")
    ranked = (
        predictions.groupBy("menu_item_id")
        .agg(
            (F.sum(ten_thousandths) / F.count(F.lit(1)) / 10000.0).alias("mean_risk"),
            F.sum("predicted_label").alias("high_risk_alerts_count"),
        )
        .orderBy(F.desc("mean_risk"), "menu_item_id")
        .limit(limit)
    )
    high = (F.col("mean_risk") >= decision) | (F.col("high_risk_alerts_count") > 0)
    names = menu_items.select(F.col(ITEM).alias("menu_item_id"), "item_name")
    return ranked.join(names, "menu_item_id", "left").select(
        "menu_item_id",
        F.coalesce("item_name", F.col("menu_item_id").cast("string")).alias("item_name"),
        fixed("mean_risk", 4).alias("risk_probability"),
        F.when(high, 1).otherwise(0).alias("predicted_label"),
        F.when(high, "HIGH RISK").otherwise("ELEVATED").alias("predicted_risk_status"),
        "high_risk_alerts_count",
    )


def promotion_summary(promotions: DataFrame) -> DataFrame:
    return promotions.groupBy(
        "source_promotion_id", "campaign_name", "discount_type", "is_promotion_trap"
    ).agg(
        F.sum("units_sold").alias("units_sold"),
        *_sum("net_revenue", "total_discount", "contribution_margin"),
    )


def top_pairs(basket: DataFrame, limit: int = 50) -> DataFrame:
    order = [F.desc("lift"), F.desc("co_occurrence_count"), "item_a_id", "item_b_id"]
    return basket.orderBy(*order).limit(limit)


def sales_anomaly_feed(sales: DataFrame, limit: int = 100) -> DataFrame:
    """Spikes and drops, the most extreme first."""
    return (
        sales.filter(F.col("is_spike_anomaly") | F.col("is_drop_anomaly"))
        .orderBy(F.desc(F.abs("z_score_revenue")), "order_date", RESTAURANT)
        .limit(limit)
    )


def rating_anomaly_feed(ratings: DataFrame, limit: int = 100) -> DataFrame:
    """Rating anomalies, the lowest score against the item's own mean first."""
    return (
        ratings.filter(F.col("is_rating_anomaly"))
        .orderBy("z_score", "week_start", RESTAURANT, ITEM)
        .limit(limit)
    )


def comparison_sample(compared: DataFrame, keys: list[str], limit: int = 100) -> DataFrame:
    return compared.orderBy(*keys).limit(limit)


def champion(metadata: DataFrame, task: str) -> DataFrame:
    """The selected algorithm of a task from the stored run metadata."""
    return metadata.filter((F.col("task") == task) & F.col("is_champion")).select(
        "task", "algorithm"
    )
