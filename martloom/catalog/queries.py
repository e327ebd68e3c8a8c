"""Every operator as a query over the star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampType

from martloom.catalog.checks import checks
from martloom.catalog.governance import governance
from martloom.catalog.insights import insights
from martloom.config import DemandRules, ScaleRules, SettlementRules, SplitDates
from martloom.functions.dates import split_label
from martloom.functions import dates
from martloom.functions.numeric import fixed, money_sum
from martloom.functions.contracts import rfm_segment
from martloom.operators import joins, profile, quarantine, settlement
from martloom.plans import (
    advice,
    anomalies,
    basket,
    compare,
    customers,
    demand,
    features,
    menu,
    models,
    operations,
    pricing,
    serving,
    waste,
)
from martloom.plans.base import with_stored_sales
from martloom.session import tune
from martloom.sources.sinks import read_mart, write_mart
from martloom.sources.snapshot import Snapshot
from martloom.sources.staging import stage, staging_root
from martloom.sources.star import event_branches, event_orders, star_snapshot

Query = Callable[[SparkSession, str], DataFrame]

SPLITS = SplitDates("2000-06-30", "2000-12-31", "2001-03-31")


def dates_as_text(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text, the form both engines print alike."""
    timed = [f.name for f in df.schema.fields if isinstance(f.dataType, (DateType, TimestampType))]
    return df.withColumns({c: F.col(c).cast("string") for c in timed}) if timed else df


def on_star(build: Callable[[Snapshot], DataFrame], item: str = "part") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dates_as_text(build(star_snapshot(tune(spark), sf_dir, item)))

    return run


SPREAD = ScaleRules(one_task_rows=0, small_basket=3, block_items=3)
"""Forces the plans meant for inputs too large for one task."""


def _menu(by_restaurant: bool, scale: ScaleRules = ScaleRules()) -> Callable[[Snapshot], DataFrame]:
    def build(snap: Snapshot) -> DataFrame:
        mart = menu.menu_performance(snap, by_restaurant, scale=scale)
        return mart.withColumns(
            {c: F.to_date(c) for c in ("first_order_date", "last_order_date")}
        )

    return build


def _peak_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return operations.peak_analysis(event_orders(spark, sf_dir), event_branches(spark, sf_dir))


def _sales_events(fill: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        orders, branches = event_orders(spark, sf_dir), event_branches(spark, sf_dir)
        return dates_as_text(anomalies.sales_anomalies(orders, branches, fill_days=fill))

    return run


MARTS: dict[str, Query] = {
    "menu_performance": on_star(_menu(True)),
    "menu_performance_chain": on_star(_menu(False)),
    "menu_performance_brands": on_star(_menu(True), "brand"),
    "menu_performance_spread": on_star(_menu(True, SPREAD)),
    "customer_rfm": on_star(customers.customer_rfm),
    "customer_rfm_spread": on_star(lambda s: customers.customer_rfm(s, scale=SPREAD)),
    "basket_analysis": on_star(basket.basket_analysis, "brand"),
    "basket_analysis_spread": on_star(
        lambda s: basket.basket_analysis(s, scale=SPREAD), "brand"
    ),
    "peak_analysis": on_star(lambda s: operations.peak_analysis(s.orders, s.restaurants)),
    "peak_analysis_events": _peak_events,
    "location_performance": on_star(operations.location_performance),
    "channel_performance": on_star(operations.channel_performance),
    "wastage": on_star(waste.wastage),
    "wastage_brands": on_star(waste.wastage, "brand"),
    "pricing": on_star(pricing.pricing, "brand"),
    "promotions": on_star(pricing.promotions),
    "rating_anomalies": on_star(anomalies.rating_anomalies, "brand"),
    "sales_anomalies": on_star(
        lambda s: anomalies.sales_anomalies(s.orders, s.restaurants, fill_days=False)
    ),
    "sales_anomalies_all_days": on_star(
        lambda s: anomalies.sales_anomalies(s.orders, s.restaurants)
    ),
    "sales_anomalies_events": _sales_events(True),
    "demand_historical": on_star(
        lambda s: demand.demand_historical(s, DemandRules(splits=SPLITS)), "brand"
    ),
}


LAST_YEAR = 2000
"""The star tables end in 2001, so rows after this year play the future timestamps."""


def _orphan_check(snap: Snapshot) -> DataFrame:
    """Lines against counted orders only, so that lines of other orders show as orphans."""
    counted = joins.counted_orders(snap.orders)
    return profile.foreign_key(
        snap.order_items, "source_order_id", counted, "source_order_id", "items_to_counted_orders"
    )


def _totals(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("quantity").alias("units"),
        money_sum("line_net_revenue").alias("net_revenue"),
    )


def _order_lines(snap: Snapshot) -> DataFrame:
    lines = joins.order_lines(
        snap.orders, snap.order_items, snap.menu_items, snap.menu_categories, snap.promotions
    )
    return _totals(lines, ["category_name", "campaign_name", "order_channel", "order_status"])


def _routed(snap: Snapshot) -> DataFrame:
    dish, raw = joins.route_wastage(snap.wastage, snap.menu_items, snap.inventory)
    total = [
        F.count(F.lit(1)).alias("row_count"),
        money_sum("cost_loss_amount").alias("cost"),
    ]
    dishes = dish.groupBy(F.col("source_category_id").alias("kind")).agg(*total)
    raws = raw.groupBy(
        F.coalesce("ingredient_category", F.lit("unknown")).alias("kind")
    ).agg(*total)
    return dishes.withColumn("path", F.lit("dish")).unionByName(
        raws.withColumn("path", F.lit("raw"))
    )


def _valid_orders(snap: Snapshot) -> DataFrame:
    return (
        joins.counted_orders(snap.orders)
        .withColumn("order_month", dates.month_start("order_timestamp"))
        .groupBy("order_status", "order_month", dates.is_weekend("order_timestamp").alias("weekend"))
        .agg(F.count(F.lit(1)).alias("orders"), money_sum("total_amount").alias("revenue"))
    )


def _as_of(snap: Snapshot) -> DataFrame:
    facts = snap.order_items.join(
        snap.orders.select("source_order_id", "order_timestamp"), "source_order_id"
    )
    priced = joins.as_of(
        facts,
        snap.pricing_history,
        key="source_menu_item_id",
        at="order_timestamp",
        start="effective_from",
        end="effective_to",
        order_id="source_pricing_history_id",
        values={"list_price": "base_price", "list_cost": "base_cost"},
    )
    return priced.groupBy("source_menu_item_id", "list_price", "list_cost").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("quantity").alias("units")
    )


def _promo_match(snap: Snapshot) -> DataFrame:
    facts = snap.order_items.select(
        "source_order_id",
        "source_order_item_id",
        "source_menu_item_id",
        "quantity",
        F.col("unit_price_at_sale").alias("unit_price"),
    ).join(
        snap.orders.select("source_order_id", "order_timestamp", "order_channel"),
        "source_order_id",
    )
    matched = joins.match_promotion(facts, snap.promotions, date="order_timestamp")
    return matched.groupBy("source_promotion_id", "order_channel").agg(
        F.count(F.lit(1)).alias("row_count"), money_sum("line_discount").alias("discount")
    )


def _stored_mart(snap: Snapshot) -> DataFrame:
    """Write a mart, then scan two of its columns."""
    mart = operations.channel_performance(snap)
    path = f"{staging_root(mart.sparkSession)}/mart-{uuid.uuid4().hex}.parquet"
    write_mart(mart, path)
    return read_mart(mart.sparkSession, path, ["source_restaurant_id", "channel", "net_revenue"])


def _profiled(table: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return on_star(lambda s: build(s.tables()[table]))


JOINS: dict[str, Query] = {
    "order_lines_join": on_star(_order_lines),
    "null_split_routing": on_star(_routed),
    "valid_order_filter": on_star(_valid_orders),
    "stored_sales": on_star(lambda s: _totals(with_stored_sales(s).sold, ["order_channel"])),
    "stored_mart_scan": on_star(_stored_mart),
    "asof_price": on_star(_as_of, "brand"),
    "promo_match": on_star(_promo_match, "brand"),
}

QUALITY: dict[str, Query] = {
    "profile_columns": _profiled("orders", profile.column_profile),
    "profile_columns_ratings": _profiled("ratings", profile.column_profile),
    "duplicate_keys": _profiled(
        "order_items", lambda df: profile.duplicate_keys(df, "source_order_item_id")
    ),
    "profile_orders": _profiled("orders", lambda df: profile.orders_profile(df, LAST_YEAR)),
    "order_status_breakdown": _profiled(
        "orders", lambda df: profile.breakdown(df, "order_status")
    ),
    "profile_order_items": _profiled("order_items", profile.order_items_profile),
    "profile_ratings": _profiled("ratings", profile.ratings_profile),
    "profile_wastage": _profiled("wastage", profile.wastage_profile),
    "invalid_identifiers": _profiled(
        "customers", lambda df: profile.validate_identifiers(df, "last_name", r"^\d{8}[02468]$")
    ),
    "fk_checks": on_star(profile.referential_integrity),
    "fk_orphans": on_star(_orphan_check),
    "quarantine_orders": on_star(
        lambda s: quarantine.reason_counts({"orders": quarantine.clean_orders(s, LAST_YEAR).quarantined})
    ),
    "quarantine_lines": on_star(
        lambda s: quarantine.clean_snapshot(s, LAST_YEAR)
        .quarantined["order_items"]
        .select(
            "source_order_item_id", "source_menu_item_id", "quantity", "line_net_revenue",
            "quarantine_reason",
        )
    ),
    "clean_lines": on_star(
        lambda s: quarantine.clean_snapshot(s, LAST_YEAR)
        .snapshot.order_items.select(
            "source_order_item_id", "source_menu_item_id", "quantity", "line_net_revenue"
        )
    ),
    "quality_reconciliation": on_star(
        # judged once and stored, as the runner does
        lambda s: quarantine.quality_report(quarantine.clean_snapshot(s, LAST_YEAR, stage))
    ),
    "chronology_rules": on_star(
        lambda s: quarantine.rule_violations(
            s.order_items.join(s.orders.select("source_order_id", "order_timestamp"), "source_order_id"),
            [quarantine.Rule("LINE_BEFORE_ORDER", F.col("created_at") < F.col("order_timestamp"))],
        )
    ),
    "constraint_rules": on_star(
        lambda s: quarantine.rule_violations(s.orders, quarantine.constraint_rules("orders"))
    ),
    "operational_flags": on_star(
        lambda s: profile.operational_flags(
            s.order_items.join(
                s.orders.select("source_order_id", "order_status", "source_customer_id"),
                "source_order_id",
            )
        )
        .groupBy("flag_not_fulfilled", "flag_guest", "flag_negative_margin")
        .agg(F.count(F.lit(1)).alias("row_count"))
    ),
}


def _demand(snap: Snapshot) -> DataFrame:
    return demand.demand_historical(snap, DemandRules(splits=SPLITS))


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: fixed(c, 6) for c in columns})


_DEMAND_STATS = ["rolling_4w_avg_quantity", "rolling_4w_std_quantity", "rolling_4w_avg_revenue"]
_WASTE_STATS = ["lag_4w_avg_cost_ratio", "lag_4w_avg_quantity_ratio"]
CUTOFFS = {
    "1999-06-30": "TRAIN",
    "1999-12-31": "TRAIN",
    "2000-06-30": "VALIDATION",
    "2000-12-31": "TEST",
}


def _settled(snap: Snapshot) -> DataFrame:
    rules = SettlementRules(tipped_channels=("1-URGENT", "2-HIGH"))
    return settlement.settle_orders(snap.order_items, snap.orders, rules)


FEATURES: dict[str, Query] = {
    "weekly_demand_features": on_star(
        lambda s: _rounded(features.weekly_demand_features(_demand(s)), _DEMAND_STATS), "brand"
    ),
    "weekly_demand_features_full": on_star(
        lambda s: _rounded(features.weekly_demand_features_full(s, SPLITS), _DEMAND_STATS), "brand"
    ),
    "waste_features": on_star(
        lambda s: _rounded(features.waste_features(waste.wastage(s)), _WASTE_STATS), "brand"
    ),
    "waste_features_full": on_star(
        lambda s: _rounded(features.waste_features_full(s, SPLITS), _WASTE_STATS), "brand"
    ),
    "churn_features": on_star(lambda s: features.churn_features(customers.customer_rfm(s))),
    "churn_features_at": on_star(lambda s: features.churn_features_at(s, SPLITS.train_end)),
    "churn_features_at_spread": on_star(
        lambda s: features.churn_features_at(s, SPLITS.train_end, scale=SPREAD)
    ),
    "churn_panel_features": on_star(lambda s: features.churn_panel(s.orders, CUTOFFS)),
    "chronological_split": on_star(
        lambda s: joins.counted_orders(s.orders)
        .groupBy(split_label(dates.day("order_timestamp"), SPLITS).alias("split"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.min(dates.day("order_timestamp")).alias("first_day"),
            F.max(dates.day("order_timestamp")).alias("last_day"),
        )
    ),
    "order_settlement": on_star(_settled),
}


def _demand_forecasts(snap: Snapshot) -> tuple[DataFrame, DataFrame]:
    """Two simple forecasts to compare: last week's quantity and the four-week mean."""
    weekly = features.weekly_demand_features(_demand(snap))

    def forecast(column: str) -> DataFrame:
        predicted = fixed(column, 2)
        actual = F.col("weekly_quantity").cast("double")
        return weekly.select(
            *compare.DEMAND_KEYS,
            actual.alias("actual_quantity"),
            predicted.alias("predicted_quantity"),
            fixed(F.abs(actual - predicted), 2).alias("absolute_error"),
            split_label("week_start_date", SPLITS).alias("split"),
        )

    return forecast("lag_1w_quantity"), forecast("rolling_4w_avg_quantity")


def _risk_forecasts(snap: Snapshot) -> tuple[DataFrame, DataFrame]:
    """Next week's risk from last week's cost ratio and from the four-week mean of it."""
    weekly = features.waste_features(waste.wastage(snap))

    def forecast(column: str) -> DataFrame:
        return weekly.select(
            *compare.DEMAND_KEYS,
            F.col("next_week_wastage_risk").alias("actual_label"),
            F.when(fixed(column, 6) > 0.05, 1).otherwise(0).alias("predicted_label"),
            fixed(F.least(F.lit(1.0), F.col(column)), 4).alias("risk_probability"),
            split_label("week_start_date", SPLITS).alias("split"),
        )

    return forecast("lag_1w_cost_ratio"), forecast("lag_4w_avg_cost_ratio")


def _segments(snap: Snapshot) -> tuple[DataFrame, DataFrame]:
    """Segments of the whole history and of completed orders up to the training end."""
    now = customers.customer_rfm(snap).select(
        F.col("source_customer_id").alias("customer_id"), F.col("rfm_segment").alias("segment_label")
    )
    then = features.churn_features_at(snap, SPLITS.train_end).select(
        "customer_id",
        F.when(F.col("r_score") == 0, "Inactive").otherwise(rfm_segment()).alias("segment_label"),
    )
    return now, then


def _overall(snap: Snapshot) -> DataFrame:
    demand_rows = compare.compare_regression(*_demand_forecasts(snap))
    risk_rows = compare.compare_classes(
        *_risk_forecasts(snap), compare.DEMAND_KEYS, "risk_probability"
    )
    return compare.overall_agreement(
        [
            compare.regression_summary(demand_rows),
            compare.class_summary(risk_rows, "wastage_risk"),
            compare.segment_summary(compare.compare_segments(*_segments(snap))),
        ]
    )


COMPARISON: dict[str, Query] = {
    "agreement_regression": on_star(
        lambda s: compare.compare_regression(*_demand_forecasts(s), split=None), "brand"
    ),
    "agreement_regression_summary": on_star(
        lambda s: compare.regression_summary(compare.compare_regression(*_demand_forecasts(s))),
        "brand",
    ),
    "agreement_classes": on_star(
        lambda s: compare.compare_classes(
            *_risk_forecasts(s), compare.DEMAND_KEYS, "risk_probability"
        ),
        "brand",
    ),
    "agreement_classes_summary": on_star(
        lambda s: compare.class_summary(
            compare.compare_classes(*_risk_forecasts(s), compare.DEMAND_KEYS, "risk_probability"),
            "wastage_risk",
        ),
        "brand",
    ),
    "segment_contingency": on_star(
        lambda s: compare.segment_contingency(compare.compare_segments(*_segments(s)))
    ),
    "overall_agreement": on_star(_overall, "brand"),
}


SCENARIOS = [
    advice.Scenario("cheaper", -10.0),
    advice.Scenario("dearer", 5.0, 0.0, 20.0),
    advice.Scenario("discount", 0.0, 15.0),
    advice.Scenario("mixed", 8.0, -10.0, 50.0),
]


def _options(snap: Snapshot) -> DataFrame:
    menu_dimension = snap.menu_items.join(snap.menu_categories, "source_category_id", "left")
    return serving.filter_options(
        operations.location_performance(snap), menu_dimension, operations.channel_performance(snap)
    )


def _kpis(snap: Snapshot) -> DataFrame:
    return serving.executive_summary(
        operations.location_performance(snap),
        snap.customers,
        anomalies.sales_anomalies(snap.orders, snap.restaurants, fill_days=False),
    )


def _menu_page(snap: Snapshot) -> DataFrame:
    rows = serving.menu_filter(
        menu.menu_performance(snap), category="economy", classification="Low Performer", search="in"
    )
    order = [F.desc("composite_score"), "source_restaurant_id", "source_menu_item_id"]
    return serving.page(rows, order, 20, 50).select(
        "source_restaurant_id", "source_menu_item_id", "item_name", "composite_score",
        "classification",
    )


def _customer_page(snap: Snapshot) -> DataFrame:
    people = serving.customer_search(customers.customer_rfm(snap), "At Risk", "customer")
    return serving.page(people, [F.desc("monetary_value"), "source_customer_id"], 5, 25)


def _recommended(snap: Snapshot) -> DataFrame:
    return advice.recommendations(
        menu.menu_performance(snap), waste.wastage(snap), customers.customer_rfm(snap)
    )


SERVING: dict[str, Query] = {
    "filter_options": on_star(_options),
    "exec_kpis": on_star(_kpis),
    "menu_page": on_star(_menu_page),
    "menu_class_counts": on_star(
        lambda s: serving.value_counts(menu.menu_performance(s), "classification")
    ),
    "customer_page": on_star(_customer_page),
    "segment_counts": on_star(
        lambda s: serving.value_counts(customers.customer_rfm(s), "rfm_segment")
    ),
    "heatmap": on_star(
        lambda s: serving.hourly_heatmap(operations.peak_analysis(s.orders, s.restaurants))
    ),
    "channel_breakdown": on_star(
        lambda s: serving.channel_breakdown(operations.channel_performance(s))
    ),
    "location_ranking": on_star(
        lambda s: serving.location_ranking(operations.location_performance(s))
    ),
    "demand_curve": on_star(lambda s: serving.demand_curve(_demand_forecasts(s)[1]), "brand"),
    "sensitivity_counts": on_star(
        lambda s: serving.value_counts(pricing.pricing(s), "sensitivity_class"), "brand"
    ),
    "waste_by_reason": on_star(lambda s: serving.waste_by_reason(waste.wastage(s))),
    "high_risk_items": on_star(lambda s: serving.high_risk_items(waste.wastage(s))),
    "weekly_waste_trend": on_star(lambda s: serving.weekly_waste(waste.wastage(s))),
    "risk_summary": on_star(lambda s: serving.risk_summary(_risk_forecasts(s)[1]), "brand"),
    "top_risk_items": on_star(
        lambda s: serving.top_risk_items(_risk_forecasts(s)[1], s.menu_items), "brand"
    ),
    "promotion_summary": on_star(lambda s: serving.promotion_summary(pricing.promotions(s))),
    "top_pairs": on_star(lambda s: serving.top_pairs(basket.basket_analysis(s)), "brand"),
    "sales_anomaly_feed": on_star(
        lambda s: serving.sales_anomaly_feed(
            anomalies.sales_anomalies(s.orders, s.restaurants, fill_days=False)
        )
    ),
    "rating_anomaly_feed": on_star(
        lambda s: serving.rating_anomaly_feed(anomalies.rating_anomalies(s)), "brand"
    ),
    "recommendations": on_star(_recommended),
    "what_if_grid": on_star(
        lambda s: advice.what_if(menu.menu_performance(s, False), pricing.pricing(s), SCENARIOS),
        "brand",
    ),
}


MODELS: dict[str, Query] = {
    "demand_tournament": on_star(
        lambda s: models.demand_contest(
            features.weekly_demand_features(_demand(s)), SPLITS
        ).predictions,
        "brand",
    ),
    "waste_tournament": on_star(
        lambda s: models.waste_contest(features.waste_features(waste.wastage(s)), SPLITS).predictions,
        "brand",
    ),
    "churn_tournament": on_star(
        lambda s: models.churn_contest(features.churn_panel(s.orders, CUTOFFS)).predictions
    ),
    "segmentation": on_star(
        lambda s: models.segment_contest(
            features.churn_features(customers.customer_rfm(s)), with_mixture=True
        ).predictions
    ),
}


INSIGHTS: dict[str, Query] = insights()
GOVERNANCE: dict[str, Query] = {name: on_star(build, item) for name, (build, item) in governance().items()}

CHECKS: dict[str, Query] = {name: on_star(build, item) for name, (build, item) in checks().items()}


def all_queries() -> dict[str, Query]:
    return {**CHECKS, **MARTS, **JOINS, **QUALITY, **FEATURES, **COMPARISON, **SERVING, **INSIGHTS, **GOVERNANCE, **MODELS}
