"""Oracle SQL per query key."""

from __future__ import annotations

from martloom.catalog import mart_sql as m
from martloom.catalog.checks import check_oracles
from martloom.catalog.domain_sql import with_domain
from martloom.catalog.governance import governance_oracles
from martloom.catalog.insights import insight_oracles
from martloom.catalog.quality_sql import quality_oracles
from martloom.catalog.queries import CUTOFFS, SCENARIOS, SPLITS
from martloom.catalog.serving_sql import comparison_oracles, feature_oracles, serving_oracles

_SPLITS = (SPLITS.train_end, SPLITS.validation_end, SPLITS.test_end)


def mart_oracles() -> dict[str, str]:
    orders = with_domain("orders", "restaurants")
    events = with_domain("events")
    return {
        "menu_performance": m.menu_performance(True),
        "menu_performance_chain": m.menu_performance(False),
        "menu_performance_brands": m.menu_performance(True, "brand"),
        "menu_performance_spread": m.menu_performance(True),
        "customer_rfm": m.customer_rfm(),
        "customer_rfm_spread": m.customer_rfm(),
        "basket_analysis": m.basket_analysis(),
        "basket_analysis_spread": m.basket_analysis(),
        "peak_analysis": m.peak_analysis("valid_orders", "d_restaurants", orders),
        "peak_analysis_events": m.peak_analysis("e_orders", "e_branches", events),
        "location_performance": m.location_performance(),
        "channel_performance": m.channel_performance(),
        "wastage": m.wastage(),
        "wastage_brands": m.wastage("brand"),
        "pricing": m.pricing(),
        "promotions": m.promotions(),
        "rating_anomalies": m.rating_anomalies("brand"),
        "sales_anomalies": m.sales_anomalies(orders, "valid_orders", "d_restaurants", False),
        "sales_anomalies_all_days": m.sales_anomalies(
            orders, "valid_orders", "d_restaurants", True
        ),
        "sales_anomalies_events": m.sales_anomalies(events, "e_orders", "e_branches", True),
        "demand_historical": m.demand_historical(_SPLITS, "brand"),
    }


def all_oracles() -> dict[str, str]:
    return {
        **check_oracles(),
        **mart_oracles(),
        **quality_oracles(),
        **feature_oracles(_SPLITS, CUTOFFS),
        **comparison_oracles(_SPLITS),
        **serving_oracles(_SPLITS, SCENARIOS),
        **insight_oracles(),
        **governance_oracles(),
    }
