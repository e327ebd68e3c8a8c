"""Time the twelve marts and a few heavy operators; prints one JSON line.

"queries" holds every query on its own, written to Parquet. "value" is one run of all
twelve marts, each written and counted, with the join of lines and order headers stored
once and its time included. Everything runs once to warm up and then BENCH_REPEATS
times; medians are reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from martloom.catalog.queries import SCENARIOS, all_queries
from martloom.plans import advice, serving
from martloom.plans.runner import run_marts
from martloom.session import local_session
from martloom.sources.star import star_snapshot

MARTS = [
    "menu_performance_brands",
    "customer_rfm",
    "basket_analysis",
    "peak_analysis",
    "location_performance",
    "channel_performance",
    "wastage_brands",
    "pricing",
    "promotions",
    "rating_anomalies",
    "sales_anomalies",
    "demand_historical",
]
OTHERS = [
    "menu_performance",
    "wastage",
    "sales_anomalies_all_days",
    "clean_lines",
    "quality_reconciliation",
    "asof_price",
    "promo_match",
    "weekly_demand_features",
    "churn_panel_features",
    "agreement_regression",
    "what_if_grid",
    "stock_levels",
    "reorder_points",
    "slow_movers",
    "promotion_lift",
    "drift_index",
    "customer_rollups",
]


def stored_pages(spark, snap, root: str) -> dict:
    """Serving from the marts just written; reads the needed columns only."""

    def mart(name: str, *columns: str):
        return serving.stored_mart(spark, root, f"mart_{name}", list(columns))

    def kpis():
        location = mart("location_performance", "gross_revenue", "total_orders", "contribution_margin", "total_waste_cost")
        sales = mart("sales_anomalies", "is_spike_anomaly", "is_drop_anomaly")
        return serving.executive_summary(location, snap.customers, sales).collect()

    def channels():
        columns = ["channel", "source_restaurant_id", "total_orders", "gross_amount", "net_revenue", "contribution_margin"]
        return mart("channel_performance", *columns).groupBy("channel").count().collect()

    def segments():
        return serving.value_counts(mart("customer_rfm", "rfm_segment"), "rfm_segment").collect()

    def what_if():
        paths = [f"{root}/mart_{name}.parquet" for name in ("menu_performance", "pricing")]
        return advice.what_if(*advice.stored_inputs(spark, *paths), SCENARIOS).collect()

    return {"stored_kpis": kpis, "stored_channels": channels, "stored_segments": segments, "stored_what_if": what_if}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cores, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    catalog = all_queries()
    scratch = tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp")

    def timed(name: str, work) -> float | None:
        """The median of the runs; a failure costs this figure alone."""
        runs = []
        for _ in range(repeats + 1):
            started = time.perf_counter()
            try:
                work()
            except Exception as err:  # reported, and shown as null in the result
                print(f"{name}: {type(err).__name__}: {str(err)[:400]}", file=sys.stderr, flush=True)
                return None
            runs.append(time.perf_counter() - started)
        median = round(statistics.median(runs[1:]), 3)
        print(f"{name}: {median}", file=sys.stderr, flush=True)
        return median

    def write(name: str) -> None:
        catalog[name](spark, sf_dir).write.mode("overwrite").parquet(f"{scratch}/{name}")

    seconds = {name: timed(name, lambda: write(name)) for name in only or [*MARTS, *OTHERS]}
    snap = star_snapshot(spark, sf_dir, "brand")
    total = timed("all marts", lambda: run_marts(snap, f"{scratch}/marts"))
    if not only:
        seconds |= {name: timed(name, page) for name, page in stored_pages(spark, snap, f"{scratch}/marts").items()}
    print(
        json.dumps(
            {
                "metric": "all_twelve_marts_written",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
