"""Cleaning a snapshot, and building and writing all of its marts."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from martloom.operators.quarantine import clean_snapshot, quality_report, stamp
from martloom.plans import anomalies, basket, customers, demand, menu, operations, pricing, waste
from martloom.plans.base import with_stored_sales
from martloom.sources.sinks import write_mart
from martloom.sources.snapshot import Snapshot, table_path
from martloom.sources.staging import stage, staging_scope

MARTS: dict[str, Callable[[Snapshot], DataFrame]] = {
    "mart_menu_performance": menu.menu_performance,
    "mart_customer_rfm": customers.customer_rfm,
    "mart_basket_analysis": basket.basket_analysis,
    "mart_peak_analysis": lambda s: operations.peak_analysis(s.orders, s.restaurants),
    "mart_location_performance": operations.location_performance,
    "mart_channel_performance": operations.channel_performance,
    "mart_wastage": waste.wastage,
    "mart_pricing": pricing.pricing,
    "mart_promotions": pricing.promotions,
    "mart_ratings_anomalies": anomalies.rating_anomalies,
    "mart_sales_anomalies": lambda s: anomalies.sales_anomalies(s.orders, s.restaurants),
    "mart_demand_historical": demand.demand_historical,
}


def run_cleaning(
    snap: Snapshot, clean_dir: str, quarantine_dir: str, last_year: int = 2025
) -> DataFrame:
    """Write the clean snapshot and the quarantine tables; returns the quality report.

    Each judged table is stored once; its clean and quarantined rows and the report's
    counts are then scans of the stored table.
    """
    cleaned = clean_snapshot(snap, last_year, stage)
    for name, df in cleaned.snapshot.tables().items():
        df.write.mode("overwrite").parquet(table_path(clean_dir, name))
    for name, df in cleaned.quarantined.items():
        stamp(df).write.mode("overwrite").parquet(table_path(quarantine_dir, f"{name}_quarantine"))
    return quality_report(cleaned)


@dataclass(frozen=True)
class MartRun:
    rows: int
    seconds: float
    columns: list[str]


def run_marts(
    snap: Snapshot,
    out: str,
    marts: dict[str, Callable[[Snapshot], DataFrame]] = MARTS,
    store_sales: bool = True,
    at_once: int = 4,
) -> dict[str, MartRun]:
    """Write every mart and report rows, time and columns.

    The join of lines and headers, which nine marts need, is stored once. A few marts run
    at once, so that the tail of one mart's stages does not leave the executors idle.
    """
    spark = snap.orders.sparkSession
    with staging_scope(spark):
        return _run_marts(snap, out, marts, store_sales, at_once)


def _run_marts(
    snap: Snapshot,
    out: str,
    marts: dict[str, Callable[[Snapshot], DataFrame]],
    store_sales: bool,
    at_once: int,
) -> dict[str, MartRun]:
    ready = with_stored_sales(snap) if store_sales else snap

    @inheritable_thread_target(snap.orders.sparkSession)
    def write(name: str) -> MartRun:
        started = time.monotonic()
        df = marts[name](ready)
        rows = write_mart(df, table_path(out, name))
        return MartRun(rows, round(time.monotonic() - started, 2), df.columns)

    # every thread sees the scope that deletes what is staged
    contexts = [copy_context() for _ in marts]
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(marts, pool.map(lambda c, name: c.run(write, name), contexts, marts)))
