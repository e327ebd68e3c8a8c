"""What the marts share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from martloom.config import OrderRules
from martloom.operators.joins import sold_lines
from martloom.sources.snapshot import Snapshot
from martloom.sources.staging import stage

RESTAURANT = "source_restaurant_id"
ITEM = "source_menu_item_id"
CUSTOMER = "source_customer_id"
ORDER = "source_order_id"


def sold_of(snap: Snapshot, rules: OrderRules) -> DataFrame:
    """The stored line-header join, or the join itself."""
    return snap.sold if snap.sold is not None else sold_lines(snap.order_items, snap.orders, rules)


def with_stored_sales(snap: Snapshot, rules: OrderRules = OrderRules()) -> Snapshot:
    """Write the line-header join once so that every mart after it scans the result."""
    return snap.with_tables(sold=stage(sold_lines(snap.order_items, snap.orders, rules), "sold"))
