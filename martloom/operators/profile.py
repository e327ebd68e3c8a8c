"""Profiling: schema defects, key patterns, nulls, duplicates, invariants, foreign keys.

Each function reads its table once (one aggregate) and returns a small DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions.numeric import as_col, cents, fixed, from_cents, ratio
from martloom.sources.schemas import KEY_PATTERNS, KEYS, table_schema
from martloom.sources.snapshot import Snapshot

FORMULA_TOLERANCE = 0.02


def _unpivoted(row: DataFrame, names: list[str], name_col: str, value_cols: list[str]) -> DataFrame:
    """Turn one wide aggregate row (name__value columns) into one row per name."""
    cells = [
        F.struct(
            F.lit(n).alias(name_col),
            *[F.col(f"`{n}__{v}`").alias(v) for v in value_cols],
        )
        for n in names
    ]
    return row.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def measures(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """(measure, value) rows from one aggregate over df."""
    row = df.agg(*[c.cast("double").alias(f"{n}__value") for n, c in counts.items()])
    return _unpivoted(row, list(counts), "measure", ["value"])


def validate_schema(entity: str, df: DataFrame) -> DataFrame:
    """Missing, unexpected and mistyped columns, and required columns that hold nulls."""
    declared = {f.name: f for f in table_schema(entity).fields}
    actual = {f.name: f for f in df.schema.fields}
    found: list[tuple[str, str, str]] = []
    for name, field in declared.items():
        if name not in actual:
            found.append((name, "MISSING_FIELD", f"expected {field.dataType.simpleString()}"))
        elif actual[name].dataType != field.dataType:
            got = actual[name].dataType.simpleString()
            found.append(
                (name, "TYPE_MISMATCH", f"expected {field.dataType.simpleString()}, found {got}")
            )
    found += [(n, "UNEXPECTED_FIELD", "not in the contract") for n in actual if n not in declared]
    schema = "column_name string, defect string, detail string"
    listed = df.sparkSession.createDataFrame(found, schema)
    required = [n for n, f in declared.items() if not f.nullable and n in actual]
    if not required:
        return listed
    row = df.agg(*[F.count_if(F.col(n).isNull()).alias(f"{n}__nulls") for n in required])
    nulls = (
        _unpivoted(row, required, "column_name", ["nulls"])
        .filter(F.col("nulls") > 0)
        .select(
            "column_name",
            F.lit("NULL_IN_REQUIRED_FIELD").alias("defect"),
            F.format_string("%d nulls", "nulls").alias("detail"),
        )
    )
    return listed.unionByName(nulls)


def validate_identifiers(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """Rows checked and rows whose key is null or does not match, over the whole table."""
    text = F.col(key).cast("string")
    return df.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.count_if(text.isNull() | ~text.rlike(pattern)).alias("invalid_ids"),
    )


def identifier_pattern(entity: str) -> tuple[str, str]:
    """(key column, pattern) of a source table."""
    if entity not in KEYS:
        raise KeyError(f"unknown entity {entity!r}")
    return KEYS[entity], KEY_PATTERNS[entity]


def column_profile(df: DataFrame) -> DataFrame:
    """Type, rows, nulls and null percentage per column."""
    names = df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    row = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.col(n).isNull()).alias(f"{n}__null_count") for n in names],
        *[F.lit(types[n]).alias(f"{n}__data_type") for n in names],
    )
    cells = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.col(f"`{n}__data_type`").alias("data_type"),
            F.col("row_count"),
            F.col(f"`{n}__null_count`").alias("null_count"),
        )
        for n in names
    ]
    share = ratio("null_count", "row_count") * 100.0
    return (
        row.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.*")
        .withColumn("null_pct", F.coalesce(fixed(share, 2), F.lit(0.0)))
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows, distinct keys and surplus rows; NULL counts as one key value."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_count"),
    )


def breakdown(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("row_count"))


def _off(actual: Column | str, expected_cents: Column) -> Column:
    """True where a 2-digit amount differs from its formula by more than the tolerance."""
    return F.abs(cents(actual) - expected_cents) > int(FORMULA_TOLERANCE * 100)


def orders_profile(orders: DataFrame, last_year: int = 2025) -> DataFrame:
    expected = (
        cents("subtotal_amount")
        - cents("discount_amount")
        + cents("tax_amount")
        + cents("tip_amount")
    )
    guests = F.count_if(F.col("source_customer_id").isNull())
    rows = F.count(F.lit(1))
    return measures(
        orders,
        {
            "rows": rows,
            "guest_orders": guests,
            "guest_pct": fixed(ratio(guests, rows) * 100.0, 2),
            "future_timestamps": F.count_if(F.year("order_timestamp") > last_year),
            "settlement_mismatches": F.count_if(_off("total_amount", expected)),
        },
    )


def order_items_profile(items: DataFrame) -> DataFrame:
    qty = F.col("quantity").cast("long")
    net = qty * cents("unit_price_at_sale") - cents("line_discount")
    margin = cents("line_net_revenue") - qty * cents("unit_cost_at_sale")
    return measures(
        items,
        {
            "rows": F.count(F.lit(1)),
            "negative_prices": F.count_if(F.col("unit_price_at_sale") < 0),
            "zero_quantities": F.count_if(F.col("quantity") <= 0),
            "negative_margins": F.count_if(F.col("line_contribution_margin") < 0),
            "net_revenue_mismatches": F.count_if(_off("line_net_revenue", net)),
            "margin_mismatches": F.count_if(_off("line_contribution_margin", margin)),
        },
    )


def ratings_profile(ratings: DataFrame) -> DataFrame:
    text = F.col("review_text")
    return measures(
        ratings,
        {
            "rows": F.count(F.lit(1)),
            "out_of_range": F.count_if(~F.col("rating_score").between(1, 5)),
            "missing_text": F.count_if(text.isNull()),
        },
    )


def wastage_profile(wastage: DataFrame) -> DataFrame:
    """Rows and cost per reason."""
    return wastage.groupBy("wastage_reason").agg(
        F.count(F.lit(1)).alias("row_count"),
        from_cents(F.sum(cents("cost_loss_amount"))).alias("total_cost"),
    )


def foreign_key(
    child: DataFrame,
    column: str,
    parent: DataFrame,
    parent_key: str,
    name: str,
    ignore_null: bool = False,
) -> DataFrame:
    """References checked (rows), and how many of them name no parent.

    Both sides are reduced to one row per key before they meet, so a hot key is one row.
    A NULL reference is an orphan unless ignored.
    """
    refs = child.groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("refs"))
    if ignore_null:
        refs = refs.filter(F.col("k").isNotNull())
    known = parent.select(F.col(parent_key).alias("k")).distinct().withColumn("known", F.lit(True))
    orphaned = F.when(F.col("known").isNull(), F.col("refs")).otherwise(0)
    return (
        refs.join(known, "k", "left")
        .agg(
            F.coalesce(F.sum("refs"), F.lit(0)).alias("total_foreign_keys_checked"),
            F.coalesce(F.sum(orphaned), F.lit(0)).alias("orphaned_count"),
        )
        .select(
            F.lit(name).alias("constraint"),
            "total_foreign_keys_checked",
            "orphaned_count",
            (F.col("orphaned_count") == 0).alias("is_clean"),
        )
    )


def referential_integrity(snap: Snapshot) -> DataFrame:
    """The four foreign keys of the orders; guests (no customer) are not checked."""
    items, orders = snap.order_items, snap.orders
    checks = [
        (items, "source_order_id", orders, "order_items_to_orders", False),
        (items, "source_menu_item_id", snap.menu_items, "order_items_to_menu_items", False),
        (orders, "source_restaurant_id", snap.restaurants, "orders_to_restaurants", False),
        (orders, "source_customer_id", snap.customers, "orders_to_customers", True),
    ]
    results = [foreign_key(c, k, p, k, name, skip) for c, k, p, name, skip in checks]
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other)
    return out


def operational_flags(lines: DataFrame) -> DataFrame:
    """Flags that are kept, not quarantined: cancelled or voided, guest, loss-making line."""
    return lines.withColumns(
        {
            "flag_not_fulfilled": F.col("order_status").isin("Cancelled", "Voided"),
            "flag_guest": F.col("source_customer_id").isNull(),
            "flag_negative_margin": as_col("line_contribution_margin") < 0,
        }
    )
