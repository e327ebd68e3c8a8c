"""Splitting a table into clean rows and quarantined rows with a reason."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions.numeric import fixed, ratio
from martloom.sources.schemas import ALLOWED_VALUES
from martloom.sources.snapshot import Snapshot


@dataclass(frozen=True)
class Rule:
    """A named defect. A NULL test result is not a defect."""

    reason: str
    violated: Column


@dataclass(frozen=True)
class Parent:
    """A parent table whose key a column must name; NULL passes only where it is optional."""

    reason: str
    column: str
    table: DataFrame
    key: str
    optional: bool = False


@dataclass(frozen=True)
class Outcome:
    """Every row with its quarantine_reason, NULL where the row is clean."""

    judged: DataFrame

    @property
    def clean(self) -> DataFrame:
        return self.judged.filter(F.col("quarantine_reason").isNull()).drop("quarantine_reason")

    @property
    def quarantined(self) -> DataFrame:
        return self.judged.filter(F.col("quarantine_reason").isNotNull())


@dataclass(frozen=True)
class Uniqueness:
    """The key that must be unique, and the order that decides which row came first."""

    key: str
    reason: str
    order_by: list[str] = field(default_factory=list)


def _with_defect(df: DataFrame, checks: list[Rule | Parent]) -> DataFrame:
    """Add `_defect`, the reason of the first failing check or NULL."""
    chain: list[Column] = []
    out = df
    for i, check in enumerate(checks):
        if isinstance(check, Parent):
            mark = f"_parent{i}"
            known = check.table.select(F.col(check.key).alias(check.column)).distinct()
            out = out.join(known.withColumn(mark, F.lit(True)), check.column, "left")
            failed = F.col(mark).isNull()
            if check.optional:
                failed = failed & F.col(check.column).isNotNull()
        else:
            failed = check.violated
        chain.append(F.when(failed, F.lit(check.reason)))
    defect = F.coalesce(*chain) if chain else F.lit(None).cast("string")
    return out.withColumn("_defect", defect).select(*df.columns, "_defect")


def split(df: DataFrame, checks: list[Rule | Parent], unique: Uniqueness | None = None) -> Outcome:
    """Route each row to clean or quarantine by its first matching reason.

    A repeated key is judged before the other checks, but only a clean row makes later
    rows duplicates: the first row without another defect stays, rows before it keep
    their own defect, all after it are duplicates. "First" is by `order_by`, then by all
    columns. Only keys that do repeat are compared; their identical copies are counted
    into one row first, and the first clean position is a plain aggregate, so a key with
    very many rows never gathers in one task.
    """
    columns = df.columns
    tagged = _with_defect(df, checks)
    defect = F.col("_defect").alias("quarantine_reason")
    if unique is None:
        return Outcome(tagged.select(*columns, defect))

    key = unique.key
    repeated = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = repeated.filter("_n > 1").select("_key")
    # rows without a key are copies of each other, like any others with one key
    same = F.col(key).eqNullSafe(F.col("_key"))
    single = tagged.join(repeated, same, "left_anti").select(*columns, defect)
    copies = (
        tagged.join(repeated, same, "left_semi")
        .groupBy(*columns, "_defect")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_place", F.struct(*unique.order_by, *columns))
    )
    first = copies.groupBy(F.col(key).alias("_key")).agg(
        F.min(F.when(F.col("_defect").isNull(), F.col("_place"))).alias("_first")
    )
    kept = (F.col("_place") == F.col("_first")) & (F.col("_copy") == 1)
    late = F.col("_place") >= F.col("_first")
    several = (
        copies.join(first, same, "inner")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(
            *columns,
            F.when(kept, F.lit(None))
            .when(late, F.lit(unique.reason))
            .otherwise(F.col("_defect"))
            .alias("quarantine_reason"),
        )
    )
    return Outcome(single.unionByName(several))


def stamp(quarantined: DataFrame) -> DataFrame:
    """The stored form: with the time of quarantine."""
    return quarantined.withColumn("quarantined_at", F.current_timestamp())


def clean_orders(snap: Snapshot, last_year: int = 2025) -> Outcome:
    return split(
        snap.orders,
        [
            Rule("FUTURE_TIMESTAMP", F.year("order_timestamp") > last_year),
            Parent(
                "ORPHANED_RESTAURANT_ID",
                "source_restaurant_id",
                snap.restaurants,
                "source_restaurant_id",
            ),
            Parent(
                "ORPHANED_CUSTOMER_ID",
                "source_customer_id",
                snap.customers,
                "source_customer_id",
                optional=True,
            ),
        ],
        Uniqueness("source_order_id", "DUPLICATE_ORDER_ID", ["order_timestamp"]),
    )


def clean_order_items(snap: Snapshot, good_orders: DataFrame) -> Outcome:
    """Lines of quarantined orders go with their order."""
    return split(
        snap.order_items,
        [
            Rule("INVALID_NEGATIVE_PRICE", F.col("unit_price_at_sale") < 0),
            Rule("INVALID_ZERO_QUANTITY", F.col("quantity") <= 0),
            Parent("ORPHANED_ORDER_PARENT", "source_order_id", good_orders, "source_order_id"),
            Parent(
                "ORPHANED_MENU_ITEM", "source_menu_item_id", snap.menu_items, "source_menu_item_id"
            ),
        ],
        Uniqueness("source_order_item_id", "DUPLICATE_ORDER_ITEM_ID", ["created_at"]),
    )


def clean_ratings(ratings: DataFrame) -> Outcome:
    return split(
        ratings, [Rule("INVALID_RATING_SCORE_BOUNDS", ~F.col("rating_score").between(1, 5))]
    )


@dataclass(frozen=True)
class Cleaned:
    """The tables that were judged, and the snapshot they belong to."""

    raw: Snapshot
    outcomes: dict[str, Outcome]

    @property
    def snapshot(self) -> Snapshot:
        return self.raw.with_tables(**{n: o.clean for n, o in self.outcomes.items()})

    @property
    def quarantined(self) -> dict[str, DataFrame]:
        return {n: o.quarantined for n, o in self.outcomes.items()}


def clean_snapshot(
    snap: Snapshot,
    last_year: int = 2025,
    store: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> Cleaned:
    """Quarantine orders, then their lines, then ratings; other tables pass through.

    `store` may write each judged table and return the stored one, so that the clean and
    the quarantined rows are both read from one pass.
    """

    def kept(name: str, outcome: Outcome) -> Outcome:
        return Outcome(store(outcome.judged, name))

    orders = kept("orders", clean_orders(snap, last_year))
    items = kept("order_items", clean_order_items(snap, orders.clean))
    ratings = kept("ratings", clean_ratings(snap.ratings))
    return Cleaned(snap, {"orders": orders, "order_items": items, "ratings": ratings})


def reason_counts(quarantined: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and reason."""
    parts = [
        df.groupBy("quarantine_reason")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("table_name"), "quarantine_reason", "row_count")
        for name, df in quarantined.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def quality_report(cleaned: Cleaned) -> DataFrame:
    """Per table and in total: raw = clean + quarantined, and the clean percentage.

    Each judged table is counted in one pass over its rows and reasons.
    """
    no_reason = F.lit(None).cast("string").alias("quarantine_reason")
    judged = {
        name: cleaned.outcomes[name].judged.select("quarantine_reason")
        if name in cleaned.outcomes
        else df.select(no_reason)
        for name, df in cleaned.raw.tables().items()
    }
    counts = reason_counts(judged)
    # an empty table still has its row in the report
    listed = counts.sparkSession.createDataFrame(
        [(name, None, 0) for name in judged],
        "table_name string, quarantine_reason string, row_count long",
    )
    counts = counts.unionByName(listed)
    is_clean = F.col("quarantine_reason").isNull()
    per_table = counts.rollup("table_name").agg(
        F.sum(F.when(is_clean, F.col("row_count")).otherwise(0)).alias("clean_rows"),
        F.sum(F.when(is_clean, 0).otherwise(F.col("row_count"))).alias("quarantined_rows"),
    )
    raw = F.col("clean_rows") + F.col("quarantined_rows")
    share = fixed(ratio("clean_rows", raw) * 100.0, 3)
    return per_table.select(
        F.coalesce("table_name", F.lit("ALL")).alias("table_name"),
        raw.alias("raw_rows"),
        "clean_rows",
        "quarantined_rows",
        F.coalesce(share, F.lit(100.0)).alias("cleanliness_rate_pct"),
        F.when(F.col("quarantined_rows") > 0, "PASSED_WITH_QUARANTINE")
        .otherwise("CLEAN")
        .alias("overall_status"),
    )


def chronology_rules() -> dict[str, list[Rule]]:
    """Dated rules beyond the cleaning pass."""
    return {
        "pricing_history": [
            Rule("INVALID_INTERVAL", F.col("effective_to") <= F.col("effective_from"))
        ],
        "promotions": [Rule("INVALID_INTERVAL", F.col("end_date") < F.col("start_date"))],
        "wastage": [Rule("INVALID_WASTE_QUANTITY", F.col("quantity_lost") <= 0)],
    }


def constraint_rules(entity: str) -> list[Rule]:
    """Allowed values and ranges of one table."""
    allowed = [
        Rule(f"INVALID_{column.upper()}", ~F.col(column).isin(*values))
        for (table, column), values in ALLOWED_VALUES.items()
        if table == entity
    ]
    ranges = {
        "restaurants": {"SEATING_CAPACITY": F.col("seating_capacity") <= 0},
        "menu_items": {
            "SPICINESS_LEVEL": ~F.col("spiciness_level").between(0, 4),
            "BASE_PRICE": F.col("current_base_price") < 0,
            "BASE_COST": F.col("current_base_cost") < 0,
        },
        "promotions": {"DISCOUNT_VALUE": F.col("discount_value") < 0},
        "orders": {"TOTAL_AMOUNT": F.col("total_amount") < 0},
        "inventory": {
            "STOCK_QUANTITY": F.col("current_stock_quantity") < 0,
            "PURCHASE_COST": F.col("unit_purchase_cost") < 0,
        },
        "wastage": {"COST_LOSS": F.col("cost_loss_amount") < 0},
    }
    bounded = [Rule(f"INVALID_{n}", test) for n, test in ranges.get(entity, {}).items()]
    return allowed + bounded + chronology_rules().get(entity, [])


def rule_violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Violations per rule, all rules counted in one pass."""
    row = df.agg(*[F.count_if(r.violated).alias(r.reason) for r in rules])
    cells = [F.struct(F.lit(r.reason).alias("rule"), F.col(r.reason).alias("violations")) for r in rules]
    return row.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
