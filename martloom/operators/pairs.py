"""Co-occurring item pairs within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.config import ScaleRules

_PAIR = ["item_a_id", "item_b_id"]


def _pairs_of_rows(groups: DataFrame, items: str) -> DataFrame:
    """All ordered pairs of a sorted array column, one row each."""
    tails = F.transform(
        F.sequence(F.lit(1), F.size(items) - 1),
        lambda i: F.transform(
            F.slice(items, i + 1, F.size(items)),
            lambda b: F.struct(F.element_at(items, i).alias("a"), b.alias("b")),
        ),
    )
    return groups.select(F.explode(F.flatten(tails)).alias("p")).select(
        F.col("p.a").alias("item_a_id"), F.col("p.b").alias("item_b_id")
    )


def _pairs_of_blocks(members: DataFrame, group: str, item: str, block_items: int) -> DataFrame:
    """All ordered pairs of large groups, cut into blocks of items.

    A pair of blocks is the join key, so a group becomes many tasks of bounded size.
    """
    sizes = members.groupBy(group).agg(
        F.ceil(F.count(item) / F.lit(block_items)).cast("int").alias("blocks")
    )
    placed = (
        members.join(sizes, group, "inner")
        .withColumn("own", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )

    def side(x: str, y: str, name: str) -> DataFrame:
        return placed.select(
            group, F.col(x).alias("x"), F.col(y).alias("y"), F.col(item).alias(name)
        )

    return (
        side("own", "other", "item_a_id")
        .join(side("other", "own", "item_b_id"), [group, "x", "y"], "inner")
        .filter(F.col("item_a_id") < F.col("item_b_id"))
        .select(*_PAIR)
    )


def _counted(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias(name))


def _in_large(pair_side: str) -> Column:
    return F.coalesce(F.col(f"large_{pair_side}"), F.lit(0))


def pair_counts(
    members: DataFrame,
    group: str,
    item: str,
    min_count: int,
    scale: ScaleRules = ScaleRules(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs seen in at least min_count groups, groups per item, number of groups).

    `members` holds distinct (group, item) rows; only groups of two or more items count.

    Groups of up to `small_basket` items form their pairs inside one row. Larger groups do
    not form all theirs. An item in fewer than min_count large groups cannot reach the
    threshold there alone, so its pairs must also occur in small groups, often enough to
    get there with the large ones added; only those candidates are looked up in the large
    groups, from the rarer side. That leaves the items in at least min_count large groups,
    whose pairs are counted block by block.
    """
    sizes = members.groupBy(group).agg(F.count(item).alias("n"))
    large_groups = sizes.filter(F.col("n") > scale.small_basket).select(group)
    small = (
        members.join(large_groups, group, "left_anti")
        .groupBy(group)
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .filter(F.size("items") >= 2)
    )
    in_large = members.join(large_groups, group, "left_semi")
    per_item = (
        small.select(F.explode("items").alias(item), F.lit(0).alias("large"))
        .unionByName(in_large.select(item, F.lit(1).alias("large")))
        .groupBy(item)
        .agg(F.count(F.lit(1)).alias("item_order_count"), F.sum("large").alias("large_groups"))
    )
    spread = per_item.filter(F.col("large_groups") > 0)

    def side(letter: str) -> DataFrame:
        return spread.select(
            F.col(item).alias(f"item_{letter}_id"), F.col("large_groups").alias(f"large_{letter}")
        )

    rarer = F.least(_in_large("a"), _in_large("b"))
    candidates = (
        _counted(_pairs_of_rows(small, "items"), "small_count")
        .join(side("a"), "item_a_id", "left")
        .join(side("b"), "item_b_id", "left")
        .filter(F.col("small_count") + rarer >= min_count)
        .withColumn("rarer", rarer)
    )
    from_small = candidates.select(*_PAIR, F.col("small_count").alias("seen"))

    a_first = _in_large("a") <= _in_large("b")
    probes = candidates.filter((F.col("rarer") > 0) & (F.col("rarer") < min_count)).select(
        *_PAIR,
        F.when(a_first, F.col("item_a_id")).otherwise(F.col("item_b_id")).alias("first"),
        F.when(a_first, F.col("item_b_id")).otherwise(F.col("item_a_id")).alias("second"),
    )
    from_probes = _counted(
        probes.join(in_large.withColumnRenamed(item, "first"), "first", "inner").join(
            in_large.withColumnRenamed(item, "second"), [group, "second"], "left_semi"
        ),
        "seen",
    )
    heavy = per_item.filter(F.col("large_groups") >= min_count).select(item)
    from_blocks = _counted(
        _pairs_of_blocks(in_large.join(heavy, item, "left_semi"), group, item, scale.block_items),
        "seen",
    )
    pairs = (
        from_small.unionByName(from_probes)
        .unionByName(from_blocks)
        .groupBy(*_PAIR)
        .agg(F.sum("seen").alias("co_occurrence_count"))
        .filter(F.col("co_occurrence_count") >= min_count)
    )
    return (
        pairs,
        per_item.drop("large_groups"),
        sizes.agg(F.count_if(F.col("n") >= 2).alias("groups")),
    )
