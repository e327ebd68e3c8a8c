"""Population stability of features between the training window and later ones.

Bins are learnt on training rows only: edges at quantiles for numbers, the values seen for
categories. A missing value is a bin of its own, and so are all categories training has not
seen. The index of a feature and window is the sum over bins of (a - e) ln(a / e), where a and
e are the bin's shares of the window and of training; empty bins count as `floor`.

Numbers can be binned exactly, or by mergeable quantile sketches that are kept per week: then
edges and shares of any window come from merged sketches, without the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions.numeric import fixed
from martloom.operators.quantiles import counted, group_quantiles
from martloom.sources.staging import stage


@dataclass(frozen=True)
class DriftRules:
    """Bins, the share an empty bin counts as, limits of the classes, size of the sketches."""

    bins: int = 10
    floor: float = 0.0001
    moderate: float = 0.10
    major: float = 0.25
    # a sketch of 400 places a value within about 1 % of the rows
    sketch_size: int = 400
    scale: int = 1_000_000


TRAIN = "TRAIN"


def long_form(df: DataFrame, window: str, numbers: Sequence[str], categories: Sequence[str] = (), week: str | None = None) -> DataFrame:
    """One row per row and feature: feature, win, week, number (scaled to a long later), category."""
    cells = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("number"), F.lit(None).cast("string").alias("category"))
        for c in numbers
    ]
    cells += [
        F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("number"), F.col(c).cast("string").alias("category"))
        for c in categories
    ]
    when = F.lit(None).cast("date") if week is None else F.col(week)
    rows = df.select(F.col(window).alias("win"), when.alias("week"), F.explode(F.array(*cells)).alias("c"))
    number = F.when(~F.isnan("c.number"), F.col("c.number"))
    return rows.select("win", "week", "c.feature", number.alias("number"), "c.category")


def _class(psi: Column, rules: DriftRules) -> Column:
    return F.when(psi >= rules.major, "Major").when(psi >= rules.moderate, "Moderate").otherwise("Stable")


def _index(shares: DataFrame, rules: DriftRules) -> DataFrame:
    """Index per feature and window from (feature, win, bin, held); a window is seen if it has a row."""
    shares = stage(shares, "bins")
    totals = shares.groupBy(F.col("feature").alias("feature_"), F.col("win").alias("win_")).agg(F.sum("held").alias("total"))
    bins = shares.groupBy(F.col("feature").alias("f_"), F.col("bin").alias("bin_")).agg(
        F.sum(F.when(F.col("win") == TRAIN, F.col("held")).otherwise(0)).alias("train_held")
    )
    # every window against every bin of its feature
    grid = totals.join(bins, F.col("feature_") == F.col("f_"))
    trained = totals.where(F.col("win_") == TRAIN).select(F.col("feature_").alias("t_"), F.col("total").alias("train_total"))
    grid = grid.join(trained, F.col("feature_") == F.col("t_"))
    here = [F.col("feature") == F.col("feature_"), F.col("win") == F.col("win_"), F.col("bin") == F.col("bin_")]
    met = grid.join(shares, here, "left")
    a = F.greatest(F.coalesce("held", F.lit(0)) / F.col("total"), F.lit(rules.floor))
    e = F.greatest(F.col("train_held") / F.col("train_total"), F.lit(rules.floor))
    psi = fixed(F.sum((a - e) * F.log(a / e)), 4)
    found = met.groupBy(F.col("feature_").alias("feature"), F.col("win_").alias("win")).agg(
        F.max("total").cast("long").alias("row_count"), F.count(F.lit(1)).alias("bins"), psi.alias("psi")
    )
    return found.withColumn("drift", _class(F.col("psi"), rules))


def _edge_shares(rules: DriftRules) -> dict[str, float]:
    return {f"q{i}": i / rules.bins for i in range(1, rules.bins)}


def _binned(rows: DataFrame, edges: DataFrame, value: Column) -> DataFrame:
    """feature, win, bin, held: a bin is how many distinct edges lie below a value."""
    named = edges.select(F.col("feature").alias("edge_of"), "edges")
    met = rows.join(named, F.col("feature") == F.col("edge_of"), "left")
    below = F.size(F.filter("edges", lambda edge: edge < value)).cast("string")
    bin_ = F.when(F.col("number").isNull(), "missing").otherwise(below)
    return met.groupBy("feature", "win", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("held"))


def _category_bins(rows: DataFrame) -> DataFrame:
    seen = rows.where((F.col("win") == TRAIN) & F.col("category").isNotNull()).select(
        F.col("feature").alias("f_"), F.col("category").alias("c_")
    ).distinct()
    met = rows.join(seen, (F.col("feature") == F.col("f_")) & (F.col("category") == F.col("c_")), "left")
    bin_ = F.when(F.col("category").isNull(), "missing").when(F.col("c_").isNull(), "unseen").otherwise(F.concat(F.lit("="), "c_"))
    return met.groupBy("feature", "win", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("held"))


def stability(
    df: DataFrame,
    window: str,
    numbers: Sequence[str],
    categories: Sequence[str] = (),
    rules: DriftRules = DriftRules(),
) -> DataFrame:
    """feature, win, row_count, bins, psi and drift, with exact edges from the rows of window TRAIN.

    Numbers are compared as whole multiples of 1 / scale; NaN is missing. A feature without
    a training row has no index.
    """
    rows = stage(long_form(df, window, numbers, categories), "features")
    number = F.round(F.col("number") * rules.scale).cast("long")
    train = rows.where((F.col("win") == TRAIN) & F.col("number").isNotNull()).withColumn("value", number)
    edges = group_quantiles(counted(train, ["feature"], "value"), ["feature"], _edge_shares(rules))
    edges = edges.select("feature", F.array_distinct(F.array(*_edge_shares(rules))).alias("edges"))
    found = _binned(rows.where(F.col("feature").isin(*numbers)), edges, number)
    if categories:
        found = found.unionByName(_category_bins(rows.where(F.col("feature").isin(*categories))))
    return _index(found, rules)


def weekly_sketches(df: DataFrame, window: str, week: str, numbers: Sequence[str], rules: DriftRules = DriftRules()) -> DataFrame:
    """feature, win, week, missing rows, and a mergeable quantile sketch of the others."""
    rows = long_form(df, window, numbers, week=week)
    return rows.groupBy("feature", "win", "week").agg(
        F.count(F.when(F.col("number").isNull(), 1)).alias("missing"),
        F.kll_sketch_agg_double("number", F.lit(rules.sketch_size)).alias("sketch"),
    )


def stability_of_sketches(sketches: DataFrame, rules: DriftRules = DriftRules()) -> DataFrame:
    """The index of numbers from weekly sketches alone."""
    merged = stage(
        sketches.groupBy("feature", "win").agg(
            F.sum("missing").alias("missing"), F.kll_merge_agg_double("sketch", F.lit(rules.sketch_size)).alias("sketch")
        ),
        "sketches",
    )
    held = F.coalesce(F.kll_sketch_get_n_double("sketch"), F.lit(0))
    places = F.array(*(F.lit(i / rules.bins) for i in range(1, rules.bins)))
    trained = merged.where((F.col("win") == TRAIN) & (held > 0))
    # one row of at most `bins` numbers per feature; ranks are asked for fixed places only
    edges = {
        row.feature: sorted(set(row.edges))
        for row in trained.select("feature", F.kll_sketch_get_quantile_double("sketch", places).alias("edges")).collect()
    }
    ranks = F.array().cast("array<double>")
    for feature, own in edges.items():
        found = F.kll_sketch_get_rank_double("sketch", F.array(*map(F.lit, own)))
        ranks = F.when((F.col("feature") == feature) & (held > 0), found).otherwise(ranks)
    met = merged
    # shares at or below each edge, and all rows at the end
    upto = F.concat(ranks, F.array(F.lit(1.0)))
    bins = met.select("feature", "win", "missing", held.alias("rows"), F.posexplode(upto).alias("place", "share"), upto.alias("upto"))
    share = F.col("share") - F.coalesce(F.get("upto", F.col("place") - 1), F.lit(0.0))
    numbers = bins.select("feature", "win", F.col("place").cast("string").alias("bin"), (share * F.col("rows")).alias("held"))
    missing = met.select("feature", "win", F.lit("missing").alias("bin"), F.col("missing").cast("double").alias("held"))
    return _index(numbers.unionByName(missing).where("held > 0"), rules)
