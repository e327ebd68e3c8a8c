"""Agreement between two sets of predictions for the same task.

Any two prediction tables of the right shape compare: two models, two versions, two
feature definitions. `names` prefix their columns; `split` limits the rows to one window
(None compares all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions.numeric import fixed

TOLERANCE = 0.10
UNSEEN = "UNSEEN_COMPARISON"
DEMAND_KEYS = ["week_start_date", "menu_item_id", "restaurant_id"]


def _windowed(df: DataFrame, split: str | None) -> DataFrame:
    return df if split is None else df.filter(F.col("split") == split)


def _percent(flag: Column) -> Column:
    return fixed(F.avg(flag.cast("double")) * 100.0, 2)


def compare_regression(
    a: DataFrame,
    b: DataFrame,
    keys: list[str] = DEMAND_KEYS,
    names: tuple[str, str] = ("a", "b"),
    split: str | None = UNSEEN,
) -> DataFrame:
    """Row by row: both predictions, their difference, match within 10 % and the closer one."""
    left, right = f"{names[0]}_prediction", f"{names[1]}_prediction"
    joined = _windowed(a, split).select(
        *keys, "actual_quantity", F.col("predicted_quantity").alias(left), "split"
    ).join(_windowed(b, split).select(*keys, F.col("predicted_quantity").alias(right)), keys, "inner")
    x, y, actual = F.col(left), F.col(right), F.col("actual_quantity")
    scale = (F.abs(x) + F.abs(y)) / 2.0 + 1e-9
    return joined.withColumn("numerical_difference", fixed(F.abs(x - y), 4)).withColumns(
        {
            "match": F.col("numerical_difference") / scale <= TOLERANCE,
            "pipeline_winner": F.when(F.abs(x - actual) <= F.abs(y - actual), names[0]).otherwise(
                names[1]
            ),
        }
    )


def regression_summary(
    compared: DataFrame, task: str = "demand_forecast", names: tuple[str, str] = ("a", "b")
) -> DataFrame:
    """One row: agreement, RMSE and MAE of both, winner (the first on a tie)."""

    def errors(name: str) -> list[Column]:
        e = F.col(f"{name}_prediction") - F.col("actual_quantity")
        return [
            fixed(F.sqrt(F.avg(e * e)), 6).alias(f"{name}_rmse"),
            fixed(F.avg(F.abs(e)), 6).alias(f"{name}_mae"),
        ]

    row = compared.agg(
        F.count(F.lit(1)).alias("total_records_compared"),
        _percent(F.col("match")).alias("agreement_pct"),
        *errors(names[0]),
        *errors(names[1]),
    )
    first = F.col(f"{names[0]}_rmse") <= F.col(f"{names[1]}_rmse")
    return row.withColumns({"task": F.lit(task), f"{names[0]}_wins": first})


def compare_classes(
    a: DataFrame,
    b: DataFrame,
    keys: list[str],
    probability: str,
    names: tuple[str, str] = ("a", "b"),
    split: str | None = UNSEEN,
) -> DataFrame:
    """Row by row: both labels and probabilities, match and which side is right."""
    one, two = names
    left = _windowed(a, split).select(
        *keys,
        "actual_label",
        F.col("predicted_label").alias(f"{one}_predicted_label"),
        F.col(probability).alias(f"{one}_{probability}"),
        "split",
    )
    right = _windowed(b, split).select(
        *keys,
        F.col("predicted_label").alias(f"{two}_predicted_label"),
        F.col(probability).alias(f"{two}_{probability}"),
    )
    first, second = F.col(f"{one}_predicted_label"), F.col(f"{two}_predicted_label")
    gap = F.abs(F.col(f"{one}_{probability}") - F.col(f"{two}_{probability}"))
    return left.join(right, keys, "inner").withColumns(
        {
            "match": first == second,
            "numerical_difference": fixed(gap, 4),
            "pipeline_winner": F.when(first == F.col("actual_label"), one)
            .when(second == F.col("actual_label"), two)
            .otherwise("neither"),
        }
    )


def class_summary(compared: DataFrame, task: str, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    def accuracy(name: str) -> Column:
        right = F.col(f"{name}_predicted_label") == F.col("actual_label")
        return fixed(F.avg(right.cast("double")), 6).alias(f"{name}_accuracy")

    row = compared.agg(
        F.count(F.lit(1)).alias("total_records_compared"),
        _percent(F.col("match")).alias("agreement_pct"),
        accuracy(names[0]),
        accuracy(names[1]),
    )
    first = F.col(f"{names[0]}_accuracy") >= F.col(f"{names[1]}_accuracy")
    return row.withColumns({"task": F.lit(task), f"{names[0]}_wins": first})


def compare_segments(
    a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b"), key: str = "customer_id"
) -> DataFrame:
    one, two = (f"{n}_segment_label" for n in names)
    left = a.select(key, F.col("segment_label").alias(one))
    right = b.select(key, F.col("segment_label").alias(two))
    return left.join(right, key, "inner").withColumn("match", F.col(one) == F.col(two))


def segment_contingency(compared: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    columns = [f"{n}_segment_label" for n in names]
    return compared.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def segment_summary(compared: DataFrame, task: str = "customer_segmentation") -> DataFrame:
    """Agreement only: segments have no ground truth, hence no winner."""
    return compared.agg(
        F.count(F.lit(1)).alias("total_records_compared"),
        _percent(F.col("match")).alias("agreement_pct"),
    ).withColumn("task", F.lit(task))


def with_champions(summary: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per task summaries with the algorithm that won the task, NULL where none is stored."""
    winners = metadata.filter("is_champion").select(F.col("task").alias("_task"), F.col("algorithm").alias("champion"))
    return summary.join(winners, F.col("task") == F.col("_task"), "left").drop("_task")


def overall_agreement(summaries: list[DataFrame]) -> DataFrame:
    """The unweighted mean of the tasks' agreement percentages."""
    columns = ["task", "agreement_pct", "total_records_compared"]
    rows = summaries[0].select(*columns)
    for other in summaries[1:]:
        rows = rows.unionByName(other.select(*columns))
    return rows.agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum("total_records_compared").alias("total_records_compared"),
        fixed(F.avg("agreement_pct"), 2).alias("overall_agreement_pct"),
    )


def metric_differences(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """From (name, metric, value) rows: both values per metric and their difference.

    For f1 the agreement is one minus the absolute difference.
    """
    wide = metrics.groupBy("metric").agg(
        F.max(F.when(F.col("name") == first, F.col("value"))).alias(f"{first}_value"),
        F.max(F.when(F.col("name") == second, F.col("value"))).alias(f"{second}_value"),
    )
    gap = F.col(f"{first}_value") - F.col(f"{second}_value")
    return wide.withColumn("difference", fixed(gap, 6)).withColumn(
        "agreement", F.when(F.col("metric") == "f1", fixed(1.0 - F.abs(gap), 6))
    )
