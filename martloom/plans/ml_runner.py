"""Training all model tasks, and storing what they predict and how they were chosen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from martloom.config import SplitDates
from martloom.plans.models import (
    Verdict,
    churn_contest,
    demand_contest,
    run_status,
    run_tasks,
    segment_contest,
    waste_contest,
)
from martloom.sources.sinks import write_mart, write_run_metadata


def prediction_path(out: str, task: str) -> str:
    return f"{out.rstrip('/')}/{task}_predictions.parquet"


def metadata_path(out: str) -> str:
    return f"{out.rstrip('/')}/run_metadata"


def run_models(
    spark: SparkSession, tasks: dict[str, Callable[[], Verdict]], out: str
) -> tuple[str, dict[str, int], dict[str, str]]:
    """Run every task and store its predictions and all candidates' scores.

    Returns the status (SUCCESS, PARTIAL or FAILED), the rows stored per task and the
    errors. A task that fails does not stop the others.
    """
    done, errors = run_tasks(tasks)
    rows = {name: write_mart(v.predictions, prediction_path(out, name)) for name, v in done.items()}
    metadata: DataFrame | None = None
    for name, verdict in done.items():
        own = verdict.metadata(spark, name)
        metadata = own if metadata is None else metadata.unionByName(own)
    if metadata is not None:
        write_run_metadata(metadata, metadata_path(out))
    return run_status(done, errors), rows, errors


def run_all(
    spark: SparkSession,
    demand: DataFrame,
    waste: DataFrame,
    churn_panel: DataFrame,
    customers: DataFrame,
    out: str,
    splits: SplitDates = SplitDates(),
) -> tuple[str, dict[str, int], dict[str, str]]:
    """Train and store demand, wastage risk, churn and segmentation from their features."""
    tasks: dict[str, Callable[[], Verdict]] = {
        "demand": lambda: demand_contest(demand, splits),
        "wastage_risk": lambda: waste_contest(waste, splits),
        "churn": lambda: churn_contest(churn_panel),
        "segmentation": lambda: segment_contest(customers),
    }
    return run_models(spark, tasks, out)


def read_metadata(spark: SparkSession, out: str) -> DataFrame:
    """One row per candidate of the stored runs."""
    schema = (
        "task string, algorithm string, is_champion boolean, hyperparameters map<string,double>, "
        "validation_metrics map<string,double>, test_metrics map<string,double>, "
        "training_duration_sec double"
    )
    return spark.read.schema(schema).json(metadata_path(out))
