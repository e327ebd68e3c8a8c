"""Writing marts and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from martloom.sources.snapshot import path_exists

def write_mart(
    df: DataFrame, path: str, partition_by: list[str] | None = None
) -> int:
    """Overwrite a Parquet table and return its row count.

    The count reads the written files' footers, so the plan runs once. An observed metric
    is not used: once a session holds one, MLlib models with a training summary no longer
    serialize in it.
    """
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def _first_rows(df: DataFrame, order: list[Column | str] | None, limit: int | None) -> DataFrame:
    """The first rows by an order; a limit without one would return any rows."""
    if limit is None:
        return df
    if not order:
        raise ValueError("a limit needs an order")
    return df.orderBy(*order).limit(limit)


def read_mart(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    limit: int | None = None,
    order: list[Column | str] | None = None,
) -> DataFrame:
    """A stored mart: named columns only, in their order; unknown names are an error."""
    df = _first_rows(spark.read.parquet(path), order, limit)
    if not columns:
        return df
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise KeyError(f"no such columns: {', '.join(unknown)}")
    return df.select(*columns)


def mart_metadata(spark: SparkSession, path: str) -> dict[str, object]:
    """Rows, columns and files; the row count comes from the Parquet footers."""
    df = spark.read.parquet(path)
    return {
        "rows": df.count(),
        "columns": len(df.columns),
        "files": len(df.inputFiles()),
        "column_names": df.columns,
    }


def available_marts(spark: SparkSession, root: str, names: list[str]) -> dict[str, bool]:
    return {name: path_exists(spark, f"{root.rstrip('/')}/{name}.parquet") for name in names}


def export_csv(
    df: DataFrame, path: str, limit: int | None = None, order: list[Column | str] | None = None
) -> None:
    """All rows as CSV, header first; on request only the first ones by an order."""
    _first_rows(df, order, limit).write.mode("overwrite").option("header", True).csv(path)


def write_run_metadata(df: DataFrame, path: str) -> None:
    """One JSON line per model candidate."""
    df.write.mode("overwrite").json(path)
