"""A snapshot: the eleven source tables as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from martloom.sources.schemas import TABLES, table_schema


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def path_exists(spark: SparkSession, path: str) -> bool:
    """True for a file and for a directory, on any Hadoop file system."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(jvm_path))


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One source table, read with its declared schema."""
    schema = table_schema(name)
    path = table_path(root, name)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        raise FileNotFoundError(f"no {name} table at {path}") from err


def completeness(spark: SparkSession, root: str) -> dict[str, bool]:
    return {name: path_exists(spark, table_path(root, name)) for name in TABLES}


Source = DataFrame | Callable[[], DataFrame]


class Snapshot:
    """Source tables by name, each built when first asked for.

    `snap.orders` and the other table names are attributes. Key columns may be of any
    type that compares and hashes. `sold`, if given, is the stored join of order lines
    and counted headers.
    """

    def __init__(self, sources: Mapping[str, Source], sold: DataFrame | None = None) -> None:
        unknown = set(sources) - set(TABLES)
        if unknown:
            raise KeyError(f"unknown tables: {', '.join(sorted(unknown))}")
        self._sources = dict(sources)
        self.sold = sold

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Snapshot:
        return cls({name: partial(load_table, spark, root, name) for name in TABLES})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._sources:
            raise AttributeError(name)
        found = self._sources[name]
        if not isinstance(found, DataFrame):
            found = self._sources[name] = found()
        return found

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES if name in self._sources}

    def with_tables(self, sold: DataFrame | None = None, **tables: Source) -> Snapshot:
        return Snapshot({**self._sources, **tables}, sold if sold is not None else self.sold)
