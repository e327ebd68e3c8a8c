"""Cutting lineage by writing a table to shared storage and reading it back."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open_scope: ContextVar[list[str] | None] = ContextVar("open_scope", default=None)
_writing: Counter[str] = Counter()
_before: dict[str, str | None] = {}
_turn = Lock()


def staging_root(spark: SparkSession) -> str:
    """The shared folder the session names; a local session without one gets its own."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-martloom-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return root


def _hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside when the block ends.

    Results that read staged tables must be written before. Scopes may be nested; each
    deletes its own tables.
    """
    staged: list[str] = []
    token = _open_scope.set(staged)
    try:
        yield
    finally:
        _open_scope.reset(token)
        for path in staged:
            found, system = _hadoop_path(spark, path)
            system.delete(found, True)


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files as they end.

    Otherwise these stay until the driver's JVM happens to collect the plan. Only writes belong
    here: a DataFrame that is itself run twice would have to make its shuffles anew. Threads of
    one session may overlap; the last one to leave restores the setting.
    """
    session = spark._jsparkSession.sessionUUID()
    with _turn:
        if not _writing[session]:
            _before[session] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writing[session] += 1
    try:
        yield
    finally:
        with _turn:
            _writing[session] -= 1
            if not _writing[session]:
                before = _before.pop(session)
                if before is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, before)


def _written(df: DataFrame, label: str, codec: str | None) -> str:
    path = f"{staging_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec) if codec else df.write
    with own_shuffles(df.sparkSession):
        writer.parquet(path)
    return path


def _kept(df: DataFrame, path: str) -> DataFrame:
    """The written table, deleted when the enclosing scope or else the application ends."""
    spark = df.sparkSession
    scope = _open_scope.get()
    if scope is None:
        found, system = _hadoop_path(spark, path)
        system.deleteOnExit(found)
    else:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write df once; later readers scan the files and survive lost executors.

    The table lives until the enclosing `staging_scope` ends, or else the application. `codec`
    compresses it, by default as the session does.
    """
    return _kept(df, _written(df, label, codec))


def stage_result(
    spark: SparkSession, build: Callable[[], DataFrame], label: str, codec: str | None = None
) -> DataFrame:
    """Stage what `build` returns, then delete the tables that it staged on the way."""
    with staging_scope(spark):
        df = build()
        path = _written(df, label, codec)
    return _kept(df, path)
