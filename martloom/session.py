"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Results depend on the zone only; the rest tells AQE to split hot join keys
# even where that costs one more shuffle. Sizes are of compressed bytes, which sorted or
# aggregated rows exceed many times over: a task is given little of them, however much
# data there is, and a partition of one hot key is split before it fills a task's memory.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32m",
    "spark.sql.files.maxPartitionBytes": "16m",
}
_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
"""Of a shuffle before small ones are coalesced: some for each that the session asks for."""
_EACH = 4


def tune(spark: SparkSession) -> SparkSession:
    """Pin the time zone and the adaptive settings on a running session."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark.conf.get(_PARTITIONS, None) is None:
        spark.conf.set(_PARTITIONS, str(_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("martloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    return tune(builder.getOrCreate())
