"""A session with the settings that the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans split skewed joins and merge small partitions; shuffle partitions scale with the input.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("tessera")
    if master:
        builder = builder.master(master)
    settings = SETTINGS | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}) | more
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
