"""New dump files appended to a table: file streams that run until they have caught up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def append_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, watermark: tuple[str, str] | None = None) -> None:
    """Reads JSON-line files that were not read before, transforms them and appends Parquet; exactly once by the checkpoint."""
    rows = spark.readStream.schema(schema).json(source)
    if watermark:
        rows = rows.withWatermark(*watermark)
    transform(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
