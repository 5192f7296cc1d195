"""Streams as tables: filters, projections, joins with tables and grouped aggregates run incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def source(spark: SparkSession, fmt: str, location: str, schema: StructType, watermark: tuple[str, str] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A streaming table over files that arrive in a folder. watermark: (column, delay)."""
    r = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    df = r.load(location)
    return df.withWatermark(*watermark) if watermark else df


def start(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Runs what has arrived, into an in-memory table of that name, and stops at the end of it."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
