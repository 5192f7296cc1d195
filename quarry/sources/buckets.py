"""Tables stored by key: joins and groups on the key then need no shuffle, and have statistics to plan by."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quarry.errors import EngineError, ErrorCode


def store(df: DataFrame, name: str, key: str, buckets: int, analyze: bool = True) -> DataFrame:
    """df as a Parquet table of the warehouse, bucketed and sorted by key. buckets: choose so that
    one is some hundred MB, and the same number for tables that meet in joins."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) or key not in df.columns or buckets < 1:
        raise EngineError(ErrorCode.INVALID_REQUEST, "A stored table needs a plain name, a key of its columns and at least one bucket.", table=name, column_name=key)
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    if analyze:
        df.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return df.sparkSession.table(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
