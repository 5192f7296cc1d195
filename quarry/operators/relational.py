"""Scan, filter, project, join, aggregate, grouping sets, order and limit over DataFrames."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def scan(df: DataFrame, alias: str) -> DataFrame:
    """Columns as alias.name; unused ones are pruned from the reader by Catalyst."""
    return df.select(*[F.col(quoted(c)).alias(f"{alias}.{c}") for c in df.columns])


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def project(df: DataFrame, named: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in named])


#: Joins that make FAN_OUT rows or more of a row, and SPREAD rows in all, are dealt out so that a task makes about ROWS_A_TASK,
#: in COPIES parts at most, or twice the cores.
FAN_OUT, SPREAD, ROWS_A_TASK, COPIES = 100, 5_000_000, 20_000_000, 64


def join(left: DataFrame, right: DataFrame, on: Column, how: str, keys: Sequence[Column] = ()) -> DataFrame:
    """Strategy and build side are left to statistics and adaptive execution, which see bytes, not the rows that a join makes.

    keys: what on takes of the right table for equalities, where both sides are tables. If few keys meet many rows, the rows
    made grow with the product of both sides, in as few tasks as these have files or keys. Then one side is dealt out in
    parts, and each part meets a copy of the other in a merge join, which holds the rows of a key in a part at most."""
    how = {"full": "full_outer"}.get(how, how)
    n, dealt = _parts(left, right, how, keys)
    if n < 2:
        return left.join(right, on, how)
    deal = lambda d: d.repartition(n).select("*", (F.spark_partition_id() % n).alias("quarry_part"))
    copy = lambda d: d.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("quarry_copy")).hint("merge")
    a, b = (deal(left), copy(right)) if dealt == "left" else (copy(left), deal(right))
    return a.join(b, on & (F.col("quarry_part") == F.col("quarry_copy")), how).drop("quarry_part", "quarry_copy")


def _parts(left: DataFrame, right: DataFrame, how: str, keys: Sequence[Column]) -> tuple[int, str]:
    """How many parts, 0 for none, of which side. Only the right table's keys are read for it, for a sketch of their number;
    where they repeat, the left table's rows are counted. Copies are never more rows than the join makes."""
    if not keys or how not in ("inner", "left", "right") or left.isStreaming or right.isStreaming:
        return 0, ""
    try:
        known = right.where(functools.reduce(lambda a, b: a & b, [k.isNotNull() for k in keys]))
        rows, distinct = known.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*keys))).first()
    except PySparkException:  # the query itself may never come to the row that fails
        return 0, ""
    if rows < FAN_OUT * max(1, distinct):
        return 0, ""
    others = left.count()
    made = others * rows // max(1, distinct)
    if made < SPREAD:
        return 0, ""
    cores = right.sparkSession.sparkContext.defaultParallelism
    dealt = "right" if how == "right" or (how == "inner" and others < rows) else "left"
    return min(max(cores, made // ROWS_A_TASK), max(COPIES, 2 * cores), made // (others if dealt == "right" else rows)), dealt


def aggregate(df: DataFrame, keys: Sequence[tuple[str, Column]], aggs: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row without keys, also for empty input; else one a group, partially aggregated before the shuffle."""
    made = [c.alias(n) for n, c in aggs]
    if not keys:
        return df.agg(*(made or [F.count(F.lit(1)).alias("quarry_rows")]))
    grouped = df.groupBy(*[c.alias(n) for n, c in keys])
    return grouped.agg(*made) if made else df.select(*[c.alias(n) for n, c in keys]).distinct()


def grouping_sets(df: DataFrame, keys: Sequence[tuple[str, Column]], sets: Sequence[Sequence[int]], aggs: Sequence[tuple[str, Column]]) -> DataFrame:
    """Keys that a set leaves out are NULL. The empty set is one of Spark's expansion, which reads the input once;
    as that yields no row for empty input, a probe of one row then adds it."""
    made = [c.alias(n) for n, c in aggs] or [F.count(F.lit(1)).alias("quarry_rows")]
    named = [c.alias(n) for n, c in keys]
    empty = sum(not s for s in sets)
    if not keys:
        one = df.agg(*made)
        return one if empty == 1 else one.withColumn("quarry_copy", F.explode(F.sequence(F.lit(1), F.lit(empty)))).drop("quarry_copy")
    cols = [F.col(quoted(n)) for n, _ in keys]
    out = df.select("*", *named).groupingSets([[cols[i] for i in s] for s in sets], *cols).agg(*made)
    if not empty:
        return out
    none = df.limit(1).agg(F.count(F.lit(1)).alias("quarry_found"), *made).where("quarry_found = 0")
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.select(*named).schema]
    none = none.withColumn("quarry_copy", F.explode(F.sequence(F.lit(1), F.lit(empty)))).select(*nulls, *[F.col(quoted(c)) for c in none.columns if c != "quarry_found"])
    return out.unionByName(none)


def order(df: DataFrame, by: Sequence[Column]) -> DataFrame:
    return df.orderBy(*by)


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
