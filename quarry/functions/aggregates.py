"""Aggregates, for groups and for windows."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from quarry.functions.scalar import Typed, comparable, wrong
from quarry.sql.types import DECIMAL, NUMERIC, spark_type

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def typed(name: str, arg: Typed | None, at: tuple[int, int]) -> str:
    """The result's kind. Sums of int32 are int64, so that they do not overflow."""
    if name == "COUNT":
        return "int64"
    if name in ("SUM", "AVG") and arg.kind not in (*NUMERIC, "null"):
        raise wrong(f"{name} needs a number, not {arg.kind}.", at, function=name)
    if name == "AVG":
        return "float64"
    kind = comparable(arg.kind, at)
    return {"int32": "int64", "null": "float64"}.get(kind, kind) if name == "SUM" else kind


def aggregate(name: str, arg: Typed | None, distinct: bool, at: tuple[int, int]) -> Typed:
    kind = typed(name, arg, at)
    if name == "COUNT":
        if arg is None:
            return Typed(kind, False, F.count(F.lit(1)))
        return Typed(kind, False, F.count_distinct(arg.col) if distinct else F.count(arg.col))
    x = arg.to(kind).col if name in ("SUM", "AVG") else arg.col
    if name == "SUM":
        out = F.sum_distinct(x) if distinct else F.sum(x)
    elif name == "AVG":
        out = F.sum_distinct(x) / F.count_distinct(x) if distinct else F.avg(x)
        if distinct:
            out = F.when(F.count_distinct(x) > 0, F.sum_distinct(x) / F.nullif(F.count_distinct(x), F.lit(0)))
    else:
        out = F.min(x) if name == "MIN" else F.max(x)
    return Typed(kind, True, out if kind == "null" else out.cast(DECIMAL if kind == "decimal" else spark_type(kind)) if name != "MIN" and name != "MAX" else out)


def over(name: str, arg: Typed | None, distinct: bool, window: WindowSpec, at: tuple[int, int]) -> Typed:
    """The same over a window. Spark has no distinct window aggregates: where frames are bounded, sets of their
    few values stand in; others come here as plain aggregates of marked rows, see windows.marked."""
    kind = typed(name, arg, at)
    if not distinct or name in ("MIN", "MAX") or arg is None:
        plain = aggregate(name, arg, False, at)
        return Typed(kind, plain.nullable, _windowed(name, arg, kind).over(window).cast(spark_type(kind)) if kind not in ("null", "decimal", "timestamp") else _windowed(name, arg, kind).over(window))
    values = F.collect_set(distinct_value(name, arg, kind)).over(window)
    if name == "COUNT":
        return Typed(kind, False, F.size(values).cast("bigint"))
    total = F.aggregate(values, F.lit(0).cast(spark_type(kind)), lambda a, v: (a + v).cast(spark_type(kind)))
    return Typed(kind, True, F.when(F.size(values) > 0, total if name == "SUM" else total / F.size(values)).cast(spark_type(kind)))


def distinct_value(name: str, arg: Typed, kind: str) -> Column:
    return arg.to(kind).col if name != "COUNT" else arg.col


def over_marked(name: str, kind: str, value: Column, window: WindowSpec) -> Typed:
    """value: what is distinct, NULL on rows that do not stand for one."""
    made = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg}[name](value).over(window)
    return Typed(kind, name != "COUNT", made.cast(spark_type(kind)))


def _windowed(name: str, arg: Typed | None, kind: str) -> Column:
    if arg is None:
        return F.count(F.lit(1))
    x = arg.to(kind).col if name in ("SUM", "AVG") else arg.col
    return {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[name](x)
