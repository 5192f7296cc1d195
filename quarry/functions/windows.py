"""Window specifications and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

RANKINGS = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}


def sort_column(c: Column, descending: bool, nulls_first: bool) -> Column:
    """Nulls come last in either direction unless they are asked for first."""
    if descending:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def specification(partition: list[Column], order: list[Column], frame: tuple[int | None, int | None] | None, ranking: bool) -> WindowSpec:
    """Rankings ignore frames, and without an order rank all rows as peers."""
    spec = Window.partitionBy(*partition)
    if order:
        spec = spec.orderBy(*order)
    elif ranking:
        spec = spec.orderBy(F.lit(1))
    if frame and not ranking:
        start, end = frame
        spec = spec.rowsBetween(Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end)
    return spec


def is_empty(frame: tuple[int | None, int | None] | None) -> bool:
    """A frame that starts after its end holds no rows; Spark refuses it or gives NULL."""
    return frame is not None and None not in frame and frame[0] > frame[1]


def ranking(name: str, spec: WindowSpec) -> Column:
    return RANKINGS[name]().over(spec).cast("bigint")


def marks(frame: tuple[int | None, int | None] | None, ordered: bool) -> str | None:
    """Which row stands for its value in DISTINCT frames of this kind: "any" of a whole partition, the "first"
    or the "last" where one end is open. None where both ends are bounded, so that a frame holds few rows."""
    if frame == (None, None) or (frame is None and not ordered):
        return "any"
    if not ordered:
        return None
    if frame is None or frame[0] is None:
        return "first"
    return "last" if frame[1] is None else None


def is_open_at_end(frame: tuple[int | None, int | None] | None) -> bool:
    """Only there: Spark makes each such frame anew from its rows, the square of a partition. From the last row back
    they only grow."""
    return frame is not None and frame[0] is not None and frame[1] is None


def backward(frame: tuple[int, None]) -> tuple[None, int]:
    """The same frame of a partition in reverse."""
    return None, -frame[0]


def counts_rows(name: str, frame: tuple[int | None, int | None] | None) -> bool:
    """Whether the order of rows of equal rank shows."""
    return name == "ROW_NUMBER" or (name not in RANKINGS and frame is not None and frame != (None, None))


def places(partition: list[Column], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def marked(df: DataFrame, which: str, value: str, partition: list[str], mark: str, place: str | None) -> DataFrame:
    """Adds mark, true on one row of each value in a partition, by place, the row's number in it.

    One exchange by the partition serves all windows here and the aggregate over them; no set of values is held.
    Rows of equal rank get one order, by place, that the mark and a ROWS frame share.
    """
    x = F.col(value)
    if which == "any":
        before = F.lag(value).over(Window.partitionBy(*partition).orderBy(x))
        return df.select("*", (x.isNotNull() & ~x.eqNullSafe(before)).alias(mark))
    peers = Window.partitionBy(*partition, value).orderBy(place)
    other = (F.lag if which == "first" else F.lead)(place).over(peers)
    return df.select("*", (x.isNotNull() & other.isNull()).alias(mark))
