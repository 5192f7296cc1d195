"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed


def _low_neighbour(both: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours; partial aggregation keeps hubs cheap."""
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Node and root (its component's least node) of every node that has an edge.

    edges: pairs of longs, in any order, repeats and loops allowed; pairs with a null are ignored.
    No edges: no rows. Each round is two shuffles, written to reliable storage, so a lost
    executor costs one round. Hubs join on their own key, which adaptive execution splits.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_low_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = _low_neighbour(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").distinct()
        after = checkpointed(small)
        # Stars with roots that are nobody's leaf: no node is both.
        settled = after.select("v").distinct().join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
        single = settled and after.groupBy("u").count().where("count > 1").isEmpty()
        e = after
        if single:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
