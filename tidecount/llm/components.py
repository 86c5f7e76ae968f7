"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise, scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that the join reads both sides from exchanges and a hub's edges can be split over tasks
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).filter("m < a"))
    return both.filter("b > a").join(least, "a", "left").select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m")))
    return edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(a, b)``: each node but the smallest of its component, with that smallest node.

    Self-loops, repeated edges and either direction are fine; no edges give no rows. No node's
    neighbours are ever gathered: a round is two aggregations with partial minima and two joins,
    whose hot keys adaptive execution splits. The number of rounds grows with the logarithm of the longest path.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = now.agg(mark).first()[0]
    for _ in range(rounds):
        if before[0] == 0:
            return now
        with scratch(edges.sparkSession):
            now = materialise(_small(materialise(_large(now))), outer=True)
        after = now.agg(mark).first()[0]
        if after == before:
            return now
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
