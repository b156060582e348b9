"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import checkpoint, compact


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = checkpoint(compact(both.groupBy("u").agg(F.min("v").alias("m")), n))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = checkpoint(compact(down.groupBy("u").agg(F.min("v").alias("m")), n))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u"), F.col("m"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, and no lower node has any."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
    return odd.limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node) for every node of ``edges`` (a, b: long) but the least ones themselves.

    Each step is two aggregations with map-side combining and two equi-joins against one row a node, cut off by
    checkpoints; edges never meet in one list.  The number of steps grows with the logarithm of the longest path.
    """
    now = checkpoint(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = now.count()
    now = compact(now, n)
    while n and not _stars(now):
        now = checkpoint(compact(_large_star(now, n), n))
        now = checkpoint(compact(_small_star(now, n), n))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
