"""Connected components of an edge table, by alternating large and small stars.

Each round is two pre-aggregated min() and two equi-joins; the edges stay
distributed, the joins are with staged tables so that a hot node's partition can
be split, and rounds grow
with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b: long): component is the smallest id reachable, itself included.

    Loops, repeated edges and edges with a null are allowed and mean nothing more. Staged.
    """
    now = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    seen = state(now)
    while seen["n"]:
        after = stage(_small_star(stage(_large_star(now), "large")), "stars")
        new = state(after)
        discard(now)
        now = after
        if new == seen:
            break
        seen = new
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
