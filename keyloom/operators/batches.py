"""Rules for batches of writes: which of several rows of a key counts, the flags of removals, and running values of hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts that a key's rows are cut in by order, about, to be ranked side by side.
PARTS = 64


def _order(new: DataFrame, on: list[str], order: str) -> Column:
    return F.col(order) if order in new.columns else F.struct(*[F.col(c) for c in new.columns if c not in on])


def last_of(new: DataFrame, on: list[str], order: str = "seq") -> DataFrame:
    """One row for each key `on`: the last by `order`, or by all other columns where there is none. Pre-aggregated."""
    rest = [c for c in new.columns if c not in on]
    if not rest:
        return new.distinct()
    return new.groupBy(*on).agg(F.max_by(F.struct(*rest), _order(new, on, order)).alias("__x")).select(*on, *[F.col(f"__x.{c}").alias(c) for c in rest])


def is_first(new: DataFrame, on: list[str], order: str = "seq") -> DataFrame:
    """new with the column first: whether a row is the first of its key. Rows are one command where `order` is equal or absent."""
    if order not in new.columns:
        return new.withColumn("first", F.lit(True))
    return new.join(new.groupBy(*on).agg(F.min(order).alias("__min")), on).withColumn("first", F.col(order) == F.col("__min")).drop("__min")


def removed(state: DataFrame, asked: DataFrame, on: list[str], order: str = "seq") -> DataFrame:
    """asked with flag: 1 if the command removes something that is there, else 0. Of several of a key the first removes it."""
    there = state.select(*on).distinct().withColumn("__there", F.lit(True))
    out = is_first(asked, on, order).join(there, on, "left")
    return out.withColumn("flag", F.when(F.col("first") & F.col("__there"), 1).otherwise(0)).drop("first", "__there")


def parted(df: DataFrame, on: list[str], by: Column) -> DataFrame:
    """df with the column part: rows of a key in about PARTS ranges of a number, in order. Equal numbers are in one part.

    The bounds come from a sketch of the quantiles (pre-aggregated), so they
    cut a hot key's work, while the result doesn't depend on them.
    """
    marks = [i / PARTS for i in range(1, PARTS)]
    cuts = df.groupBy(*on).agg(F.percentile_approx(by, marks, 1000).alias("__cuts"))
    return df.join(cuts, on, "left").withColumn("part", F.coalesce(F.size(F.filter("__cuts", lambda c: c < by)), F.lit(0))).drop("__cuts")


def before(df: DataFrame, on: list[str], value: Column) -> DataFrame:
    """(on, part, before): the sums of a value over the earlier parts of a key; a window over the few parts of each."""
    sums = df.groupBy(*on, "part").agg(F.sum(value).alias("__n"))
    run = F.sum("__n").over(W.partitionBy(*on).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return sums.select(*on, "part", F.coalesce(run, F.lit(0)).alias("before"))
