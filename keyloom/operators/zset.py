"""Score-ordered sets: zset(key, member, score, value), in order of score, then member, ascending.

A member is there once. Null keys and members match nothing. Of several writes of a member in a batch, the column seq
decides, or the greatest row where there is none; repeated members of a read give repeated rows. Ties of score are broken
by member, so every order is total. Empty tables are allowed everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .batches import before, parted


def ranked(zset: DataFrame) -> DataFrame:
    """zset with the 1-based position rn. -0.0 counts as 0.0."""
    order = W.partitionBy("key").orderBy(F.col("score") + F.lit(0.0), "member")
    return zset.withColumn("rn", F.row_number().over(order).cast("long"))


def top(zset: DataFrame, n: int) -> DataFrame:
    """The n lowest of every set, with their positions. Limited before the shuffle."""
    return ranked(zset).where(F.col("rn") <= n)


def all_ranked(zset: DataFrame) -> DataFrame:
    """As ranked(), for all positions of large sets: ranges of scores are ranked side by side and set behind each other."""
    parts = parted(zset.withColumn("__s", F.col("score") + F.lit(0.0)), ["key"], F.col("__s"))
    local = F.row_number().over(W.partitionBy("key", "part").orderBy("__s", "member"))
    out = parts.withColumn("rn", local).join(before(parts, ["key"], F.lit(1)), ["key", "part"])
    return out.withColumn("rn", (F.col("rn") + F.col("before")).cast("long")).drop("part", "before", "__s")


def rank(zset: DataFrame, members: DataFrame) -> DataFrame:
    """(key, member, rank) of members; -1 if there is none."""
    return members.select("key", "member").join(all_ranked(zset).select("key", "member", "rn"), ["key", "member"], "left").select("key", "member", F.coalesce("rn", F.lit(-1).cast("long")).alias("rank"))


def rank_of(zset: DataFrame, key: str, member: str) -> DataFrame:
    """The rank of one member as a count of what stands before it, -1 if it is absent: no sort, however large the set."""
    own = zset.where((F.col("key") == key) & (F.col("member") == member)).agg(F.max("score").alias("s"))
    ahead = (F.col("score") < F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("member") <= member))
    return zset.where(F.col("key") == key).crossJoin(F.broadcast(own)).agg(F.max("s").alias("s"), F.count_if(ahead).alias("n")).select(F.when(F.col("s").isNull(), -1).otherwise(F.col("n")).cast("long").alias("rank"))  # own is one row


def at(zset: DataFrame, position: int) -> DataFrame:
    return ranked(zset).where(F.col("rn") == position).select("key", "value")


def positions(zset: DataFrame, start: int, stop: int) -> DataFrame:
    """Positions start to stop of every set; none if start < 1 or start > stop."""
    return ranked(zset).where(F.lit(1 <= start <= stop) & F.col("rn").between(start, stop))


def scores(zset: DataFrame, low: float, high: float) -> DataFrame:
    """Members with low <= score <= high; the bounds reach the scan."""
    return zset.where(F.col("score").between(low, high))


def score(zset: DataFrame, members: DataFrame) -> DataFrame:
    """(key, member, score); null if there is none."""
    return members.select("key", "member").join(zset.select("key", "member", "score"), ["key", "member"], "left")


def add(zset: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by member; an equal score changes nothing, not even the value. Several adds of a member (by seq) count one after another."""
    new = _last_moves(new.where("key is not null and member is not null"))
    both = zset.select("key", "member", F.col("score").alias("s0"), F.col("value").alias("v0")).join(new.select("key", "member", F.col("score").alias("s1"), F.col("value").alias("v1"), "again"), ["key", "member"], "full")
    moved = F.col("s1").isNotNull() & (F.coalesce("again", F.lit(False)) | ~F.col("s0").eqNullSafe(F.col("s1")))
    return both.select("key", "member", F.when(moved, F.col("s1")).otherwise(F.col("s0")).alias("score"), F.when(moved, F.col("v1")).otherwise(F.col("v0")).alias("value"))


def _last_moves(new: DataFrame) -> DataFrame:
    """(key, member, score, value, again): of each member the last add whose score differs from the one before it, and whether there is one before it."""
    order = W.partitionBy("key", "member").orderBy(*([F.col("seq")] if "seq" in new.columns else [F.col("score"), F.col("value")]))
    at, last = F.row_number().over(order), F.lag("score").over(order)
    steps = new.select("key", "member", "score", "value", at.alias("at"), last.alias("last")).where((F.col("at") == 1) | ~F.col("score").eqNullSafe(F.col("last")))
    kept = steps.groupBy("key", "member").agg(F.max_by(F.struct("score", "value", (F.col("at") > 1).alias("again")), "at").alias("x"))
    return kept.select("key", "member", "x.*")


def incr(zset: DataFrame, increments: DataFrame) -> DataFrame:
    """Sums of increments (key, member, inc) added; an absent member starts at 0 with itself as value."""
    sums = increments.groupBy("key", "member").agg(F.sum("inc").alias("inc"))
    out = zset.join(sums, ["key", "member"], "full")
    return out.select("key", "member", (F.coalesce("score", F.lit(0.0)) + F.coalesce("inc", F.lit(0.0))).alias("score"), F.coalesce("value", "member").alias("value"))


def remove(zset: DataFrame, members: DataFrame) -> DataFrame:
    return zset.join(members.select("key", "member"), ["key", "member"], "left_anti")


def drop(zset: DataFrame, keys: DataFrame) -> DataFrame:
    return zset.join(keys.select("key"), "key", "left_anti")
