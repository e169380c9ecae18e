"""String key-value pairs with expiry: kv(key, value, expire_at, seq). Reads are pure; writes make a new table.

A key is there once. Null keys are no keys: they match nothing and put nothing. Of several writes of a key in a batch, seq
decides; repeated keys of a read give repeated rows. Empty tables are allowed everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import is_first, last_of, removed


def live(now_ms: int) -> Column:
    """GET and EXISTS see a pair up to and including its expiry."""
    return F.col("expire_at").isNull() | (F.col("expire_at") >= now_ms)


def get(kv: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """(key, value) of each key; null if absent or expired."""
    return keys.select("key").join(kv.where(live(now_ms)).select("key", "value"), "key", "left")


def exists(kv: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """(key, flag) of each key: 1 if there is a live pair."""
    found = kv.where(live(now_ms)).select("key", F.lit(1).alias("flag"))
    return keys.select("key").join(found, "key", "left").select("key", F.coalesce("flag", F.lit(0)).alias("flag"))


def put(kv: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert; a new pair replaces value and expiry. The last of a key (by seq) counts."""
    last = last_of(new.where("key is not null").select("key", "value", "expire_at", "seq"), ["key"])
    return kv.join(last.select("key"), "key", "left_anti").unionByName(last)


def put_if_absent(kv: DataFrame, new: DataFrame, now_ms: int) -> DataFrame:
    """new with flag OK or FAIL: FAIL if a pair lives. At its expiry a pair counts as dead here, unlike in get().

    Of several rows of a key the first by seq may be OK; without the column seq they are one command. Null keys fail.
    """
    held = kv.where(F.col("expire_at").isNull() | (F.col("expire_at") > now_ms)).select("key", F.lit("FAIL").alias("flag"))
    out = is_first(new.where("key is not null"), ["key"]).join(held, "key", "left")
    out = out.withColumn("flag", F.when(F.col("flag").isNull() & F.col("first"), "OK").otherwise("FAIL")).drop("first")
    return out.unionByName(new.where("key is null").withColumn("flag", F.lit("FAIL")))


def delete_flags(kv: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """keys with flag: 1 if the command deletes a live pair, else 0; of several of a key (by seq) the first deletes it."""
    return removed(kv.where(live(now_ms)), keys, ["key"])


def delete(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return kv.join(keys.select("key"), "key", "left_anti")


def sweep(kv: DataFrame, now_ms: int, most: int | None = 100) -> DataFrame:
    """kv without expired pairs; at most `most` of them go, those that expired first."""
    dead = kv.where(F.col("expire_at") <= now_ms)
    if most is not None:
        dead = dead.orderBy("expire_at", "key").limit(most)
    return kv.join(dead.select("key"), "key", "left_anti")


def size_bytes(key: Column, value: Column, expire_at: Column) -> Column:
    return (F.octet_length(key) + F.octet_length(value) + F.when(expire_at.isNotNull(), 8).otherwise(0)).cast("long")
