"""Bloom filters: bloom_def(key, m, k) and the set bits bloom_bits(key, bit).

A key has one definition. Null values are blank; repeated values and bits count once. Empty tables are allowed everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bloom_positions, string_hash

#: Bits of all filters, up to which they are packed and broadcast to the probes (8 MB).
BROADCAST_BITS = 1 << 26


def init(wanted: DataFrame) -> DataFrame:
    """(key, m, k) of wanted (key, n, p). Rows with n <= 0 or p outside (0, 1) are refused and left out."""
    m = F.ceil(-F.col("n") * F.log("p") / F.pow(F.log(F.lit(2.0)), F.lit(2.0))).cast("long")
    good = wanted.where("n > 0 and p > 0 and p < 1").withColumn("m", m)
    return good.select("key", "m", F.ceil(F.col("m") / F.col("n") * F.log(F.lit(2.0))).cast("long").alias("k"))


def positions(defs: DataFrame, values: DataFrame) -> DataFrame:
    """(key, value, bit), one row a position; values of absent filters have none."""
    hashed = values.withColumn("h", string_hash(F.col("value"))).join(defs, "key")
    return hashed.select("key", "value", F.explode(bloom_positions(F.col("h"), F.col("m"), F.col("k"))).alias("bit"))


def add(defs: DataFrame, bits: DataFrame | None, values: DataFrame) -> DataFrame:
    """The set bits after adding values (key, value)."""
    new = positions(defs, values).select("key", "bit")
    return (new if bits is None else bits.select("key", "bit").union(new)).distinct()


def exists(defs: DataFrame, bits: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, value, flag) of probes: 1 if all positions are set, or if the value is blank and there is a filter."""
    asked = probes.distinct()
    blank = F.coalesce(F.trim("value") == "", F.lit(True))
    if (defs.agg(F.sum("m")).first()[0] or 0) <= BROADCAST_BITS:
        word = F.col("bit") / 64
        words = bits.groupBy("key", F.floor(word).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("mask"))
        packed = defs.join(words.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "mask"))).alias("words")), "key", "left")
        last = F.floor((F.col("m") - 1) / 64)
        whole = packed.select("key", "m", "k", F.transform(F.sequence(F.lit(0).cast("long"), last), lambda w: F.coalesce(F.try_element_at("words", w), F.lit(0).cast("long"))).alias("words"))
        hit = F.forall(bloom_positions(F.col("h"), F.col("m"), F.col("k")), lambda b: F.getbit(F.get("words", F.floor(b / 64).cast("int")), (b % 64).cast("int")) == 1)
        out = asked.withColumn("h", string_hash(F.col("value"))).join(F.broadcast(whole), "key", "left")  # within BROADCAST_BITS
        return out.select("key", "value", F.when(F.col("m").isNull(), 0).when(blank, 1).otherwise(hit.cast("int")).alias("flag"))
    set_ = positions(defs, asked).join(bits.withColumn("on", F.lit(1)), ["key", "bit"], "left")
    found = set_.groupBy("key", "value").agg(F.min(F.coalesce("on", F.lit(0))).alias("all_on"))
    out = asked.join(defs.select("key", F.lit(1).alias("there")), "key", "left").join(found, ["key", "value"], "left")
    return out.select("key", "value", F.when(blank & F.col("there").isNotNull(), 1).otherwise(F.coalesce("all_on", F.lit(0))).alias("flag"))


def remove(defs: DataFrame, bits: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definitions, bits) without the filters of keys."""
    gone = keys.select("key")
    return defs.join(gone, "key", "left_anti"), bits.join(gone, "key", "left_anti")


def reset(bits: DataFrame, keys: DataFrame) -> DataFrame:
    """The bits without those of keys, whose filters stay, empty."""
    return bits.join(keys.select("key"), "key", "left_anti")


def add_flags(defs: DataFrame, values: DataFrame) -> DataFrame:
    """values with flag: OK, or FAIL where there is no filter."""
    there = defs.select("key", F.lit("OK").alias("flag"))
    return values.join(there, "key", "left").withColumn("flag", F.coalesce("flag", F.lit("FAIL")))


def density(defs: DataFrame, bits: DataFrame) -> DataFrame:
    """(key, set_bits, density)."""
    n = bits.groupBy("key").agg(F.count("*").alias("set_bits"))
    return defs.join(n, "key", "left").select("key", F.coalesce("set_bits", F.lit(0)).alias("set_bits"), (F.coalesce("set_bits", F.lit(0)) / F.col("m")).alias("density"))
