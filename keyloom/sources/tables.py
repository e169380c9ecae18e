"""Structures derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as g


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    expire = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") * 1000)
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), expire.alias("expire_at"), F.col("c_custkey").alias("seq"))


def zset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"), F.col("c_custkey").cast("string").alias("value"))


def increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"), F.col("value").alias("inc"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").cast("string").alias("field"), F.col("text").alias("value"))


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lat = F.lit(-80.0) + ((k * 7919) % 16000) / F.lit(100.0)
    lon = F.lit(-180.0) + ((k * 104729) % 36000) / F.lit(100.0)
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), lat.alias("lat"), lon.alias("lon"), k.alias("k"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_points(spark, sf_dir).drop("k").withColumn("geohash", g.encode(F.col("lat"), F.col("lon")))


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of events: errors delete, the others put; every fifth only if absent."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("command"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
        F.lit(0).cast("bigint").alias("ttl_ms"),
        (F.col("event_id") % 5 == 0).alias("not_exists"),
    )


def zset_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of events: purchases add, errors remove, the others increment."""
    e = table(spark, sf_dir, "events")
    command = F.when(F.col("event_type") == "purchase", "Z_ADD").when(F.col("event_type") == "error", "Z_RM").otherwise("Z_INCR")
    return e.select(F.col("event_id").alias("seq"), command.alias("command"), F.lit("z").alias("key"), F.col("user_id").cast("string").alias("z_member"), F.col("value").alias("z_score"), F.col("event_id").cast("string").alias("value"))
