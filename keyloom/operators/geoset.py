"""Point sets: geo(key, member, lat, lon, geohash).

A member is there once. Null keys and members match nothing and add nothing. Of several writes of a member in a batch, the column seq decides,
or the greatest row where there is none; what is out of bounds is refused first. Empty tables are allowed everywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo as g
from .batches import last_of


def add(points: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (key, member); points out of bounds are refused."""
    good = new.where("key is not null and member is not null").where(g.in_bounds(F.col("lat"), F.col("lon")))
    good = last_of(good, ["key", "member"]).drop("seq").withColumn("geohash", g.encode(F.col("lat"), F.col("lon")))
    return points.join(good.select("key", "member"), ["key", "member"], "left_anti").unionByName(good)


def position(points: DataFrame) -> DataFrame:
    """(key, member, lat, lon), as decoded from the geohash."""
    lat, lon = g.decode(F.col("geohash"))
    return points.select("key", "member", lat.alias("lat"), lon.alias("lon"))


def distance(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, m1, m2, dist_m) of pairs, between decoded positions; -1 if one is absent."""
    at = position(points)
    one = at.select("key", F.col("member").alias("m1"), F.col("lat").alias("y1"), F.col("lon").alias("x1"))
    two = at.select("key", F.col("member").alias("m2"), F.col("lat").alias("y2"), F.col("lon").alias("x2"))
    d = g.distance_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    return pairs.join(one, ["key", "m1"], "left").join(two, ["key", "m2"], "left").select("key", "m1", "m2", F.coalesce(d, F.lit(-1.0)).alias("dist_m"))


def _box(lat: Column, lon: Column, lat0: float, lon0: float, radius_m: float) -> Column:
    """A bound that reaches the scan: latitudes, and longitudes unless a pole or the antimeridian is inside."""
    d = math.degrees(radius_m / g.EARTH_M) + 1e-9
    box = lat.between(lat0 - d, lat0 + d)
    if abs(lat0) + d < 90:
        w = math.degrees(math.asin(min(1.0, math.sin(min(radius_m / g.EARTH_M, math.pi / 2)) / math.cos(math.radians(lat0))))) + 1e-9
        if lon0 - w >= -180 and lon0 + w <= 180:
            box &= lon.between(lon0 - w, lon0 + w)
    return box


def search(points: DataFrame, lat0: float, lon0: float, radius_m: float, limit: int | None = None) -> DataFrame:
    """(key, member, dist_m) of the points within a radius of a centre; with a limit, the nearest of each set (ties by member)."""
    if radius_m <= 0:
        return points.where("false").select("key", "member", F.lit(0.0).alias("dist_m"))
    d = g.distance_m(F.col("lat"), F.col("lon"), F.lit(float(lat0)), F.lit(float(lon0)))
    out = points.where(_box(F.col("lat"), F.col("lon"), lat0, lon0, radius_m)).select("key", "member", d.alias("dist_m")).where(F.col("dist_m") <= radius_m)
    if limit:
        out = out.withColumn("rn", F.row_number().over(W.partitionBy("key").orderBy("dist_m", "member"))).where(F.col("rn") <= limit).drop("rn")
    return out


def search_many(points: DataFrame, centres: DataFrame, radius_m: float) -> DataFrame:
    """(centre, key, member, dist_m) for centres (centre, lat0, lon0): an equi-join on cells, then the exact distance.

    A centre takes every cell that its bounding box meets; the box widens
    towards the poles and takes all longitudes where a pole is inside.
    """
    d = math.degrees(radius_m / g.EARTH_M) + 1e-9
    cell = max(d, 0.01)
    columns = max(1, int(360 / cell))
    width = 360.0 / columns
    reach = F.when(F.abs("lat0") + d >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(min(radius_m / g.EARTH_M, math.pi / 2))) / F.cos(F.radians("lat0"))))) + 1e-9)
    rows = F.sequence(F.floor((F.col("lat0") - d) / cell), F.floor((F.col("lat0") + d) / cell))
    first, last = F.floor((F.col("lon0") - F.col("w") + 180) / width), F.floor((F.col("lon0") + F.col("w") + 180) / width)
    asked = centres.withColumn("w", reach).withColumn("r", F.explode(rows)).withColumn("c", F.explode(F.array_distinct(F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.lit(columns))))))
    there = points.withColumn("r", F.floor(F.col("lat") / cell)).withColumn("c", F.pmod(F.floor((F.col("lon") + 180) / width), F.lit(columns)))
    dist = g.distance_m(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    return there.join(asked, ["r", "c"]).select("centre", "key", "member", dist.alias("dist_m")).where(F.col("dist_m") <= radius_m)


def neighbours(points: DataFrame) -> DataFrame:
    """(key, member, dir, geohash, lat, lon): the cells around each point, and its own."""
    out = points.select("key", "member", F.explode(g.neighbours(F.col("geohash"))).alias("x")).select("key", "member", "x.dir", "x.geohash")
    lat, lon = g.decode(F.col("geohash"))
    return out.withColumns({"lat": lat, "lon": lon})


def encoded(points: DataFrame) -> DataFrame:
    """(key, member, code): eleven characters."""
    return points.select("key", "member", g.base32(F.col("geohash")).alias("code"))


def exists(points: DataFrame, members: DataFrame) -> DataFrame:
    found = points.select("key", "member", F.lit(1).alias("flag"))
    return members.select("key", "member").join(found, ["key", "member"], "left").select("key", "member", F.coalesce("flag", F.lit(0)).alias("flag"))


def remove(points: DataFrame, members: DataFrame) -> DataFrame:
    return points.join(members.select("key", "member"), ["key", "member"], "left_anti")


def drop(points: DataFrame, keys: DataFrame) -> DataFrame:
    return points.join(keys.select("key"), "key", "left_anti")
