"""Geohashes of 52 bits, their text form, neighbours and distances, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds, bits of an axis, alphabet and radius must equal those of the stores whose data are read.
LAT_MAX, LON_MAX = 85.05112878, 180.0
GRID = 67108863  # 2^26 - 1
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH_M = 6371000.0

DIRECTIONS = (("N", 1, 0), ("S", -1, 0), ("E", 0, 1), ("W", 0, -1), ("NE", 1, 1), ("NW", 1, -1), ("SE", -1, 1), ("SW", -1, -1), ("CT", 0, 0))


def in_bounds(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-LAT_MAX, LAT_MAX) & lon.between(-LON_MAX, LON_MAX), F.lit(False))


def grid_index(v: Column, most: float) -> Column:
    """The index of a coordinate on the grid from -most to most."""
    share = (F.least(F.greatest(v, F.lit(-most)), F.lit(most)) - F.lit(-most)) / F.lit(2 * most)
    return (share * F.lit(float(GRID))).cast("long")


def _spread(x: Column) -> Column:
    """Bit i to bit 2i: the binary digits read in base four."""
    return F.conv(F.bin(x), 4, 10).cast("long")


def _gather(x: Column) -> Column:
    """Bit 2i to bit i: base-four digits, of which only the low bits are left, read in base two."""
    even = x.bitwiseAND(F.lit(0x5555555555555555).cast("long"))
    return F.conv(F.conv(even.cast("string"), 10, 4), 2, 10).cast("long")


def interleave(lat_index: Column, lon_index: Column) -> Column:
    """Even bits from the latitude, odd ones from the longitude."""
    return _spread(lat_index).bitwiseOR(F.shiftleft(_spread(lon_index), 1))


def encode(lat: Column, lon: Column) -> Column:
    return interleave(grid_index(lat, LAT_MAX), grid_index(lon, LON_MAX))


def indices(geohash: Column) -> tuple[Column, Column]:
    """(latitude index, longitude index)."""
    return _gather(geohash), _gather(F.shiftright(geohash, 1))


def coordinate(index: Column, most: float) -> Column:
    """The lower corner of a cell."""
    return F.lit(-most) + (index / F.lit(float(GRID))) * F.lit(2 * most)


def decode(geohash: Column) -> tuple[Column, Column]:
    lat, lon = indices(geohash)
    return coordinate(lat, LAT_MAX), coordinate(lon, LON_MAX)


def base32(geohash: Column) -> Column:
    """Eleven characters."""
    wide = F.shiftleft(geohash, 3)
    letters = [F.substring(F.lit(ALPHABET), F.shiftright(wide, 50 - 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(11)]
    return F.concat(*letters)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine)."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def neighbours(geohash: Column) -> Column:
    """Array of (dir, geohash) of the eight cells around, and of the cell: latitude stops at the poles, longitude wraps."""
    lat, lon = indices(geohash)
    cells = []
    for name, dy, dx in DIRECTIONS:
        y = F.least(F.greatest(lat + dy, F.lit(0).cast("long")), F.lit(GRID).cast("long"))
        x = (lon + dx).bitwiseAND(GRID)
        cells.append(F.struct(F.lit(name).alias("dir"), interleave(y, x).alias("geohash")))
    return F.array(*cells)


# Bounds of radii in metres, and the bits that cells of a search are coarser by.
SHIFTS = ((50, 0), (500, 3), (5_000, 6), (50_000, 10))
WIDEST_SHIFT = 14


def step_shift(radius_m: Column) -> Column:
    """The bits by which the cells of a search of a radius are coarser than the grid."""
    out = F.lit(WIDEST_SHIFT)
    for most, bits in reversed(SHIFTS):
        out = F.when(radius_m <= most, bits).otherwise(out)
    return out


def box_ranges(south: Column, north: Column, west: Column, east: Column, parts: int = 3) -> Column:
    """Array of (lo, hi): the geohashes of opposite corners of the parts x parts pieces of a box, from the south-west, the lesser first."""

    def cut(low: Column, high: Column, k: Column) -> Column:
        return low + k * ((high - low) / F.lit(float(parts)))

    def piece(k: Column) -> Column:
        i, j = F.floor(k / parts), k % parts
        a, b = (encode(cut(south, north, i + d), cut(west, east, j + d)) for d in (0, 1))
        return F.array_sort(F.array(a, b))

    pairs = F.transform(F.sequence(F.lit(0), F.lit(parts * parts - 1)), piece)
    return F.transform(pairs, lambda x: F.struct(x[0].alias("lo"), x[1].alias("hi")))
