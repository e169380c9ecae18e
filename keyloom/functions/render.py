"""Texts of results, as column expressions; null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(items: Column) -> Column:
    """An array of texts in brackets, by commas; null items are left out."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def point(lat: Column, lon: Column) -> Column:
    """A position with six decimals."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("[%.6f,%.6f]", lat, lon))
