"""Field hashes in tall form: fields(key, field, value). A hash without fields isn't there.

A field of a key is there once. Null keys and fields match nothing and set nothing. Of several writes of a field in a batch, the column
seq decides, or the greatest value where there is none. Empty tables are allowed everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import last_of


def set_(fields: DataFrame, new: DataFrame) -> DataFrame:
    new = last_of(new.where("key is not null and field is not null"), ["key", "field"]).select("key", "field", "value")
    return fields.join(new, ["key", "field"], "left_anti").unionByName(new)


def get(fields: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, field, value); null if there is none."""
    return asked.select("key", "field").join(fields, ["key", "field"], "left")


def all_json(fields: DataFrame) -> DataFrame:
    """(key, json): an object of all fields, in order of their names. Asked for as one text, so a hash is one row's work."""
    entries = F.array_sort(F.collect_list(F.struct("field", "value")))
    return fields.groupBy("key").agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def remove(fields: DataFrame, asked: DataFrame) -> DataFrame:
    return fields.join(asked.select("key", "field"), ["key", "field"], "left_anti")


def drop(fields: DataFrame, keys: DataFrame) -> DataFrame:
    return fields.join(keys.select("key"), "key", "left_anti")
