"""Form fields: merging, filling and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill(fields: DataFrame, values: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Fields with new values where given; a null or empty new value changes nothing."""
    new = values.filter(f"{value} is not null and {value} <> ''").select(name, F.col(value).alias("_new"))
    return fields.join(new, name, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def to_json(fields: DataFrame, group: str) -> DataFrame:
    """(group, json): each group's fields as a JSON array of name, value and options, in the order of names."""
    items = F.array_sort(F.collect_list(F.struct("name", "value", "options")))
    return fields.groupBy(group).agg(F.to_json(items).alias("json"))


FIELD = "array<struct<name:string,value:string,options:array<string>>>"


def from_json(text: Column) -> Column:
    """Fields of a JSON array."""
    return F.from_json(text, FIELD)


def values(fields: Column) -> Column:
    """Name to value of the fields that have a value; the last of equal names wins."""
    kept = F.filter(fields, lambda f: F.length(f["value"]) > 0)
    names = F.array_distinct(F.transform(kept, lambda f: f["name"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(kept, lambda f: f["name"] == n), -1)["value"])
    return F.map_from_arrays(names, last)


# ------------------------------------------------------------------ dictionaries as maps
def put(m: Column, key: str, value: Column) -> Column:
    """The map with the key set; an entry of that key is replaced."""
    rest = F.map_filter(m, lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), value))


def put_if_not_null(m: Column, key: str, value: Column) -> Column:
    return F.when(value.isNull(), m).otherwise(put(m, key, value))


def merge(a: Column, b: Column) -> Column:
    """Both maps; entries of the second win."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def remove(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def set_at(array: Column, i: int, value: Column) -> Column:
    """The array with its i-th item (from 0) replaced; null if there is none."""
    return F.when(F.size(array) > i, F.transform(array, lambda x, k: F.when(k == i, value).otherwise(x)))
