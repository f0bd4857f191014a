"""Sorted-set rollups. Values are typed arrays; text forms are made only at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_set(value: Column) -> Column:
    """Sorted distinct non-null values; duplicates are dropped map-side."""
    return F.array_sort(F.collect_set(value))


def joined_set(value: Column, separator: str = " | ") -> Column:
    """Sorted distinct values as one text, null when there are none."""
    return F.nullif(F.array_join(sorted_set(F.nullif(value, F.lit(""))), separator), F.lit(""))


def merged_arrays(value: Column) -> Column:
    """Union of array cells in a group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(value))))


def json_array(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def single_or_null(value: Column) -> Column:
    """The value if the group agrees on one, else null."""
    return F.when(F.min(value) == F.max(value), F.max(value))


def disagree(value: Column) -> Column:
    """True when a group holds two different non-null values; no distinct needed."""
    return F.coalesce(F.min(value) < F.max(value), F.lit(False))


def derived_key(canonical: Column, prefix: str = "embedded-provenance-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical, 256), 1, 16))
