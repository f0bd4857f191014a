"""Small literal tables attached to rows by explode, so no cross join is planned."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _cell(value: Any, dtype: str) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value]).cast(dtype)
    return F.lit(value).cast(dtype)


def with_grid(df: DataFrame, rows: Sequence[Mapping[str, Any]], schema: Mapping[str, str]) -> DataFrame:
    """Repeat every row once per registry row. The registry is configuration, not data."""
    if not rows:
        raise ValueError("the grid needs at least one row")
    cells = F.array(
        *[F.struct(*[_cell(row.get(name), dtype).alias(name) for name, dtype in schema.items()]) for row in rows]
    )
    return df.select("*", F.explode(cells).alias("_grid")).select(df.columns + ["_grid.*"])


def registry(spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: Mapping[str, str]) -> DataFrame:
    """A configuration table as a DataFrame of literals: no Python worker, and a size the planner knows."""
    if not rows:
        return spark.createDataFrame([], ", ".join(f"{name} {dtype}" for name, dtype in schema.items()))
    return with_grid(spark.range(0, 1, 1, 1), rows, schema).drop("id")


def lookup(mapping: Mapping[str, Any], key: Column) -> Column:
    """Value of a literal map; null for an unknown key."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)
