"""Many column statistics in one pass over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(
    df: DataFrame, fields: Mapping[str, Mapping[str, Column]], by: Sequence[str] = (), label: str = "field"
) -> DataFrame:
    """One output row per field (and group): all aggregates share a single scan and shuffle."""
    aggregates, structs = [], []
    for index, (field, metrics) in enumerate(fields.items()):
        aggregates += [expr.alias(f"_{index}_{name}") for name, expr in metrics.items()]
        structs.append(
            F.struct(F.lit(field).alias(label), *[F.col(f"_{index}_{name}").alias(name) for name in metrics])
        )
    return (
        df.groupBy(*by).agg(*aggregates).select(*by, F.explode(F.array(*structs)).alias("_row")).select(*by, "_row.*")
    )


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long for double columns."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), name, value
    )
