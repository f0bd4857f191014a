"""List-valued rollups with bounded cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators.ranking import positions

PER_CELL = 10_000


def rollup_cells(df: DataFrame, keys: Sequence[str], value: str, per_cell: int = PER_CELL) -> DataFrame:
    """Sorted distinct values of each key, as arrays of at most ``per_cell`` values.

    Almost every key has the single cell 0. A key with more values continues in cells 1, 2, …,
    so no value is lost and no group is ever gathered whole.
    """
    distinct = df.filter(F.col(value).isNotNull() & (F.col(value) != "")).select(*keys, value).distinct()
    placed = positions(distinct, keys, [(value, True)], "_position")
    return (
        placed.withColumn("cell", ((F.col("_position") - 1) / per_cell).cast("int"))
        .groupBy(*keys, "cell")
        .agg(F.array_sort(F.collect_list(value)).alias("values"))
    )


def joined_cells(df: DataFrame, keys: Sequence[str], value: str, separator: str = " | ", per_cell: int = PER_CELL) -> DataFrame:
    """The same rollup as separated text."""
    cells = rollup_cells(df, keys, value, per_cell)
    return cells.select(*keys, "cell", F.array_join("values", separator).alias("refs"))
