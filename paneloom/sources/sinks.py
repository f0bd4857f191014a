"""Validated writes and scratch space."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from paneloom.sources.contracts import Contract, violation_count


def scratch_folder(spark: SparkSession, name: str) -> str:
    """New folder beside the checkpoints, which every executor can reach."""
    from paneloom.operators.ranking import checkpoint_folder

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
    contract: Contract | None = None,
) -> None:
    """Write parquet or CSV by coordinate folders. A contract is checked first, and an existing
    target is never replaced silently."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown sink format: {fmt}")
    if contract is not None:
        from paneloom.operators.ranking import cut

        df = cut(df)  # what is written is what was checked, and the source is read once
        if violation_count(df, contract):
            raise ValueError("the table breaks its contract; see validate_contract for the rows")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
