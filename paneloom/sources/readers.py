"""Batch readers. Text formats give all-string columns; typing is a separate, explicit step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the long financial-value layout.
LONG_VALUE_COLUMNS = (
    "issuer_ticker", "fiscal_year", "audit_status", "scope", "source_item_id", "value_numeric", "unit",
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null mean the same thing: no value."""
    return df.select(
        *[
            F.nanvl(F.col(f.name), F.lit(None)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_source(
    spark: SparkSession,
    path: str | list[str],
    fmt: str,
    *,
    delimiter: str | None = None,
    encoding: str = "UTF-8",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Parquet, CSV, TSV, JSON lines or a JSON array; gzip is recognised by its suffix."""
    if fmt == "parquet":
        return nan_to_null(spark.read.parquet(*([path] if isinstance(path, str) else path)))
    if fmt in ("csv", "tsv"):
        df = (
            spark.read.option("header", True)
            .option("sep", delimiter or ("\t" if fmt == "tsv" else ","))
            .option("encoding", encoding)
            .option("escape", '"')
            .csv(path)
        )
        return df.toDF(*[name.removeprefix("\ufeff") for name in df.columns])
    if fmt in ("jsonl", "json"):
        reader = spark.read.option("mode", "FAILFAST").option("multiLine", fmt == "json").option("encoding", encoding)
        return (reader.schema(schema) if schema is not None else reader).json(path)
    raise ValueError(f"unknown source format: {fmt}")


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    return df


def read_long_values(spark: SparkSession, path: str) -> DataFrame:
    """Long financial values: every column text, required columns checked."""
    return require_columns(read_source(spark, path, "csv"), LONG_VALUE_COLUMNS).select(*LONG_VALUE_COLUMNS)
