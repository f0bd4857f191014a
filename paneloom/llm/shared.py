"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from paneloom.sources.sinks import scratch_folder

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its comparison SQL where SQL can express it."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete runs of equal keys, from rows sorted by them, and where each run starts.

    The run at a batch's end waits for the next batch, so what is held is a batch and one run.
    """
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        values = [rows.column(k).to_numpy() for k in keys]
        changed = np.zeros(rows.num_rows - 1, bool)
        for v in values:
            changed |= v[1:] != v[:-1]
        starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
        held = rows.slice(int(starts[-1]))
        if len(starts) > 1:
            yield rows.slice(0, int(starts[-1])), starts[:-1]
    if held is not None:
        yield held, np.array([0])


def release() -> None:
    """Give memory that Arrow keeps for later, up to several slices of text, back to the system."""
    pa.default_memory_pool().release_unused()


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each, and a row at least.

    A worker outlives its tasks, so what a slice took is released before the next.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        release()
        at = stop


def scratch(spark: SparkSession, name: str) -> str:
    """New folder beside the checkpoints, which every executor reaches, with the scheme of its file system.

    A folder without a scheme is one of the cluster's default file system, as Spark's checkpoints take it.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark, name))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    return f"file://{whole.removeprefix('file:')}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once and read again: what follows neither repeats the work nor loses it with
    an executor, and knows the table's size."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
