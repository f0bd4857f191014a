"""Ordered computations that never put one group into one task.

A window over a group that holds a third of the table runs in a single task. Here the rows
are range-partitioned by (group, order), the placement is fixed in reliable storage, running
sums are taken inside each partition, and the partition totals are added as offsets.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder for cut lineage: the one the cluster names, or a fresh one in a local session."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages read what was placed, even after an executor is lost."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def attach(df: DataFrame, aggregated: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join an aggregate back to its rows. Hot keys are split by the adaptive skew join.

    Without keys the other side must be one row (or none, which gives nulls); more fail the query.
    """
    if not keys:
        row = aggregated.select(F.struct(*aggregated.columns).alias("_one"))
        many = F.raise_error(F.lit("attach without keys needs a single row on the other side"))
        one = row.agg(F.when(F.count(F.lit(1)) > 1, many).otherwise(F.any_value("_one")).alias("_one"))
        return df.join(F.broadcast(one), how=how, on=F.lit(True)).select(*df.columns, "_one.*")
    right = aggregated.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in aggregated.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & df[key].eqNullSafe(right[f"_r_{key}"])
    return df.join(right, condition, how).drop(*[f"_r_{k}" for k in keys])


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[tuple[str, bool]],
    sums: Mapping[str, Column],
    totals: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Inclusive running sums in total order inside each ``by`` group.

    ``order`` lists (column, ascending) and must be unique within the group. ``totals`` adds the
    group sum of each value as ``<name>_total``; it falls out of the partition totals. ``ranges``
    fixes the number of ranges, so that a task's rows don't grow with rows that compress well.
    """
    by = list(by)
    sort = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    number = [] if ranges is None else [ranges]
    dealt = df.repartitionByRange(*number, *[F.col(b).asc() for b in by], *sort)
    # the values are taken behind the shuffle: a writer that sorts by many ranges holds the bare rows only
    placed = cut(dealt.select("*", *[expr.alias(f"_v_{name}") for name, expr in sums.items()], F.spark_partition_id().alias("_part")))
    # one row per (partition, group): the windows below see at most the partition count per group
    parts = placed.groupBy("_part", *by).agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = parts.select(
        "_part",
        *by,
        *[F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_v_{n}") for n in sums],
        *([F.sum(f"_v_{n}").over(whole).alias(f"_t_{n}") for n in sums] if totals else []),
        F.lit(0).alias("_kind"),
    )
    # the offset enters its partition as a leading row, so no join moves the data once more
    led = placed.withColumn("_kind", F.lit(1)).unionByName(offsets, allowMissingColumns=True)
    if ranges is not None:
        led = led.repartition(ranges, "_part", *by)
    inside = (
        Window.partitionBy("_part", *by).orderBy("_kind", *sort).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = [F.sum(f"_v_{n}").over(inside).alias(n) for n in sums]
    if totals:
        summed += [F.max(f"_t_{n}").over(inside).alias(f"{n}_total") for n in sums]
    return led.select(*df.columns, *summed, "_kind").filter("_kind = 1").drop("_kind")


def positions(
    df: DataFrame, by: Sequence[str], order: Sequence[tuple[str, bool]], name: str = "position", totals: bool = False
) -> DataFrame:
    """1-based position of each row in its group (and, with ``totals``, the group size)."""
    return running(df, by, order, {name: F.lit(1).cast("long")}, totals)


def value_counts(
    df: DataFrame, by: Sequence[str], value: str, extra: Mapping[str, Column] | None = None, totals: bool = False
) -> DataFrame:
    """One row per distinct value: rows, rows up to and including it, and its average rank.

    Equal values collapse before the shuffle, so a heavy tie costs one row.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("rows"), *[e.alias(n) for n, e in (extra or {}).items()])
    )
    return with_average_rank(counted, by, value, totals)


def with_average_rank(counted: DataFrame, by: Sequence[str], value: str, totals: bool = False) -> DataFrame:
    """Rows up to and including each value, and its average rank, of ``rows`` counted by distinct value."""
    ranked = running(counted, by, [(value, True)], {"rows_upto": F.col("rows")}, totals)
    return ranked.withColumn("average_rank", F.col("rows_upto") - F.col("rows") + (F.col("rows") + 1) / 2)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Attach the average rank (ties share their mean position) to every row."""
    ranks = value_counts(df, by, value).select(*by, value, F.col("average_rank").alias(name))
    return attach(df, ranks, [*by, value])


def quantile_rows(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per (group, probability).

    No group is held in memory: each distinct value knows the index range it covers and keeps only
    the wanted indices that fall inside.
    """
    counts = value_counts(df, by, value, totals=True).withColumnRenamed("rows_upto_total", "_n")
    first, last = F.col("rows_upto") - F.col("rows"), F.col("rows_upto") - 1

    def target(p: Column) -> Column:
        return (F.col("_n") - 1) * p

    wanted = F.filter(
        F.array(*[F.lit(float(p)) for p in probabilities]),
        lambda p: F.floor(target(p)).between(first, last) | F.ceil(target(p)).between(first, last),
    )
    hits = counts.select(*by, value, "_n", "rows", "rows_upto", F.explode(wanted).alias("p"))
    low = F.max(F.when(F.floor(target(F.col("p"))).between(first, last), F.col(value)))
    high = F.max(F.when(F.ceil(target(F.col("p"))).between(first, last), F.col(value)))
    ends = hits.groupBy(*by, "p", "_n").agg(low.alias("_lo"), high.alias("_hi"))
    share = target(F.col("p")) - F.floor(target(F.col("p")))
    return ends.select(*by, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias("quantile"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """The same with one column per named probability."""
    rows = quantile_rows(df, by, value, list(probabilities.values()))
    return rows.groupBy(*by).agg(
        *[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("quantile"))).alias(name) for name, p in probabilities.items()]
    )
