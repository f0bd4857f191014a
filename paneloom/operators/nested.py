"""Quantiles and ranks of a value against many overlapping sets of rows, in one sort.

A row names the sets it belongs to (periods before each fold, all domains but one, drawn bags) in an
array. Rows collapse to one count per distinct value and membership, are range-partitioned by value once,
and every set is counted along the same order: a task holds one running count per set. Rows are never
copied per set, so what is shuffled doesn't depend on how many sets there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.functions.profile import melt
from paneloom.operators.ranking import attach, cut

#: Rows whose counts for all sets are held at a time.
SLICE = 2048
#: (batches, number of sets) to what ``walk`` yields.
Walk = Callable[[Iterator[pa.RecordBatch], int], Iterator[tuple]]


def members(period: Column, before: Sequence[int]) -> Column:
    """Numbers of the sets "rows before p" that hold a row of this period."""
    return F.array_compact(F.array(*[F.when(period < F.lit(int(p)), F.lit(i)) for i, p in enumerate(before)]))


def counts(df: DataFrame, sets: str = "sets") -> DataFrame:
    """(feature, value, sets, rows) in order of feature and value; the placement is fixed."""
    grouped = df.filter(F.col("value").isNotNull() & (F.size(sets) > 0)).groupBy("feature", "value", sets).agg(F.count(F.lit(1)).alias("rows"))
    placed = grouped.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value")
    return cut(placed.withColumn("part", F.spark_partition_id()))


def offsets(placed: DataFrame) -> DataFrame:
    """(feature, part, set, inside, before, n): rows of a set in a part, in earlier parts and in all."""
    return spots_of(placed.select("feature", "part", "rows", F.explode("sets").alias("set")).groupBy("feature", "part", "set").agg(F.sum("rows").alias("inside")))


def spots_of(parts: DataFrame) -> DataFrame:
    by = Window.partitionBy("feature", "set")  # one row a part
    before = F.sum("inside").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("*", F.coalesce(before, F.lit(0)).alias("before"), F.sum("inside").over(by).alias("n"))


def walk(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """(feature, part, values, running counts of every set within the part, counts before the slice)."""
    now, held = None, np.zeros(size, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            rows = batch.slice(at, SLICE)
            names = rows.column("feature").to_pylist()
            edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            if "times" in rows.schema.names:
                here = rows.column("times").flatten().to_numpy().reshape(len(names), size).astype(np.int64)
            else:
                lists, many = rows.column("sets"), rows.column("rows").to_numpy()
                lengths = np.diff(lists.offsets.to_numpy())
                here = np.zeros((len(names), size), np.int64)
                np.add.at(here, (np.repeat(np.arange(len(names)), lengths), lists.flatten().to_numpy()), np.repeat(many, lengths))
            values, part = rows.column("value").to_numpy(), rows.column("part")[0].as_py()
            for start, stop in zip(edges, edges[1:], strict=False):
                if names[start] != now:
                    now, held = names[start], np.zeros(size, np.int64)
                upto = held + here[start:stop].cumsum(0)
                yield now, part, values[start:stop], upto, held
                held = upto[-1]


def nested_quantiles(df: DataFrame, size: int, probabilities: Sequence[float] = (0.5,)) -> DataFrame:
    """(feature, set, p, quantile): exact linearly interpolated quantiles of every feature in every set.

    ``df`` has feature, value and sets, an array of set numbers below ``size``. Only the wanted places,
    two per feature, set and probability, reach the driver.
    """
    placed = counts(df)
    return selected(placed, offsets(placed), size, probabilities)


def replicate_quantiles(df: DataFrame, size: int, probabilities: Sequence[float]) -> DataFrame:
    """(feature, set, p, quantile) where the sets are replicates: ``df`` has feature, value and times, an array
    of how often each of ``size`` replicates draws the row."""
    rows = df.filter(F.col("value").isNotNull()).select("feature", "value", "times")
    placed = cut(rows.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value").withColumn("part", F.spark_partition_id()))

    return selected(placed, drawn_spots(placed, size, walk), size, probabilities)


def drawn_spots(placed: DataFrame, size: int, walk: Walk) -> DataFrame:
    """``offsets`` of rows that carry how often each of ``size`` replicates draws them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for feature, part, _, upto, held in walk(batches, size):
            found[feature, part] = found.get((feature, part), 0) + upto[-1] - held
        for (feature, part), total in found.items():
            yield pa.RecordBatch.from_pydict({"feature": pa.array([feature]), "part": pa.array([part], pa.int32()), "inside": pa.array([total.tolist()])})

    parts = placed.mapInArrow(add, "feature string, part int, inside array<long>")
    return spots_of(parts.select("feature", "part", F.posexplode("inside").alias("set", "inside")).filter("inside > 0"))


def walk_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """``walk`` over packed blocks (grp, z, times, part) whose rows were placed in order of grp and z."""
    counted: dict[str, np.ndarray] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            name, values = batch.column("grp")[i].as_py(), batch.column("z")[i].values.to_numpy()
            held = counted.get(name, np.zeros(size, np.int64))
            upto = batch.column("times")[i].values.to_numpy().reshape(len(values), size).cumsum(0, dtype=np.int64)
            upto += held
            yield name, batch.column("part")[i].as_py(), values, upto, held
            counted[name] = upto[-1].copy()


def block_quantiles(blocks: DataFrame, size: int, probabilities: Sequence[float]) -> DataFrame:
    """``replicate_quantiles`` of the z of packed blocks, which are read as they lie."""
    return selected(blocks, drawn_spots(blocks, size, walk_blocks), size, probabilities, walk_blocks)


def selected(placed: DataFrame, spots: DataFrame, size: int, probabilities: Sequence[float], walk: Walk = walk) -> DataFrame:
    """The wanted places of every (feature, set), read off the placed rows."""
    ends = F.explode(
        F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(k).alias("end"), f((F.col("n") - 1) * p).cast("long").alias("at"))
                  for p in probabilities for k, f in enumerate((F.floor, F.ceil))])
    )
    wanted = spots.select("*", ends.alias("e")).select("*", "e.*").filter((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("inside")))
    table = wanted.select("feature", "part", "set", (F.col("at") - F.col("before")).alias("at"), "p", "end", "n").toArrow().to_pandas()
    asked = {key: tuple(rows[c].to_numpy() for c in ("set", "at", "p", "end", "n")) for key, rows in table.groupby(["feature", "part"])}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for feature, part, values, upto, held in walk(batches, size):
            if (feature, part) not in asked:
                continue
            sets, at, p, end, n = asked[feature, part]
            here = np.flatnonzero((held[sets] <= at) & (at < upto[-1, sets]))
            if len(here):
                hits = [float(values[np.searchsorted(upto[:, s], k, side="right")]) for s, k in zip(sets[here], at[here], strict=True)]
                columns = [[feature] * len(here), sets[here], p[here], end[here], n[here], hits]
                kinds = (pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.float64())
                names = ("feature", "set", "p", "end", "n", "value")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

    found = placed.mapInArrow(find, "feature string, set int, p double, end int, n long, value double")
    low, high = (F.max(F.when(F.col("end") == k, F.col("value"))) for k in (0, 1))
    both = found.groupBy("feature", "set", "p", "n").agg(low.alias("low"), high.alias("high"))
    share = (F.col("n") - 1) * F.col("p") - F.floor((F.col("n") - 1) * F.col("p"))
    return both.select("feature", "set", "p", (F.col("low") + (F.col("high") - F.col("low")) * share).alias("quantile"))


def nested_medians(df: DataFrame, features: Sequence[str], size: int, sets: str = "sets") -> list[dict[str, float]]:
    """For every set the medians of the features that have a value in it."""
    long = melt(df.withColumnRenamed(sets, "sets"), ["sets"], features).withColumn("value", F.col("value").cast("double"))
    found: list[dict[str, float]] = [{} for _ in range(size)]
    for r in nested_quantiles(long, size).collect():  # one number per feature and set
        found[r["set"]][r["feature"]] = r["quantile"]
    return found


def nested_ranks(reference: DataFrame, size: int) -> DataFrame:
    """(feature, value, upto, n): for every distinct value the rows of each set up to it, and the sets' rows.

    Values that occur in no set are ranked too. A value's memberships lie in one partition, next to each other.
    """
    marked = reference.withColumn("sets", F.concat("sets", F.array(F.lit(size))))  # the last set holds every value
    placed = counts(marked)
    spots = offsets(placed).filter(F.col("set") < size)
    listed = spots.groupBy("feature", "part").agg(F.map_from_arrays(F.collect_list("set"), F.collect_list("before")).alias("before"))
    totals = spots.groupBy("feature").agg(F.map_from_entries(F.collect_set(F.struct("set", "n"))).alias("n"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for feature, part, values, upto, _ in walk(batches, size + 1):
            keys = [(feature, part, float(v)) for v in values]
            rows = []
            if waiting is not None and waiting[0] != keys[0]:
                rows.append(waiting)
            last = [i for i in range(len(keys) - 1) if keys[i] != keys[i + 1]]
            rows += [(keys[i], upto[i, :size].tolist()) for i in last]
            waiting = (keys[-1], upto[-1, :size].tolist())
            if rows:
                yield batch_of(rows)
        if waiting is not None:
            yield batch_of([waiting])

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"feature": pa.array([k[0] for k, _ in rows]), "part": pa.array([k[1] for k, _ in rows], pa.int32()),
             "value": pa.array([k[2] for k, _ in rows]), "inside": pa.array([u for _, u in rows], pa.list_(pa.int64()))}
        )

    inside = placed.mapInArrow(rank, "feature string, part int, value double, inside array<long>")
    joined = attach(attach(inside, listed, ["feature", "part"]), totals, ["feature"])

    def at(column: str, i: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(column), i), F.lit(0).cast("long"))

    upto = F.transform("inside", lambda x, i: x + at("before", i))
    n = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: at("n", i))
    return joined.select("feature", "value", upto.alias("upto"), n.alias("n"))


def nested_ecdf(df: DataFrame, value: str, period: str, before: Sequence[int], name: str = "ecdf") -> DataFrame:
    """Rows with the array ``name``: for each period p in ``before`` the rank of the row's value among the
    values of the periods before p, (count up to it - 0.5) / n, clipped.

    An entry is null for rows later than its period, so no rank is read where it could tell of the future,
    for null values, and where no value lies before the period.
    """
    if not before:
        return df.withColumn(name, F.array().cast("array<double>"))
    v = F.col(value).cast("double")
    reference = df.select(F.lit("").alias("feature"), v.alias("value"), members(F.col(period), before).alias("sets"))
    ranks = nested_ranks(reference, len(before)).select(F.col("value").alias("_v"), "upto", "n")
    joined = attach(df.withColumn("_v", v), ranks, ["_v"])
    share = [
        F.when(
            (F.col(period) <= F.lit(int(p))) & (F.col("n")[i] > 0),
            F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (F.col("upto")[i] - 0.5) / F.col("n")[i])),
        )
        for i, p in enumerate(before)
    ]
    return joined.select(*df.columns, F.when(F.col("_v").isNotNull(), F.array(*share)).alias(name))
