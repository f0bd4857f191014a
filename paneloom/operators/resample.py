"""Bootstrap replicates as arrays: one row carries how often each replicate draws it.

Entities are drawn with all their rows, inside each group of ``by`` (a fold) for itself. A row of the scored
table gets an array of B multiplicities, is range-partitioned once by rank, and is never copied per
replicate: a partition adds up B running counts, its totals become the offsets of the next ones, and a
second walk over the placed rows computes what every replicate needs at its own rank. What is sorted is
the scored rows, whatever the number of replicates.

Draw i of replicate r in a group of n entities picks hash(seed, group, r, i) mod n, so a replicate is the
same on any partitioning and after a retry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.functions.draws import hash_numbers
from paneloom.operators.ranking import attach, cut, positions

#: Multiplicities that a task holds at a time.
CELLS = 2_000_000
#: Draws that a task makes and counts.
DRAWS = 16_000_000
#: Rank order of a model's rows; copies of a row are ranked next to each other.
ORDER = (("prediction", False), ("entity_id", True), ("period", True))


def multiplicity_arrays(df: DataFrame, by: Sequence[str], replications: int, seed: str) -> DataFrame:
    """(by, entity_id, times): how often each replicate draws an entity; entities never drawn have no row.

    Draws are shuffled as blocks of a bucket, which is a range of unit numbers with CELLS multiplicities, and
    meet the names of its units there: a task holds one bucket, and no draw is a row.
    """
    by, span = list(by), max(1, CELLS // replications)
    units = positions(df.select(*by, "entity_id").distinct(), by, [("entity_id", True)], "unit", totals=True)
    head = F.concat_ws(":", F.lit(seed), *[F.col(b).cast("string") for b in by])  # coordinates of hash_number
    units = units.select(*by, "entity_id", (F.col("unit") - 1).alias("unit"), F.col("unit_total").alias("n"), head.alias("_head"))
    keys = [*by, "_bucket"]

    def blocks(names: list[pa.Array], bucket: np.ndarray, kind: int, entities: pa.Array, codes: np.ndarray) -> pa.RecordBatch:
        """One row per bucket: its draws (kind 0) or its units (kind 1)."""
        order = np.argsort(bucket.astype(np.min_scalar_type(bucket.max())), kind="stable")
        bucket = bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        found = bucket[starts]
        ends = pa.array(np.r_[starts, len(order)], pa.int32())
        if kind:
            entities = pa.ListArray.from_arrays(ends, entities.take(pa.array(order)))
        else:
            entities = pa.ListArray.from_arrays(pa.array(np.zeros(len(found) + 1), pa.int32()), entities.slice(0, 0))
        columns = [n.take(pa.array(np.zeros(len(found), np.int64))) for n in names]
        lists = pa.ListArray.from_arrays(ends, pa.array(codes[order].astype(np.int32)))
        return pa.RecordBatch.from_arrays([*columns, pa.array(found), pa.array([kind] * len(found), pa.int32()), entities, lists], [*keys, "_kind", "_entities", "_codes"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, span):
                rows = batch.slice(at, span)
                codes = np.stack([pc.fill_null(rows.column(c).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for c in [*by, "n"]])
                edges = np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(0), True])
                for start, stop in zip(edges, edges[1:], strict=False):
                    some = rows.slice(start, stop - start)
                    unit, n, head = some.column("unit").to_numpy(), some.column("n")[0].as_py(), some.column("_head")[0].as_py()
                    picked = hash_numbers(head, np.arange(replications), unit) % n
                    names = [some.column(c) for c in by]
                    place = picked % span * replications + np.arange(replications)[:, None]
                    yield blocks(names, picked.ravel() // span, 0, some.column("entity_id"), place.ravel())
                    yield blocks(names, unit // span, 1, some.column("entity_id"), unit % span)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, times = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                names = [batch.column(c).slice(i, 1) for c in by]
                key = repr([*(n[0].as_py() for n in names), batch.column("_bucket")[i].as_py()])
                if key != now:
                    now, waiting, times = key, [], None
                codes = batch.column("_codes")[i].values.to_numpy()
                if batch.column("_kind")[i].as_py() == 0:
                    waiting.append(codes)
                    continue
                if times is None:
                    drawn = np.concatenate([*waiting, np.zeros(0, np.int32)])
                    waiting, times = [], np.bincount(drawn, minlength=span * replications).astype(np.int32).reshape(span, replications)
                mine = times[codes]
                hit = np.flatnonzero(mine.any(1))
                spans = pa.array(np.arange(0, len(hit) * replications + 1, replications), pa.int32())
                lists = pa.ListArray.from_arrays(spans, pa.array(mine[hit].ravel()).cast(pa.int8()))  # raises beyond 127
                entities = batch.column("_entities")[i].values.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([*[n.take(pa.array(np.zeros(len(hit), np.int64))) for n in names], entities, lists], [*by, "entity_id", "times"])

    types = dict(units.dtypes)
    kinds = [f"`{c}` {types[c]}" for c in by]
    # buckets are dealt over as many tasks as shuffles have, and over more where they hold more than DRAWS
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + units.count() * replications // DRAWS)
    units = units.withColumn("_bucket", F.floor(F.col("unit") / span)).repartition(tasks, *keys).sortWithinPartitions(*keys).drop("_bucket")
    dealt = units.mapInArrow(deal, ", ".join([*kinds, "_bucket long", "_kind int", f"_entities array<{types['entity_id']}>", "_codes array<int>"]))
    placed = dealt.repartition(tasks, *keys).sortWithinPartitions(*keys, "_kind")
    return placed.mapInArrow(count, ", ".join([*kinds, f"entity_id {types['entity_id']}", "times array<tinyint>"]))


#: (rows, multiplicities, copies before, hits before, copies in all) to named sums, each an array of replicates.
Visit = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)


def per_group(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Slices that belong to one group each."""
    for batch in batches:
        names = batch.column("_grp").to_pylist()
        edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        for start, stop in zip(edges, edges[1:], strict=False):
            for at in range(start, stop, step):
                yield names[at], batch.slice(at, min(step, stop - at))


def replicate_sums(df: DataFrame, by: Sequence[str], replications: int, seed: str, visit: Visit, names: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(by, model_id, name, sums): what ``visit`` finds over each model's rows in rank order, an array of replicates.

    ``df`` has by, model_id, key, prediction, outcome and the ``extra`` columns that ``visit`` reads. Models of
    one group share the draws.
    """
    keys, own = [*by, "model_id"], {b: f"_by{i}" for i, b in enumerate(by)}
    times = multiplicity_arrays(df, by, replications, seed).withColumnsRenamed(own)
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_grp")
    used = df.select(group, *[F.col(b).alias(o) for b, o in own.items()], *[c for c, _ in ORDER], F.col("outcome").cast("int").alias("_hit"), *extra)
    joined = attach(used, times, [*own.values(), "entity_id"]).filter("times IS NOT NULL").drop(*own.values())
    order = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in ORDER]
    placed = cut(joined.repartitionByRange("_grp", *order).sortWithinPartitions("_grp", *order).withColumn("_part", F.spark_partition_id()))
    step = max(1, CELLS // replications)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        part = 0
        for name, rows in per_group(batches, step):
            m = matrix(rows.column("times"), replications)
            hit = pc.fill_null(rows.column("_hit"), 0).to_numpy(zero_copy_only=False)
            part = rows.column("_part")[0].as_py()
            held = found.setdefault(name, [0, 0])
            held[0], held[1] = held[0] + m.sum(0), held[1] + hit @ m
        for name, (t, h) in found.items():
            yield pa.RecordBatch.from_pydict({"_grp": pa.array([name]), "_part": pa.array([part], pa.int32()), "t": pa.array([t.tolist()]), "h": pa.array([h.tolist()])})

    parts = placed.mapInArrow(totals, "_grp string, _part int, t array<long>, h array<long>")

    def offsets(group: pa.Table) -> pa.Table:
        group = group.sort_by("_part")  # one row a partition
        t, h = (np.array(group.column(c).to_pylist()) for c in "th")
        return pa.table({
            "_grp": group.column("_grp"), "_part": group.column("_part"), "_t": pa.array((t.cumsum(0) - t).tolist(), pa.list_(pa.int64())),
            "_h": pa.array((h.cumsum(0) - h).tolist(), pa.list_(pa.int64())), "_n": pa.array([t.sum(0).tolist()] * len(t), pa.list_(pa.int64())),
        })

    before = parts.groupBy("_grp").applyInArrow(offsets, "_grp string, _part int, _t array<long>, _h array<long>, _n array<long>")
    led = placed.withColumn("_kind", F.lit(1)).unionByName(before.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    walked = led.repartition("_part").sortWithinPartitions("_part", "_grp", "_kind", *order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        t = h = n = None
        for name, rows in per_group(batches, step):
            while rows.num_rows and rows.column("_kind")[0].as_py() == 0:  # a partition's first row of a group
                t, h, n = (np.array(rows.column(c)[0].as_py()) for c in ("_t", "_h", "_n"))
                rows = rows.slice(1)
            if not rows.num_rows:
                continue
            stop = next((i for i, k in enumerate(rows.column("_kind").to_pylist()) if k == 0), None)
            pending = rows
            while pending is not None:
                some = pending if stop is None else pending.slice(0, stop)
                m = matrix(some.column("times"), replications)
                hit = m * pc.fill_null(some.column("_hit"), 0).to_numpy(zero_copy_only=False)[:, None]
                first, hits = t + m.cumsum(0) - m, h + hit.cumsum(0) - hit
                for key, value in visit(some, m, first, hits, n).items():
                    sums[name, key] = sums.get((name, key), 0) + value
                t, h = t + m.sum(0), h + hit.sum(0)
                if stop is None:
                    break
                rest = pending.slice(stop)
                t, h, n = (np.array(rest.column(c)[0].as_py()) for c in ("_t", "_h", "_n"))
                pending = rest.slice(1)
                stop = next((i for i, k in enumerate(pending.column("_kind").to_pylist()) if k == 0), None)
        for (name, key), value in sums.items():
            yield pa.RecordBatch.from_pydict({"_grp": pa.array([name]), "name": pa.array([key]), "sums": pa.array([np.asarray(value, float).tolist()])})

    pieces = walked.mapInArrow(walk, "_grp string, name string, sums array<double>")

    def add(group: pa.Table) -> pa.Table:
        whole = np.sum(group.column("sums").to_pylist(), axis=0)  # one row a task
        return pa.table({"_grp": group.column("_grp")[:1], "name": group.column("name")[:1], "sums": pa.array([whole.tolist()], pa.list_(pa.float64()))})

    summed = pieces.groupBy("_grp", "name").applyInArrow(add, "_grp string, name string, sums array<double>")
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)
    return summed.select(F.from_json("_grp", schema).alias("_k"), "name", "sums").select("_k.*", "name", "sums")


def precision_gains(rows: pa.RecordBatch, times: np.ndarray, before: np.ndarray, hits: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of the precision at every drawn positive, and their number."""
    positive = pc.fill_null(rows.column("_hit"), 0).to_numpy(zero_copy_only=False) > 0
    m, r, h = times[positive], before[positive], hits[positive]
    gain = np.zeros(times.shape[1])
    for j in range(1, int(m.max(initial=0)) + 1):
        gain += np.where(m >= j, (h + j) / (r + j), 0.0).sum(0)
    return {"gain": gain, "positives": m.sum(0)}


def replicate_precision(df: DataFrame, by: Sequence[str], replications: int, seed: str) -> DataFrame:
    """(by, model_id, rep, average_precision) of every replicate; unknown where it drew no positive."""
    keys = [*by, "model_id"]
    found = replicate_sums(df, by, replications, seed, precision_gains, ("gain", "positives"))
    wide = found.groupBy(*keys).agg(*[F.max_by("sums", F.col("name") == n).alias(n) for n in ("gain", "positives")])
    each = F.posexplode(F.arrays_zip("gain", "positives")).alias("rep", "_v")
    return wide.select(*keys, each).select(*keys, "rep", F.try_divide("_v.gain", "_v.positives").alias("average_precision"))


def paired_samples(precision: DataFrame, pairs: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """(by, candidate, reference, rep, delta) of the replicates of both models of each pair."""
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(r).alias("reference")) for c, r in pairs.items()])).alias("_p")
    rows = precision.select("*", pair).select(*precision.columns, "_p.*").filter("model_id = candidate OR model_id = reference")
    value = {side: F.max(F.when(F.col("model_id") == F.col(side), F.col("average_precision"))) for side in ("candidate", "reference")}
    sides = [F.count_if(F.col("model_id") == F.col(side)) > 0 for side in value]
    wide = rows.groupBy(*by, "candidate", "reference", "rep").agg((value["candidate"] - value["reference"]).alias("delta"), (sides[0] & sides[1]).alias("_both"))
    return wide.filter("_both").drop("_both")
