"""Many small logistic fits in shared passes over the rows.

A group (fold, domain, replicate) may hold most of the table, so no group is gathered. Rows are packed once
into blocks of one group, arrays of up to BLOCK numbers. Each Newton step is one Arrow pass that sums the
gradient and curvature of every (group, point) that still moves, as products of a block with all of them at
once; Spark adds the partial sums, and only the coefficients, a configured number of small vectors, meet on
the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators.ranking import cut

# (batch, point) -> design matrix
Design = Callable[[pd.DataFrame, float], np.ndarray]
#: Rows of a block, and multiplicities that it holds at most.
BLOCK, CELLS = 4096, 2_000_000
#: Numbers that a product of a block with some of the fits holds.
PRODUCT = 65_536
#: Newton steps that a fit may take from a near one's coefficients.
SOON = 8
#: The point of a hinge that no row reaches: a fit without it.
NOWHERE = float("inf")
NUMBERS = ("z", "monitor", "label", "weight")
#: Upper triangle of a curvature: powers of (z, monitor) and of the hinge that its entries sum.
SQUARE = [(i, j) for i in range(6) for j in range(i, 6)]
POWERS = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 0, 1), (0, 1, 1))
TERMS = [tuple(a + b for a, b in zip(POWERS[i], POWERS[j], strict=True)) for i, j in SQUARE]


def packed(df: DataFrame, group: str, times: str | None = None) -> DataFrame:
    """(grp, z, monitor, label, weight [, times], part): the numbers of up to BLOCK rows of a group as arrays; the
    multiplicities of a block's rows follow each other. Blocks of a part keep the order of its rows."""
    columns = [*NUMBERS, *([times] if times else [])]
    source = df.select(F.col(group).cast("string").alias("grp"), *[F.col(c).cast("double").alias(c) for c in NUMBERS], *([times] if times else []))

    def block(name: str, rows: pa.Table) -> pa.RecordBatch:
        lists = []
        for c in columns:
            values = rows.column(c).combine_chunks()
            values = values.flatten().cast(pa.int8()) if c == times else values  # raises beyond 127
            lists.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), *lists], ["grp", *columns])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, pa.Table] = {}
        for batch in batches:
            code = batch.column("grp").dictionary_encode()
            at = code.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(len(code.dictionary) + 1))
            for k, name in enumerate(code.dictionary.to_pylist()):
                new = pa.Table.from_batches([batch.take(pa.array(order[ends[k] : ends[k + 1]]))])
                mine = pa.concat_tables([waiting[name], new]) if name in waiting else new
                size = BLOCK if not times else min(BLOCK, max(1, CELLS // max(1, len(batch.column(times)[0]))))
                whole = mine.num_rows - mine.num_rows % size
                for start in range(0, whole, size):
                    yield block(name, mine.slice(start, size))
                waiting[name] = mine.slice(whole)
        for name, rows in waiting.items():
            if rows.num_rows:
                yield block(name, rows)

    kinds = "grp string, " + ", ".join(f"{c} array<double>" for c in NUMBERS) + (f", {times} array<tinyint>" if times else "")
    return cut(source.mapInArrow(pack, kinds).withColumn("part", F.spark_partition_id()))


def opened(batches: Iterator[pa.RecordBatch], times: str | None) -> Iterator[tuple[str, dict[str, np.ndarray]]]:
    """The blocks of a task: group and numbers; multiplicities are rows by replicates."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in NUMBERS}
            if times:
                rows["times"] = batch.column(times)[i].values.to_numpy(zero_copy_only=False).reshape(len(rows["z"]), -1)
            yield batch.column("grp")[i].as_py(), rows


def drawn_rows(blocks: DataFrame, times: str = "times") -> DataFrame:
    """(grp, rep, n, ones): rows and positives that every replicate draws."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for name, rows in opened(batches, times):
            found[name] = found.get(name, 0) + np.stack([rows["times"].sum(0), rows["label"] @ rows["times"]])
        for name, total in found.items():
            reps = np.arange(total.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(reps)), pa.array(reps), *map(pa.array, total)], ["grp", "rep", "n", "ones"])

    return blocks.mapInArrow(add, "grp string, rep int, n double, ones double").groupBy("grp", "rep").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))


def block_sums(rows: dict[str, np.ndarray], reps: np.ndarray, points: np.ndarray, beta: np.ndarray, losses: bool) -> np.ndarray:
    """(sums, cells) of a block: gradient and upper curvature, or loss and weight. Some cells at a time, so that what
    a product holds doesn't grow with their number."""
    z, m, y, w = (rows[c][:, None] for c in NUMBERS)
    flat = np.concatenate([np.ones_like(z), z, m, z * m], 1)
    wanted = [(terms is TERMS, h, sorted({t for t in terms if t[2] == h})) for terms in (POWERS, TERMS) for h in range(3) if any(t[2] == h for t in terms)]
    lefts = [np.concatenate([z**a * m**b for a, b, _ in some], 1).T for _, _, some in wanted]
    places = {(bent, t): k for k, (bent, t) in enumerate([*((False, t) for t in POWERS), *((True, t) for t in dict.fromkeys(TERMS))])}
    found = np.empty((2 if losses else len(places), len(points)))
    size = max(1, PRODUCT // len(z))
    for at in range(0, len(points), size):
        cells = slice(at, at + size)
        b = beta[:, cells]
        weight = w * rows["times"][:, reps[cells]] if "times" in rows else np.broadcast_to(w, (len(z), b.shape[1]))
        hinge = np.maximum(z - points[cells], 0.0)
        eta = flat @ b[:4]
        eta += hinge * (b[4] + m * b[5])
        np.clip(eta, -35, 35, out=eta)
        if losses:
            lost = np.log(1 + np.exp(-np.abs(eta))) + np.maximum(eta, 0) - y * eta
            found[0, cells], found[1, cells] = (weight * lost).sum(0), weight.sum(0)
            continue
        mu = np.exp(np.negative(eta, out=eta), out=eta)
        mu += 1
        np.reciprocal(mu, out=mu)
        pull = weight * (mu - y)
        bend = mu * (1 - mu)
        bend *= weight
        for (bent, h, some), left in zip(wanted, lefts, strict=True):
            value = bend if bent else pull
            if h:
                value *= hinge  # powers of the hinge follow each other
            for t, sums in zip(some, left @ value, strict=True):
                found[places[bent, t], cells] = sums
    return found if losses else found[[*range(len(POWERS)), *[places[True, t] for t in TERMS]]]


def fit_many(
    df: DataFrame, group: str, points: dict[str, Sequence], design: Design, width: int, penalty: float, steps: int = 25,
    tolerance: float = 1e-8, times: str | None = None, blocks: DataFrame | None = None,
) -> pd.DataFrame:
    """Penalised logistic coefficients and mean log-loss per (group, point).

    ``df`` has the group column, label (0/1), weight, z and monitor. ``points`` lists the hinges of each group;
    at NOWHERE, and in the interaction design, a fit has no hinge. With ``times``, an array column of
    multiplicities, points are (replicate, parameter): the replicate's multiplicity is a factor of the weight,
    and rows are not copied. ``blocks`` are the packed rows, if there already.

    The first replicate of a group is fitted first, and the others start from its nearest fits; what is not
    done soon from there starts again from zero.
    """
    if design not in (hinge_design, interaction_design):
        raise ValueError("blocks know the interaction and hinge designs")
    blocks = packed(df, group, times) if blocks is None else blocks
    asked = {g: np.array([p[1] if times else p for p in ps], float) for g, ps in points.items() if len(ps)}
    rep = {g: np.array([p[0] if times else 0 for p in points[g]]) for g in asked}
    spot = {g: np.full(len(p), NOWHERE) if design is interaction_design else p for g, p in asked.items()}
    beta = {g: np.zeros((6, len(p))) for g, p in asked.items()}
    names = [f"s{i}" for i in range(len(POWERS) + len(TERMS))]

    def sums(active: dict[str, np.ndarray], losses: bool = False) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Cells of every group and their sums, a row a cell."""
        at = {g: (rep[g][i], spot[g][i], beta[g][:, i]) for g, i in active.items() if len(i)}
        heads = names[:2] if losses else names

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[str, np.ndarray] = {}
            for g, rows in opened(batches, times):
                if g in at:
                    totals[g] = totals.get(g, 0) + block_sums(rows, *at[g], losses)
            for g, total in totals.items():
                index = pa.array(active[g], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(index)), index, *map(pa.array, total)], ["grp", "idx", *heads])

        partial = blocks.mapInArrow(step, f"grp string, idx int, {', '.join(f'{n} double' for n in heads)}")
        table = partial.groupBy("grp", "idx").agg(*[F.sum(n).alias(n) for n in heads]).toArrow()
        group, index = np.array(table.column("grp").to_pylist(), object), table.column("idx").to_numpy()
        values = np.stack([table.column(n).to_numpy() for n in heads], 1) if len(index) else np.zeros((0, len(heads)))
        return {g: (index[group == g], values[group == g]) for g in at}

    def moved(active: dict[str, np.ndarray], steps: int) -> dict[str, np.ndarray]:
        """Newton steps of the active cells; those that still move, or went astray."""
        for _ in range(steps):
            active = {g: i for g, i in active.items() if len(i)}
            if not active:
                break
            moving = {}
            for g, (index, s) in sums(active).items():
                curvature = np.zeros((len(index), 6, 6))
                for k, (i, j) in enumerate(SQUARE):
                    curvature[:, i, j] = curvature[:, j, i] = s[:, 6 + k]
                curvature += penalty * np.eye(6)
                bare = spot[g][index] == NOWHERE
                curvature[np.ix_(bare, [4, 5], [4, 5])] = np.eye(2)
                gradient = s[:, :6] + penalty * beta[g][:, index].T
                gradient[np.ix_(bare, [4, 5])] = 0
                change = np.linalg.solve(curvature, gradient[:, :, None])[:, :, 0]
                beta[g][:, index] -= change.T
                moving[g] = index[~(np.abs(change).max(1) < tolerance)]
            active = moving
        return {g: i for g, i in active.items() if len(i)}

    first = {g: np.flatnonzero(r == r[0]) for g, r in rep.items()}
    moved(first, steps)
    later = {g: np.flatnonzero(r != r[0]) for g, r in rep.items()}
    for g, index in later.items():
        for bare in (False, True):
            start, mine = (i[(spot[g][i] == NOWHERE) == bare] for i in (first[g], index))
            if len(start) and len(mine):
                near = start[:1] if bare else start[np.abs(spot[g][mine][:, None] - spot[g][start]).argmin(1)]
                beta[g][:, mine] = beta[g][:, near]
    astray = moved(later, SOON)
    for g, index in astray.items():
        beta[g][:, index] = 0
    moved(astray, steps)
    frames = []
    for g, (index, s) in sums({g: np.arange(len(r)) for g, r in rep.items()}, True).items() if rep else ():
        index, s = index[s[:, 1] > 0], s[s[:, 1] > 0]
        order = np.argsort(index)
        index, s = index[order], s[order]
        fits = {f"b{i}": beta[g][i, index] for i in range(width)}
        frames.append(pd.DataFrame({"grp": g, **({"rep": rep[g][index]} if times else {}), "point": asked[g][index], "loss": s[:, 0] / s[:, 1], **fits}))
    empty = pd.DataFrame(columns=["grp", *(["rep"] if times else []), "point", "loss", *[f"b{i}" for i in range(width)]])
    return pd.concat(frames, ignore_index=True) if frames else empty


def interaction_design(rows: pd.DataFrame, _: float) -> np.ndarray:
    z, m = rows["z"].to_numpy(float), rows["monitor"].to_numpy(float)
    return np.column_stack([np.ones(len(z)), z, m, z * m])


def hinge_design(rows: pd.DataFrame, point: float) -> np.ndarray:
    z, m = rows["z"].to_numpy(float), rows["monitor"].to_numpy(float)
    hinge = np.maximum(z - point, 0.0)
    return np.column_stack([np.ones(len(z)), z, m, z * m, hinge, hinge * m])
