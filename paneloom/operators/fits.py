"""Logistic fits of many cells in shared passes over the rows.

A cell is one model: a set of rows, a list of features, a label and a penalty. Folds, held-out domains,
settings of a tuning grid, bags of a resampling and dropped features are all cells. A row names the sets
it belongs to in an array and is never copied. One pass gives the moments of every cell, and one pass per
Newton step the loss, gradient and curvature of every cell that still moves: an Arrow batch multiplies its
design once with the coefficients of all cells. The number of passes doesn't depend on the number of cells.

A cell may take the curvature of another, its lead: without some of the lead's features it uses the
sub-matrix, so one matrix serves every dropped feature of a fold. Steps are then no longer quadratic, but
gradients and losses stay the cell's own, and a step that raises the loss is halved.

Each cell fills missing values with its own medians and standardises by its own moments. Both are linear
in (1, value or 0, missing), so sums are taken once in that design and turned into each cell's terms.
Every fit leaves a receipt: rows, label total, steps, loss after each accepted step, and a verdict. A fit
that did not converge has no coefficients, so nothing can be scored with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.operators.nested import nested_medians
from paneloom.operators.ranking import attach

SLICE = 4096
PASS, ONE_CLASS, NO_FEATURE, OPEN = "PASS", "TWO_CLASSES_REQUIRED", "NO_FEATURE_WITH_VALUES", "MODEL_NONCONVERGENCE"


@dataclass(frozen=True)
class Cell:
    """``rows`` is the number of the set the cell is fitted on, ``label`` the place of its target in labels.

    ``penalty`` is 1 / C against the summed loss; the intercept is free. ``lasso`` is the share of it that
    falls on absolute values instead of half squares. ``balanced`` weighs both classes alike.
    """

    name: str
    rows: int
    features: tuple[str, ...]
    label: int = 0
    penalty: float = 1.0
    balanced: bool = False
    lead: str | None = None
    lasso: float = 0.0


@dataclass
class Fit:
    """One fitted cell: coefficients of the raw design (intercept, values, missing), or none."""

    cell: Cell
    status: str
    row_count: int = 0
    label_total: float = 0.0
    steps: int = 0
    losses: list[float] = field(default_factory=list)
    raw: np.ndarray | None = None


def design(batch: pa.RecordBatch, features: Sequence[str], middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Intercept, values about the common middle (0 where missing), and marks of missing values."""
    columns = [batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]
    x = (np.stack(columns, 1) - middle) / spread if columns else np.zeros((batch.num_rows, 0))
    missing = np.isnan(x)
    return np.concatenate([np.ones((batch.num_rows, 1)), np.where(missing, 0.0, x), missing], 1)


def membership(batch: pa.RecordBatch, size: int, column: str = "sets") -> np.ndarray:
    """Rows by sets, 1 where a row belongs."""
    lists = batch.column(column)
    out = np.zeros((batch.num_rows, size))
    out[np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = 1.0
    return out


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def targets(batch: pa.RecordBatch, places: np.ndarray, count: int) -> np.ndarray:
    """Labels of the cells, not a number where unknown."""
    labels = batch.column("labels").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, count)
    return labels[:, places]


class SharedFits:
    """Fits of ``cells`` over rows with the features, weight, sets (array of set numbers) and labels
    (array, of one length, of targets in [0, 1], null where unknown). ``most`` limits the steps of the
    cells whose names begin so, up to a bar."""

    def __init__(
        self, rows: DataFrame, cells: Sequence[Cell], steps: int = 60, tolerance: float = 1e-8, most: Mapping[str, int] | None = None
    ) -> None:
        if len({c.name for c in cells}) < len(cells):
            raise ValueError("cells need distinct names")
        self.cells, self.steps, self.tolerance, self.most = list(cells), steps, tolerance, dict(most or {})
        self.features = sorted({f for c in cells for f in c.features})
        self.size = max((c.rows for c in cells), default=0) + 1
        self.rows = rows.withColumn("sets", F.filter("sets", lambda s: s < self.size))  # sets that no cell reads
        self.fits: dict[str, Fit] = {c.name: Fit(c, OPEN) for c in cells}
        self.middle, self.spread = np.zeros(len(self.features)), np.ones(len(self.features))
        self.passes = 0
        if cells:
            self.labels = rows.select(F.max(F.size("labels"))).first()[0] or 0
            if self.labels > 0:
                self._fit()
            else:
                for fit in self.fits.values():
                    fit.status = ONE_CLASS

    def _summed(self, make, schema: str, keys: Sequence[str]) -> pd.DataFrame:
        """Partial sums of the tasks added by Spark; the sums of the cells come to the driver."""
        self.passes += 1
        parts = self.rows.select(*self.features, "weight", "sets", "labels").mapInArrow(make, schema)
        return parts.groupBy(*keys).agg(F.sum("value").alias("value")).toPandas()

    def _scale(self) -> None:
        stats = self.rows.agg(*[g(F.col(f).cast("double")).alias(f"{n}_{f}") for f in self.features for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.middle = np.array([stats[f"m_{f}"] or 0.0 for f in self.features])
        spread = np.array([stats[f"s_{f}"] or 0.0 for f in self.features])
        self.spread = np.where((spread > 0) & np.isfinite(spread), spread, 1.0)

    def _moments(self) -> pd.DataFrame:
        """Per (cell, name): rows, weight, label total, extremes apart, and per feature present, sum, squares."""
        cells, features, middle, spread, size, labels = self.cells, self.features, self.middle, self.spread, self.size, self.labels
        sets, places, p = np.array([c.rows for c in cells]), np.array([c.label for c in cells]), len(self.features)

        def run(batches):
            total = np.zeros((len(cells), 5 + 3 * p))
            for batch in sliced(batches):
                u, y = design(batch, features, middle, spread), targets(batch, places, labels)
                m = membership(batch, size)[:, sets] * ~np.isnan(y)
                w = m * batch.column("weight").to_numpy()[:, None]
                y = np.nan_to_num(y)
                present, x = 1 - u[:, 1 + p :], u[:, 1 : 1 + p]
                total[:, :5] += np.stack([m.sum(0), w.sum(0), (w * y).sum(0), (m * y).sum(0), (m * y * y).sum(0)], 1)
                total[:, 5:] += np.concatenate([m.T @ present, m.T @ x, m.T @ (x * x)], 1)
            yield flat(total)

        table = self._summed(run, "cell int, place int, value double", ["cell", "place"])
        out = np.zeros((len(cells), 5 + 3 * p))
        out[table["cell"], table["place"]] = table["value"]
        return out

    def _fit(self) -> None:
        self._scale()
        moments, p = self._moments(), len(self.features)
        fills = nested_medians(self.rows, self.features, self.size) if self.features else []
        at = {f: i for i, f in enumerate(self.features)}
        turn: dict[str, np.ndarray] = {}
        state: dict[str, dict] = {}
        for k, cell in enumerate(self.cells):
            fit, (n, w, wy, y, yy) = self.fits[cell.name], moments[k, :5]
            fit.row_count, fit.label_total = int(round(n)), float(wy)
            if n < 2 or w <= 0 or wy <= 0 or wy >= w or yy / n - (y / n) ** 2 <= 1e-24:
                fit.status = ONE_CLASS
                continue
            columns = []
            for f in cell.features:
                j = at[f]
                present, total, squares = moments[k, [5 + j, 5 + p + j, 5 + 2 * p + j]]
                if present == 0 or f not in fills[cell.rows]:
                    continue
                fill = (fills[cell.rows][f] - self.middle[j]) / self.spread[j]
                mean = (total + (n - present) * fill) / n
                square = (squares + (n - present) * fill * fill) / n
                deviation = np.sqrt(max(0.0, square - mean * mean))
                column = np.zeros(1 + 2 * p)
                if deviation * deviation > 1e-12 * square:  # below that the difference is rounding: a constant
                    column[[0, 1 + j, 1 + p + j]] = -mean / deviation, 1 / deviation, fill / deviation
                columns.append(column)
            if not columns:
                fit.status = NO_FEATURE
                continue
            one = np.zeros(1 + 2 * p)
            one[0] = 1
            turn[cell.name] = np.stack([one, *columns], 1)
            share = (w / (2 * wy), w / (2 * (w - wy))) if cell.balanced else (1.0, 1.0)
            state[cell.name] = {"beta": np.zeros(1 + len(columns)), "kept": None, "loss": None, "share": share}
        curvature: dict[str, np.ndarray] = {}
        active = [c for c in self.cells if c.name in state]
        for _ in range(self.steps if active else 0):
            leads = [c for c in active if c.lead is None or c.lead not in state]
            sums = self._pass(active, leads, {c.name: turn[c.name] @ state[c.name]["beta"] for c in active}, state)
            for cell in leads:
                curvature[cell.name] = sums[cell.name][2]
            active = [c for c in active if not self._step(c, turn[c.name], state[c.name], sums[c.name], curvature)]
            active = [c for c in active if self.fits[c.name].steps < self.most.get(c.name.rsplit("|", 1)[0], self.steps)]
            if not active:
                break
        for cell in self.cells:
            fit = self.fits[cell.name]
            if cell.name in state and fit.status == PASS:
                fit.raw = turn[cell.name] @ state[cell.name]["beta"]

    def _pass(self, active: list[Cell], leads: list[Cell], raw: dict[str, np.ndarray], state: dict) -> dict[str, tuple]:
        features, middle, spread, size, labels, p = self.features, self.middle, self.spread, self.size, self.labels, len(self.features)
        sets, places = np.array([c.rows for c in active]), np.array([c.label for c in active])
        a = np.stack([raw[c.name] for c in active], 1)
        share = np.array([state[c.name]["share"] for c in active])
        lead_at = [i for i, c in enumerate(active) if c in leads]
        width = 1 + 2 * p
        upper = np.triu_indices(width)

        def run(batches):
            total = np.zeros((len(active), 1 + width))
            bend = np.zeros((len(lead_at), len(upper[0])))
            for batch in sliced(batches):
                u, y = design(batch, features, middle, spread), targets(batch, places, labels)
                w = membership(batch, size)[:, sets] * ~np.isnan(y) * batch.column("weight").to_numpy()[:, None]
                y = np.nan_to_num(y)
                eta = u @ a
                mu = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                one, zero = w * y * share[:, 0], w * (1 - y) * share[:, 1]
                total[:, 0] += (one * np.logaddexp(0, -eta) + zero * np.logaddexp(0, eta)).sum(0)
                total[:, 1:] += ((one + zero) * mu - one).T @ u
                d = (one + zero) * mu * (1 - mu)
                for k, i in enumerate(lead_at):
                    bend[k] += ((u * d[:, i : i + 1]).T @ u)[upper]
            yield flat(total)
            if len(lead_at):
                yield flat(bend, -1 - np.arange(len(lead_at)))

        table = self._summed(run, "cell int, place int, value double", ["cell", "place"])
        plain = table[table["cell"] >= 0]
        total = np.zeros((len(active), 1 + width))
        total[plain["cell"], plain["place"]] = plain["value"]
        bends = np.zeros((len(lead_at), len(upper[0])))
        rest = table[table["cell"] < 0]
        bends[-1 - rest["cell"], rest["place"]] = rest["value"]
        out = {}
        for i, cell in enumerate(active):
            square = None
            if i in lead_at:
                square = np.zeros((width, width))
                square[upper] = bends[lead_at.index(i)]
                square = square + np.triu(square, 1).T
            out[cell.name] = (total[i, 0], total[i, 1:], square)
        return out

    def _step(self, cell: Cell, turn: np.ndarray, now: dict, sums: tuple, curvature: dict[str, np.ndarray]) -> bool:
        """Move a cell; true once it is settled."""
        fit, beta = self.fits[cell.name], now["beta"]
        ridge = np.full(len(beta), cell.penalty * (1 - cell.lasso))
        flat_price = np.full(len(beta), cell.penalty * cell.lasso)
        ridge[0] = flat_price[0] = 0
        loss = sums[0] + float((ridge * beta * beta).sum()) / 2 + float((flat_price * np.abs(beta)).sum())
        fit.steps += 1
        if now["loss"] is not None and loss > now["loss"] + 1e-12 * abs(now["loss"]):
            if np.abs(beta - now["kept"]).max() < self.tolerance:
                now["beta"], fit.status = now["kept"], PASS
                return True
            now["beta"] = (beta + now["kept"]) / 2
            return False
        settled = now["loss"] is not None and now["loss"] - loss <= 1e-13 * abs(loss)
        fit.losses.append(float(loss))
        matrix = curvature[cell.lead if cell.lead in curvature else cell.name]
        bend = turn.T @ matrix @ turn + np.diag(ridge)
        slope = turn.T @ sums[1] + ridge * beta
        if cell.lasso > 0:
            change = beta - sparse_minimum(bend, bend @ beta - slope, flat_price, beta)
        else:
            size = np.sqrt(np.maximum(np.diag(bend), 1e-300))  # equal scales, so that a heavy penalty hides no other term
            change = np.linalg.lstsq(bend / np.outer(size, size), slope / size, rcond=None)[0] / size
        now["kept"], now["loss"], now["beta"] = beta, loss, beta - change
        if settled or np.abs(change).max() < self.tolerance:
            fit.status = PASS
            return True
        return False

    # ------------------------------------------------------------- results

    def receipts(self, spark: SparkSession | None = None) -> DataFrame:
        """One row per cell: what it was fitted on and how the fit ended."""
        schema = (
            "cell string, row_count long, label_total double, status string, converged boolean, steps int, loss double, losses array<double>"
        )
        rows = [
            (f.cell.name, f.row_count, f.label_total, f.status, f.status == PASS, f.steps, f.losses[-1] if f.losses else None, f.losses)
            for f in self.fits.values()
        ]
        return (spark or self.rows.sparkSession).createDataFrame(rows, schema)

    def fitted(self) -> list[str]:
        return [c.name for c in self.cells if self.fits[c.name].status == PASS]

    def score(self, rows: DataFrame, keep: Sequence[str], asked: Column, places: bool = False) -> DataFrame:
        """(keep, cell, prediction) of every row for the cells named in its array ``asked``; cells without
        a fit score nothing. Predictions have 12 digits, so that equal rows score alike in any batch.

        With ``places`` a cell goes by its place in ``cells``, in ``asked`` and in the result: a row that many
        cells score then carries numbers instead of names.
        """
        names = self.fitted()
        kind = T.StructField("cell", T.IntegerType() if places else T.StringType())
        if not names:
            kinds = T.StructType([*[rows.schema[c] for c in keep], kind, T.StructField("prediction", T.DoubleType())])
            return rows.sparkSession.createDataFrame([], kinds)
        at = {n: i for i, n in enumerate(names)}
        if places:
            number = F.array(*[F.lit(at.get(c.name)).cast("int") for c in self.cells])
            wanted = F.array_compact(F.transform(asked, lambda c: F.get(number, c)))
            called = pa.array([k for k, c in enumerate(self.cells) if c.name in at], pa.int32())
        else:
            number = F.create_map(*[x for n, i in at.items() for x in (F.lit(n), F.lit(i))])
            wanted = F.array_compact(F.transform(asked, lambda c: F.try_element_at(number, c)))
            called = pa.array(names, pa.string())
        features, middle, spread = self.features, self.middle, self.spread
        a = np.stack([self.fits[n].raw for n in names], 1)
        alias = {c: f"_k{i}" for i, c in enumerate(keep)}
        source = rows.select(*[F.col(c).alias(k) for c, k in alias.items()], *features, wanted.alias("_asked")).filter(F.size("_asked") > 0)

        def run(batches):
            for batch in sliced(batches):
                lists = batch.column("_asked")
                row, cell = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
                eta = (design(batch, features, middle, spread) @ a)[row, cell]
                value = np.round(1 / (1 + np.exp(-np.clip(eta, -500, 500))), 12)
                kept = [batch.column(k).take(pa.array(row)) for k in alias.values()]
                yield pa.RecordBatch.from_arrays([*kept, called.take(pa.array(cell)), pa.array(value)], [*keep, "cell", "prediction"])

        fields = [T.StructField(c, rows.schema[c].dataType) for c in keep]
        return source.mapInArrow(run, T.StructType([*fields, kind, T.StructField("prediction", T.DoubleType())]))

    def mean_score(self, rows: DataFrame, output: str = "prediction") -> DataFrame:
        """Rows with the mean prediction of all fitted cells; one product with all coefficients a batch."""
        names = self.fitted()
        features, middle, spread = self.features, self.middle, self.spread
        a = np.stack([self.fits[n].raw for n in names], 1)

        def run(batches):
            for batch in sliced(batches):
                eta = design(batch, features, middle, spread) @ a
                value = np.round((1 / (1 + np.exp(-np.clip(eta, -500, 500)))).mean(1), 12)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, output])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(output, T.DoubleType())]))


def sparse_minimum(bend: np.ndarray, pull: np.ndarray, price: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Minimum of b' bend b / 2 - pull b + price |b|, coordinate by coordinate; as many numbers as a cell has features."""
    b, diagonal = start.copy(), np.maximum(np.diag(bend), 1e-300)
    for _ in range(2000):
        moved = 0.0
        for j in range(len(b)):
            free = pull[j] - bend[j] @ b + diagonal[j] * b[j]
            new = np.sign(free) * max(0.0, abs(free) - price[j]) / diagonal[j]
            moved, b[j] = max(moved, abs(new - b[j])), new
        if moved < 1e-13:
            break
    return b


def flat(total: np.ndarray, names: np.ndarray | None = None) -> pa.RecordBatch:
    """(cell, place, value) of the sums that are not zero."""
    row, place = np.nonzero(total)
    cell = row if names is None else np.asarray(names)[row]
    return pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "place": pa.array(place, pa.int32()), "value": pa.array(total[row, place])})


def with_reasons(df: DataFrame, receipts: DataFrame, cell: str = "cell") -> DataFrame:
    """Rows with the status of the fit that their cell came from."""
    return attach(df, receipts.select(F.col("cell").alias(cell), "status"), [cell])
