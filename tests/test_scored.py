"""Scores that carry numbers of cells, and support from counted scores."""

import numpy as np
from pyspark.sql import functions as F

from paneloom.operators import metrics, transport
from paneloom.operators.fits import Cell, SharedFits


def test_cells_go_by_place_as_by_name(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=200)
    data = [(i, float(v), 1.0, [0], [float(v + e > 0), None]) for i, (v, e) in enumerate(zip(x, draw.normal(size=200), strict=True))]
    rows = spark.createDataFrame(data, "k int, x double, weight double, sets array<int>, labels array<double>")
    cells = [Cell("no label", 0, ("x",), 1), Cell("a", 0, ("x",)), Cell("b", 0, ("x",), penalty=50.0)]
    fits = SharedFits(rows, cells)
    named = fits.score(rows, ["k"], F.array(*[F.lit(c.name) for c in cells])).collect()
    placed = fits.score(rows, ["k"], F.array(F.lit(0), F.lit(1), F.lit(2)), places=True)
    assert dict(placed.dtypes)["cell"] == "int"
    assert sorted((r["k"], cells[r["cell"]].name, r["prediction"]) for r in placed.collect()) == sorted(map(tuple, named))
    assert len(named) == 400  # the cell without a fit scores nothing
    empty = SharedFits(rows, cells[:1]).score(rows, ["k"], F.array(F.lit(0)), places=True)
    assert empty.count() == 0 and empty.columns == placed.columns


def test_support_reads_scores_once_and_counts_them(spark):
    draw = np.random.default_rng(8)
    data = [(f"g{i % 3}", bool(draw.random() < 0.4), round(float(draw.random()), 2)) for i in range(3000)] + [("none", False, 0.5)]
    calls = spark.sparkContext.accumulator(0)

    def scored(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    scores = spark.createDataFrame(data, "level string, is_held boolean, prediction double")
    got = {r["level"]: r for r in transport.domain_support(scores.mapInArrow(scored, scores.schema), (0.2, 0.7), ["level"]).collect()}
    assert calls.value == len(data)
    aucs = {r["level"]: r["roc_auc"] for r in metrics.roc_auc(scores.withColumn("outcome", F.col("is_held")), ["level"]).collect()}
    for g in ("g0", "g1", "g2"):
        held = [p for level, h, p in data if level == g and h]
        assert got[g]["held_rows"] == len(held) and abs(got[g]["roc_auc"] - aucs[g]) < 1e-12
        assert abs(got[g]["support_fraction"] - np.mean([0.2 <= p <= 0.7 for p in held])) < 1e-12
    assert got["none"]["held_rows"] == 0 and got["none"]["support_fraction"] is None and got["none"]["roc_auc"] is None


def test_values_that_differ_by_rounding_choose_the_first_setting(spark):
    rows = [("a", 0, 0.3), ("a", 1, 0.1 + 0.2), ("a", 2, 0.2), ("b", 0, 0.3), ("b", 1, 0.31)]
    values = spark.createDataFrame(rows, "fold string, setting int, inner_ap double")
    assert sorted(map(tuple, transport.first_of_best(values, ["fold"]).collect())) == [("a", 0), ("b", 1)]
