"""Queries that once left a part of their job undone."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom.functions.draws import hash_number, hash_numbers
from paneloom.operators import gates, nested, newton
from paneloom.plans import catalogue, robustness_queries
from paneloom.plans.bindings import TABLES, Inputs

FOLDER = "/root/testdata/sf0.001"


def test_full_transfer_scores_every_period_with_an_earlier_one(spark):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    columns = ["level", "fold", "train_rows", "held_rows", "observed_rows", "held_positives"]
    theirs = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.SQL['domain_transfer']}) t").fetchall())
    rows = catalogue.QUERIES["domain_transfer_full"](spark, FOLDER).collect()
    assert sorted(tuple(r[c] for c in columns) for r in rows) == theirs
    assert all(r["support_fraction"] is not None for r in rows)


def test_claims_draw_every_replicate_of_every_row_over_the_scan_of_their_folds(spark, monkeypatch):
    seen = {}

    def scan(rows, *asked):
        seen.setdefault("scan", asked)
        grp = rows.select("grp").distinct()
        return grp.selectExpr("grp", "0D AS breakpoint", "0D AS loss", "0D AS interaction", "0D AS side_fraction", "0D AS z_low", "0D AS z_high")

    def bootstrap(rows, *asked):
        seen["bootstrap"], seen["rows"] = asked, rows.count()
        return rows.select("grp").distinct().selectExpr("grp", "0D AS interaction_lower", "0D AS interaction_upper", "0D AS breakpoint_lower", "0D AS breakpoint_upper")

    monkeypatch.setattr(gates, "breakpoint_scan", scan)
    monkeypatch.setattr(gates, "shape_bootstrap", bootstrap)
    fx = Inputs(spark, FOLDER)
    robustness_queries._claims(fx)
    *positions, replications, alpha, _ = seen["bootstrap"]
    assert (replications, alpha) == (2000, 0.05 / 3)
    assert tuple(positions) == seen["scan"]  # a replicate chooses from as many positions as its fold
    assert seen["rows"] == 2 * fx("fx_domain").count()  # both claims, also entities without a balance


def test_hashes_of_whole_arrays_are_those_of_the_expression(spark):
    first, second = np.array([0, 9, 10, 1999]), np.array([0, 7, 99, 100, 123_456_789, 10**12])
    for head in ("s", "shape:spend|1999", "ß" * 30):  # the last one leaves no room in a block
        rows = spark.createDataFrame([(a, b) for a in first.tolist() for b in second.tolist()], "a long, b long")
        want = [r["h"] for r in rows.coalesce(1).select(hash_number(head, F.col("a"), F.col("b")).alias("h")).collect()]
        assert hash_numbers(head, first, second).ravel().tolist() == want


def test_thousands_of_replicates_match_direct_fits(spark):
    rng = np.random.default_rng(4)
    n, reps = 60, 2000
    z, m = rng.normal(size=n).round(2), rng.integers(1, 4, n).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(float)
    times = rng.multinomial(n, np.ones(n) / n, reps).T
    rows = pd.DataFrame({"grp": "a", "z": z, "monitor": m, "label": y, "weight": 1.0, "times": times.tolist()}).sort_values("z")
    df = spark.createDataFrame(rows, "grp string, z double, monitor double, label double, weight double, times array<int>").coalesce(1)
    blocks = newton.packed(df, "grp", "times")
    found = nested.block_quantiles(blocks, reps, [0.2, 0.5]).collect()
    assert len(found) == 2 * reps
    for r in found[::97]:
        assert r["quantile"] == pytest.approx(np.quantile(np.repeat(z, times[:, r["set"]]), r["p"]))
    cells = [(rep, p) for rep in range(reps) for p in (0.1, newton.NOWHERE)]
    fits = newton.fit_many(df, "grp", {"a": cells}, newton.hinge_design, 6, 1.0, times="times", blocks=blocks)
    assert list(zip(fits["rep"], fits["point"], strict=True)) == cells
    for r in fits.iloc[::123].itertuples():
        x = np.column_stack([np.ones(n), z, m, z * m, *([] if r.point == newton.NOWHERE else [np.maximum(z - r.point, 0), np.maximum(z - r.point, 0) * m])])
        w, b = times[:, r.rep], np.zeros(x.shape[1])
        for _ in range(60):
            mu = 1 / (1 + np.exp(-x @ b))
            b -= np.linalg.solve((x * (w * mu * (1 - mu))[:, None]).T @ x + np.eye(len(b)), x.T @ (w * (mu - y)) + b)
        assert [r.b0, r.b1, r.b2, r.b3, r.b4, r.b5][: len(b)] == pytest.approx(list(b), abs=1e-8)
