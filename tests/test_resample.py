"""Replicate arrays, fold-wise draws, shape evidence and gates against plain versions."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom.operators import gates, metrics, nested, newton, resample


def drawn(seed, group, rep, i, n):
    parts = [seed, *([group] if group is not None else []), rep, i]
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16) % n


def times_of(entities, seed, group, rep):
    names = sorted(entities)
    count = dict.fromkeys(names, 0)
    for i in range(len(names)):
        count[names[drawn(seed, group, rep, i, len(names))]] += 1
    return count


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(150):
        entity, fold, hit = str(k % 120), 2019 + k % 3, bool(rng.random() < 0.25)
        rows += [(entity, fold, m, float(rng.integers(0, 30)) / 30 + hit * w, hit) for m, w in (("a", 0.3), ("b", 0.1))]
    table = pd.DataFrame(rows, columns=["entity_id", "period", "model_id", "prediction", "outcome"])
    return table.drop_duplicates(["entity_id", "period", "model_id"])


def plain_precision(rows, times):
    rows = rows.sort_values(["prediction", "entity_id", "period"], ascending=[False, True, True])
    hits = rank = total = positives = 0
    for r in rows.itertuples():
        for _ in range(times[r.entity_id]):
            rank += 1
            if r.outcome:
                hits += 1
                positives += 1
                total += hits / rank
    return total / positives if positives else None


def test_draws_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(resample, "CELLS", 70)  # ten units a bucket
    rows = [(g, f"e{k}") for g, n in (("a", 95), (None, 33), ("b", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "grp string, entity_id string").repartition(3)
    arrays = resample.multiplicity_arrays(df, ["grp"], 7, "s")
    assert "Generate" not in arrays._jdf.queryExecution().executedPlan().toString()  # no row per draw
    got = {(r["grp"], r["entity_id"]): r["times"] for r in arrays.collect()}
    want = {}
    for g in ("a", None, "b"):
        names = [e for x, e in rows if x == g]
        each = [times_of(names, "s", g, rep) for rep in range(7)]
        want |= {(g, e): [t[e] for t in each] for e in names if any(t[e] for t in each)}
    assert got == want


def test_replicates_match_plain_resampling(spark, scored):
    df = spark.createDataFrame(scored).repartition(5)
    for by in ([], ["period"]):
        got = {(r["period"] if by else None, r["model_id"], r["rep"]): r["average_precision"] for r in resample.replicate_precision(df, by, 12, "s").collect()}
        groups = sorted(scored.period.unique()) if by else [None]
        assert len(got) == len(groups) * 2 * 12
        for g in groups:
            part = scored if g is None else scored[scored.period == g]
            for rep in range(12):
                times = times_of(part.entity_id.unique(), "s", g, rep)
                for m in "ab":
                    want = plain_precision(part[part.model_id == m], times)
                    assert got[g, m, rep] == (want if want is None else pytest.approx(want)), (g, m, rep)


def test_rows_are_not_copied_per_replicate(spark, scored):
    df = spark.createDataFrame(scored)
    seen = []

    def visit(rows, times, before, hits, n):
        return {"rows": np.full(times.shape[1], float(rows.num_rows)), "copies": times.sum(0)}

    for replications in (5, 60):
        found = resample.replicate_sums(df, [], replications, "s", visit, ("rows", "copies")).collect()
        seen.append({(r["model_id"], r["name"]): (r["sums"][0], len(r["sums"])) for r in found})
    assert seen[1]["a", "rows"][0] <= (scored.model_id == "a").sum() and seen[1]["a", "rows"][1] == 60
    arrays = resample.multiplicity_arrays(df, [], 60, "s").toPandas()
    assert np.stack(arrays.times).sum(0).tolist() == [scored.entity_id.nunique()] * 60


def test_no_rows_and_no_positives(spark, scored):
    df = spark.createDataFrame(scored)
    assert resample.replicate_precision(df.limit(0), [], 4, "s").count() == 0
    none = resample.replicate_precision(df.withColumn("outcome", F.lit(False)), [], 4, "s").collect()
    assert len(none) == 8 and all(r["average_precision"] is None for r in none)
    some = resample.paired_samples(resample.replicate_precision(df.filter("model_id = 'a'"), [], 4, "s"), {"a": "b"})
    assert some.count() == 0
    assert metrics.bootstrap_delta(df, "a", "b", 7, 0.95, "s").filter("delta IS NOT NULL").count() == 7


@pytest.fixture(scope="module")
def shape():
    rng = np.random.default_rng(9)
    n = 160
    z, m = np.round(rng.normal(size=n), 2), rng.integers(0, 3, n).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(z * (m - 1) + np.maximum(z - 0.3, 0))))).astype(float)
    return pd.DataFrame({"entity_id": [str(i) for i in range(n)], "period": 2000, "grp": np.where(np.arange(n) % 2, "c|x", "c|y"), "z": z, "monitor": m, "label": y, "weight": 1.0})


def best_point(rows, weight, points):
    found = []
    for p in sorted(set(points)):
        x = newton.hinge_design(rows, p)
        b = fitted(x, rows.label.to_numpy(), weight)
        eta = x @ b
        found.append((((weight * (np.logaddexp(0, eta) - rows.label * eta)).sum() / weight.sum()), p))
    return min(found)


def fitted(x, y, w, penalty=1.0):
    b = np.zeros(x.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (w * mu * (1 - mu))[:, None]).T @ x + penalty * np.eye(len(b)), x.T @ (w * (mu - y)) + penalty * b)
    return b


def test_breakpoints_and_their_intervals_match_direct_fits(spark, shape):
    df = spark.createDataFrame(shape).repartition(4)
    scan = {r["grp"]: r for r in gates.breakpoint_scan(df, (0.2, 0.8), 4, 1.0).collect()}
    boot = {r["grp"]: r for r in gates.shape_bootstrap(df, (0.2, 0.8), 4, 1.0, 6, 0.1, "s").collect()}
    for g, rows in shape.groupby("grp"):
        ones = np.ones(len(rows))
        loss, point = best_point(rows, ones, np.quantile(rows.z, np.linspace(0.2, 0.8, 4)))
        assert (scan[g]["breakpoint"], scan[g]["loss"]) == (pytest.approx(point), pytest.approx(loss, abs=1e-7))
        assert scan[g]["interaction"] == pytest.approx(fitted(newton.interaction_design(rows, 0), rows.label.to_numpy(), ones)[3], abs=1e-6)
        points, turns = [], []
        for rep in range(6):
            times = times_of(rows.entity_id, "s", g, rep)
            w = np.array([times[e] for e in rows.entity_id], float)
            points.append(best_point(rows, w, np.quantile(np.repeat(rows.z, w.astype(int)), np.linspace(0.2, 0.8, 4)))[1])
            turns.append(fitted(newton.interaction_design(rows, 0), rows.label.to_numpy(), w)[3])
        ends = [boot[g][c] for c in ("breakpoint_lower", "breakpoint_upper", "interaction_lower", "interaction_upper")]
        assert ends == pytest.approx([*np.quantile(points, [0.05, 0.95]), *np.quantile(turns, [0.05, 0.95])], abs=1e-5)
        assert boot[g]["valid_replications"] == 6
    open_ = gates.shape_bootstrap(df.withColumn("label", F.lit(1.0)), (0.2, 0.8), 4, 1.0, 3, 0.1, "s").collect()
    assert len(open_) == 2 and all(r["valid_replications"] == 0 and r["interaction_lower"] == float("-inf") for r in open_)


def test_replicate_quantiles(spark, shape):
    times = np.random.default_rng(1).integers(0, 4, (len(shape), 5))
    df = spark.createDataFrame(pd.DataFrame({"feature": shape.grp, "value": shape.z, "times": times.tolist()}), "feature string, value double, times array<int>")
    got = {(r["feature"], r["set"], r["p"]): r["quantile"] for r in nested.replicate_quantiles(df, 5, [0.0, 0.3, 1.0]).collect()}
    for g in ("c|x", "c|y"):
        at = (shape.grp == g).to_numpy()
        for rep in range(5):
            sample = np.repeat(shape.z[at], times[at, rep])
            assert [got[g, rep, p] for p in (0.0, 0.3, 1.0)] == pytest.approx(np.quantile(sample, [0.0, 0.3, 1.0]))


CFG = {"breakpoint_tolerance": 0.5, "domain_difference_max": 1.0, "common_support_min": 0.2, "min_side_fraction": 0.1, "min_domains": 2, "claims": 2, "same_direction_min": 2}


def verdict(spark, intervals, claims=(True, True), parent="PASS", stable=True, **cfg):
    directions = spark.createDataFrame([(str(i), x, lo, hi) for i, (x, lo, hi) in enumerate(intervals)], "grp string, interaction double, interaction_lower double, interaction_upper double")
    held = spark.createDataFrame([(str(i), c) for i, c in enumerate(claims)], "claim string, method_pass boolean")
    row = gates.gate3(directions, held, spark.createDataFrame([(stable,)], "passed boolean"), spark.createDataFrame([(parent,)], "verdict string"), CFG | cfg).first()
    return row["shape_verdict"], row["reason"]


def test_gate3_needs_direction_and_intervals(spark):
    up = [(1.0, 0.2, 2.0), (2.0, 0.1, 3.0), (0.5, 0.1, 1.0)]
    assert verdict(spark, up) == ("PASS", None)
    assert verdict(spark, [(-a, -c, -b) for a, b, c in up]) == ("PASS", None)
    assert verdict(spark, [*up[:2], (0.5, -0.1, 1.0)]) == ("FAIL", None)  # one interval holds zero
    assert verdict(spark, [(1.0, 0.2, 2.0), (-1.0, -2.0, -0.2)]) == ("FAIL", None)  # directions differ
    assert verdict(spark, [*up[:2], (0.5, None, None)]) == ("FAIL", None)  # an interval is missing
    assert verdict(spark, up, claims=(True, False)) == ("FAIL", None)
    assert verdict(spark, up, claims=(True,)) == ("SKIPPED", "THRESHOLD_CLAIMS_MISSING")
    assert verdict(spark, [], ()) == ("SKIPPED", "NO_FOLD_DIRECTIONS")
    assert verdict(spark, up, parent="FAIL") == ("SKIPPED", "PARENT_GATE_NOT_PASS")
    assert verdict(spark, up, stable=False) == ("SKIPPED", "MEASUREMENT_NOT_STABLE")


def test_threshold_claims(spark):
    scan = "grp string, breakpoint double, side_fraction double, z_low double, z_high double"
    folds = spark.createDataFrame([(f"{c}|{y}", b, s, -2.0, 2.0) for c, y, b, s in (("p", 1, 0.1, 0.4), ("p", 2, 0.3, 0.3), ("q", 1, 0.1, 0.4), ("q", 2, 1.9, 0.4), ("r", 1, 0.1, 0.4))], scan)
    domains = spark.createDataFrame([(f"{c}|{d}", b, 0.4, lo, hi) for c in "pqr" for d, b, lo, hi in (("u", 0.0, -2.0, 2.0), ("v", 0.5, -1.0, 3.0))], scan)
    known = spark.createDataFrame([(g, float("-inf") if g == "r|1" else 0.0, 1.0) for g in ("p|1", "p|2", "q|1", "q|2", "r|1")], "grp string, breakpoint_lower double, breakpoint_upper double")
    got = {r["claim"]: r for r in gates.threshold_claims(folds, domains, known, CFG).collect()}
    assert {c: r["method_pass"] for c, r in got.items()} == {"p": True, "q": False, "r": False}
    assert got["p"]["common_support"] == pytest.approx(0.75) and got["q"]["breakpoint_sd"] == pytest.approx(0.9) and got["r"]["interval_count"] == 0
    one = gates.threshold_claims(folds, domains.filter("grp LIKE '%u'"), known, CFG).collect()
    assert not any(r["method_pass"] for r in one) and {r["domain_count"] for r in one} == {1}
