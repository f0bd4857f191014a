"""Fits against closed computations, and rules that no outer row may break."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom.operators import features, models, newton, selection, weights
from paneloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def newton_numpy(x, y, w, penalty, steps=60):
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (w * mu * (1 - mu))[:, None]).T @ x + penalty * np.eye(len(b)), x.T @ (w * (mu - y)) + penalty * b)
    return b


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    z, m = rng.normal(size=400), rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + z - 0.5 * m)))).astype(float)
    return pd.DataFrame({"grp": np.where(np.arange(400) % 3 == 0, "a", "b"), "z": z, "monitor": m, "label": y, "weight": 1.0 + np.arange(400) % 2})


def test_shared_newton_matches_direct_fits(spark, frame):
    df = spark.createDataFrame(frame).repartition(5)
    got = newton.fit_many(df, "grp", {"a": [0.0, 0.4], "b": [0.1]}, newton.hinge_design, 6, 0.5)
    for row in got.itertuples():
        part = frame[frame.grp == row.grp]
        want = newton_numpy(newton.hinge_design(part, row.point), part.label.to_numpy(), part.weight.to_numpy(), 0.5)
        assert np.allclose([row.b0, row.b1, row.b2, row.b3, row.b4, row.b5], want, atol=1e-6)


def test_soft_platt_matches_newton(spark):
    rng = np.random.default_rng(4)
    s = rng.uniform(0.05, 0.95, 300)
    t = np.clip(s + rng.normal(scale=0.2, size=300), 0, 1)
    df = spark.createDataFrame(pd.DataFrame({"prediction": s, "target_value": t}))
    got = selection.soft_platt(df).first()
    want = newton_numpy(np.column_stack([np.ones(300), np.log(s / (1 - s))]), t, np.ones(300), 1e-8)
    assert np.allclose([got.intercept, got.slope], want, atol=1e-4)
    flat = df.withColumn("target_value", F.lit(0.5))
    assert selection.soft_platt(flat).first().status.startswith("IDENTITY")


def test_fits_reach_all_models_and_rows(spark):
    run = catalogue.QUERIES
    assert {r["model_id"] for r in run["soft_platt"](spark, FOLDER).collect()} == {"full", "observability_only"}
    periods = {r["period"] for r in run["stabilized_weights"](spark, FOLDER).collect()}
    assert min(periods) < 1999 <= max(periods)
    rows = panel(spark).withColumn("verified", F.col("outcome"))
    early = rows.filter("period < 2018")
    got = weights.stabilized_ipw(early, ["x"], rows=rows)
    assert got.count() == rows.count()
    both = got.select("entity_id", "period", F.col("weight").alias("w")).join(weights.stabilized_ipw(early, ["x"]), ["entity_id", "period"])
    assert both.count() == early.count() and both.filter("abs(w - weight) > 1e-9").count() == 0


def panel(spark):
    rng = np.random.default_rng(8)
    rows = [(str(i), 2015 + i % 5, float(rng.normal()), bool(rng.random() < 0.5)) for i in range(300)]
    return spark.createDataFrame(rows, "entity_id string, period int, x double, outcome boolean").withColumn("y", F.col("outcome").cast("double"))


def test_temporal_oof_uses_earlier_periods_only(spark):
    rows = panel(spark).cache()
    before = {r.entity_id: r.prediction for r in models.temporal_oof(rows.filter("period <= 2018"), ["x"], "y", "logistic").collect()}
    flipped = rows.withColumn("y", F.when(F.col("period") == 2019, 1 - F.col("y")).otherwise(F.col("y")))
    after = models.temporal_oof(flipped, ["x"], "y", "logistic").filter("period <= 2018").collect()
    assert {r.entity_id for r in after} == set(before)
    assert all(abs(before[r.entity_id] - r.prediction) < 1e-9 and 0 <= r.prediction <= 1 for r in after)


def test_stabilised_weights_are_positive_and_skip_without_classes(spark):
    rows = panel(spark).withColumn("verified", F.col("x") > 0.2)
    got = weights.stabilized_ipw(rows, ["x"]).agg(F.min("weight").alias("w"), F.max("reason").alias("r")).first()
    assert got.w > 0 and got.r is None
    none = weights.stabilized_ipw(rows.withColumn("verified", F.lit(False)), ["x"]).first()
    assert none.weight == 1.0 and none.reason == "NO_OBSERVED_VERIFICATION"


def test_pu_bags(spark):
    members = models.pu_bags(panel(spark), F.col("x") > 1.2, 3, 2.0, "s").cache()
    counts = {r.bag: (r.p, r.u) for r in members.groupBy("bag").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("u")).collect()}
    assert len(counts) == 3 and all(u == 2 * p for p, u in counts.values())
    tiny = panel(spark).withColumn("first", F.col("entity_id") == "1")
    assert models.pu_bags(tiny, F.col("first"), 2, 1.0, "s").isEmpty()


def test_holdout_split_bounds(spark):
    small = spark.createDataFrame([(str(i), 1) for i in range(19)], "entity_id string, period int")
    assert {r.side for r in weights.holdout_split(small, 0.2, "s").collect()} == {"both"}
    more = spark.createDataFrame([(str(i), 1) for i in range(25)], "entity_id string, period int")
    assert weights.holdout_split(more, 0.1, "s").filter("side = 'validation'").count() == 10


def test_formulas(spark):
    df = spark.createDataFrame([("e", 2019, 10.0, 4.0), ("e", 2020, 20.0, 0.0), ("e", 2022, 5.0, 2.0)], "entity_id string, period int, fs_aud_a double, fs_aud_b double")
    got = {r.period: r for r in features.feat_ratio(df, {"g": "(a_t - a_t_minus_1) / abs(a_t_minus_1)", "r": "a_t / b_t", "m": "a_t / average(b_t,b_t_minus_1)"}).collect()}
    assert got[2019].g is None and got[2020].g == 1.0 and got[2022].g is None
    assert got[2019].r == 2.5 and got[2020].r is None and got[2020].m == 10.0


def test_grid_budget():
    assert len(models.grid({"a": 1}, {"b": [1, 2], "c": [3, 4, 5]}, 6)) == 6
    with pytest.raises(ValueError):
        models.grid({}, {"b": [1, 2, 3]}, 2)


def test_medians(spark):
    rows = panel(spark).withColumn("z", F.when(F.col("x") > 0, F.col("x") * 3)).withColumn("empty", F.lit(None).cast("double"))
    got = models.medians(rows, ["x", "z", "empty"])
    want = rows.agg(F.percentile("x", F.lit(0.5)).alias("x"), F.percentile("z", F.lit(0.5)).alias("z")).first()
    assert set(got) == {"x", "z"} and all(got[k] == pytest.approx(want[k]) for k in got)
    before = models.medians_before(rows, ["x", "z"], [2017, 2019])
    early = rows.filter("period < 2017").agg(F.percentile("x", F.lit(0.5)).alias("x")).first()
    assert before[2017]["x"] == pytest.approx(early["x"]) and set(before) == {2017, 2019}


def direct_fit(x, y, w, c):
    """Weighted logistic fit on a standardised column: summed loss plus slope² / 2c."""
    z = (x - x.mean()) / x.std(ddof=1)
    beta = np.zeros(2)
    design = np.stack([np.ones(len(z)), z], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (w * (p - y)) + np.array([0, beta[1] / c])
        beta -= np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + np.diag([0, 1 / c]), gradient)
    return 1 / (1 + np.exp(-design @ beta))


@pytest.mark.parametrize("soft", [False, True])
def test_weighted_fits_equal_a_direct_solution(spark, soft):
    draw = np.random.default_rng(1)
    x, w = draw.normal(size=80), draw.uniform(0.2, 5, 80)
    y = draw.uniform(size=80) if soft else (draw.uniform(size=80) < 1 / (1 + np.exp(-x))).astype(float)
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(x, y, w, strict=True))], "i int, x double, y double, w double")
    for c in (0.05, 1.0):
        fitted = models.fit(frame, ["x"], "y", "logistic", {"C": c, "standardization": False}, "w", soft=soft)
        got = [r.prediction for r in fitted.score(frame).orderBy("i").collect()]
        assert got == pytest.approx(direct_fit(x, y, w, c).tolist(), abs=1e-4)


def test_weights_of_learners_without_weights_become_copies(spark):
    rows = spark.createDataFrame([(float(i), 1.0, 3.0 if i % 2 else 1.0) for i in range(2000)], "_features double, _label double, _weight double")
    counts = {r.odd: r.n for r in models.resampled(rows).groupBy((F.col("_features") % 2).alias("odd")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts[1.0] / counts[0.0] == pytest.approx(3, rel=0.1)
    assert models.resampled(rows.withColumn("_weight", F.lit(2.0))).count() == 2000


def test_soft_fold_with_ranked_target(spark):
    rows = panel(spark)
    labels = rows.select("entity_id", "period", (1 / (1 + F.exp(-F.col("x")))).alias("p"))
    weights_ = rows.select("entity_id", "period", F.lit(2.0).alias("weight")).filter("period > 2016")
    got = models.fit_fold(rows.drop("y"), labels, weights_, 2019, {"g": ["x"]}, {"logistic": [{"C": 1.0}]}, "p", soft=True, ecdf=True)
    parts = {r.split: r for r in got.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.corr("target", "prediction").alias("c"), F.max("outcome").alias("o")).collect()}
    assert set(parts) == {"oof", "outer"} and parts["oof"].c > 0.8 and parts["oof"].o is None
