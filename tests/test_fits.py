"""Shared fits against direct solutions, and what follows from their receipts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom.operators import fits, models, selection, transport
from paneloom.operators.fits import Cell, SharedFits


def direct(x, y, w, penalty, steps=200):
    """Newton's method on standardised columns with a free intercept; predictions of the same rows."""
    x = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    ridge, b = np.r_[0, np.full(x.shape[1], penalty)], np.zeros(1 + x.shape[1])
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * mu * (1 - mu))[:, None]).T @ z + np.diag(ridge), z.T @ (w * (mu - y)) + ridge * b)
    return 1 / (1 + np.exp(-z @ b))


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    n = 700
    x = rng.normal(size=(n, 3)) * [1, 50, 1e4] + [0, 500, -3e5]
    p = 1 / (1 + np.exp(-(0.4 + x[:, 0] - (x[:, 1] - 500) / 60)))
    x[rng.random((n, 3)) < 0.15] = np.nan
    return pd.DataFrame({"entity_id": [str(i) for i in range(n)], "period": 2010 + np.arange(n) % 5, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2],
                         "y": (rng.random(n) < p).astype(float), "soft": p, "w": 1.0 + np.arange(n) % 3})


FRAMES = {}


def frame(spark, table):
    if "df" not in FRAMES:  # placed once for all tests
        FRAMES["df"] = placed(spark, table).cache()
    return FRAMES["df"]


def placed(spark, table):
    df = spark.createDataFrame(table.astype({"period": "int32"}))
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in ("a", "b", "c") else F.col(c) for c in df.columns]).repartition(3)


def prepared(df):
    return df.withColumns(
        {"weight": F.col("w"), "sets": F.array_compact(F.array(F.lit(0), F.when(F.col("period") < 2013, F.lit(1)))), "labels": F.array("y", "soft")}
    )


CELLS = [
    Cell("all", 0, ("a", "b", "c"), 0, 0.5), Cell("early", 1, ("a", "b", "c"), 0, 0.5), Cell("soft", 0, ("a", "b"), 1, 2.0),
    Cell("without c", 0, ("a", "b"), 0, 0.5, lead="all"), Cell("balanced", 1, ("b",), 0, 1.0, True), Cell("without a", 1, ("b", "c"), 0, 0.5, lead="early"),
]


def test_cells_match_direct_fits(spark, table):
    df = prepared(frame(spark, table)).cache()
    shared = SharedFits(df, CELLS)
    got = {(r["cell"], r["entity_id"]): r["prediction"] for r in shared.score(df, ["entity_id"], F.array(*[F.lit(c.name) for c in CELLS])).collect()}
    for c in CELLS:
        rows = table if c.rows == 0 else table[table.period < 2013]
        y, w = rows[("y", "soft")[c.label]].to_numpy(), rows.w.to_numpy()
        if c.balanced:
            one = (w * y).sum()
            w = np.where(y > 0.5, w * w.sum() / (2 * one), w * w.sum() / (2 * (w.sum() - one)))
        want = direct(rows[list(c.features)].to_numpy(), y, w, c.penalty)
        assert np.allclose([got[c.name, e] for e in rows.entity_id], want, atol=2e-6), c.name
    receipts = {r["cell"]: r for r in shared.receipts().collect()}
    assert all(r["status"] == "PASS" and r["converged"] and r["steps"] >= len(r["losses"]) > 1 for r in receipts.values())
    assert all(sorted(r["losses"], reverse=True) == r["losses"] for r in receipts.values())
    mean = shared.mean_score(df).toPandas()
    assert np.allclose(mean.prediction, [np.mean([got[c.name, e] for c in CELLS]) for e in mean.entity_id])


def test_sparse_fits_meet_the_conditions_of_a_minimum(spark, table):
    df = prepared(frame(spark, table))
    x = table[["a", "b", "c"]].to_numpy()
    x = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    z, w, y = (x - x.mean(0)) / x.std(0), table.w.to_numpy(), table.y.to_numpy()
    cells = [Cell(f"l{p}", 0, ("a", "b", "c"), 0, p, lasso=0.5) for p in (0.5, 60.0, 1e5)]
    shared = SharedFits(df, cells)
    got = {(r["cell"], r["entity_id"]): r["prediction"] for r in shared.score(df, ["entity_id"], F.array(*[F.lit(c.name) for c in cells])).collect()}
    for c in cells:
        mu = np.array([got[c.name, e] for e in table.entity_id])
        eta = np.log(mu / (1 - mu))
        b = np.linalg.lstsq(np.column_stack([np.ones(len(z)), z]), eta, rcond=None)[0][1:]
        slope = z.T @ (w * (mu - y)) + c.penalty * 0.5 * b
        for j in range(3):  # a coefficient is zero only where the slope is within the price
            if abs(b[j]) > 1e-7:
                assert slope[j] == pytest.approx(-np.sign(b[j]) * c.penalty * 0.5, abs=1e-3)
            else:
                assert abs(slope[j]) <= c.penalty * 0.5 + 1e-3
        assert abs((w * (mu - y)).sum()) < 1e-3
    assert all(f.status == "PASS" for f in shared.fits.values())
    assert np.ptp([got["l100000.0", e] for e in table.entity_id]) < 1e-9


def test_passes_do_not_grow_with_cells(spark, table):
    df = prepared(frame(spark, table)).cache()
    one = SharedFits(df, CELLS[:1]).passes
    many = [Cell(f"c{i}", i % 2, ("a", "b", "c"), 0, 0.5 + i / 100) for i in range(60)]
    assert SharedFits(df, many).passes <= one + 2


def test_cells_that_cannot_be_fitted(spark, table):
    df = prepared(frame(spark, table)).withColumns({"none": F.lit(None).cast("double"), "flat": F.lit(3.0), "labels": F.array(F.lit(1.0), F.lit(None).cast("double"), F.col("y"))})
    cells = [Cell("one class", 0, ("a",), 0), Cell("no label", 0, ("a",), 1), Cell("no values", 0, ("none",), 2), Cell("flat", 0, ("flat",), 2), Cell("no rows", 7, ("a",), 2)]
    shared = SharedFits(df, cells)
    assert {n: f.status for n, f in shared.fits.items()} == {
        "one class": "TWO_CLASSES_REQUIRED", "no label": "TWO_CLASSES_REQUIRED", "no values": "NO_FEATURE_WITH_VALUES", "flat": "PASS", "no rows": "TWO_CLASSES_REQUIRED"
    }
    scores = shared.score(df, ["entity_id"], F.array(*[F.lit(c.name) for c in cells])).toPandas()
    assert set(scores.cell) == {"flat"} and np.allclose(scores.prediction, (table.w * table.y).sum() / table.w.sum(), atol=1e-6)
    empty = SharedFits(df.limit(0), cells)
    assert empty.fitted() == [] and empty.score(df, ["entity_id"], F.array(F.lit("flat"))).count() == 0
    assert empty.receipts().count() == 5
    assert SharedFits(df, []).receipts(spark).count() == 0
    with pytest.raises(ValueError):
        SharedFits(df, cells + cells[:1])


def test_a_capped_fit_has_no_scores(spark, table):
    df = prepared(frame(spark, table))
    shared = SharedFits(df, [Cell("x|1", 0, ("a", "b"), 0, 1e-6), Cell("y|1", 0, ("a", "b"), 0, 1e-6)], most={"x": 2})
    assert [f.status for f in shared.fits.values()] == [fits.OPEN, fits.PASS] and shared.fits["x|1"].raw is None
    assert shared.score(df, ["entity_id"], F.array(F.lit("x|1"), F.lit("y|1"))).count() == len(table)


def test_a_candidate_with_an_open_fit_is_void(spark, table):
    df = frame(spark, table)
    labels, none = df.select("entity_id", "period", (F.col("y") > 0).alias("outcome")), df.limit(0).select("entity_id", "period", F.col("w").alias("weight"))
    for settings in ([{"C": 1.0, "maxIter": 1}, {"C": 1.0}], [{"C": 1.0, "elasticNetParam": 0.0, "maxIter": 1}, {"C": 1.0, "elasticNetParam": 0.0}]):
        scores, found, receipts = models.tune_fold(df.drop("y"), labels, none, 2014, {"g": ["a", "b"]}, {"logistic": settings})
        row = found.first()
        assert (row["status"], row["evaluated_settings"], row["valid_settings"], row["setting"]) == ("PASS", 2, 1, 1)
        kinds = receipts.groupBy("setting").agg(F.bool_and("converged").alias("ok"), F.max("period").alias("last")).collect()
        assert {r["setting"]: r["ok"] for r in kinds} == {0: False, 1: True} and {r["last"] for r in kinds if r["setting"] == 1} == {2014}
        assert scores.groupBy("split").count().count() == 2
    scores, found, _ = models.tune_fold(df.drop("y"), labels, none, 2014, {"g": ["a", "b"]}, {"logistic": settings[:1]})
    assert scores is None and found.first()["reason"] == "INSUFFICIENT_POSITIVES"
    with pytest.raises(ValueError):
        models.fit_fold(df.drop("y"), labels, none, 2014, {"g": ["a", "b"]}, {"logistic": settings[:1]})


def test_ranked_targets_ignore_later_periods(spark, table):
    df = frame(spark, table)
    none = df.limit(0).select("entity_id", "period", F.col("w").alias("weight"))

    def run(rows):
        scores = models.fit_fold(
            df.drop("y"), rows.select("entity_id", "period", "soft"), none, 2014, {"g": ["a", "b"]}, {"logistic": [{"C": 1.0}]}, "soft", soft=True, ecdf=True
        )
        return {(r["entity_id"], r["split"]): (r["prediction"], r["target"]) for r in scores.filter("split = 'oof' AND period <= 2012").collect()}

    before = run(df)
    after = run(df.withColumn("soft", F.when(F.col("period") >= 2013, 1 - F.col("soft")).otherwise(F.col("soft"))))
    assert before == after and len(before) == int((table.period.between(2011, 2012)).sum())
    early = np.sort(table[table.period < 2011].soft)
    for r in table[table.period == 2011].itertuples():
        want = min(1 - 1e-6, max(1e-6, ((early <= r.soft).sum() - 0.5) / len(early)))
        assert before[r.entity_id, "oof"][1] == pytest.approx(want)


def test_bags_match_one_fit_at_a_time(spark, table):
    df = frame(spark, table).withColumn("hit", F.when(F.col("period") != 2011, F.col("y") > 0))
    members = models.pu_bags(df, F.col("hit"), 4, 1.5, "s").toPandas()
    draws = df.select("entity_id", "hit", *[models.bag_hash("s", b).alias(f"h{b}") for b in range(4)]).toPandas()
    size = int(np.ceil((draws.hit == True).sum() * 1.5))  # noqa: E712
    for b in range(4):
        free = draws[draws.hit == False].sort_values([f"h{b}", "entity_id"])  # noqa: E712
        assert set(members[(members.bag == b) & (members.label == 0)].entity_id) == set(free.entity_id[:size])
        assert set(members[(members.bag == b) & (members.label == 1)].entity_id) == set(draws[draws.hit == True].entity_id)  # noqa: E712
    got = models.pu_bagging(df, df, ["a", "b"], F.col("hit"), 4, 1.5, "s", 2.0).toPandas().set_index("entity_id").prediction
    total = 0
    for b in range(4):
        bag = members[members.bag == b]
        mu = pd.Series(direct(bag[["a", "b"]].to_numpy(float), bag.label.to_numpy(), np.ones(len(bag)), 0.5), index=bag.entity_id)
        total = total + mu
    common = total.dropna().index
    assert len(common) > 50 and np.allclose(got[common], total[common] / 4, atol=1e-6)
    assert models.pu_bagging(df, df, ["a"], F.col("hit") & F.lit(False), 4, 1.5, "s") is None


def test_calibrations_share_a_fit(spark, table):
    rows = frame(spark, table).select(F.when(F.col("period") < 2012, "x").when(F.col("period") == 2012, None).otherwise("z").alias("model_id"),
                                      (F.col("soft") * 0.9 + 0.05).alias("prediction"), F.when(F.col("period") == 2012, 0.5).otherwise(F.col("y")).alias("target_value"))
    got = {r["model_id"]: r for r in selection.soft_platt_by_model(rows).collect()}
    assert got[None]["status"] == "IDENTITY_INSUFFICIENT_TARGET_VARIATION" and got[None]["slope"] == 1.0
    for name, part in (("x", table[table.period < 2012]), ("z", table[table.period > 2012])):
        s = np.log((part.soft * 0.9 + 0.05) / (1 - (part.soft * 0.9 + 0.05)))
        want = direct(s.to_numpy()[:, None], part.y.to_numpy(), np.ones(len(part)), 0.0)
        assert np.allclose(1 / (1 + np.exp(-(got[name]["intercept"] + got[name]["slope"] * s))), want, atol=1e-6)
    assert selection.soft_platt_by_model(rows.limit(0)).count() == 0


def test_nested_refits_tune_every_cell(spark, table):
    df = frame(spark, table)
    channels = df.select("entity_id", "period", F.explode(F.array(*[F.struct(F.lit(c).alias("channel_id"), F.col(s).alias("channel_score"), (F.col("y") > 0).alias("outcome"))
                         for c, s in (("s1", "soft"), ("s2", "y"))])).alias("c")).select("entity_id", "period", "c.*")

    def mean(rows):
        return rows.groupBy("entity_id", "period").agg(F.avg("channel_score").alias("target_value"))

    run = {"panel": df.select("entity_id", "period", "a", "b", "c"), "channels": channels, "outer_year": 2014, "features": {"s1": ["a"], "s2": ["b"], "all": ["c"]},
           "learner": "logistic", "targets": {"L2": mean}}
    cells = {r["held_channel"]: r for r in selection.nested_refit(**run, settings=[{"C": 1e-9}, {"C": 1.0}]).collect()}
    assert set(cells) == {"s1", "s2"} and all(r["status"] == "PASS" and r["setting"] == 1 for r in cells.values())
    assert cells["s1"]["row_count"] == int((table.period.between(2011, 2013)).sum())
    void = selection.nested_refit(**run, settings=[{"C": 1.0, "maxIter": 1}]).collect()
    assert {(r["status"], r["setting"], r["row_count"]) for r in void} == {("MODEL_NONCONVERGENCE", None, 0)}
    half = {r["held_channel"]: r for r in selection.nested_refit(**run, settings=[{"C": 1.0, "maxIter": 1}, {"C": 1.0}]).collect()}
    assert {r["setting"] for r in half.values()} == {1}
    # the held channel's feature is not read: without it nothing changes
    again = selection.nested_refit(**(run | {"panel": run["panel"].withColumn("a", -F.col("a") * 7)}), settings=[{"C": 1.0}]).collect()
    base = {r["held_channel"]: r for r in selection.nested_refit(**run, settings=[{"C": 1.0}]).collect()}
    assert {r["held_channel"]: r["cross_entropy"] for r in again}["s1"] == pytest.approx(base["s1"]["cross_entropy"], abs=1e-9)


def test_transfer_cells_keep_their_reasons(spark, table):
    df = frame(spark, table).withColumn("domain", F.when(F.col("entity_id").cast("int") % 7 == 0, None).otherwise((F.col("entity_id").cast("int") % 3).cast("string")))
    df = df.withColumn("outcome", F.when((F.col("domain") == "2") & (F.col("period") == 2013), True).otherwise(F.col("y") > 0))
    support = df.select(F.col("domain").alias("level"), F.col("period").alias("fold")).distinct().filter("NOT (level = '1' AND fold = 2012)").withColumn("support_fraction", F.lit(0.9))
    cells, receipts = transport.domain_transfer(df, "domain", ["a", "b"], ["c"], 0.05, support, 0.8, [{"C": 0.1}, {"C": 1.0}])
    got = {(r["level"], r["fold"]): r for r in cells.collect()}
    assert set(got) == {(lev, y) for lev in "012" for y in (2011, 2012, 2013, 2014)}
    assert got["2", 2013]["reason"] == "HELD_DOMAIN_TEST_CLASS_UNAVAILABLE" and got["1", 2012]["reason"] == "DOMAIN_SUPPORT_UNAVAILABLE"
    # no inner period before the first fold, so nothing is tuned
    assert got["0", 2011]["reason"] == "DOMAIN_REFIT_PREDICTIONS_UNAVAILABLE"
    assert got["0", 2014]["complete"] and got["0", 2014]["non_inferior"] and got["0", 2014]["train_rows"] == df.filter("domain <> '0' AND period < 2014").count()
    assert receipts.count() == 3 * 4 * 2 * 2
    one, _ = transport.domain_transfer(df, "domain", ["a", "b"], ["c"], 0.05, support, 0.8, folds=[2011, 2014])
    first = {(r["level"], r["fold"]): r for r in one.collect()}["0", 2011]
    part = table.assign(domain=[None if int(e) % 7 == 0 else str(int(e) % 3) for e in table.entity_id])
    assert first["complete"] and first["held_rows"] == int(((part.domain == "0") & (part.period == 2011)).sum())
