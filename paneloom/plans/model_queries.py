"""Splits, weights, learners and measurement selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.functions.profile import melt
from paneloom.operators import features as feature_rules
from paneloom.operators import labels, metrics, models, nested, selection, weights
from paneloom.operators.ranking import cut
from paneloom.plans.bindings import Inputs, query
from paneloom.plans.feature_queries import ENTRIES, _round
from paneloom.plans.label_queries import CHANNEL_SQL, L0_SQL, QUALITY, SCORE_SQL, _l0, _scores
from paneloom.plans.metric_queries import REGIMES, _draw

KEY = ["entity_id", "period"]
NUMERIC = ["spend", "orders_made", "top_order", "balance"]
YEARS = [1998, 1999, 2000]

# ------------------------------------------------------------- splits and weights


@query(
    "rolling_splits",
    """SELECT f.entity_id, f.period, fold, CASE WHEN f.period < fold THEN 'train' ELSE 'test' END AS side
       FROM fx_features f JOIN fx_panel p ON p.entity_id = f.entity_id AND p.period = f.period
       CROSS JOIN (VALUES (1998), (1999), (2000)) y(fold) WHERE f.period <= fold AND CAST(f.entity_id AS INT) % 7 <> 0""",
)
def _(fx: Inputs) -> DataFrame:
    return weights.rolling_splits(fx("fx_features"), _risk(fx), YEARS)


def _risk(fx: Inputs) -> DataFrame:
    return fx("fx_panel").select(*KEY, F.lit(True).alias("eligible"), (F.col("entity_id").cast("int") % 7 != 0).alias("mature"))


@query(
    "split_audit",
    """SELECT fold, count_if(f.period < fold) AS train_rows, count_if(f.period = fold) AS test_rows,
              max(f.period) FILTER (f.period < fold) AS fit_max_period, false AS leak
       FROM fx_features f JOIN fx_panel p ON p.entity_id = f.entity_id AND p.period = f.period
       CROSS JOIN (VALUES (1998), (1999), (2000)) y(fold) WHERE f.period <= fold AND CAST(f.entity_id AS INT) % 7 <> 0 GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    return weights.split_audit(weights.rolling_splits(fx("fx_features"), _risk(fx), YEARS))


@query(
    "verified_keys",
    f"SELECT entity_id, period, coalesce(bool_or(channel_id = 'S1' AND outcome IS NOT NULL), false) AS verified FROM ({L0_SQL}) l GROUP BY 1, 2",
)
def _(fx: Inputs) -> DataFrame:
    return weights.verified_keys(_l0(fx), ["S1"])


def _flagged(fx: Inputs) -> DataFrame:
    """Domain rows with a verification flag that depends on spend."""
    verified = (F.col("spend") > 150000) & (F.col("entity_id").cast("int") % 3 != 0)
    return fx("fx_domain").select(*KEY, *NUMERIC, verified.alias("verified"))


FLAGGED_SQL = """SELECT entity_id, period, spend, orders_made, top_order, balance, spend > 150000 AND CAST(entity_id AS INT) % 3 <> 0 AS verified,
                        CAST(0.05 + (CAST(entity_id AS INT) % 17) / 20.0 AS DOUBLE) AS propensity FROM fx_domain"""


def _with_propensity(fx: Inputs) -> DataFrame:
    return _flagged(fx).withColumn("propensity", 0.05 + F.col("entity_id").cast("int") % 17 / 20)


@query("stabilized_weights")
def _(fx: Inputs) -> DataFrame:
    whole = _flagged(fx)
    rows = weights.stabilized_ipw(whole.filter("period < 1999"), NUMERIC, rows=whole)
    return rows.groupBy("period", "verified", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("weight"), 4).alias("mean_weight"), F.min("weight").alias("least_weight")
    )


@query(
    "capped_weights",
    f"SELECT entity_id, period, round(least(1 / greatest(0.05, least(1.0, propensity)), 20.0), 9) AS weight FROM ({FLAGGED_SQL}) q",
)
def _(fx: Inputs) -> DataFrame:
    return _with_propensity(fx).select(*KEY, F.round(weights.capped_ipw(F.col("propensity")), 9).alias("weight"))


STABLE_SQL = f"""SELECT *, CASE WHEN verified THEN r / propensity ELSE (1 - r) / (1 - propensity) END AS weight
                 FROM (SELECT *, avg(CAST(verified AS INT)) OVER () AS r FROM ({FLAGGED_SQL}) f) g"""


def _weighted(fx: Inputs) -> DataFrame:
    rows = _with_propensity(fx)
    rate = rows.agg(F.avg(F.col("verified").cast("double")).alias("r"))
    weight = F.when(F.col("verified"), F.col("r") / F.col("propensity")).otherwise((1 - F.col("r")) / (1 - F.col("propensity")))
    return rows.join(F.broadcast(rate), F.lit(True)).withColumn("weight", weight).drop("r")


@query(
    "effective_sample_size",
    f"SELECT period, round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS effective_sample_size FROM ({STABLE_SQL}) w GROUP BY 1",
)
def _(fx: Inputs) -> DataFrame:
    return _round(weights.ess(_weighted(fx), "weight", ["period"]), 6)


@query(
    "weight_decision",
    f"""SELECT *, CASE WHEN effective_sample_size < required_ess OR support_fraction < 0.7 THEN 'WEIGHT_DIAGNOSTICS_FAILED' END AS reason,
               CASE WHEN effective_sample_size < required_ess OR support_fraction < 0.7 THEN 'unweighted' ELSE 'stabilized_verification_ipw' END AS weight_method
        FROM (SELECT count(*) AS row_count, round(sum(weight) * sum(weight) / sum(weight * weight), 5) AS effective_sample_size,
                     round(avg(CAST(propensity BETWEEN 0.1 AND 0.9 AS INT)), 5) AS support_fraction,
                     round(greatest(100.0, count(*) * 0.3), 5) AS required_ess FROM ({STABLE_SQL}) w) d""",
)
def _(fx: Inputs) -> DataFrame:
    rows = _weighted(fx).withColumn("reason", F.lit(None).cast("string"))
    return _round(weights.ipw_decision(rows, (0.1, 0.9), 100, 0.3, 0.7), 5)


def _smd_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature_id, round((avg({c}) FILTER (verified) - avg({c}) FILTER (NOT verified)) / stddev_samp({c}), 7) AS smd_before,
               round((sum(weight * {c}) FILTER (verified) / sum(weight) FILTER (verified AND {c} IS NOT NULL)
                - sum(weight * {c}) FILTER (NOT verified) / sum(weight) FILTER (NOT verified AND {c} IS NOT NULL)) / stddev_samp({c}), 7) AS smd_after
               FROM ({STABLE_SQL}) w"""


@query("standardized_differences", " UNION ALL ".join(_smd_sql(c) for c in NUMERIC))
def _(fx: Inputs) -> DataFrame:
    return _round(weights.smd(_weighted(fx), NUMERIC, "verified", "weight"))


@query(
    "overlap_weights",
    f"""SELECT round(sum(o) * sum(o) / sum(o * o), 6) AS effective_sample_size
        FROM (SELECT CASE WHEN verified THEN 1 - propensity ELSE propensity END AS o FROM ({FLAGGED_SQL}) f) g""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(weights.ess(_with_propensity(fx), weights.overlap_weights(F.col("propensity"), F.col("verified"))), 6)


@query(
    "all_null_columns",
    """SELECT 'balance' AS feature_id, count(balance) AS value_count, true AS kept FROM fx_domain WHERE period < 1998
       UNION ALL SELECT 'late', 0, false""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_domain").withColumn("late", F.when(F.col("period") >= 1998, F.col("spend"))).filter("period < 1998")
    return weights.drop_all_null(rows, ["balance", "late"])


@query(
    "holdout_split",
    f"""SELECT entity_id, period, CASE WHEN row_number() OVER (ORDER BY {_draw("holdout", "entity_id", "period")}, entity_id, period)
               <= greatest(10, least(count(*) OVER () - 10, CAST(round(count(*) OVER () * 0.25) AS BIGINT))) THEN 'validation' ELSE 'train' END AS side
        FROM fx_domain""",
)
def _(fx: Inputs) -> DataFrame:
    return weights.holdout_split(fx("fx_domain").select(*KEY), 0.25, "holdout")


@query(
    "cost_training_weights",
    f"""SELECT entity_id, period, round(c / avg(c) OVER (), 8) AS training_weight
        FROM (SELECT entity_id, period, greatest(1e-12, least(20.0, 1 / propensity * CASE WHEN verified THEN 13.0 ELSE 2.0 END)) AS c FROM ({FLAGGED_SQL}) f) g""",
)
def _(fx: Inputs) -> DataFrame:
    rows = _with_propensity(fx).select(*KEY, F.col("verified").alias("outcome"), (1 / F.col("propensity")).alias("weight"))
    return weights.cost_weights(rows, REGIMES[0], 20.0).select(*KEY, F.round("training_weight", 8).alias("training_weight"))


@query(
    "label_strategies",
    f"""SELECT strategy, count(*) AS n, count_if(y) AS positives, round(sum(w), 6) AS total_weight
        FROM (SELECT 'naive_observed_as_negative' AS strategy, coalesce(spend > 250000 AND verified, false) AS y, 1.0::DOUBLE AS w FROM ({FLAGGED_SQL}) a
              UNION ALL SELECT 'verified_only', spend > 250000, 1.0 FROM ({FLAGGED_SQL}) b WHERE verified
              UNION ALL SELECT 'ipw', spend > 250000, least(1 / greatest(0.05, least(1.0, propensity)), 20.0) FROM ({FLAGGED_SQL}) c WHERE verified
              UNION ALL SELECT 'pu', coalesce(spend > 250000 AND verified, false), 1.0 FROM ({FLAGGED_SQL}) d) u GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    rows = _with_propensity(fx).withColumn("outcome", F.when(F.col("verified"), F.col("spend") > 250000))
    whole = None
    for strategy in ("naive_observed_as_negative", "verified_only", "ipw", "pu"):
        part = weights.training_view(rows, strategy).select(F.lit(strategy).alias("strategy"), "label", "weight")
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("label").alias("positives"), F.round(F.sum("weight"), 6).alias("total_weight")
    )


# ------------------------------------------------------------- learners


@query(
    "feature_groups",
    """WITH n AS (SELECT count(fs_aud_price) AS p, count(fs_aud_rebate) AS r, count(fs_aud_quantity) AS q, count(fs_aud_orders) AS o FROM fx_features)
       SELECT 'content_only' AS feature_group, ['early_only', 'fs_aud_price', 'fs_aud_rebate', 'gone'] AS features, [0, p, r, 0] AS value_counts FROM n
       UNION ALL SELECT 'observability_only', ['fs_aud_quantity'], [q] FROM n
       UNION ALL SELECT 'full', ['early_only', 'fs_aud_orders', 'fs_aud_price', 'fs_aud_quantity', 'fs_aud_rebate', 'gone'], [0, o, p, q, r, 0] FROM n""",
)
def _(fx: Inputs) -> DataFrame:
    return models.feature_groups(feature_rules.registry_table(fx.spark, ENTRIES), fx("fx_features"))


def _training(fx: Inputs) -> DataFrame:
    # every fit reads these rows, so they are placed once
    return cut(fx("fx_domain").withColumn("y", F.col("outcome").cast("double")))


@query("temporal_oof")
def _(fx: Inputs) -> DataFrame:
    rows = models.temporal_oof(_training(fx), NUMERIC, "y", "elastic_net_logistic", {"elasticNetParam": 0.5, "C": 1.0})
    scored = rows.withColumn("outcome", F.col("y") > 0)
    summary = metrics.scored_summary(scored, 0.1, ["period"])
    return _round(summary, 4)


@query("learner_library")
def _(fx: Inputs) -> DataFrame:
    rows = _training(fx)
    train = rows.filter("period < 1998")
    whole = None
    settings = {
        "logistic": {}, "elastic_net_logistic": {"elasticNetParam": 0.5}, "linear_svm": {"maxIter": 20},
        "random_forest": {"numTrees": 10, "maxDepth": 4}, "gradient_boosting": {"maxIter": 5, "maxDepth": 3},
        "decision_tree": {"maxDepth": 4}, "gaussian_nb": {}, "mlp": {"hidden": [4], "maxIter": 20},
    }
    for learner, params in settings.items():
        scores = models.fit(train, NUMERIC, "y", learner, params).score(rows)
        part = scores.select(F.lit(learner).alias("model_id"), *KEY, "outcome", "prediction")
        whole = part if whole is None else whole.unionByName(part)
    return _round(metrics.roc_auc(whole, ["model_id"]), 3)


@query("tuned_fold_predictions")
def _(fx: Inputs) -> DataFrame:
    panel = fx("fx_domain").drop("outcome")
    outcomes = fx("fx_domain").select(*KEY, "outcome")
    loads = fx("fx_domain").filter("CAST(entity_id AS INT) % 9 <> 0").select(*KEY, F.lit(1.5).alias("weight"))
    predictions = models.fit_fold(
        panel, outcomes, loads, 2000, {"full": NUMERIC, "observability_only": ["orders_made"]},
        {"logistic": models.grid({}, {"C": [0.1, 1.0]}, 50)},
    )
    return predictions.groupBy("model_id", "split", "period").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 3).alias("mean_prediction")
    )


@query(
    "soft_label_rows",
    """SELECT model_id, entity_id, period, label, round(label_weight, 9) AS label_weight FROM (
         SELECT model_id, entity_id, period, 1.0::DOUBLE AS label, prediction * 2 AS label_weight FROM fx_scores
         UNION ALL SELECT model_id, entity_id, period, 0.0, (1 - prediction) * 2 FROM fx_scores) q WHERE label_weight > 0""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_scores").withColumn("w", F.lit(2.0))
    return models.expand_soft(rows, "prediction", "w").select("model_id", *KEY, "label", F.round("label_weight", 9).alias("label_weight"))


@query(
    "training_ecdf",
    """SELECT v.entity_id, v.period, round(greatest(1e-6, least(1 - 1e-6, (count(r.spend) - 0.5) / (SELECT count(*) FROM fx_domain WHERE period < 1997))), 9) AS ecdf
       FROM fx_domain v LEFT JOIN (SELECT spend FROM fx_domain WHERE period < 1997) r ON r.spend <= v.spend GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_domain")
    result = models.train_ecdf(rows, rows.filter("period < 1997"), "spend")
    return result.select(*KEY, F.round("ecdf", 9).alias("ecdf"))


@query(
    "fold_ecdf",
    """WITH k AS (SELECT DISTINCT period AS p FROM fx_domain),
            r AS (SELECT entity_id, period, p, count_if(period < p) OVER (PARTITION BY p ORDER BY spend RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                         count_if(period < p) OVER (PARTITION BY p) AS n FROM fx_domain CROSS JOIN k)
       SELECT entity_id, period, p AS fold, round(greatest(1e-6, least(1 - 1e-6, (upto - 0.5) / n)), 9) AS ecdf FROM r WHERE n > 0 AND period <= p""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_domain").select(*KEY, "spend")
    folds = sorted(r["period"] for r in rows.select("period").distinct().collect())
    ranked = nested.nested_ecdf(rows, "spend", "period", folds)
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, folds)).alias("fold"), F.col("ecdf")))
    return ranked.select(*KEY, each.alias("e")).select(*KEY, "e.fold", F.round("e.ecdf", 9).alias("ecdf")).filter("ecdf IS NOT NULL")


@query(
    "fold_medians",
    " UNION ALL ".join(
        f"""SELECT p AS fold, '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS median FROM fx_domain
            JOIN (SELECT DISTINCT period AS p FROM fx_domain) k ON period < p WHERE {c} IS NOT NULL GROUP BY 1"""
        for c in NUMERIC
    ),
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_domain")
    folds = sorted(r["period"] for r in rows.select("period").distinct().collect())
    marked = melt(rows.withColumn("sets", nested.members(F.col("period"), folds)), ["sets"], NUMERIC)
    found = nested.nested_quantiles(marked, len(folds))
    return found.select(F.element_at(F.array(*map(F.lit, folds)), F.col("set") + 1).alias("fold"), "feature", F.round("quantile", 6).alias("median"))


@query(
    "estimability",
    """SELECT domain, count(y) AS known_count, count(y) >= 2 AND max(y) > min(y) AS estimable
       FROM (SELECT domain, CASE WHEN domain <> 'BUILDING' OR outcome THEN CAST(outcome AS INT) END AS y FROM fx_domain) q GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    known = F.when((F.col("domain") != "BUILDING") | F.col("outcome"), F.col("outcome").cast("double"))
    return models.estimable(fx("fx_domain").withColumn("y", known), "y", soft=False, by=["domain"])


BAG_POSITIVE = "spend > 600000"


@query(
    "pu_bag_members",
    f"""SELECT bag, entity_id, period, 1.0::DOUBLE AS label FROM fx_domain CROSS JOIN range(3) b(bag) WHERE {BAG_POSITIVE}
        UNION ALL
        SELECT bag, entity_id, period, 0.0 FROM (
          SELECT bag, entity_id, period, row_number() OVER (PARTITION BY bag ORDER BY {_draw("bags", "bag", "entity_id", "period")}, entity_id, period) AS pos
          FROM fx_domain CROSS JOIN range(3) b(bag) WHERE NOT {BAG_POSITIVE}) u
        WHERE pos <= (SELECT ceil(count(*) * 2.0) FROM fx_domain WHERE {BAG_POSITIVE})""",
)
def _(fx: Inputs) -> DataFrame:
    members = models.pu_bags(fx("fx_domain"), F.expr(BAG_POSITIVE), 3, 2.0, "bags")
    return members.select(F.col("bag").cast("long").alias("bag"), *KEY, "label")


@query("pu_bagging_scores")
def _(fx: Inputs) -> DataFrame:
    rows = cut(fx("fx_domain"))
    scored = models.pu_bagging(
        rows.filter("period < 2000"), rows, NUMERIC, F.col("spend") > 500000, 20, 2.0, "bags"
    )
    return scored.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.min("prediction").alias("low"), F.max("prediction").alias("high")
    )


@query(
    "combined_predictions",
    """SELECT model_id, entity_id, period, round(min(prediction), 9) AS prediction, count(*) AS copies
       FROM (SELECT * FROM fx_scores UNION ALL SELECT * FROM fx_scores WHERE period = 2016) u GROUP BY 1, 2, 3""",
)
def _(fx: Inputs) -> DataFrame:
    scores = fx("fx_scores").select("model_id", *KEY, "prediction")
    return _round(models.combine_predictions(scores, scores.filter("period = 2016")), 9)


HOLDOUT_SQL = f"""
    SELECT h.channel_id, coalesce(n, 0) AS row_count, ce AS cross_entropy
    FROM (SELECT DISTINCT channel_id FROM ({CHANNEL_SQL}) c) h LEFT JOIN (
      SELECT channel_id, count(*) AS n, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ce
      FROM (SELECT a.channel_id, CAST(a.outcome AS INT) AS y, greatest(1e-6, least(1 - 1e-6, avg(b.channel_score))) AS p
            FROM ({CHANNEL_SQL}) a JOIN ({SCORE_SQL}) b ON b.entity_id = a.entity_id AND b.period = a.period AND b.channel_id <> a.channel_id
            WHERE a.outcome IS NOT NULL AND a.period < 2019 GROUP BY a.entity_id, a.period, a.channel_id, a.outcome
            HAVING count(b.channel_score) >= 1) x GROUP BY 1) s ON s.channel_id = h.channel_id"""


def _holdout(fx: Inputs) -> DataFrame:
    # the source grid feeds outcomes and scores
    grid = cut(_l0(fx))
    outcomes = labels.channel_outcomes(grid, ["quality", "toxic", "lang", "appeal"])
    rows = cut(outcomes.join(labels.l2_channel_scores(grid, QUALITY, 180.0), [*KEY, "channel_id"]))
    return selection.channel_holdout_ce(rows, 2019, 1)


@query("channel_holdout", f"SELECT channel_id, row_count, round(cross_entropy, 7) AS cross_entropy FROM ({HOLDOUT_SQL}) q")
def _(fx: Inputs) -> DataFrame:
    return _round(_holdout(fx))


@query(
    "selected_measurement",
    f"""SELECT CASE WHEN bool_and(row_count > 0) THEN 'L2' ELSE 'none' END AS selected,
               CASE WHEN NOT bool_and(row_count > 0) THEN 'NO_ELIGIBLE_CANDIDATE' END AS reason FROM ({HOLDOUT_SQL}) q""",
)
def _(fx: Inputs) -> DataFrame:
    results = selection.holdout_objective(_holdout(fx), "L2")
    blocked = results.select(
        F.lit("L3").alias("candidate"), F.lit(False).alias("eligible"), F.lit(0.0).alias("objective"), F.lit("L3_UNAVAILABLE").alias("reason")
    )
    return selection.select_candidate(results.unionByName(blocked), ["L2", "L3"])


@query(
    "track_plan",
    f"""SELECT 'L1_ANNUAL' AS measurement_id, 0 AS position, 'primary' AS role, 'REQUIRED' AS status, true AS eligible, CAST(NULL AS STRING) AS reason
        UNION ALL SELECT 'L2', 1, 'optional', CASE WHEN bool_and(row_count > 0) THEN 'AVAILABLE' ELSE 'SKIPPED' END, bool_and(row_count > 0),
                         CASE WHEN NOT bool_and(row_count > 0) THEN 'INSUFFICIENT_CHANNELS' END FROM ({HOLDOUT_SQL}) q
        UNION ALL SELECT 'L3', 2, 'optional', 'SKIPPED', false, 'CAPABILITY_UNAVAILABLE'""",
)
def _(fx: Inputs) -> DataFrame:
    candidates = selection.holdout_objective(_holdout(fx), "L2")
    return models.track_plan(fx.spark, candidates, ["L1_ANNUAL", "L2", "L3"])


@query("soft_platt")
def _(fx: Inputs) -> DataFrame:
    docs = fx("documents").select(F.col("doc_id").cast("string").alias("entity_id"), ((F.col("n_chars") % 41) / 40).alias("target_value"))
    return _round(selection.soft_platt_by_model(fx("fx_scores").join(docs, "entity_id")), 4)


@query("calibrated_evaluation")
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_scores")
    table = selection.hard_platt(rows.filter("period < 2020"))
    outer = metrics.calibrated(rows.filter("period >= 2020"), table.drop("status"))
    return _round(metrics.scored_summary(outer, 0.1, ["model_id"]), 4)


# ------------------------------------------------------------- fits with closed answers
#
# With one binary feature and next to no penalty, a fitted probability is the rate of its group, so
# the fitting operators can be compared with plain averages.

FREE = {"C": 1e12, "tol": 1e-12}
BINARY_SQL = """SELECT *, CASE WHEN orders_made > 2 THEN 1.0::DOUBLE ELSE 0.0 END AS many, CAST(outcome AS INT) AS y,
                       spend > 150000 AND CAST(entity_id AS INT) % 3 <> 0 AS verified FROM fx_domain"""


def _binary(fx: Inputs) -> DataFrame:
    return cut(
        fx("fx_domain").select(
            "*", (F.col("orders_made") > 2).cast("double").alias("many"), F.col("outcome").cast("double").alias("y"),
            ((F.col("spend") > 150000) & (F.col("entity_id").cast("int") % 3 != 0)).alias("verified"),
        )
    )


@query(
    "saturated_weights",
    f"""SELECT entity_id, period, round(CASE WHEN verified THEN r / p ELSE (1 - r) / (1 - p) END, 4) AS weight
        FROM (SELECT *, avg(CAST(verified AS INT)) OVER () AS r, avg(CAST(verified AS INT)) OVER (PARTITION BY many) AS p FROM ({BINARY_SQL}) b) q""",
)
def _(fx: Inputs) -> DataFrame:
    rows = weights.stabilized_ipw(_binary(fx), ["many"], inverse_regularization=1e12, tolerance=1e-12)
    return rows.select(*KEY, F.round("weight", 4).alias("weight"))


@query(
    "saturated_learners",
    f"""WITH b AS ({BINARY_SQL}), g AS (SELECT many, avg(y) AS p FROM b GROUP BY 1)
        SELECT model_id, many, round(p, 5) AS prediction, (SELECT count(*) FROM b WHERE b.many = g.many) AS n
        FROM g CROSS JOIN (VALUES ('logistic'), ('elastic_net_logistic'), ('decision_tree')) m(model_id)""",
)
def _(fx: Inputs) -> DataFrame:
    rows, whole = _binary(fx), None
    for learner, params in (("logistic", FREE), ("elastic_net_logistic", FREE), ("decision_tree", {"maxDepth": 1})):
        part = models.fit(rows, ["many"], "y", learner, params).score(rows).select(F.lit(learner).alias("model_id"), "many", "prediction")
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("model_id", "many", F.round("prediction", 5).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


OOF_SQL = f"""
    WITH b AS ({BINARY_SQL}), k AS (SELECT DISTINCT period AS p FROM b),
    g AS (SELECT p, many, avg(y) AS prediction FROM b JOIN k ON period < p GROUP BY 1, 2),
    f AS (SELECT p FROM b JOIN k ON period < p GROUP BY 1 HAVING max(y) > min(y))
    SELECT b.period, b.many, round(any_value(prediction), 5) AS prediction, count(*) AS n, sum(y) AS positives
    FROM b JOIN f ON f.p = b.period JOIN g ON g.p = b.period AND g.many = b.many GROUP BY 1, 2"""


@query("saturated_oof", OOF_SQL)
def _(fx: Inputs) -> DataFrame:
    rows = _binary(fx)
    scored = models.temporal_oof(rows, ["many"], "y", "logistic", FREE).join(rows.select(*KEY, "many"), KEY)
    return scored.groupBy("period", "many").agg(
        F.round(F.any_value("prediction"), 5).alias("prediction"), F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives")
    )


#: A penalty that leaves the intercept alone, so that every row gets the rate of all fitted rows.
FLAT = {"C": 1e-24}


def _fold_sql(flag: str) -> str:
    """Predictions of the better of two settings, FREE (the rate of the row's group) and FLAT (the rate of all rows)."""
    return f"""
    WITH b AS (SELECT entity_id, period, CASE WHEN {flag} THEN 1.0::DOUBLE ELSE 0.0 END AS many, CAST(outcome AS INT) AS y FROM fx_domain WHERE period <= 2000),
    k AS (SELECT DISTINCT period AS p FROM b), g AS (SELECT p, many, avg(y) AS free FROM b JOIN k ON period < p GROUP BY 1, 2),
    f AS (SELECT p, avg(y) AS flat FROM b JOIN k ON period < p GROUP BY 1 HAVING max(y) > min(y)),
    s AS (SELECT b.*, 0 AS setting, free AS prediction FROM b JOIN f ON f.p = period JOIN g ON g.p = period AND g.many = b.many
          UNION ALL SELECT b.*, 1, flat FROM b JOIN f ON f.p = period),
    a AS (SELECT setting, sum(CASE WHEN y = 1 THEN hits / pos END) / sum(y) AS ap FROM (
            SELECT setting, y, sum(y) OVER w AS hits, row_number() OVER w AS pos FROM s WHERE period < 2000
            WINDOW w AS (PARTITION BY setting ORDER BY round(prediction, 11) DESC, entity_id, period)) q GROUP BY 1),
    c AS (SELECT setting FROM a ORDER BY ap DESC, setting LIMIT 1)
    SELECT CASE WHEN period < 2000 THEN 'oof' ELSE 'outer' END AS split, period, many, round(any_value(prediction), 5) AS prediction, count(*) AS n,
           CASE WHEN period < 2000 THEN sum(y) END AS positives, setting FROM s JOIN c USING (setting) GROUP BY 1, 2, 3, setting"""


def _tuned(fx: Inputs, flag: str) -> DataFrame:
    rows = _binary(fx).withColumn("many", F.expr(flag).cast("double"))
    none = rows.limit(0).select(*KEY, F.lit(1.0).alias("weight"))
    folds, found, _ = models.tune_fold(
        rows.select(*KEY, "many"), rows.select(*KEY, "outcome"), none, 2000, {"g": ["many"]}, {"logistic": [FREE, FLAT]}
    )
    folds = folds.join(F.broadcast(found.select("model_id", "setting")), "model_id")
    return folds.join(rows.select(*KEY, "many"), KEY).groupBy("split", "period", "many", "setting").agg(
        F.round(F.any_value("prediction"), 5).alias("prediction"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("outcome").cast("int")).alias("positives"),
    )


@query("saturated_fold", _fold_sql("orders_made > 2"))
def _(fx: Inputs) -> DataFrame:
    return _tuned(fx, "orders_made > 2")


@query("saturated_fold_large_orders", _fold_sql("top_order > 200000"))
def _(fx: Inputs) -> DataFrame:
    return _tuned(fx, "top_order > 200000")


@query(
    "saturated_ranked_fold",
    """WITH b AS (SELECT entity_id, period, CASE WHEN orders_made > 2 THEN 1.0::DOUBLE ELSE 0.0 END AS many, round(CAST(entity_id AS INT) % 13 / 12.0, 6) + period % 3 AS t FROM fx_domain),
       k AS (SELECT DISTINCT period AS p FROM b),
       r AS (SELECT b.*, p, count_if(period < p) OVER (PARTITION BY p ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                    count_if(period < p) OVER (PARTITION BY p) AS n FROM b CROSS JOIN k WHERE p <= 2000 AND period <= p),
       e AS (SELECT *, greatest(1e-6, least(1 - 1e-6, (upto - 0.5) / n)) AS rank FROM r WHERE n > 0),
       g AS (SELECT p, many, avg(rank) AS prediction FROM e WHERE period < p GROUP BY 1, 2)
       SELECT 'oof' AS split, e.period, e.many, round(any_value(prediction), 5) AS prediction, count(*) AS n, round(avg(rank), 6) AS target
       FROM e JOIN g ON g.p = e.p AND g.many = e.many WHERE e.period = e.p AND e.p < 2000 GROUP BY 2, 3
       UNION ALL SELECT 'outer', 2000, b.many, round(any_value(prediction), 5), count(*), NULL FROM b JOIN g ON g.p = 2000 AND g.many = b.many WHERE period = 2000 GROUP BY 3""",
)
def _(fx: Inputs) -> DataFrame:
    rows = _binary(fx)
    target = F.round(F.col("entity_id").cast("int") % 13 / 12, 6) + F.col("period") % 3
    none = rows.limit(0).select(*KEY, F.lit(1.0).alias("weight"))
    folds = models.fit_fold(
        rows.select(*KEY, "many"), rows.select(*KEY, target.alias("t")), none, 2000, {"g": ["many"]}, {"logistic": [FREE]}, "t", soft=True, ecdf=True
    )
    return folds.join(rows.select(*KEY, "many"), KEY).groupBy("split", "period", "many").agg(
        F.round(F.any_value("prediction"), 5).alias("prediction"), F.count(F.lit(1)).alias("n"), F.round(F.avg("target"), 6).alias("target")
    )


RECEIPT_ROWS = f"""
    SELECT p AS period, count(*) AS row_count FROM ({BINARY_SQL}) b JOIN (SELECT DISTINCT period AS p FROM fx_domain WHERE period <= 2000) k ON b.period < p
    GROUP BY 1 HAVING max(y) > min(y)"""


def _capped(fx: Inputs) -> tuple:
    """A setting whose fits may take one step only, beside one that may go on."""
    rows = _binary(fx)
    none = rows.limit(0).select(*KEY, F.lit(1.0).alias("weight"))
    return models.tune_fold(
        rows.select(*KEY, "many"), rows.select(*KEY, "outcome"), none, 2000, {"g": ["many"]},
        {"logistic": [FREE | {"maxIter": 1}, FREE]},
    )


@query(
    "fit_receipts",
    f"""SELECT 'logistic:g' AS model_id, setting, period, row_count, CASE WHEN setting = 0 THEN 'MODEL_NONCONVERGENCE' ELSE 'PASS' END AS status,
               setting = 1 AS converged FROM ({RECEIPT_ROWS}) r CROSS JOIN (VALUES (0), (1)) s(setting)""",
)
def _(fx: Inputs) -> DataFrame:
    return _capped(fx)[2].select("model_id", "setting", "period", "row_count", "status", "converged")


@query(
    "tuned_models",
    f"""WITH o AS ({OOF_SQL})
        SELECT 'logistic:g' AS model_id, 'PASS' AS status, NULL::VARCHAR AS reason, 2 AS evaluated_settings, 1 AS valid_settings, 1 AS setting
        WHERE EXISTS (SELECT * FROM o WHERE period < 2000)""",
)
def _(fx: Inputs) -> DataFrame:
    return _capped(fx)[1].drop("loss")


@query(
    "saturated_bagging",
    f"""WITH b AS ({BINARY_SQL}),
        m AS (SELECT bag, b.many, label FROM (
                SELECT bag, entity_id, period, 1.0::DOUBLE AS label FROM b CROSS JOIN range(20) g(bag) WHERE {BAG_POSITIVE}
                UNION ALL
                SELECT bag, entity_id, period, 0.0 FROM (
                  SELECT bag, entity_id, period, row_number() OVER (PARTITION BY bag ORDER BY {_draw("bags", "bag", "entity_id", "period")}, entity_id, period) AS pos
                  FROM b CROSS JOIN range(20) g(bag) WHERE NOT {BAG_POSITIVE}) u
                WHERE pos <= (SELECT ceil(count(*) * 2.0) FROM b WHERE {BAG_POSITIVE})) q JOIN b USING (entity_id, period)),
        r AS (SELECT many, avg(p) AS p FROM (SELECT bag, many, avg(label) AS p FROM m GROUP BY 1, 2) a GROUP BY 1)
        SELECT many, round(p, 4) AS prediction, (SELECT count(*) FROM b WHERE b.many = r.many) AS n FROM r""",
)
def _(fx: Inputs) -> DataFrame:
    rows = _binary(fx)
    scored = models.pu_bagging(rows, rows, ["many"], F.expr(BAG_POSITIVE), 20, 2.0, "bags", 1e12, 1e-12)
    return scored.groupBy("many").agg(F.round(F.any_value("prediction"), 4).alias("prediction"), F.count(F.lit(1)).alias("n"))


@query(
    "saturated_platt",
    """WITH x AS (SELECT CASE WHEN s.prediction < 0.5 THEN 0.3::DOUBLE ELSE 0.8 END AS p, (d.n_chars % 41) / 40.0 AS t
                  FROM fx_scores s JOIN documents d ON CAST(d.doc_id AS STRING) = s.entity_id),
            m AS (SELECT ln(avg(t) FILTER (p < 0.5) / (1 - avg(t) FILTER (p < 0.5))) AS lo, ln(avg(t) FILTER (p > 0.5) / (1 - avg(t) FILTER (p > 0.5))) AS hi,
                         ln(0.3 / 0.7) AS a, ln(0.8 / 0.2) AS b FROM x)
       SELECT round(lo - a * (hi - lo) / (b - a), 4) AS intercept, round((hi - lo) / (b - a), 4) AS slope, 'SOFT_PLATT' AS status FROM m""",
)
def _(fx: Inputs) -> DataFrame:
    docs = fx("documents").select(F.col("doc_id").cast("string").alias("entity_id"), ((F.col("n_chars") % 41) / 40).alias("target_value"))
    rows = fx("fx_scores").withColumn("prediction", F.when(F.col("prediction") < 0.5, 0.3).otherwise(0.8)).join(docs, "entity_id")
    return _round(selection.soft_platt(rows), 4)


def _document_panel(fx: Inputs) -> DataFrame:
    return fx("documents").select(
        F.col("doc_id").cast("string").alias("entity_id"), (F.col("doc_id") % 7 + 2015).cast("int").alias("period"),
        F.col("n_chars").cast("double").alias("chars"), F.length(F.regexp_replace("text", r"[^\n]", "")).cast("double").alias("lines"),
        (F.col("source") == "web").cast("double").alias("web"),
    )


@query("nested_refit_cells")
def _(fx: Inputs) -> DataFrame:
    outcomes = labels.channel_outcomes(_l0(fx), ["quality", "toxic", "lang", "appeal"])
    rows = cut(outcomes.join(_scores(fx), [*KEY, "channel_id"]))

    def mean_score(channels: DataFrame) -> DataFrame:
        return channels.groupBy(*KEY).agg(F.avg("channel_score").alias("target_value"))

    cells = selection.nested_refit(
        cut(_document_panel(fx)), rows, 2019, {"S1": ["web"], "S2": ["lines"], "all": ["chars"]}, "logistic", {"L2": mean_score}, [{"C": 0.01}, {"C": 1.0}]
    )
    return cells.withColumns({"cross_entropy": F.round("cross_entropy", 3), "tuning_loss": F.round("tuning_loss", 3)})


#: One scored period and one binary feature: fits and calibrations are rates of groups.
REFIT_SQL = f"""
    WITH c AS (SELECT * FROM ({CHANNEL_SQL}) a JOIN ({SCORE_SQL}) b USING (entity_id, period, channel_id) WHERE period < 2017),
    w AS (SELECT CAST(doc_id AS VARCHAR) AS entity_id, doc_id % 7 + 2015 AS period, source = 'web' AS web FROM documents),
    h AS (SELECT DISTINCT channel_id AS held FROM c),
    t AS (SELECT held, entity_id, period, web, avg(channel_score) AS t FROM c JOIN w USING (entity_id, period) JOIN h ON channel_id <> held GROUP BY 1, 2, 3, 4 HAVING avg(channel_score) IS NOT NULL),
    o AS (SELECT DISTINCT held FROM t WHERE period = 2015 GROUP BY held HAVING count(*) >= 2 AND max(t) - min(t) > 1e-12),
    p AS (SELECT s.*, k, CASE WHEN k = 0 THEN (SELECT avg(t) FROM t e WHERE e.held = s.held AND e.period = 2015 AND e.web = s.web)
                 ELSE (SELECT avg(t) FROM t e WHERE e.held = s.held AND e.period = 2015) END AS prediction FROM t s JOIN o USING (held) CROSS JOIN (VALUES (0), (1)) v(k) WHERE period = 2016),
    l AS (SELECT held, k, -avg(t * ln(greatest(1e-9, least(1 - 1e-9, prediction))) + (1 - t) * ln(1 - greatest(1e-9, least(1 - 1e-9, prediction)))) AS loss FROM p GROUP BY 1, 2),
    b AS (SELECT held, min(k) AS k, arg_min(loss, k) AS loss FROM l JOIN (SELECT held, min(loss) AS least FROM l GROUP BY 1) USING (held) WHERE loss <= least + 1e-9 GROUP BY 1),
    m AS (SELECT p.*, CASE WHEN k = 0 THEN avg(t) OVER (PARTITION BY held, web) ELSE avg(t) OVER (PARTITION BY held) END AS fit FROM p JOIN b USING (held, k)),
    q AS (SELECT m.held, count(*) AS n, avg(-(y * ln(greatest(1e-6, least(1 - 1e-6, fit))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, fit))))) AS ce
          FROM m JOIN (SELECT entity_id, period, channel_id AS held, CAST(outcome AS INT) AS y FROM c WHERE outcome IS NOT NULL) z USING (entity_id, period, held) GROUP BY 1)
    SELECT 'L2' AS candidate, held AS held_channel, k AS setting, round(loss, 6) AS tuning_loss, coalesce(n, 0) AS row_count, round(ce, 5) AS cross_entropy,
           CASE WHEN n > 0 THEN 'PASS' ELSE 'NO_ROWS' END AS status, 0 AS outer_rows_used FROM h LEFT JOIN b USING (held) LEFT JOIN q USING (held)"""


@query("saturated_refit_cells", REFIT_SQL)
def _(fx: Inputs) -> DataFrame:
    grid = cut(_l0(fx))
    outcomes = labels.channel_outcomes(grid, ["quality", "toxic", "lang", "appeal"])
    rows = cut(outcomes.join(labels.l2_channel_scores(grid, QUALITY, 180.0), [*KEY, "channel_id"]))

    def mean_score(channels: DataFrame) -> DataFrame:
        return channels.groupBy(*KEY).agg(F.avg("channel_score").alias("target_value"))

    cells = selection.nested_refit(cut(_document_panel(fx)), rows, 2017, {"all": ["web"]}, "logistic", {"L2": mean_score}, [FREE, FLAT])
    return cells.withColumns({"cross_entropy": F.round("cross_entropy", 5), "tuning_loss": F.round("tuning_loss", 6)})


@query(
    "refit_receipt_violations",
    f"""SELECT 'L2' AS candidate, channel_id AS held_channel, 'CELL_OBJECTIVE_INVALID' AS violation FROM ({HOLDOUT_SQL}) a WHERE cross_entropy IS NULL
        UNION ALL SELECT 'L2', 'S9', 'CELL_MISSING'
        UNION ALL SELECT 'L3', c, 'CELL_MISSING' FROM (VALUES ('S1'), ('S2'), ('S3'), ('S9')) v(c)""",
)
def _(fx: Inputs) -> DataFrame:
    cells = _holdout(fx).select(
        F.lit("L2").alias("candidate"), F.col("channel_id").alias("held_channel"), F.greatest("row_count", F.lit(1)).alias("row_count"),
        "cross_entropy", F.lit("PASS").alias("status"), F.lit(0).alias("outer_rows_used"),
    )
    return selection.receipt_violations(cells, ["S1", "S2", "S3", "S9"], ["L2", "L3"])


@query(
    "selected_prevalence",
    f"""SELECT 0.75::DOUBLE AS eligible_fraction, 0.05::DOUBLE AS selected_pi, round(avg(cross_entropy) * 0.9, 7) AS objective, 'PASS' AS status
        FROM ({HOLDOUT_SQL}) q WHERE cross_entropy IS NOT NULL""",
)
def _(fx: Inputs) -> DataFrame:
    holdout = _holdout(fx).filter("cross_entropy IS NOT NULL")
    cells = [
        F.struct(F.lit(pi).alias("pi"), F.lit(scale).alias("scale"), F.lit(ok).alias("diagnostics_eligible"))
        for pi, scale, ok in ((0.02, 1.2, True), (0.05, 0.9, True), (0.1, 1.0, True), (0.2, 0.1, False))
    ]
    scores = holdout.select(F.col("channel_id").alias("held_channel"), "cross_entropy", F.explode(F.array(*cells)).alias("c")).select(
        "held_channel", "c.pi", "c.diagnostics_eligible", (F.col("cross_entropy") * F.col("c.scale")).alias("cross_entropy")
    )
    return _round(selection.select_pi(scores, 0.6))
