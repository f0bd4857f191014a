"""Ranking, calibration, bootstrap, utility and cost metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators import metrics, posterior
from paneloom.plans.bindings import Inputs, query

BY = ["model_id", "period"]
PAIRS = {"full": "observability_only"}

# rows in the order that every ranking metric uses
RANKED = """SELECT *, row_number() OVER (PARTITION BY model_id, period ORDER BY prediction DESC, entity_id) AS pos,
                   sum(CAST(outcome AS INT)) OVER (PARTITION BY model_id, period ORDER BY prediction DESC, entity_id
                     ROWS UNBOUNDED PRECEDING) AS hits,
                   count(*) OVER (PARTITION BY model_id, period) AS n FROM fx_scores"""
AP_SQL = f"""SELECT model_id, period, sum(CASE WHEN outcome THEN hits * 1.0 / pos END) / nullif(count_if(outcome), 0)
               AS average_precision FROM ({RANKED}) r GROUP BY 1, 2"""
AUC_SQL = """
    SELECT model_id, period, (sum(CASE WHEN outcome THEN r END) - count_if(outcome) * (count_if(outcome) + 1) / 2.0)
           / nullif(count_if(outcome) * count_if(NOT outcome), 0) AS roc_auc
    FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY model_id, period, prediction) - 1) / 2.0 AS r
          FROM fx_scores WINDOW w AS (PARTITION BY model_id, period ORDER BY prediction)) q GROUP BY 1, 2"""


def _round(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("average_precision", f"SELECT model_id, period, round(average_precision, 9) AS average_precision FROM ({AP_SQL}) q")
def _(fx: Inputs) -> DataFrame:
    return _round(metrics.average_precision(fx("fx_scores"), BY))


@query("roc_auc", f"SELECT model_id, period, round(roc_auc, 9) AS roc_auc FROM ({AUC_SQL}) q")
def _(fx: Inputs) -> DataFrame:
    return _round(metrics.roc_auc(fx("fx_scores"), BY))


# a lineitem-sized ranking: one model holds every row
@query(
    "roc_auc_large",
    """SELECT round((sum(CASE WHEN y THEN r END) - count_if(y) * (count_if(y) + 1) / 2.0)
                    / (count_if(y) * count_if(NOT y)), 9) AS roc_auc
       FROM (SELECT l_returnflag = 'R' AS y, rank() OVER (ORDER BY l_extendedprice)
                    + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS r FROM lineitem) q""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("lineitem").select(
        F.col("l_extendedprice").alias("prediction"), (F.col("l_returnflag") == "R").alias("outcome")
    )
    return _round(metrics.roc_auc(rows))


@query(
    "brier_score",
    """SELECT model_id, period, round(avg((CAST(outcome AS INT) - prediction) * (CAST(outcome AS INT) - prediction)), 9) AS brier
       FROM fx_scores GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(metrics.brier(fx("fx_scores"), BY))


@query(
    "precision_at_fraction",
    f"""SELECT model_id, period, CAST(max(greatest(1, ceil(n * 0.1))) AS BIGINT) AS review_count,
               round(count_if(outcome AND pos <= greatest(1, ceil(n * 0.1))) / max(greatest(1, ceil(n * 0.1))), 9) AS precision
        FROM ({RANKED}) r GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(metrics.precision_at(fx("fx_scores"), 0.1, BY))


@query(
    "scored_summary",
    f"""SELECT s.*, round(average_precision, 9) AS average_precision, round(roc_auc, 9) AS roc_auc
        FROM (SELECT model_id, period, count(*) AS row_count, count_if(outcome) AS positive_count,
                     round(avg((CAST(outcome AS INT) - prediction) * (CAST(outcome AS INT) - prediction)), 9) AS brier,
                     round(count_if(outcome AND pos <= greatest(1, ceil(n * 0.2))) / max(greatest(1, ceil(n * 0.2))), 9) AS precision_at
              FROM ({RANKED}) r GROUP BY 1, 2) s
        JOIN ({AP_SQL}) a ON a.model_id = s.model_id AND a.period = s.period
        JOIN ({AUC_SQL}) u ON u.model_id = s.model_id AND u.period = s.period""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(metrics.scored_summary(fx("fx_scores"), 0.2, BY))


@query(
    "paired_delta",
    f"""SELECT c.period, 'full' AS candidate, 'observability_only' AS reference, round(c.average_precision, 9) AS candidate_ap,
               round(r.average_precision, 9) AS reference_ap, round(c.average_precision - r.average_precision, 9) AS delta
        FROM ({AP_SQL}) c JOIN ({AP_SQL}) r ON c.period = r.period AND c.model_id = 'full' AND r.model_id = 'observability_only'""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(metrics.paired_delta(fx("fx_scores"), PAIRS, ["period"]))


DAMAGED = "(model_id = 'full' AND CAST(entity_id AS INT) % 10 = 0)"


@query(
    "pairing_audit",
    f"""SELECT 'full' AS candidate, 'observability_only' AS reference, count_if(l AND r) AS paired_count,
               count_if(NOT r) AS candidate_only_count, count_if(NOT l) AS reference_only_count,
               CAST(0 AS BIGINT) AS duplicate_count, 'PAIRED_COMPARISON_BLOCKED' AS status
        FROM (SELECT entity_id, bool_or(model_id = 'full') AS l, bool_or(model_id <> 'full') AS r FROM fx_scores
              WHERE NOT {DAMAGED} GROUP BY 1) q
        UNION ALL
        SELECT 'observability_only', 'gone', 0, count(*), 0, 0, 'PAIRED_COMPARISON_BLOCKED' FROM fx_scores
        WHERE model_id = 'observability_only'""",
)
def _(fx: Inputs) -> DataFrame:
    return metrics.pairing_audit(fx("fx_scores").filter(f"NOT {DAMAGED}"), {**PAIRS, "observability_only": "gone"})


# ------------------------------------------------------------- bootstrap

REPS = 40


def _draw(seed: str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({p} AS STRING)" for p in parts]])
    return f"CAST('0x' || substring(md5({text}), 1, 15) AS BIGINT)"


RESAMPLED = f"""
    SELECT s.model_id, s.entity_id, s.prediction, s.outcome, b.rep, b.times
    FROM fx_scores s JOIN (SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS unit
                           FROM (SELECT DISTINCT entity_id FROM fx_scores) k) u ON u.entity_id = s.entity_id
    JOIN (SELECT rep, {_draw("boot", "rep", "i")} % n AS unit, count(*) AS times
          FROM (SELECT count(*) AS n FROM (SELECT DISTINCT entity_id FROM fx_scores) k) z
          CROSS JOIN range({REPS}) r(rep) CROSS JOIN (SELECT row_number() OVER (ORDER BY entity_id) - 1 AS i
                           FROM (SELECT DISTINCT entity_id FROM fx_scores) k) d GROUP BY 1, 2) b ON b.unit = u.unit"""
COPIES = f"""
    SELECT model_id, rep, outcome, prediction, entity_id,
           row_number() OVER (PARTITION BY model_id, rep ORDER BY prediction DESC, entity_id, j) AS pos,
           sum(CAST(outcome AS INT)) OVER (PARTITION BY model_id, rep ORDER BY prediction DESC, entity_id, j
             ROWS UNBOUNDED PRECEDING) AS hits,
           count(*) OVER (PARTITION BY model_id, rep) AS n
    FROM (SELECT *, unnest(range(times)) AS j FROM ({RESAMPLED}) e) x"""
DELTA_SQL = f"""
    SELECT rep, max(ap) FILTER (model_id = 'full') - max(ap) FILTER (model_id <> 'full') AS delta
    FROM (SELECT model_id, rep, sum(CASE WHEN outcome THEN hits * 1.0 / pos END) / nullif(count_if(outcome), 0) AS ap
          FROM ({COPIES}) c GROUP BY 1, 2) a GROUP BY 1"""


@query(
    "bootstrap_multiplicities",
    f"SELECT rep, model_id, entity_id, times FROM ({RESAMPLED}) q",
)
def _(fx: Inputs) -> DataFrame:
    return metrics.bootstrap_rows(fx("fx_scores"), REPS, "boot").select("rep", "model_id", "entity_id", "times")


@query("bootstrap_delta", f"SELECT rep, round(delta, 9) AS delta FROM ({DELTA_SQL}) q")
def _(fx: Inputs) -> DataFrame:
    return _round(metrics.bootstrap_delta(fx("fx_scores"), "full", "observability_only", REPS, 0.95, "boot"))


@query(
    "bootstrap_interval",
    f"""SELECT count(delta) AS valid_replications, round(avg(delta), 8) AS mean, round(quantile_cont(delta, 0.025), 8) AS lower,
               round(quantile_cont(delta, 0.975), 8) AS upper FROM ({DELTA_SQL}) q""",
)
def _(fx: Inputs) -> DataFrame:
    samples = metrics.bootstrap_delta(fx("fx_scores"), "full", "observability_only", REPS, 0.95, "boot")
    return _round(metrics.interval(samples, "delta", 0.95), 8)


# ------------------------------------------------------------- soft target agreement

MODELS = ["full", "observability_only"]
TRACK = """SELECT model_id AS m, CAST(prediction AS DOUBLE) AS s, CAST(n_chars % 40 AS DOUBLE) / 40 AS t
           FROM fx_scores JOIN documents ON CAST(doc_id AS STRING) = entity_id"""


@query(
    "track_metrics",
    f"""WITH x AS ({TRACK}),
        l AS (SELECT m, round(-avg(t * ln(greatest(1e-9, least(1 - 1e-9, s))) + (1 - t) * ln(1 - greatest(1e-9, least(1 - 1e-9, s)))), 9) AS soft_log_loss FROM x GROUP BY 1),
        r AS (SELECT m, round(corr(rt, rs), 9) AS spearman FROM (SELECT m, rank() OVER (PARTITION BY m ORDER BY t) + (count(*) OVER (PARTITION BY m, t) - 1) / 2.0 AS rt,
                rank() OVER (PARTITION BY m ORDER BY s) + (count(*) OVER (PARTITION BY m, s) - 1) / 2.0 AS rs FROM x) q GROUP BY 1),
        p AS (SELECT a.m, CAST(count(*) AS DECIMAL(38, 0)) AS comparable_pairs, round(avg(CASE WHEN a.s < b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END), 9) AS concordance
              FROM x a JOIN x b ON a.m = b.m AND a.t < b.t GROUP BY 1)
        SELECT m AS model_id, soft_log_loss, spearman, comparable_pairs, concordance FROM l JOIN r USING (m) JOIN p USING (m)""",
)
def _(fx: Inputs) -> DataFrame:
    docs = fx("documents").select(
        F.col("doc_id").cast("string").alias("entity_id"), ((F.col("n_chars") % 40) / 40).alias("target_value")
    )
    rows, whole = fx("fx_scores").join(docs, "entity_id"), None
    for model in MODELS:
        part = metrics.track_metrics(rows.filter(F.col("model_id") == model)).withColumn("model_id", F.lit(model))
        whole = part if whole is None else whole.unionByName(part)
    return _round(whole)


# ------------------------------------------------------------- utility and cost

SCENARIOS = [
    {"scenario_id": "base", "true_positive_benefit": 10.0, "review_cost": 1.0, "false_positive_cost": 0.5,
     "false_negative_cost": 2.0, "review_fraction": 0.1},
    {"scenario_id": "tight", "true_positive_benefit": 6.0, "review_cost": 2.0, "false_positive_cost": 1.0,
     "false_negative_cost": 4.0, "review_fraction": 0.02},
]
SCENARIO_ROWS = "(VALUES ('base', 10.0::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE, 2.0::DOUBLE, 0.1::DOUBLE), ('tight', 6.0, 2.0, 1.0, 4.0, 0.02)) sc(scenario_id, ben, rev, fpc, fnc, frac)"


def _with_risk(fx: Inputs) -> DataFrame:
    docs = fx("documents").select(
        F.col("doc_id").cast("string").alias("entity_id"),
        F.array((F.col("n_chars") % 100) / 100, (F.col("n_chars") % 70) / 70).alias("draws"),
    )
    return fx("fx_scores").join(docs, "entity_id")


def _utility_sql(rows: str, by: str) -> str:
    return f"""
        SELECT {by}, scenario_id, CAST(max(k) AS BIGINT) AS reviewed_cases, sum(CASE WHEN pos <= k THEN risk ELSE 0 END) AS tp,
               sum(CASE WHEN pos <= k THEN 1 - risk ELSE 0 END) AS fp, sum(CASE WHEN pos > k THEN risk ELSE 0 END) AS fn,
               any_value(ben) * sum(CASE WHEN pos <= k THEN risk ELSE 0 END)
               - any_value(fpc) * sum(CASE WHEN pos <= k THEN 1 - risk ELSE 0 END)
               - any_value(fnc) * sum(CASE WHEN pos > k THEN risk ELSE 0 END) - any_value(rev) * max(k) AS net
        FROM (SELECT r.*, sc.*, least(n, greatest(1, ceil(n * frac))) AS k FROM ({rows}) r CROSS JOIN {SCENARIO_ROWS}) g
        GROUP BY {by}, scenario_id"""


POINT_ROWS = """SELECT s.model_id, row_number() OVER (PARTITION BY model_id ORDER BY prediction DESC, entity_id) AS pos,
                       count(*) OVER (PARTITION BY model_id) AS n,
                       (CAST(n_chars % 100 AS DOUBLE) / 100 + CAST(n_chars % 70 AS DOUBLE) / 70) / 2 AS risk
                FROM fx_scores s JOIN documents ON CAST(doc_id AS STRING) = entity_id"""


@query(
    "review_utility",
    f"""SELECT model_id, scenario_id, reviewed_cases, round(tp, 8) AS expected_true_positives,
               round(fp, 8) AS expected_false_positives, round(fn, 8) AS expected_false_negatives, round(net, 8) AS net_utility,
               'PASS' AS status FROM ({_utility_sql(POINT_ROWS, "model_id")}) q""",
)
def _(fx: Inputs) -> DataFrame:
    risk = F.aggregate("draws", F.lit(0.0), lambda a, x: a + x) / F.size("draws")
    return _round(metrics.utility(_with_risk(fx).withColumn("risk", risk).drop("draws"), SCENARIOS), 8)


SAMPLED_ROWS = f"""SELECT model_id, rep, pos, n, CASE WHEN {_draw("boot", "'draw'", "rep")} % 2 = 0
                          THEN CAST(n_chars % 100 AS DOUBLE) / 100 ELSE CAST(n_chars % 70 AS DOUBLE) / 70 END AS risk
                   FROM ({COPIES}) c JOIN documents ON CAST(doc_id AS STRING) = entity_id"""


@query(
    "utility_bootstrap",
    f"""SELECT 'full' AS candidate, 'observability_only' AS reference, scenario_id, count(net) AS valid_replications,
               round(quantile_cont(net, 0.05), 7) AS net_lower, round(quantile_cont(net, 0.95), 7) AS net_upper,
               round(quantile_cont(net - other, 0.05), 7) AS gain_lower, round(quantile_cont(net - other, 0.95), 7) AS gain_upper
        FROM (SELECT scenario_id, rep, max(net) FILTER (model_id = 'full') AS net, max(net) FILTER (model_id <> 'full') AS other
              FROM ({_utility_sql(SAMPLED_ROWS, "model_id, rep")}) u GROUP BY 1, 2) w GROUP BY 1, 2, 3""",
)
def _(fx: Inputs) -> DataFrame:
    rows = _with_risk(fx).withColumnRenamed("draws", "risk")
    return _round(metrics.utility_bootstrap(rows, SCENARIOS, PAIRS, 2, REPS, 0.9, "boot"), 7)


@query(
    "latent_risk_draws",
    """SELECT scenario_id, draw, entity_id, round(1 / (1 + exp(-(ln(pi / (1 - pi)) + coalesce(sum(CASE WHEN outcome THEN ln(se / (1 - sp))
              WHEN NOT outcome THEN ln((1 - se) / sp) END), 0)))), 7) AS risk
       FROM fx_matrix CROSS JOIN (VALUES ('low', 0, 0.05::DOUBLE), ('low', 1, 0.05), ('high', 0, 0.2), ('high', 1, 0.2)) sc(scenario_id, draw, pi)
       JOIN (VALUES (0, 'quality', 0.8::DOUBLE, 0.95::DOUBLE), (0, 'toxic', 0.6, 0.99), (0, 'lang', 0.7, 0.9), (1, 'quality', 0.7, 0.9),
             (1, 'toxic', 0.5, 0.97), (1, 'lang', 0.75, 0.85)) acc(d, s, se, sp) ON d = draw AND s = source_id
       GROUP BY scenario_id, draw, entity_id, pi""",
)
def _(fx: Inputs) -> DataFrame:
    draws = [
        {"accuracy": {"quality": (0.8, 0.95), "toxic": (0.6, 0.99), "lang": (0.7, 0.9)}, "sd": {"A": 0.0, "B": 0.0}},
        {"accuracy": {"quality": (0.7, 0.9), "toxic": (0.5, 0.97), "lang": (0.75, 0.85)}, "sd": {"A": 0.0, "B": 0.0}},
    ]
    wide = posterior.wide_outcomes(fx("fx_matrix"), ["quality", "toxic", "lang"])
    risks = posterior.latent_risk(
        wide, {"low": 0.05, "high": 0.2, "unfitted": 0.4}, {0.05: draws, 0.2: draws},
        {"quality": "A", "toxic": "A", "lang": "B"},
    )
    return _round(risks.select("scenario_id", "draw", "entity_id", "risk"), 7)


REGIMES = [
    {"regime_id": "cheap", "review_cost": 1.0, "false_positive_cost": 2.0, "false_negative_cost": 10.0, "true_positive_benefit": 3.0},
    {"regime_id": "dear", "review_cost": 5.0, "false_positive_cost": 1.0, "false_negative_cost": 4.0, "true_positive_benefit": 0.0},
]
REGIME_ROWS = "(VALUES ('cheap', 1.0::DOUBLE, 2.0::DOUBLE, 10.0::DOUBLE, 3.0::DOUBLE), ('dear', 5.0, 1.0, 4.0, 0.0)) rg(regime_id, rev, fpc, fnc, ben)"


@query(
    "threshold_cost",
    f"""SELECT model_id, regime_id, total AS total_cost, total / n AS cost_per_row, round((total - oracle) / greatest(abs(p * fnc - oracle), 1e-12), 9)
               AS normalized_regret, p * fnc - total AS savings_vs_none, total - oracle AS regret, (tp + fp) * rev AS review_component,
               fp * fpc AS false_positive_component, (p - tp) * fnc AS false_negative_component, tp * ben AS benefit_component
        FROM (SELECT *, (tp + fp) * rev + fp * fpc + (p - tp) * fnc - tp * ben AS total,
                     p * least(rev - ben, fnc) + (n - p) * least(rev + fpc, 0) AS oracle
              FROM (SELECT model_id, count(*) AS n, count_if(outcome) AS p, count_if(outcome AND prediction >= 0.6) AS tp,
                           count_if(NOT outcome AND prediction >= 0.6) AS fp FROM fx_scores GROUP BY 1) c CROSS JOIN {REGIME_ROWS}) t""",
)
def _(fx: Inputs) -> DataFrame:
    return metrics.threshold_cost(fx("fx_scores"), REGIMES, 0.6, ["model_id"]).withColumn(
        "normalized_regret", F.round("normalized_regret", 9)
    )


@query(
    "budget_cost",
    f"""SELECT model_id, fraction, regime_id, k AS review_count, total AS total_cost, total - oracle AS regret,
               round((total - oracle) / greatest(abs(p * fnc - oracle), 1e-12), 6) AS normalized_regret,
               p * fnc - total AS savings_vs_none, round(tp / k, 9) AS precision, round(tp / p, 9) AS recall
        FROM (SELECT *, k * rev + (k - tp) * fpc + (p - tp) * fnc - tp * ben AS total,
                     k * rev + (k - b) * fpc + (p - b) * fnc - b * ben AS oracle
              FROM (SELECT *, CASE WHEN fnc - rev + ben >= -rev - fpc THEN least(k, p) ELSE greatest(0, k - (n - p)) END AS b
                    FROM (SELECT model_id, fraction, n, k, count_if(outcome) AS p, count_if(outcome AND pos <= k) AS tp
                          FROM (SELECT model_id, outcome, row_number() OVER (PARTITION BY model_id ORDER BY prediction DESC, entity_id) AS pos,
                                       count(*) OVER (PARTITION BY model_id) AS n, fraction,
                                       CAST(greatest(1, ceil(count(*) OVER (PARTITION BY model_id) * fraction)) AS BIGINT) AS k
                                FROM (SELECT model_id, entity_id, outcome, prediction FROM fx_scores) s, (VALUES (1)) one(x),
                                     (SELECT 0.0 AS fraction WHERE false) z) e GROUP BY 1, 2, 3, 4) c CROSS JOIN {REGIME_ROWS}) o) t""".replace(
        """CAST(greatest(1, ceil(count(*) OVER (PARTITION BY model_id) * fraction)) AS BIGINT) AS k
                                FROM (SELECT model_id, entity_id, outcome, prediction FROM fx_scores) s, (VALUES (1)) one(x),
                                     (SELECT 0.0 AS fraction WHERE false) z)""",
        """CAST(greatest(1, ceil(n0 * fraction)) AS BIGINT) AS k
                                FROM (SELECT s.*, f.fraction, count(*) OVER (PARTITION BY s.model_id, f.fraction) AS n0
                                      FROM fx_scores s CROSS JOIN (VALUES (0.05::DOUBLE), (0.25::DOUBLE)) f(fraction)) s)""",
    )
    .replace("row_number() OVER (PARTITION BY model_id ORDER BY", "row_number() OVER (PARTITION BY model_id, fraction ORDER BY")
    .replace("count(*) OVER (PARTITION BY model_id) AS n, fraction,", "n0 AS n, fraction,"),
)
def _(fx: Inputs) -> DataFrame:
    result = metrics.budget_cost(fx("fx_scores"), [0.05, 0.25], REGIMES, ["model_id"])
    return result.select(
        *[F.round(c, 6 if c == "normalized_regret" else 9).alias(c) if c in ("normalized_regret", "precision", "recall") else F.col(c)
          for c in result.columns]
    )


@query(
    "cost_threshold",
    f"""WITH s AS (SELECT model_id AS i, prediction AS p, outcome AS y, 1.0 + CAST(entity_id AS INT) % 3 AS w FROM fx_scores),
             q AS (SELECT i, unnest(quantile_cont(p, [{", ".join(f"{i / 100!r}" for i in range(101))}])) AS c FROM s GROUP BY 1),
             g AS (SELECT r.*, i, greatest(0, least(1, (fpc + rev) / (fpc + fnc + ben))) AS bayes FROM {REGIME_ROWS.replace("rg(", "r(")} CROSS JOIN (SELECT DISTINCT i FROM s) d),
             c AS (SELECT regime_id, i, c AS t FROM g JOIN q USING (i) UNION SELECT regime_id, i, bayes FROM g UNION SELECT regime_id, i, v FROM g, (VALUES (0.0::DOUBLE), (0.5), (1.0)) f(v)),
             k AS (SELECT regime_id, i, t, any_value(bayes) AS bayes, sum(CASE WHEN p >= t THEN w * (rev + CASE WHEN y THEN -ben ELSE fpc END)
                          WHEN y THEN w * fnc ELSE 0 END) AS cost FROM c JOIN g USING (regime_id, i) JOIN s USING (i) GROUP BY 1, 2, 3),
             m AS (SELECT regime_id, i, min(cost) AS best FROM k GROUP BY 1, 2)
        SELECT i AS model_id, regime_id, round(arg_min(t, abs(t - bayes)), 9) AS threshold, true AS searched, round(min(cost), 6) AS cost
        FROM k JOIN m USING (regime_id, i) WHERE cost <= best + 1e-12 GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    rows, result = fx("fx_scores").withColumn("weight", 1.0 + F.col("entity_id").cast("int") % 3), None
    for model in MODELS:
        part = metrics.select_threshold(rows.filter(F.col("model_id") == model), REGIMES).withColumn("model_id", F.lit(model))
        result = part if result is None else result.unionByName(part)
    return result.withColumns({"threshold": F.round("threshold", 9), "cost": F.round("cost", 6)})


@query(
    "bayes_threshold",
    f"""SELECT regime_id, model_id, round(greatest(0, least(1, (fpc + rev) / (fpc + fnc + ben))), 9) AS bayes,
               count_if(prediction >= greatest(0, least(1, (fpc + rev) / (fpc + fnc + ben)))) AS flagged
        FROM fx_scores CROSS JOIN {REGIME_ROWS} GROUP BY 1, 2, 3""",
)
def _(fx: Inputs) -> DataFrame:
    grid = metrics.with_grid(fx("fx_scores"), REGIMES, metrics.COSTS).withColumn("bayes", metrics.bayes_threshold())
    return grid.groupBy("regime_id", "model_id", F.round("bayes", 9).alias("bayes")).agg(
        F.count_if(F.col("prediction") >= F.col("bayes")).alias("flagged")
    )
