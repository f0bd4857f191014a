"""Risk set, labels, posteriors and observability."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators import evidence, labels, observability, posterior, riskset
from paneloom.plans.bindings import Inputs, query

CUTOFF = "2000-06-30 00:00:00"
KEY = ["entity_id", "period"]

# ------------------------------------------------------------- risk set

FLAGS_SQL = """
    SELECT *, true AS eligible, anchor <= TIMESTAMP '2000-06-30 00:00:00' AS annual_mature, period + 1 AS required_year,
           period + 1 <= 2000 AND period + 1 <> 1998 AS next_mature FROM fx_panel"""


def _flags(fx: Inputs) -> DataFrame:
    return riskset.maturity_flags(fx("fx_panel"), CUTOFF, 2000, (1998,))


def _risk(fx: Inputs) -> DataFrame:
    return riskset.primary_maturity(_flags(fx), "L1_REPORTING")


RISK_SQL = f"""
    SELECT *, annual_mature AND next_mature AS mature,
           CASE WHEN annual_mature AND next_mature THEN 'ANNUAL_AND_NEXT_MATURE' ELSE 'ANNUAL_AND_NEXT_MATURE_INCOMPLETE' END
             AS maturity_status FROM ({FLAGS_SQL}) f"""


@query("maturity_flags", FLAGS_SQL)
def _(fx: Inputs) -> DataFrame:
    return _flags(fx)


@query(
    "horizon_maturity",
    "SELECT *, anchor + INTERVAL 18 MONTH <= TIMESTAMP '2000-06-30 00:00:00' AS mature FROM fx_panel",
)
def _(fx: Inputs) -> DataFrame:
    return riskset.horizon_mature(fx("fx_panel"), 18, CUTOFF)


@query(
    "primary_maturity",
    f"""SELECT target, maturity_status, mature, count(*) AS n FROM (
          SELECT 'L1_REPORTING' AS target, maturity_status, mature FROM ({RISK_SQL}) a
          UNION ALL SELECT 'BROAD', CASE WHEN next_mature THEN 'NEXT_PERIOD_MATURE' ELSE 'NEXT_PERIOD_MATURE_INCOMPLETE' END,
                           next_mature FROM ({FLAGS_SQL}) b
          UNION ALL SELECT 'L1_ANNUAL', CASE WHEN annual_mature THEN 'ANNUAL_MEASUREMENT_MATURE'
                           ELSE 'ANNUAL_MEASUREMENT_MATURE_INCOMPLETE' END, annual_mature FROM ({FLAGS_SQL}) c
          UNION ALL SELECT 'none', 'PRIMARY_TARGET_NOT_LOCKED', false FROM ({FLAGS_SQL}) d) u GROUP BY 1, 2, 3""",
)
def _(fx: Inputs) -> DataFrame:
    flags = _flags(fx)
    whole = None
    for target in ("L1_REPORTING", "BROAD", "L1_ANNUAL", None):
        part = riskset.primary_maturity(flags, target).select(
            F.lit(target or "none").alias("target"), "maturity_status", "mature"
        )
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("target", "maturity_status", "mature").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prospective_split",
    f"""SELECT CASE WHEN mature THEN 'retrospective' ELSE 'prospective' END AS risk_side, period, count(*) AS n
        FROM ({RISK_SQL}) r GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return riskset.split_prospective(_risk(fx)).groupBy("risk_side", "period").agg(F.count(F.lit(1)).alias("n"))


@query(
    "censoring_registry",
    f"""SELECT entity_id, period, CASE WHEN mature THEN 'complete_mature_followup' ELSE maturity_status END AS classification,
               mature AS retrospective, false AS assigned_negative FROM ({RISK_SQL}) r""",
)
def _(fx: Inputs) -> DataFrame:
    return riskset.censoring_registry(_risk(fx))


@query(
    "maturity_counts",
    """SELECT months, count_if(anchor + months * INTERVAL 1 MONTH <= TIMESTAMP '2000-06-30 00:00:00') AS mature_count
       FROM fx_panel CROSS JOIN (VALUES (6), (12), (24)) h(months) GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    return riskset.maturity_counts(fx("fx_panel"), [12, 6, 24, 12], CUTOFF)


CURVES_SQL = """
    SELECT source_id, channel_id, months, count(*) AS event_count, count_if(availability < anchor) AS pre_anchor_count,
           count_if(lag < 0) AS negative_lag_count, count_if(availability = anchor) AS same_moment_count,
           count_if(availability > anchor) AS future_count, count_if(availability > cut) AS post_cutoff_count,
           count_if(availability > anchor AND availability <= anchor + months * INTERVAL 1 MONTH AND availability <= cut)
             AS in_horizon_count,
           count_if(availability > anchor + months * INTERVAL 1 MONTH AND availability <= cut) AS post_horizon_count,
           quantile_cont(lag, 0.5) AS median_lag_days,
           count_if(availability > anchor AND availability <= anchor + months * INTERVAL 1 MONTH AND availability <= cut)
             * 1.0 / count(*) AS in_horizon_fraction
    FROM (SELECT e.*, anchor, TIMESTAMP '2024-01-25 00:00:00' AS cut,
                 CAST(floor((epoch_us(availability) - epoch_us(anchor)) / 86400000000.0) AS DOUBLE) AS lag
          FROM fx_events e JOIN fx_event_panel p ON p.entity_id = e.entity_id AND p.period = e.period) x
    CROSS JOIN (VALUES (1), (3)) h(months) GROUP BY 1, 2, 3"""


@query("maturity_curves", CURVES_SQL)
def _(fx: Inputs) -> DataFrame:
    return riskset.maturity_curves(fx("fx_event_panel"), fx("fx_events"), [1, 3], "2024-01-25 00:00:00")


@query(
    "annual_availability",
    """SELECT source_id, channel_id, count(*) AS record_count, count_if(availability = anchor) AS at_anchor_count,
              count_if(availability IS DISTINCT FROM anchor) AS anchor_mismatch_count,
              count_if(opportunity) AS opportunity_true_count, count_if(NOT opportunity) AS opportunity_false_count,
              count_if(opportunity IS NULL) AS opportunity_unknown_count,
              list_sort(list_distinct(list(CASE WHEN row_included THEN 'anchor' ELSE 'late' END))) AS availability_bases
       FROM fx_records r JOIN fx_doc_panel p ON p.entity_id = r.entity_id AND p.period = r.period
       WHERE role = 'annual_at_anchor' GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    basis = F.when(F.col("row_included"), "anchor").otherwise("late")
    return riskset.annual_availability(fx("fx_doc_panel"), fx("fx_records").withColumn("availability_basis", basis))


@query(
    "maturity_audit",
    f"""SELECT count(*) AS row_count, count_if(eligible) AS eligible_count, count_if(mature) AS mature_count,
               count_if(NOT mature) AS prospective_count, count_if(annual_mature) AS annual_mature_count,
               count_if(next_mature) AS next_mature_count, CAST(0 AS BIGINT) AS assigned_negative_count FROM ({RISK_SQL}) r""",
)
def _(fx: Inputs) -> DataFrame:
    return riskset.maturity_audit(_risk(fx))


# ------------------------------------------------------------- labels

SOURCES = [
    {"source_id": "quality", "channel_id": "S1", "role": evidence.ANNUAL, "zero_allowed": True},
    {"source_id": "toxic", "channel_id": "S2", "role": evidence.ANNUAL, "zero_allowed": True},
    {"source_id": "lang", "channel_id": "S3", "role": evidence.NEXT, "zero_allowed": True},
    {"source_id": "appeal", "channel_id": "S2", "role": evidence.DELAYED, "zero_allowed": False},
]
TARGETS = {"L1": ["quality", "toxic", "lang"], "L1_ANNUAL": ["quality", "toxic"], "L1_LATE": ["lang", "appeal"]}

ADMITTED_SQL = """
    SELECT entity_id, period, record_id, source_id, outcome, opportunity,
           CAST(CASE WHEN role = 'annual_at_anchor' THEN 0 ELSE floor((epoch_us(availability) - epoch_us(anchor)) / 86400000000.0)
                END AS INT) AS lag_days,
           CASE WHEN role = 'annual_at_anchor' AND availability IS DISTINCT FROM anchor THEN 'ANNUAL_NOT_AT_ANCHOR'
                WHEN role = 'delayed_verification' AND availability IS NULL THEN 'DELAYED_WITHOUT_DATE'
                WHEN source_id = 'appeal' AND outcome = false THEN 'ZERO_NOT_ALLOWED' END AS violation
    FROM (SELECT r.*, k.anchor FROM fx_records r JOIN fx_risk k ON k.entity_id = r.entity_id AND k.period = r.period) j
    WHERE role <> 'delayed_verification' OR availability IS NULL
          OR (availability > anchor AND availability <= anchor + INTERVAL 12 MONTH)"""
L0_SQL = f"""
    SELECT g.*, outcome, opportunity, CASE WHEN outcome THEN lag_true WHEN NOT outcome THEN lag_false END AS lag_days,
           CASE WHEN g.mature AND g.eligible THEN outcome END AS label
    FROM (SELECT k.entity_id, k.period, s.source_id, s.channel_id, s.role, k.eligible,
                 CASE s.role WHEN 'annual_at_anchor' THEN annual_mature WHEN 'next_period' THEN next_mature ELSE mature END AS mature
          FROM fx_risk k CROSS JOIN (VALUES ('quality', 'S1', 'annual_at_anchor'), ('toxic', 'S2', 'annual_at_anchor'),
               ('lang', 'S3', 'next_period'), ('appeal', 'S2', 'delayed_verification')) s(source_id, channel_id, role)) g
    LEFT JOIN (SELECT entity_id, period, source_id,
                      CASE WHEN bool_or(outcome) THEN true WHEN count_if(outcome = false AND opportunity) = count(*) THEN false END
                        AS outcome,
                      CASE WHEN bool_or(opportunity) THEN true WHEN count(opportunity) = count(*) THEN false END AS opportunity,
                      min(lag_days) FILTER (outcome) AS lag_true, min(lag_days) FILTER (NOT outcome) AS lag_false
               FROM ({ADMITTED_SQL}) a WHERE violation IS NULL GROUP BY 1, 2, 3) e
      ON e.entity_id = g.entity_id AND e.period = g.period AND e.source_id = g.source_id"""
TARGET_ROWS = "(VALUES ('L1', 'quality', 3), ('L1', 'toxic', 3), ('L1', 'lang', 3), ('L1_ANNUAL', 'quality', 2), ('L1_ANNUAL', 'toxic', 2), ('L1_LATE', 'lang', 2), ('L1_LATE', 'appeal', 2)) t(target_id, need, n)"
TARGET_SQL = f"""
    SELECT entity_id, period, target_id, bool_and(eligible) AS eligible, bool_and(mature) AS mature,
           CASE WHEN bool_and(mature) AND bool_and(eligible) THEN CASE WHEN bool_or(outcome) THEN true
                WHEN count_if(outcome = false AND opportunity) = max(n) THEN false END END AS outcome
    FROM ({L0_SQL}) l JOIN {TARGET_ROWS} ON need = source_id GROUP BY 1, 2, 3"""
CHANNEL_SQL = f"""
    SELECT entity_id, period, channel_id,
           CASE WHEN bool_or(outcome) THEN true WHEN count_if(outcome = false AND opportunity) = count(*) THEN false END AS outcome,
           CASE WHEN bool_or(opportunity) THEN true WHEN count(opportunity) = count(*) THEN false END AS opportunity,
           bool_and(eligible) AS eligible, bool_and(mature) AS mature FROM ({L0_SQL}) l GROUP BY 1, 2, 3"""


def _admitted(fx: Inputs) -> DataFrame:
    return labels.admit_events(fx("fx_risk"), fx("fx_records"), SOURCES, 12)


def _l0(fx: Inputs) -> DataFrame:
    return labels.source_outcomes(fx("fx_risk"), _admitted(fx), SOURCES)


def _targets(fx: Inputs) -> DataFrame:
    return labels.candidate_targets(_l0(fx), TARGETS)


@query("admitted_events", ADMITTED_SQL)
def _(fx: Inputs) -> DataFrame:
    return _admitted(fx)


@query(
    "opportunity_aggregate",
    f"""SELECT source_id, opportunity, count(*) AS n FROM ({L0_SQL}) l GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return _l0(fx).groupBy("source_id", "opportunity").agg(F.count(F.lit(1)).alias("n"))


@query("source_labels", f"SELECT * FROM ({L0_SQL}) l")
def _(fx: Inputs) -> DataFrame:
    return _l0(fx)


@query(
    "union_labels",
    f"SELECT entity_id, period, outcome FROM ({TARGET_SQL}) t WHERE target_id = 'L1'",
)
def _(fx: Inputs) -> DataFrame:
    return _targets(fx).filter("target_id = 'L1'").select(*KEY, "outcome")


@query(
    "matching_lags",
    f"SELECT source_id, outcome, count(lag_days) AS n, min(lag_days) AS low, max(lag_days) AS high FROM ({L0_SQL}) l GROUP BY 1, 2",
)
def _(fx: Inputs) -> DataFrame:
    return (
        _l0(fx)
        .groupBy("source_id", "outcome")
        .agg(F.count("lag_days").alias("n"), F.min("lag_days").alias("low"), F.max("lag_days").alias("high"))
    )


@query("candidate_targets", TARGET_SQL)
def _(fx: Inputs) -> DataFrame:
    return _targets(fx)


@query("sealed_outcomes", f"SELECT entity_id, period, target_id, outcome FROM ({TARGET_SQL}) t WHERE outcome IS NOT NULL")
def _(fx: Inputs) -> DataFrame:
    return labels.sealed_outcomes(_targets(fx))


@query("channel_outcomes", f"SELECT entity_id, period, channel_id, outcome, opportunity FROM ({CHANNEL_SQL}) c")
def _(fx: Inputs) -> DataFrame:
    return labels.channel_outcomes(_l0(fx), [s["source_id"] for s in SOURCES])


QUALITY = {"quality": 0.9, "toxic": 0.8, "lang": 0.5, "appeal": 1.0}
SCORE_SQL = f"""
    SELECT entity_id, period, channel_id,
           avg(CASE WHEN outcome IS NOT NULL AND lag_days IS NOT NULL THEN CAST(outcome AS INT) * q
               * power(2.0, -greatest(0, lag_days) / 180.0) END) AS channel_score
    FROM ({L0_SQL}) l JOIN (VALUES ('quality', CAST(0.9 AS DOUBLE)), ('toxic', 0.8), ('lang', 0.5), ('appeal', 1.0)) q(s, q)
      ON s = source_id GROUP BY 1, 2, 3"""


def _scores(fx: Inputs) -> DataFrame:
    return labels.l2_channel_scores(_l0(fx), QUALITY, 180.0)


@query("channel_scores", f"SELECT entity_id, period, channel_id, round(channel_score, 9) AS channel_score FROM ({SCORE_SQL}) s")
def _(fx: Inputs) -> DataFrame:
    return _scores(fx).withColumn("channel_score", F.round("channel_score", 9))


@query(
    "evidence_scores",
    f"""SELECT entity_id, period, round(avg(channel_score), 9) AS l2_score, count(channel_score) AS observed_channel_count
        FROM ({SCORE_SQL}) s GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return labels.l2_score(_scores(fx)).withColumn("l2_score", F.round("l2_score", 9))


@query(
    "matrix_rows",
    f"""SELECT entity_id, period, bool_and(eligible) AS eligible, bool_and(mature) AS mature,
               count(outcome) AS observed_source_count,
               CAST(count(DISTINCT channel_id) FILTER (outcome IS NOT NULL) AS INT) AS observed_channel_count,
               count_if(outcome) AS positive_source_count, count_if(NOT outcome) AS observed_zero_source_count,
               count_if(outcome IS NULL) AS unknown_source_count, count_if(opportunity) AS opportunity_count,
               count_if(NOT opportunity) AS opportunity_absent_count, count_if(opportunity IS NULL) AS opportunity_unknown_count,
               list_sort(coalesce(list(source_id) FILTER (outcome), [])) AS positive_sources
        FROM ({L0_SQL}) l GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    rows = labels.matrix_rows(_l0(fx))
    positive = F.map_keys(F.map_filter("source_outcomes", lambda _, v: F.coalesce(v, F.lit(False))))
    return rows.withColumn("positive_sources", F.array_sort(positive)).drop("source_outcomes", "source_opportunities")


@query(
    "channel_capability",
    f"""SELECT list_sort(list_distinct(list(channel_id) FILTER (outcome IS NOT NULL))) AS valid_channels,
               CAST(count(DISTINCT channel_id) FILTER (outcome IS NOT NULL) AS INT) AS channel_count,
               true AS strict_holdout_possible, 'AVAILABLE' AS status, 'AVAILABLE' AS anchor_status FROM ({CHANNEL_SQL}) c""",
)
def _(fx: Inputs) -> DataFrame:
    channels = labels.channel_outcomes(_l0(fx), [s["source_id"] for s in SOURCES])
    return labels.channel_capability(channels, ["lang"], [s["source_id"] for s in SOURCES])


@query(
    "measurement_variables",
    f"""SELECT concat('L0:', source_id) AS variable_id, 'single_source_benchmark' AS role, count(outcome) AS labelled
        FROM ({L0_SQL}) l GROUP BY 1
        UNION ALL SELECT target_id, 'candidate_binary_aggregation', count(outcome) FROM ({TARGET_SQL}) t GROUP BY 1
        UNION ALL SELECT 'L2', 'observed_channel_normalized_score', count(channel_score) FROM ({SCORE_SQL}) s""",
)
def _(fx: Inputs) -> DataFrame:
    registered = labels.variable_registry(fx.spark, SOURCES, TARGETS)
    l0 = _l0(fx).groupBy(F.concat(F.lit("L0:"), "source_id").alias("variable_id"))
    counts = l0.agg(F.count("outcome").alias("labelled"))
    counts = counts.unionByName(
        _targets(fx).groupBy(F.col("target_id").alias("variable_id")).agg(F.count("outcome").alias("labelled"))
    ).unionByName(_scores(fx).agg(F.count("channel_score").alias("labelled")).withColumn("variable_id", F.lit("L2")))
    return registered.join(counts, "variable_id").select("variable_id", "role", "labelled")


ROLES = {2015: "initial", 2016: "nested", 2017: "nested", 2018: "nested", 2019: "nested", 2021: "prospective"}
ELIGIBILITY_SQL = f"""
    SELECT *, CASE WHEN configured_role IN ('initial', 'prospective') THEN concat(configured_role, '_separate')
                   WHEN NOT both_classes THEN 'descriptive' WHEN positive_count >= 60 THEN 'confirmatory'
                   WHEN positive_count BETWEEN 20 AND 59 THEN 'sensitivity' ELSE 'descriptive' END AS assigned_role,
           CASE WHEN configured_role IN ('initial', 'prospective') THEN coalesce(classes, 'NONCONFIRMATORY_FOLD_ROLE')
                WHEN NOT both_classes THEN classes WHEN positive_count >= 60 THEN NULL
                WHEN positive_count BETWEEN 20 AND 59 THEN 'POSITIVE_COUNT_BELOW_CONFIRMATORY' ELSE 'INSUFFICIENT_POSITIVES'
                END AS reason
    FROM (SELECT *, labelled_count - positive_count AS observed_zero_count, mature_count - labelled_count AS unknown_count,
                 positive_count > 0 AND labelled_count > positive_count AS both_classes,
                 mature_count < labelled_count AS violation,
                 CASE WHEN positive_count > 0 AND labelled_count > positive_count THEN NULL
                      WHEN labelled_count = 0 THEN 'NO_OBSERVED_BINARY_CLASSES'
                      WHEN positive_count = 0 THEN 'POSITIVE_CLASS_MISSING' ELSE 'ZERO_CLASS_MISSING' END AS classes
          FROM (SELECT g.target_id, g.period, g.configured_role, coalesce(eligible_count, 0) AS eligible_count,
                       coalesce(mature_count, 0) AS mature_count, coalesce(labelled_count, 0) AS labelled_count,
                       coalesce(positive_count, 0) AS positive_count
                FROM (SELECT DISTINCT target_id, y AS period, configured_role FROM {TARGET_ROWS}
                      CROSS JOIN (VALUES (2015, 'initial'), (2016, 'nested'), (2017, 'nested'), (2018, 'nested'),
                                  (2019, 'nested'), (2021, 'prospective')) r(y, configured_role)) g
                LEFT JOIN (SELECT target_id, period, count_if(eligible) AS eligible_count,
                                  count_if(eligible AND mature) AS mature_count, count(outcome) AS labelled_count,
                                  count_if(outcome) AS positive_count FROM ({TARGET_SQL}) t GROUP BY 1, 2) c
                  ON c.target_id = g.target_id AND c.period = g.period) a) b"""


def _eligibility(fx: Inputs) -> DataFrame:
    return labels.fold_eligibility(_targets(fx), ROLES, 60, (20, 59))


@query("fold_eligibility", f"SELECT * EXCLUDE (classes) FROM ({ELIGIBILITY_SQL}) q")
def _(fx: Inputs) -> DataFrame:
    return _eligibility(fx)


@query(
    "fold_blockers",
    f"""SELECT target_id, y AS period, list_filter([
               CASE WHEN f.period IS NOT NULL AND observed_zero_count <= 0 THEN 'EXPLICIT_ZERO_CLASS_MISSING' END,
               CASE WHEN f.period IS NULL THEN 'FOLD_ELIGIBILITY_BINDING_MISSING' END,
               CASE WHEN assigned_role <> 'confirmatory' THEN 'FOLD_ROLE_NOT_CONFIRMATORY' END,
               CASE WHEN positive_count <= 0 THEN 'POSITIVE_CLASS_MISSING' END,
               CASE WHEN NOT both_classes THEN 'TWO_OBSERVED_CLASSES_REQUIRED' END], lambda x: x IS NOT NULL) AS blockers
        FROM (SELECT 'L1_ANNUAL' AS target_id, y FROM (VALUES (2016), (2017), (2020), (2021)) w(y)) w
        LEFT JOIN (SELECT * EXCLUDE (target_id) FROM ({ELIGIBILITY_SQL}) e WHERE target_id = 'L1_ANNUAL') f ON f.period = y""",
)
def _(fx: Inputs) -> DataFrame:
    return labels.fold_blockers(_eligibility(fx), [2016, 2017, 2020, 2021], "L1_ANNUAL")


@query(
    "soft_targets",
    f"""SELECT entity_id, period, CASE WHEN n >= 2 THEN round(s, 9) END AS target_value, true AS in_range
        FROM (SELECT entity_id, period, avg(channel_score) AS s, count(channel_score) AS n FROM ({SCORE_SQL}) c GROUP BY 1, 2) q""",
)
def _(fx: Inputs) -> DataFrame:
    return labels.target_frame(labels.l2_score(_scores(fx)), "l2_score", 2).withColumn(
        "target_value", F.round("target_value", 9)
    )


@query(
    "fold_soft_targets",
    f"""SELECT entity_id, period, round(s * 1.3, 9) AS target_value,
               CASE WHEN period >= 2019 THEN 'OUTER_OR_FUTURE_ROW' WHEN s * 1.3 > 1 THEN 'OUTSIDE_UNIT_INTERVAL' END AS violation
        FROM (SELECT entity_id, period, avg(channel_score) AS s FROM ({SCORE_SQL}) c GROUP BY 1, 2) q WHERE s IS NOT NULL""",
)
def _(fx: Inputs) -> DataFrame:
    rows = labels.l2_score(_scores(fx)).filter("l2_score IS NOT NULL")
    frame = labels.fold_target_frame(rows.select(*KEY, (F.col("l2_score") * 1.3).alias("target_value")), 2019)
    return frame.withColumn("target_value", F.round("target_value", 9))


# ------------------------------------------------------------- posteriors

ACCURACY = {"quality": (0.8, 0.95), "toxic": (0.6, 0.99), "lang": (0.7, 0.9)}
CHANNELS = {"quality": "S1", "toxic": "S1", "lang": "S3"}
SD = {"S1": 0.8, "S3": 0.4}
ACC_ROWS = "(VALUES " + ", ".join(
    f"('{s}', {math.log(se / (1 - sp))!r}, {math.log((1 - se) / sp)!r}, {se!r}, {sp!r})" for s, (se, sp) in ACCURACY.items()
) + ") acc(s, yes, no, se, sp)"


def _posterior_sql(pi: float) -> str:
    return f"""
        SELECT entity_id, period, 1 / (1 + exp(-greatest(-35.0, least(35.0, {math.log(pi / (1 - pi))!r}
               + coalesce(sum(CASE WHEN outcome THEN yes WHEN NOT outcome THEN no END), 0))))) AS posterior
        FROM fx_matrix JOIN {ACC_ROWS} ON s = source_id GROUP BY 1, 2"""


@query(
    "posterior_fixed_prevalence",
    f"SELECT entity_id, period, round(posterior, 9) AS posterior FROM ({_posterior_sql(0.1)}) q",
)
def _(fx: Inputs) -> DataFrame:
    return posterior.posterior_fixed_pi(fx("fx_matrix"), ACCURACY, 0.1).withColumn("posterior", F.round("posterior", 9))


_NODES, _WEIGHTS = np.polynomial.hermite.hermgauss(20)
NODE_ROWS = "(VALUES " + ", ".join(
    f"({float(math.sqrt(2) * n)!r}::DOUBLE, {float(w / math.sqrt(math.pi))!r}::DOUBLE)" for n, w in zip(_NODES, _WEIGHTS, strict=True)
) + ") nodes(n, w)"
QUADRATURE_ROWS = "(VALUES " + ", ".join(
    f"('{s}', '{CHANNELS[s]}', {SD[CHANNELS[s]]!r}::DOUBLE, {math.log(se / (1 - se))!r}::DOUBLE, {math.log((1 - sp) / sp)!r}::DOUBLE)"
    for s, (se, sp) in ACCURACY.items()
) + ") qs(s, ch, sd, l1, l0)"
QUADRATURE_SQL = f"""
    SELECT entity_id, period, 1 / (1 + exp(-({math.log(0.1 / 0.9)!r} + sum(ln(greatest(one, 1e-300)) - ln(greatest(zero, 1e-300))))))
             AS posterior
    FROM (SELECT entity_id, period, ch, coalesce(sum(w * one), 1.0) AS one, coalesce(sum(w * zero), 1.0) AS zero
          FROM (SELECT entity_id, period, ch, w,
                       product(CASE WHEN outcome THEN p1 ELSE 1 - p1 END) AS one,
                       product(CASE WHEN outcome THEN p0 ELSE 1 - p0 END) AS zero
                FROM (SELECT m.entity_id, m.period, ch, w, n, outcome, 1 / (1 + exp(-(l1 + sd * n))) AS p1,
                             1 / (1 + exp(-(l0 + sd * n))) AS p0
                      FROM fx_matrix m JOIN {QUADRATURE_ROWS} ON s = source_id CROSS JOIN {NODE_ROWS}
                      WHERE outcome IS NOT NULL) a GROUP BY entity_id, period, ch, w, n) b GROUP BY 1, 2, 3) c GROUP BY 1, 2"""


@query(
    "posterior_quadrature",
    f"""SELECT k.entity_id, k.period, round(coalesce(posterior, 0.1), 8) AS posterior
        FROM (SELECT DISTINCT entity_id, period FROM fx_matrix) k LEFT JOIN ({QUADRATURE_SQL}) q
          ON q.entity_id = k.entity_id AND q.period = k.period""",
)
def _(fx: Inputs) -> DataFrame:
    return posterior.posterior_quadrature(fx("fx_matrix"), CHANNELS, ACCURACY, SD, 0.1).withColumn(
        "posterior", F.round("posterior", 8)
    )


@query(
    "posterior_grid_mean",
    f"""SELECT entity_id, period, round(avg(posterior), 9) AS posterior_mean
        FROM ({_posterior_sql(0.05)} UNION ALL {_posterior_sql(0.1)}) q GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    whole = None
    for pi in (0.05, 0.1, 0.3):
        part = posterior.posterior_fixed_pi(fx("fx_matrix"), ACCURACY, pi).withColumn("pi", F.lit(pi))
        whole = part if whole is None else whole.unionByName(part)
    return posterior.posterior_grid_mean(whole, [0.05, 0.1]).withColumn("posterior_mean", F.round("posterior_mean", 9))


GRID = [float(x) for x in np.linspace(0.001, 0.5, 500)]
PATTERN_SQL = """
    SELECT count(*) AS n, quality, toxic, lang,
           CASE WHEN quality THEN 0.8 WHEN NOT quality THEN 0.2 ELSE 1.0 END * CASE WHEN toxic THEN 0.6 WHEN NOT toxic THEN 0.4 ELSE 1.0 END
             * CASE WHEN lang THEN 0.7 WHEN NOT lang THEN 0.3 ELSE 1.0 END AS one,
           CASE WHEN quality THEN 0.05 WHEN NOT quality THEN 0.95 ELSE 1.0 END * CASE WHEN toxic THEN 0.01 WHEN NOT toxic THEN 0.99 ELSE 1.0 END
             * CASE WHEN lang THEN 0.1 WHEN NOT lang THEN 0.9 ELSE 1.0 END AS zero
    FROM (SELECT entity_id, period, bool_or(outcome) FILTER (source_id = 'quality') AS quality,
                 bool_or(outcome) FILTER (source_id = 'toxic') AS toxic, bool_or(outcome) FILTER (source_id = 'lang') AS lang
          FROM fx_matrix GROUP BY 1, 2) w GROUP BY quality, toxic, lang"""


@query(
    "prevalence_posterior",
    f"""WITH ll AS (SELECT pi, sum(n * ln(greatest(pi * one + (1 - pi) * zero, 1e-12))) AS l
                    FROM ({PATTERN_SQL}) p CROSS JOIN (SELECT 0.001 + i * (0.499 / 499) AS pi FROM range(500) r(i)) g GROUP BY 1),
             pp AS (SELECT pi, exp(l - (SELECT max(l) FROM ll)) AS m FROM ll),
             cc AS (SELECT pi, m / (SELECT sum(m) FROM pp) AS p, sum(m) OVER (ORDER BY pi) / (SELECT sum(m) FROM pp) AS c FROM pp)
        SELECT round(sum(pi * p), 7) AS estimate, round(min(pi) FILTER (c >= 0.025), 7) AS lower,
               round(min(pi) FILTER (c >= 0.975), 7) AS upper FROM cc""",
)
def _(fx: Inputs) -> DataFrame:
    wide = posterior.wide_outcomes(fx("fx_matrix"), list(ACCURACY))
    result = posterior.prevalence_posterior(posterior.independent_patterns(wide, ACCURACY), GRID)
    return result.select(*[F.round(c, 7).alias(c) for c in result.columns])


MODEL = posterior.PatternModel(
    {"anchor": (0.8, 0.95), "weak": (0.6, 0.85)}, pi=0.15, dependence=0.3, selective=0.2, anchor_verification=0.5,
    weak_verification=0.6, horizon_days=300.0, delay_mean_days=60.0,
)
VARIANTS = ("correct", "ignore_dependence", "wrong_fixed_pi", "clean_anchor")


def _pattern_rows(fx: Inputs) -> DataFrame:
    wide = posterior.wide_outcomes(fx("fx_matrix"), ["quality", "toxic"]).withColumnsRenamed(
        {"quality": "anchor", "toxic": "weak"}
    )
    docs = fx("documents").select(
        F.col("doc_id").cast("string").alias("entity_id"),
        ((F.col("n_chars") % 100) / 100).alias("risk"),
        (F.col("lang") != "en").cast("double").alias("truth"),
    )
    return wide.join(docs, "entity_id")


def _pattern_sql(variant: str) -> str:
    model = MODEL.variant(variant)
    ready = 1 - math.exp(-300.0 / 60.0)

    def likelihood(latent: bool) -> str:
        pa, pw = (model.accuracy[s][0] if latent else 1 - model.accuracy[s][1] for s in ("anchor", "weak"))
        both = model.dependence * min(pa, pw) + (1 - model.dependence) * pa * pw
        q = {s: f"greatest(0, least(1, {b + 0.15 * latent!r}::DOUBLE + 0.05 * risk))" for s, b in (("a", 0.5), ("w", 0.6))}
        return f"""greatest(1e-12, least(1.0, (CASE WHEN a IS NULL AND w IS NULL THEN 1.0 WHEN w IS NULL THEN CASE WHEN a THEN {pa!r} ELSE {1 - pa!r} END
            WHEN a IS NULL THEN CASE WHEN w THEN {pw!r} ELSE {1 - pw!r} END WHEN a AND w THEN {both!r}
            WHEN a THEN {pa - both!r} WHEN w THEN {pw - both!r} ELSE {1 - pa - pw + both!r} END)::DOUBLE *
            CASE WHEN a IS NOT NULL AND w IS NOT NULL THEN {ready!r}::DOUBLE * {q["a"]} * {q["w"]}
                 WHEN a IS NOT NULL THEN {ready!r}::DOUBLE * {q["a"]} * (1 - {q["w"]})
                 WHEN w IS NOT NULL THEN {ready!r}::DOUBLE * (1 - {q["a"]}) * {q["w"]}
                 ELSE {1 - ready!r}::DOUBLE + {ready!r}::DOUBLE * (1 - {q["a"]}) * (1 - {q["w"]}) END))"""

    return f"""SELECT entity_id, period, a, w, truth, '{variant}' AS variant, {model.pi!r}::DOUBLE AS pi,
                      greatest(1e-9, least(1 - 1e-9, {model.pi!r}::DOUBLE * {likelihood(True)} / ({model.pi!r}::DOUBLE * {likelihood(True)}
                      + {1 - model.pi!r}::DOUBLE * {likelihood(False)}))) AS p
               FROM (SELECT m.entity_id, m.period, bool_or(outcome) FILTER (source_id = 'quality') AS a,
                            bool_or(outcome) FILTER (source_id = 'toxic') AS w, max(n_chars % 100) / 100.0::DOUBLE AS risk,
                            CAST(max(lang) <> 'en' AS INT)::DOUBLE AS truth
                     FROM fx_matrix m JOIN documents d ON CAST(d.doc_id AS STRING) = m.entity_id GROUP BY 1, 2) z"""


@query(
    "pattern_variants",
    " UNION ALL ".join(f"SELECT entity_id, period, variant, round(p, 9) AS posterior FROM ({_pattern_sql(v)}) q" for v in VARIANTS),
)
def _(fx: Inputs) -> DataFrame:
    cells = F.array(
        *[
            F.struct(F.lit(v).alias("variant"), F.round(posterior.pattern_posterior(MODEL.variant(v), F.col("risk")), 9).alias("posterior"))
            for v in VARIANTS
        ]
    )
    return _pattern_rows(fx).select(*KEY, F.explode(cells).alias("v")).select(*KEY, "v.*")


def _metric_sql(variant: str) -> str:
    return f"""SELECT '{variant}' AS variant, round(avg((truth - p) * (truth - p)), 8) AS brier,
               round(avg((truth - p) * (truth - p)) - avg((truth - r) * (truth - r)), 8) AS brier_regret,
               round(-avg(truth * ln(p) + (1 - truth) * ln(1 - p)), 8) AS log_loss, round(avg(p - truth), 8) AS calibration_bias,
               round(var_samp(truth - p), 8) AS residual_variance, round(avg(p), 8) AS probability_mean,
               round(stddev_samp(p), 8) AS probability_sd, round(var_samp(truth - p) / var_samp(truth - l1), 8) AS size_ratio_vs_l1,
               round(var_samp(truth - p) / var_samp(truth - l2), 8) AS size_ratio_vs_l2,
               round(1 - var_samp(truth - p) / var_samp(truth - l1), 8) AS variance_reduction_vs_l1,
               round(1 - var_samp(truth - p) / var_samp(truth - l2), 8) AS variance_reduction_vs_l2
        FROM (SELECT v.*, c.p AS r, CASE WHEN coalesce(v.a, false) OR coalesce(v.w, false) THEN 1.0
                     WHEN v.a IS NOT NULL OR v.w IS NOT NULL THEN 0.0 ELSE 0.15 END::DOUBLE AS l1,
                     coalesce((coalesce(CAST(v.a AS INT), 0) + coalesce(CAST(v.w AS INT), 0))
                       / nullif(CAST(v.a IS NOT NULL AS INT) + CAST(v.w IS NOT NULL AS INT), 0)::DOUBLE, 0.15) AS l2
              FROM ({_pattern_sql(variant)}) v JOIN ({_pattern_sql("correct")}) c ON c.entity_id = v.entity_id) m"""


@query("posterior_quality", " UNION ALL ".join(_metric_sql(v) for v in VARIANTS))
def _(fx: Inputs) -> DataFrame:
    a, w = F.col("anchor"), F.col("weak")
    seen = a.isNotNull().cast("int") + w.isNotNull().cast("int")
    hits = F.coalesce(a.cast("int"), F.lit(0)) + F.coalesce(w.cast("int"), F.lit(0))
    rows = _pattern_rows(fx).select(
        "truth",
        posterior.pattern_posterior(MODEL, F.col("risk")).alias("reference"),
        F.when(hits > 0, 1.0).when(seen > 0, 0.0).otherwise(MODEL.pi).alias("l1_proxy"),
        F.coalesce(F.try_divide(hits, seen), F.lit(MODEL.pi)).alias("l2_proxy"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(v).alias("variant"), posterior.pattern_posterior(MODEL.variant(v), F.col("risk")).alias("posterior"))
                    for v in VARIANTS
                ]
            )
        ).alias("v"),
    ).select("truth", "reference", "l1_proxy", "l2_proxy", "v.*")
    result = posterior.posterior_metrics(rows, ["variant"])
    return result.select("variant", *[F.round(c, 8).alias(c) for c in result.columns if c != "variant"])


@query(
    "posterior_predictive_error",
    f"""SELECT round(max(abs(r - (0.1 * se + 0.9 * (1 - sp)))), 9) AS rate_error, CAST(sum(n) AS BIGINT) AS observed_count
        FROM (SELECT source_id, count(*) AS n, avg(CAST(outcome AS INT)) AS r FROM fx_matrix WHERE outcome IS NOT NULL GROUP BY 1) o
        JOIN {ACC_ROWS} ON s = source_id""",
)
def _(fx: Inputs) -> DataFrame:
    return posterior.ppc_rate_error(fx("fx_matrix"), ACCURACY, 0.1).withColumn("rate_error", F.round("rate_error", 9))


# ------------------------------------------------------------- observability


def _counters_sql(by: str, rows: str) -> str:
    return f"""
        SELECT *, eligible_count - opportunity_count - opportunity_absent_count AS opportunity_unknown_count,
               eligible_count - observed_count AS unknown_count, mature_count - mature_observed_count AS mature_unknown_count,
               positive_count / eligible_count AS positive_fraction, observed_count / eligible_count AS observed_fraction,
               mature_observed_count / nullif(mature_count, 0) AS mature_observed_fraction,
               CASE WHEN opportunity_count + opportunity_absent_count > 0 THEN opportunity_count / eligible_count END AS coverage_rate
        FROM (SELECT {by}, count(*) AS eligible_count, count_if(mature) AS mature_count, count_if(NOT mature) AS prospective_count,
                     count(outcome) AS observed_count, count_if(outcome IS NOT NULL AND mature) AS mature_observed_count,
                     count_if(outcome IS NOT NULL AND NOT mature) AS prospective_observed_count,
                     count_if(outcome) AS positive_count, count_if(NOT outcome) AS observed_zero_count,
                     count_if(opportunity) AS opportunity_count, count_if(NOT opportunity) AS opportunity_absent_count
              FROM ({rows}) r WHERE eligible GROUP BY 1) c"""


@query("source_observability", _counters_sql("source_id", L0_SQL))
def _(fx: Inputs) -> DataFrame:
    return observability.source_observability(_l0(fx))


@query("channel_observability", _counters_sql("channel_id", CHANNEL_SQL))
def _(fx: Inputs) -> DataFrame:
    return observability.channel_observability(_l0(fx))


WIDE_SQL = f"""
    SELECT entity_id, period, bool_and(mature) AS mature,
           string_agg(channel_id, '∩' ORDER BY channel_id) FILTER (outcome IS NOT NULL) AS seen,
           string_agg(channel_id, '∩' ORDER BY channel_id) FILTER (opportunity) AS open
    FROM ({CHANNEL_SQL}) c WHERE eligible GROUP BY 1, 2"""


@query(
    "channel_overlap",
    f"""SELECT basis, pattern AS channel_pattern, count(*) AS eligible_count, count_if(mature) AS mature_count,
               count_if(NOT mature) AS prospective_count
        FROM (SELECT 'observed_outcome' AS basis, coalesce(seen, 'NONE') AS pattern, mature FROM ({WIDE_SQL}) a
              UNION ALL SELECT 'observed_opportunity', coalesce(open, 'NONE'), mature FROM ({WIDE_SQL}) b) u GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return observability.channel_overlap(observability.channel_rows(_l0(fx)), ["S1", "S2", "S3"])


@query(
    "pair_overlap",
    f"""SELECT a.channel_id AS channel_a, b.channel_id AS channel_b,
               count_if(a.outcome IS NOT NULL AND b.outcome IS NOT NULL) AS outcome_overlap,
               count_if(a.opportunity AND b.opportunity) AS opportunity_overlap
        FROM ({CHANNEL_SQL}) a JOIN ({CHANNEL_SQL}) b
          ON a.entity_id = b.entity_id AND a.period = b.period AND a.channel_id < b.channel_id
        WHERE a.eligible GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return observability.pair_overlap(observability.channel_rows(_l0(fx)), ["S1", "S2", "S3"])


@query(
    "verification_classes",
    """SELECT channel_id, CASE max(rank) WHEN 2 THEN 'observed_verification' WHEN 1 THEN 'observed_opportunity_only' ELSE 'unknown' END
              AS verification
       FROM (SELECT o_orderpriority AS channel_id, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 2
                    WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS rank FROM orders) q
       GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    status = (
        F.when(F.expr("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"), "observed_verification")
        .when(F.expr("o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'"), "derived_from_audited_filings")
        .otherwise("high_confirmation")
    )
    rows = fx("orders").select(F.col("o_orderpriority").alias("channel_id"), status.alias("status"))
    return observability.channel_verification(rows)
