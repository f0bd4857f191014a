"""Report tables, reconciliations and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators import evidence, labels, observability, reports
from paneloom.plans.bindings import Inputs, query
from paneloom.plans.evidence_queries import (
    CLUSTER_SQL,
    ENDPOINT_SQL,
    LEDGER_SQL,
    OPINION_SQL,
    PAIRS_SQL,
    _endpoints,
    _ledger,
    _opinions,
    _pairs,
)
from paneloom.plans.feature_queries import _round
from paneloom.plans.label_queries import (
    CHANNEL_SQL,
    ELIGIBILITY_SQL,
    L0_SQL,
    TARGET_SQL,
    _eligibility,
    _l0,
    _targets,
)

KEY = ["entity_id", "period"]
OUT = "count_if(outcome) AS positive, count_if(NOT outcome) AS observed_zero, count_if(outcome IS NULL) AS unknown"
OPP = "count_if(opportunity) AS opportunity_observed, count_if(NOT opportunity) AS opportunity_absent, count_if(opportunity IS NULL) AS opportunity_unknown"

RESULT_SQL = f"""
    SELECT 'pairs' AS section, item AS subject, CASE WHEN avg(CAST(outcome AS INT)) > 0.5 THEN 'PASS' ELSE 'FAIL' END AS verdict,
           round(avg(ratio), 6) AS value FROM ({PAIRS_SQL}) a GROUP BY 1, 2
    UNION ALL
    SELECT 'folds', target_id, CASE WHEN bool_or(assigned_role = 'confirmatory') THEN 'PASS' ELSE 'FAIL' END, NULL
    FROM ({ELIGIBILITY_SQL}) b GROUP BY 1, 2
    UNION ALL
    SELECT 'folds', 'amount', 'PASS', CAST(count(*) AS DOUBLE) FROM fx_panel"""


def _results(fx: Inputs) -> DataFrame:
    pairs = _pairs(fx).groupBy(F.lit("pairs").alias("section"), F.col("item").alias("subject")).agg(
        F.when(F.avg(F.col("outcome").cast("double")) > 0.5, "PASS").otherwise("FAIL").alias("verdict"), F.round(F.avg("ratio"), 6).alias("value")
    )
    folds = _eligibility(fx).groupBy(F.lit("folds").alias("section"), F.col("target_id").alias("subject")).agg(
        F.when(F.bool_or(F.col("assigned_role") == "confirmatory"), "PASS").otherwise("FAIL").alias("verdict")
    )
    size = fx("fx_panel").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("folds").alias("section"), F.lit("amount").alias("subject"), F.lit("PASS").alias("verdict"), "value"
    )
    return reports.final_ledger(pairs, folds, size)


@query("final_result_ledger", RESULT_SQL)
def _(fx: Inputs) -> DataFrame:
    return _results(fx)


@query(
    "verdict_matrix",
    f"SELECT subject, max(verdict) FILTER (section = 'pairs') AS pairs, max(verdict) FILTER (section = 'folds') AS folds FROM ({RESULT_SQL}) r GROUP BY 1",
)
def _(fx: Inputs) -> DataFrame:
    return reports.verdict_matrix(_results(fx), ["pairs", "folds"])


@query(
    "result_tables",
    f"SELECT section, count(*) AS row_count, count_if(verdict = 'PASS') AS pass_count, count(value) AS value_count FROM ({RESULT_SQL}) r GROUP BY 1",
)
def _(fx: Inputs) -> DataFrame:
    return reports.result_tables(_results(fx))


@query(
    "pair_counts_by_period",
    f"""SELECT item, period, count(*) AS record_count, {OPP}, {OUT}, count_if(reason LIKE 'INVALID_DENOMINATOR%') AS invalid_denominator,
               count_if(reason LIKE 'DUPLICATE%') AS duplicate_or_conflict, count(ratio) AS ratio_computed,
               count_if(outcome) / nullif(count(outcome), 0) AS prevalence, count_if(reason = 'EMPIRICAL_RULE_NOT_LOCKED') = 0 AS rule_locked
        FROM ({PAIRS_SQL}) p GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return reports.s1_counts(_pairs(fx))


@query(
    "opinion_counts_by_period",
    f"""SELECT period, count(*) AS record_count, count_if(opportunity) AS opinion_observed, count_if(category = 'clean') AS clean,
               count_if(category = 'qualified') AS qualified, count_if(category = 'adverse') AS adverse,
               count_if(reason IN ('OPINION_RECORD_MISSING', 'OPINION_MISSING')) AS missing, {OUT},
               count_if(reason = 'CONFLICTING_OPINIONS') AS conflicting,
               count_if(reason IN ('OPINION_UNMAPPED', 'CATEGORY_PENDING', 'CATEGORY_UNMAPPED')) AS unmapped_or_pending
        FROM ({OPINION_SQL}) o GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    return reports.s2_counts(_opinions(fx), ["clean", "qualified", "adverse"])


@query(
    "union_label_counts",
    f"""SELECT c.*, coalesce(assigned_role, 'not_a_fold') AS assigned_role
        FROM (SELECT target_id, period, count(*) AS row_count, count_if(mature) AS mature_count, {OUT} FROM ({TARGET_SQL}) t GROUP BY 1, 2) c
        LEFT JOIN ({ELIGIBILITY_SQL}) e ON e.target_id = c.target_id AND e.period = c.period""",
)
def _(fx: Inputs) -> DataFrame:
    return reports.l1_counts(_targets(fx), _eligibility(fx))


@query(
    "source_label_counts",
    f"""SELECT source_id, period, count_if(mature) AS mature_count, count_if(NOT mature) AS immature_count, count_if(mature AND outcome) AS positive,
               count_if(mature AND NOT outcome) AS observed_zero, count_if(mature AND outcome IS NULL) AS unknown, {OPP}
        FROM ({L0_SQL}) l GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return reports.l0_counts(_l0(fx))


@query("failure_reason_counts", f"SELECT item, reason, opportunity, count(*) AS row_count FROM ({PAIRS_SQL}) p WHERE outcome IS NULL GROUP BY 1, 2, 3")
def _(fx: Inputs) -> DataFrame:
    return reports.failure_counts(evidence.pair_failures(_pairs(fx)), ["item", "reason", "opportunity"])


@query(
    "decision_counts",
    f"""SELECT coalesce(CAST(target_period AS STRING), 'UNRESOLVED') AS target_year, count(*) AS row_count,
               count(DISTINCT document_id) AS document_count, count_if(hard_positive AND row_included) AS included_count
        FROM ({LEDGER_SQL}) l GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    return reports.decision_counts(_ledger(fx))


ENDPOINT_COUNT_SQL = f"SELECT endpoint, period, count(*) AS row_count, {OUT}, {OPP}, period < 1999 AS development FROM ({ENDPOINT_SQL}) e GROUP BY 1, 2"


@query("endpoint_counts", ENDPOINT_COUNT_SQL)
def _(fx: Inputs) -> DataFrame:
    return reports.endpoint_counts(_endpoints(fx), 1999)


@query(
    "unknown_reason_counts",
    f"SELECT endpoint, period, reason, count(*) AS row_count FROM ({ENDPOINT_SQL}) e WHERE outcome IS NULL GROUP BY 1, 2, 3",
)
def _(fx: Inputs) -> DataFrame:
    return reports.unknown_reasons(_endpoints(fx))


COMPARED_SQL = f"""
    SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, coalesce(a.period, b.period) AS period, coalesce(a.source_id, b.source_id) AS source_id,
           a.entity_id IS NULL AS left_missing, b.entity_id IS NULL AS right_missing,
           a.entity_id IS NOT NULL AND b.entity_id IS NOT NULL AND a.outcome IS DISTINCT FROM b.outcome AS outcome_mismatch,
           a.entity_id IS NOT NULL AND b.entity_id IS NOT NULL AND a.opportunity IS DISTINCT FROM b.opportunity AS opportunity_mismatch
    FROM (SELECT * FROM fx_matrix WHERE CAST(entity_id AS INT) % 29 <> 1) a
    FULL JOIN ({L0_SQL}) b ON a.entity_id = b.entity_id AND a.period = b.period AND a.source_id = b.source_id"""


def _compared(fx: Inputs) -> DataFrame:
    return reports.reconcile(fx("fx_matrix").filter("CAST(entity_id AS INT) % 29 <> 1"), _l0(fx))


@query("reconciliation_detail", f"SELECT * FROM ({COMPARED_SQL}) c WHERE left_missing OR right_missing OR outcome_mismatch OR opportunity_mismatch")
def _(fx: Inputs) -> DataFrame:
    return reports.reconcile_detail(_compared(fx))


@query(
    "reconciliation_summary",
    f"""SELECT period, source_id, count(*) AS compared_keys, count_if(left_missing) AS left_missing, count_if(right_missing) AS right_missing,
               count_if(outcome_mismatch) AS outcome_mismatch, count_if(opportunity_mismatch) AS opportunity_mismatch FROM ({COMPARED_SQL}) c GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return reports.reconcile_summary(_compared(fx))


@query(
    "earliest_positive",
    f"SELECT endpoint, min(period) FILTER (positive > 0) AS earliest_positive_period FROM ({ENDPOINT_COUNT_SQL}) c GROUP BY 1",
)
def _(fx: Inputs) -> DataFrame:
    return reports.earliest_positive(reports.endpoint_counts(_endpoints(fx), 1999))


RATES = """count(*) AS row_count, count(outcome) AS observed_count, count_if(outcome) AS positive_count, count(outcome) / count(*) AS coverage,
           count_if(outcome) / nullif(count(outcome), 0) AS observed_positive_rate"""


@query("source_coverage", f"SELECT source_id, channel_id, {RATES} FROM ({L0_SQL}) l WHERE eligible AND period < 2019 GROUP BY 1, 2")
def _(fx: Inputs) -> DataFrame:
    return reports.source_coverage(_l0(fx), 2019)


CHANNEL_RATES = f"SELECT channel_id, {RATES} FROM ({CHANNEL_SQL}) c WHERE eligible AND period < 2019 GROUP BY 1"


def _channel_rates(fx: Inputs) -> DataFrame:
    rows = _l0(fx)
    return reports.channel_coverage(observability.channel_rows(rows), rows, 2019)


@query(
    "channel_coverage",
    f"SELECT c.*, CASE channel_id WHEN 'S1' THEN ['quality'] WHEN 'S2' THEN ['appeal', 'toxic'] ELSE ['lang'] END AS source_ids FROM ({CHANNEL_RATES}) c",
)
def _(fx: Inputs) -> DataFrame:
    return _channel_rates(fx)


@query(
    "lag_distribution",
    """SELECT source_id, count(*) AS record_count, count(outcome) AS observed_count, round(avg(lag), 6) AS lag_mean, quantile_cont(lag, 0.25) AS lag_p25,
              quantile_cont(lag, 0.5) AS lag_p50, quantile_cont(lag, 0.75) AS lag_p75, round(quantile_cont(lag, 0.9), 6) AS lag_p90,
              quantile_cont(lag, 0.5) FILTER (outcome IS NOT NULL) AS observed_lag_p50
       FROM (SELECT source_id, outcome, CAST(floor((epoch_us(availability) - epoch_us(anchor)) / 86400000000.0) AS DOUBLE) AS lag
             FROM fx_records r JOIN fx_risk k ON k.entity_id = r.entity_id AND k.period = r.period
             WHERE availability IS NOT NULL AND eligible AND k.period < 2019) q GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(reports.lag_distribution(fx("fx_risk"), fx("fx_records"), 2019), 6)


@query(
    "anchor_quantiles",
    f"""SELECT count(r) AS channel_count, round(quantile_cont(r, 0.1), 8) AS p10, round(quantile_cont(r, 0.25), 8) AS p25, round(quantile_cont(r, 0.5), 8) AS p50,
               round(quantile_cont(r, 0.75), 8) AS p75, round(quantile_cont(r, 0.9), 8) AS p90
        FROM (SELECT observed_positive_rate AS r FROM ({CHANNEL_RATES}) c) q""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(reports.anchor_quantiles(_channel_rates(fx)), 8)


EVENT_SQL = f"""
    SELECT c.source_id, c.channel_id, c.period, s AS status, availability, anchor, TIMESTAMP '2024-01-25 00:00:00' AS cut
    FROM (SELECT q.*, CASE WHEN p.entity_id IS NULL THEN 'UNLINKED_ENTITY_PERIOD' ELSE status END AS s, p.anchor
          FROM ({CLUSTER_SQL}) q LEFT JOIN fx_event_panel p ON p.entity_id = q.entity_id AND p.period = q.period) c"""
TIMING = """count(*) AS raw_event_rows, count_if(l) AS linked_events, count_if(status = 'UNLINKED_ENTITY_PERIOD') AS unlinked_events,
    count_if(status = 'DUPLICATE_UPSTREAM_EVENT') AS duplicate_events, CAST(0 AS BIGINT) AS excluded_events,
    count_if(l AND availability < anchor) AS pre_anchor_events, count_if(l AND availability = anchor) AS same_moment_events,
    count_if(l AND availability > anchor AND availability <= anchor + INTERVAL 12 MONTH AND availability <= cut) AS in_12_month_events,
    count_if(l AND availability > anchor + INTERVAL 12 MONTH AND availability <= anchor + INTERVAL 24 MONTH AND availability <= cut) AS month_12_to_24_events,
    count_if(l AND availability > anchor AND availability <= anchor + INTERVAL 24 MONTH AND availability <= cut) AS in_24_month_events,
    count_if(l AND availability > anchor + INTERVAL 24 MONTH AND availability <= cut) AS post_horizon_events, count_if(availability > cut) AS post_cutoff_events"""


@query(
    "event_reconciliation",
    f"""WITH e AS (SELECT *, status IN ('ACCEPTED', 'DUPLICATE_UPSTREAM_EVENT') AS l FROM ({EVENT_SQL}) x)
        SELECT source_id, channel_id, period, {TIMING} FROM e GROUP BY 1, 2, 3
        UNION ALL SELECT NULL, NULL, NULL, {TIMING} FROM e""",
)
def _(fx: Inputs) -> DataFrame:
    events = evidence.dedupe_event_clusters(fx("fx_event_copies"))
    panel = fx("fx_event_panel")
    known = events.join(panel.select(*KEY, F.lit(True).alias("_p")), KEY, "left")
    statuses = known.withColumn("status", F.when(F.col("_p").isNull(), "UNLINKED_ENTITY_PERIOD").otherwise(F.col("status")))
    return reports.event_reconciliation(statuses, panel, "2024-01-25 00:00:00")


@query(
    "label_changes",
    f"""WITH o AS (SELECT entity_id, period, outcome FROM ({TARGET_SQL}) a WHERE target_id = 'L1' AND outcome IS NOT NULL),
             n AS (SELECT entity_id, period, outcome FROM ({TARGET_SQL}) b WHERE target_id = 'L1_ANNUAL' AND outcome IS NOT NULL)
        SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) x
        UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) y""",
)
def _(fx: Inputs) -> DataFrame:
    sealed = labels.sealed_outcomes(_targets(fx))
    return reports.label_diff(sealed.filter("target_id = 'L1'"), sealed.filter("target_id = 'L1_ANNUAL'"))


@query(
    "table_digest",
    """SELECT count(*) AS row_count, CAST(sum(CAST('0x' || substring(md5(coalesce(length(c) || ':' || c, '-') || coalesce(length(k) || ':' || k, '-') ||
              coalesce(length(p) || ':' || p, '-') || coalesce(length(s) || ':' || s, '-')), 1, 15) AS BIGINT)) AS DECIMAL(38, 0)) AS content_hash
       FROM (SELECT CAST(o_custkey AS STRING) AS c, CAST(o_orderkey AS STRING) AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders) t""",
)
def _(fx: Inputs) -> DataFrame:
    return reports.table_digest(fx("orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"))
