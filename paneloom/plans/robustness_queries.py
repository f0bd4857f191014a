"""Transport, identification, gates and simulation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators import gates, identify, mcse, metrics, resample, transport
from paneloom.operators.ranking import cut
from paneloom.plans.bindings import Inputs, query
from paneloom.plans.evidence_queries import ENDPOINT_SQL, _endpoints
from paneloom.plans.feature_queries import _round
from paneloom.plans.label_queries import L0_SQL, RISK_SQL, TARGET_SQL, _l0, _risk, _targets
from paneloom.plans.metric_queries import AP_SQL, AUC_SQL, PAIRS, RANKED, REPS, _draw
from paneloom.plans.model_queries import _document_panel

KEY = ["entity_id", "period"]

# ------------------------------------------------------------- transport


@query(
    "target_outcomes",
    f"SELECT entity_id, period, outcome, CAST(1 AS BIGINT) AS copies FROM ({TARGET_SQL}) t WHERE target_id = 'L1_ANNUAL' AND outcome IS NOT NULL",
)
def _(fx: Inputs) -> DataFrame:
    return transport.select_outcomes(_targets(fx), "L1_ANNUAL")


CHANNELS = {"quality": "S1", "toxic": "S2", "appeal": "S2", "lang": "S3"}
EXCLUDED = "(VALUES ('source:appeal', ['appeal']), ('source:lang', ['lang']), ('source:quality', ['quality']), ('source:toxic', ['toxic']), ('channel:S1', ['quality']), ('channel:S2', ['appeal', 'toxic']), ('channel:S3', ['lang'])) x(exclusion_id, ex)"
RELABEL_SQL = f"""
    SELECT exclusion_id, entity_id, period, CASE WHEN bool_and(mature) THEN CASE WHEN bool_or(outcome) FILTER (keep) THEN true
           WHEN count_if(keep AND outcome = false) = count_if(keep) AND count_if(keep) > 0 THEN false END END AS outcome
    FROM (SELECT l.*, exclusion_id, NOT list_contains(ex, source_id) AS keep FROM ({L0_SQL}) l CROSS JOIN {EXCLUDED}) r GROUP BY 1, 2, 3"""


@query("relabelled_without", RELABEL_SQL)
def _(fx: Inputs) -> DataFrame:
    return transport.relabel_without(_l0(fx), CHANNELS)


@query("exclusion_refits")
def _(fx: Inputs) -> DataFrame:
    labels = cut(transport.relabel_without(_l0(fx), CHANNELS))
    fixed = transport.select_outcomes(_targets(fx), "L1_ANNUAL")
    panel, features = cut(_document_panel(fx)), ["chars", "lines", "web"]
    refits = transport.exclusion_refits(panel, labels, fixed, 2019, features)
    whole = _targets(fx).filter("target_id = 'L1_ANNUAL'").select(F.lit("none").alias("exclusion_id"), *KEY, "outcome")
    baseline = transport.exclusion_refits(panel, cut(whole), fixed, 2019, features).select("average_precision")
    return _round(transport.ablation(cut(refits), cut(baseline)), 3)


#: With one binary feature and no penalty a model scores every row by the rate of its group.
SATURATED_REFIT_SQL = f"""
    WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS entity_id, doc_id % 7 + 2015 AS period, source = 'web' AS web FROM documents),
    r AS (SELECT * FROM ({RELABEL_SQL}) q UNION ALL SELECT 'none', entity_id, period, outcome FROM ({TARGET_SQL}) t WHERE target_id = 'L1_ANNUAL'),
    h AS (SELECT entity_id, outcome FROM ({TARGET_SQL}) t WHERE target_id = 'L1_ANNUAL' AND outcome IS NOT NULL AND period = 2019),
    t AS (SELECT exclusion_id, web, avg(CAST(outcome AS INT)) AS rate FROM r JOIN p USING (entity_id, period) WHERE period < 2019 AND outcome IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT exclusion_id, count(*) AS train_rows, max(CAST(outcome AS INT)) > min(CAST(outcome AS INT)) AS fit FROM r JOIN p USING (entity_id, period)
          WHERE period < 2019 AND outcome IS NOT NULL GROUP BY 1),
    s AS (SELECT exclusion_id, outcome, count_if(outcome) OVER w AS hits, row_number() OVER w AS pos FROM h JOIN p USING (entity_id) JOIN t USING (web)
          WHERE p.period = 2019 WINDOW w AS (PARTITION BY exclusion_id ORDER BY round(rate, 11) DESC, entity_id)),
    a AS (SELECT exclusion_id, sum(CASE WHEN outcome THEN hits / pos END) / nullif(count_if(outcome), 0) AS ap FROM s GROUP BY 1),
    e AS (SELECT DISTINCT exclusion_id FROM r),
    m AS (SELECT exclusion_id, CASE WHEN fit THEN ap END AS ap, coalesce(fit, false) AS fit FROM e LEFT JOIN c USING (exclusion_id) LEFT JOIN a USING (exclusion_id))
    SELECT exclusion_id, round(ap, 8) AS average_precision, round(ap - (SELECT ap FROM m WHERE exclusion_id = 'none'), 8) AS delta_to_baseline,
           CASE WHEN fit THEN 'PASS' ELSE 'TWO_CLASSES_REQUIRED' END AS status FROM m WHERE exclusion_id <> 'none'"""


@query("saturated_refits", SATURATED_REFIT_SQL)
def _(fx: Inputs) -> DataFrame:
    labels = transport.relabel_without(_l0(fx), CHANNELS).select("exclusion_id", *KEY, "outcome")
    whole = _targets(fx).filter("target_id = 'L1_ANNUAL'").select(F.lit("none").alias("exclusion_id"), *KEY, "outcome")
    fixed = transport.select_outcomes(_targets(fx), "L1_ANNUAL")
    refits = cut(transport.exclusion_refits(cut(_document_panel(fx)), cut(labels.unionByName(whole)), fixed, 2019, ["web"], inverse_regularization=1e12))
    base = refits.filter("exclusion_id = 'none'").select("average_precision")
    return _round(transport.ablation(refits.filter("exclusion_id <> 'none'"), base), 8)


@query(
    "source_summary",
    """SELECT list_sort(list_distinct(list(source_id) FILTER (outcome IS NOT NULL))) AS sources,
              list_sort(list_distinct(list(channel_id) FILTER (outcome IS NOT NULL))) AS channels, true AS two_sources, true AS two_channels FROM fx_records""",
)
def _(fx: Inputs) -> DataFrame:
    return transport.source_summary(fx("fx_records"))


@query("domain_support")
def _(fx: Inputs) -> DataFrame:
    scores, _ = transport.support_scores(fx("fx_domain"), "domain", ["spend", "orders_made", "balance"], 3, "support")
    return _round(transport.domain_support(scores, (0.1, 0.9), ["level"]), 3)


#: Three groups of rows by two binary features, so that models with both, or with one, are rates of groups.
SUPPORT_ROWS = """SELECT entity_id, period, domain, CASE WHEN orders_made > 2 THEN 1.0::DOUBLE ELSE 0.0 END AS many,
                         CASE WHEN orders_made = 2 THEN 1.0::DOUBLE ELSE 0.0 END AS two FROM fx_domain"""
SUPPORT_SQL = f"""
    WITH b AS (SELECT *, {_draw("support", "entity_id")} % 2 AS fold FROM ({SUPPORT_ROWS}) r), l AS (SELECT DISTINCT domain AS level FROM b),
    y AS (SELECT DISTINCT period AS p FROM b WHERE period >= 1999),
    x AS (SELECT b.*, level, p, domain = level AS held FROM b CROSS JOIN l CROSS JOIN y WHERE (domain = level AND period = p) OR (domain <> level AND period < p)),
    u AS (SELECT x.*, '' AS feature_id, many * 2 + two AS v FROM x UNION ALL SELECT x.*, 'many', two FROM x UNION ALL SELECT x.*, 'two', many FROM x),
    g AS (SELECT level, p, feature_id, k, v, count_if(held) AS h, count_if(NOT held) AS d FROM u JOIN (VALUES (0), (1)) f(k) ON fold <> k GROUP BY 1, 2, 3, 4, 5),
    q AS (SELECT *, h / sum(h) OVER w / (h / sum(h) OVER w + d / sum(d) OVER w) AS score FROM g WINDOW w AS (PARTITION BY level, p, feature_id, k)),
    s AS (SELECT u.*, round(score, 9) AS score FROM u JOIN q ON q.level = u.level AND q.p = u.p AND q.feature_id = u.feature_id AND q.k = u.fold AND q.v = u.v),
    r AS (SELECT *, rank() OVER (PARTITION BY level, p, feature_id ORDER BY score) + (count(*) OVER (PARTITION BY level, p, feature_id, score) - 1) / 2.0 AS r FROM s),
    t AS (SELECT level, p AS fold_period, feature_id, count_if(held) AS held_rows, avg(CASE WHEN held THEN CAST(score BETWEEN 0.48 AND 0.52 AS INT) END) AS support_fraction,
                 (sum(r) FILTER (held) - count_if(held) * (count_if(held) + 1) / 2.0) / (count_if(held) * count_if(NOT held)) AS roc_auc FROM r GROUP BY 1, 2, 3)"""


def _support(fx: Inputs) -> DataFrame:
    rows = fx("fx_domain").select(
        *KEY, "domain", (F.col("orders_made") > 2).cast("double").alias("many"), (F.col("orders_made") == 2).cast("double").alias("two")
    )
    scores, _ = transport.support_scores(rows, "domain", ["many", "two"], 2, "support", _late(rows), True, 1e12)
    return transport.domain_support(scores, (0.48, 0.52), ["level", "fold_period", "feature_id"])


def _late(rows: DataFrame) -> list[int]:
    return sorted(r["period"] for r in rows.select("period").distinct().collect() if r["period"] >= 1999)


def _after_first(rows: DataFrame) -> list[int]:
    """Every period with an earlier one to develop on."""
    return sorted(r["period"] for r in rows.select("period").distinct().collect())[1:]


@query("saturated_support", f"{SUPPORT_SQL} SELECT level, fold_period, feature_id, held_rows, round(support_fraction, 6) AS support_fraction, round(roc_auc, 6) AS roc_auc FROM t")
def _(fx: Inputs) -> DataFrame:
    return _round(_support(fx), 6)


@query(
    "support_drivers",
    f"""{SUPPORT_SQL}
        SELECT level, fold_period, a.feature_id, round(a.support_fraction, 6) AS support_fraction, round(a.support_fraction - b.support_fraction, 6) AS support_gain,
               round(b.roc_auc - a.roc_auc, 6) AS auc_drop, b.support_fraction < 0.5 AND a.support_fraction >= 0.5 AS restores_support
        FROM t a JOIN (SELECT * FROM t WHERE feature_id = '') b USING (level, fold_period) WHERE a.feature_id <> ''""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(transport.support_drivers(cut(_support(fx)), 0.5), 6)


def _shift_sql(c: str) -> str:
    return f"""
        SELECT '{c}' AS feature_id, round(avg(CAST({c} IS NULL AS INT)) FILTER (NOT h), 6) AS development_missing_rate,
               round(avg(CAST({c} IS NULL AS INT)) FILTER (h), 6) AS held_missing_rate, round(avg({c}) FILTER (NOT h), 6) AS development_mean,
               round(avg({c}) FILTER (h), 6) AS held_mean, round(quantile_cont({c}, 0.5) FILTER (NOT h), 6) AS development_median,
               round(quantile_cont({c}, 0.5) FILTER (h), 6) AS held_median,
               round((avg({c}) FILTER (h) - avg({c}) FILTER (NOT h)) / sqrt((var_samp({c}) FILTER (h) + var_samp({c}) FILTER (NOT h)) / 2), 6) AS smd,
               any_value(auc) AS separation_auc,
               round(avg(abs({c} - md) / iqr) FILTER (h AND NOT s) - avg(abs({c} - md) / iqr) FILTER (h AND s), 6) AS unsupported_excess_z
        FROM (SELECT *, domain = 'BUILDING' AS h, CAST(entity_id AS INT) % 4 <> 0 AS s FROM fx_domain) d CROSS JOIN (
          SELECT quantile_cont({c}, 0.5) AS md, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM fx_domain WHERE domain <> 'BUILDING') q
        CROSS JOIN (SELECT round(greatest(a, 1 - a), 6) AS auc FROM (
          SELECT (sum(r) FILTER (h) - count_if(h) * (count_if(h) + 1) / 2.0) / (count_if(h) * count_if(NOT h)) AS a
          FROM (SELECT domain = 'BUILDING' AS h, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r
                FROM (SELECT domain, coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM fx_domain)) AS v FROM fx_domain) f) g) k) a"""


@query("feature_shift", " UNION ALL ".join(_shift_sql(c) for c in ("spend", "balance")))
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_domain").select(
        "spend", "balance", (F.col("domain") == "BUILDING").alias("is_held"), (F.col("entity_id").cast("int") % 4 != 0).alias("supported")
    )
    return _round(transport.feature_shift(rows, ["spend", "balance"]), 6)


DRIVER_ROWS = """SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS feature_id,
                        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice % 1000 AS DOUBLE) / 1000 END AS support_gain,
                        o_orderkey % 5 = 0 AS restores_support FROM orders"""


@query(
    "driver_ranking",
    f"""SELECT feature_id, count(*) AS cell_count, round(avg(support_gain), 7) AS mean_gain, round(max(support_gain), 7) AS max_gain,
               count_if(restores_support) AS restored_cells, round(quantile_cont(support_gain, 0.5), 7) AS median_gain FROM ({DRIVER_ROWS}) d GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(transport.aggregate_drivers(fx.sql(DRIVER_ROWS), ["feature_id"]))


@query(
    "scenario_consistency",
    """SELECT o_orderpriority AS feature_id, count(*) AS scenario_count, min(s) AS support_fraction, max(s) - min(s) > 1e-12 AS support_disagrees,
              max(abs(s - 0.5)) > 1e-12 AS baseline_drift
       FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderkey % 3 AS DOUBLE) / 4 ELSE 0.5 END AS s FROM orders) q GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("orders").select(
        F.col("o_orderpriority").alias("feature_id"), F.lit(0.5).alias("baseline_support"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") % 3 / 4).otherwise(0.5).alias("support_fraction"),
    )
    return transport.scenario_consistency(rows, ["feature_id"])


@query(
    "censoring_summary",
    f"""SELECT (SELECT list_sort(list(DISTINCT CAST(period AS STRING))) FROM fx_panel WHERE period BETWEEN 1997 AND 1999 AND period <> 1998) AS eligible_folds,
               count_if(NOT mature) AS not_mature_count, 'SKIPPED' AS status,
               'CENSORING_TIME_OR_EXIT_SOURCE_UNAVAILABLE' AS reason FROM ({RISK_SQL}) r""",
)
def _(fx: Inputs) -> DataFrame:
    year = F.col("period")
    decisions = fx("fx_panel").groupBy("period").agg(F.count(F.lit(1)).alias("n")).select(
        year.cast("string").alias("fold"), year.isin(1997, 1998, 1999).alias("diagnostics_pass"),
        F.when(year == 1998, "all_rows").otherwise("development_history").alias("fit_scope"), F.lit(0).alias("outer_rows_used"),
    )
    registry = _risk(fx).select(F.col("mature").alias("retrospective"))
    return transport.censoring_summary(decisions, registry)


TRANSFER_FREE, TRANSFER_FLAT = {"C": 1e12}, {"C": 1e-24}
TRANSFER_SQL = """
    WITH b AS (SELECT entity_id, period, domain, CAST(outcome AS INT) AS y, CAST(orders_made > 2 AS INT) AS many, CAST(entity_id AS INT) % 2 AS odd, spend FROM fx_domain),
    l AS (SELECT DISTINCT domain AS level FROM b), k AS (SELECT DISTINCT period AS p FROM b WHERE period > (SELECT min(period) FROM b)),
    u AS (SELECT b.*, 'candidate' AS side, many AS v FROM b UNION ALL SELECT b.*, 'reference', odd FROM b),
    g AS (SELECT level, p, side, v, avg(y) AS free FROM u JOIN l ON domain <> level JOIN k ON period < p GROUP BY 1, 2, 3, 4),
    f AS (SELECT level, p, avg(y) AS flat, count(*) AS train_rows FROM b JOIN l ON domain <> level JOIN k ON period < p GROUP BY 1, 2 HAVING max(y) > min(y)),
    s AS (SELECT u.*, f.level, 0 AS setting, free AS prediction FROM u JOIN f ON f.p = period JOIN g ON g.level = f.level AND g.p = period AND g.side = u.side AND g.v = u.v
          UNION ALL SELECT u.*, f.level, 1, flat FROM u JOIN f ON f.p = period),
    i AS (SELECT level, p AS fold, side, setting, y, sum(y) OVER w AS hits, row_number() OVER w AS pos FROM s JOIN k ON period < p AND domain <> level
          WINDOW w AS (PARTITION BY level, p, side, setting ORDER BY round(prediction, 11) DESC, entity_id, period)),
    a AS (SELECT level, fold, side, setting, sum(CASE WHEN y = 1 THEN hits / pos END) / sum(y) AS ap FROM i GROUP BY 1, 2, 3, 4),
    c AS (SELECT level, fold, side, arg_max(setting, (ap, -setting)) AS setting FROM a GROUP BY 1, 2, 3),
    n AS (SELECT s.level, fold, s.side, c.setting, y, sum(y) OVER w AS hits, row_number() OVER w AS pos FROM s
          JOIN c ON c.level = s.level AND s.domain = s.level AND c.fold = s.period AND c.side = s.side AND c.setting = s.setting
          WINDOW w AS (PARTITION BY s.level, fold, s.side ORDER BY round(prediction, 11) DESC, entity_id, period)),
    m AS (SELECT level, fold, side, any_value(setting) AS setting, sum(CASE WHEN y = 1 THEN hits / pos END) / nullif(sum(y), 0) AS ap FROM n GROUP BY 1, 2, 3),
    h AS (SELECT domain AS level, period AS fold, count(*) AS held_rows, sum(y) AS held_positives, avg(CAST(spend < 500000 AS INT)) AS support_fraction FROM b JOIN k ON p = period GROUP BY 1, 2),
    t AS (SELECT h.level, h.fold, coalesce(train_rows, (SELECT count(*) FROM b WHERE domain <> h.level AND period < h.fold)) AS train_rows, held_rows, held_rows AS observed_rows,
                 held_positives::BIGINT AS held_positives, x.setting AS candidate_setting, r.setting AS reference_setting, round(x.ap, 8) AS candidate_ap,
                 round(r.ap, 8) AS reference_ap, round(support_fraction, 8) AS support_fraction,
                 CASE WHEN x.setting IS NULL OR r.setting IS NULL THEN 'DOMAIN_REFIT_PREDICTIONS_UNAVAILABLE'
                      WHEN held_positives IN (0, held_rows) THEN 'HELD_DOMAIN_TEST_CLASS_UNAVAILABLE' END AS reason
          FROM h LEFT JOIN f ON f.level = h.level AND f.p = h.fold LEFT JOIN m x ON x.level = h.level AND x.fold = h.fold AND x.side = 'candidate'
          LEFT JOIN m r ON r.level = h.level AND r.fold = h.fold AND r.side = 'reference'),
    z AS (SELECT *, reason IS NULL AS complete, reason IS NULL AND support_fraction >= 0.8 AND candidate_ap >= reference_ap * 0.95 AS non_inferior FROM t)"""


def _transfer(fx: Inputs) -> DataFrame:
    panel = fx("fx_domain").select(
        "*", (F.col("orders_made") > 2).cast("double").alias("many"), (F.col("entity_id").cast("int") % 2).cast("double").alias("odd")
    )
    support = panel.groupBy(F.col("domain").alias("level"), F.col("period").alias("fold")).agg(
        F.avg((F.col("spend") < 500000).cast("double")).alias("support_fraction")
    )
    cells, _ = transport.domain_transfer(panel, "domain", ["many"], ["odd"], 0.05, support, 0.8, [TRANSFER_FREE, TRANSFER_FLAT])
    return cells


@query("domain_transfer", f"{TRANSFER_SQL} SELECT * FROM z")
def _(fx: Inputs) -> DataFrame:
    return _round(_transfer(fx), 8)


@query(
    "domain_transfer_summary",
    f"""{TRANSFER_SQL}
        SELECT count_if(complete) AS complete_cells, count(*) AS expected_cells, count(DISTINCT level) AS level_count,
               round(count_if(non_inferior) / count(*), 9) AS robust_fraction, count_if(complete) = count(*) AND count(DISTINCT level) >= 2 AS evidence_complete FROM z""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(transport.transfer_summary(cut(_transfer(fx))), 9)


@query("domain_transfer_full")
def _(fx: Inputs) -> DataFrame:
    """Penalised fits of all features, with support from cross-fitted domain scores of every level and period but the first."""
    panel = cut(fx("fx_domain"))
    folds = _after_first(panel)
    features = ["spend", "orders_made", "top_order", "balance"]
    scores, _ = transport.support_scores(panel, "domain", features, 3, "support", folds)
    support = transport.domain_support(scores, (0.1, 0.9), ["level", "fold_period"]).withColumnRenamed("fold_period", "fold")
    cells, _ = transport.domain_transfer(panel, "domain", features, ["orders_made"], 0.05, cut(support), 0.8, [{"C": 0.1}, {"C": 1.0}], folds)
    return _round(cells, 4)


# ------------------------------------------------------------- partial identification

RATE_ROWS = """SELECT endpoint, CAST(count_if(outcome) AS DOUBLE) / nullif(count(outcome), 0) AS rate,
                      CASE WHEN endpoint = 'broad' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS false_positive_upper,
                      CASE WHEN endpoint = 'broad' THEN CAST(0.6 AS DOUBLE) END AS sensitivity_lower FROM ({}) e GROUP BY 1"""


def _rates(fx: Inputs) -> DataFrame:
    broad = F.col("endpoint") == "broad"
    return _endpoints(fx).groupBy("endpoint").agg(F.avg(F.col("outcome").cast("double")).alias("rate")).select(
        "endpoint", "rate", F.when(broad, 0.1).otherwise(0.4).alias("false_positive_upper"), F.when(broad, 0.6).alias("sensitivity_lower")
    )


@query(
    "prevalence_bounds",
    f"""SELECT endpoint, round(rate, 8) AS rate, false_positive_upper, sensitivity_lower, round(lo, 8) AS lower, round(hi, 8) AS upper,
               CASE WHEN lo > hi + 1e-12 THEN 'INCOMPATIBLE_RESTRICTIONS' ELSE 'BOUNDED' END AS status, 'sensitivity_region' AS domain_type
        FROM (SELECT *, greatest(0, (rate - false_positive_upper) / (1 - false_positive_upper)) AS lo, least(1, coalesce(rate / sensitivity_lower, 1)) AS hi
              FROM ({RATE_ROWS.format(ENDPOINT_SQL)}) r) b""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(identify.prevalence_bounds(_rates(fx)), 8)


@query(
    "corner_bounds",
    f"""SELECT endpoint, round(any_value(rate), 8) AS rate, round((min(v) + max(v)) / 2, 8) AS estimate, round(min(v), 8) AS lower, round(max(v), 8) AS upper
        FROM (SELECT endpoint, rate, greatest(0, least(1, (rate - fp) / (se - fp))) AS v FROM ({RATE_ROWS.format(ENDPOINT_SQL)}) r
              CROSS JOIN (VALUES (0.5::DOUBLE), (0.9)) s(se) CROSS JOIN (VALUES (0.01::DOUBLE), (0.1)) f(fp)) c GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(identify.corner_bounds(_rates(fx).select("endpoint", "rate"), (0.5, 0.9), (0.01, 0.1)), 8)


DOMINANCE_SQL = """SELECT a.model_id AS model_a, b.model_id AS model_b, count(*) AS common_count, min(a.value - b.value) AS worst_difference
                   FROM fx_surface a JOIN fx_surface b ON a.scenario_id = b.scenario_id AND a.model_id <> b.model_id GROUP BY 1, 2"""


@query("paired_dominance", f"SELECT model_a, model_b, common_count, round(worst_difference, 4) AS worst_difference, worst_difference > -8000 AS dominates FROM ({DOMINANCE_SQL}) d")
def _(fx: Inputs) -> DataFrame:
    return _round(identify.paired_dominance(fx("fx_surface"), tolerance=-8000.0), 4)


@query(
    "separated_dominance",
    """WITH r AS (SELECT model_id, min(-value) AS lo, max(-value) AS hi FROM fx_surface GROUP BY 1)
       SELECT a.model_id AS model_a, b.model_id AS model_b, round(a.lo - b.hi, 4) AS margin, a.lo - b.hi > 0 AS dominates FROM r a JOIN r b ON a.model_id <> b.model_id""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(identify.separated_dominance(fx("fx_surface"), higher_is_better=False), 4)


@query(
    "selection_set",
    f"SELECT DISTINCT model_id FROM fx_surface WHERE model_id NOT IN (SELECT model_b FROM ({DOMINANCE_SQL}) d WHERE worst_difference > -8000)",
)
def _(fx: Inputs) -> DataFrame:
    return identify.selection_set(fx("fx_surface"), tolerance=-8000.0)


@query(
    "minimax_regret",
    """WITH g AS (SELECT model_id, max(best - value) AS m, count(*) AS n FROM (SELECT *, max(value) OVER (PARTITION BY scenario_id) AS best FROM fx_surface
                  WHERE scenario_id <> '1995') s GROUP BY 1)
       SELECT model_id, n AS common_count, round(m, 4) AS max_regret, m <= (SELECT min(m) FROM g) + 1e-12 AS minimax FROM g""",
)
def _(fx: Inputs) -> DataFrame:
    surface = fx("fx_surface").filter("NOT (scenario_id = '1995' AND model_id = '5-LOW')")
    return _round(identify.minimax_regret(surface), 4)


@query(
    "restriction_audit",
    """SELECT c_mktsegment AS restriction_id, list_sort(list_distinct(flatten(list(r)))) AS reasons, len(list_distinct(flatten(list(r)))) = 0 AS eligible
       FROM (SELECT c_mktsegment, list_filter([CASE WHEN c_mktsegment = 'BUILDING' THEN 'VALUE_NOT_SET' END, CASE WHEN b >= 23 THEN 'BASIS_UNREGISTERED' END,
                    CASE WHEN b < 23 AND n_regionkey = 0 THEN 'APPROVED_NOT_MET' END, CASE WHEN b < 23 AND b % 11 = 0 THEN 'TRANSPORTABLE_NOT_MET' END], lambda x: x IS NOT NULL) AS r
             FROM (SELECT DISTINCT c_mktsegment, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN c_nationkey ELSE 3 END AS b FROM customer) c
             LEFT JOIN nation ON n_nationkey = b AND n_nationkey < 23) q GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    segment = F.col("c_mktsegment")
    restrictions = fx("customer").groupBy(segment.alias("restriction_id")).agg(
        F.when(F.first(segment) != "BUILDING", 0.5).alias("value"),
        F.collect_set(F.when(segment == "AUTOMOBILE", F.col("c_nationkey")).otherwise(3)).alias("basis_ids"),
    )
    bases = fx("nation").filter("n_nationkey < 23").select(
        F.col("n_nationkey").alias("basis_id"), (F.col("n_regionkey") != 0).alias("approved"), (F.col("n_nationkey") % 11 != 0).alias("transportable")
    )
    return identify.restriction_audit(restrictions, bases, ["approved", "transportable"])


# ------------------------------------------------------------- gates

GATE = {
    "interval_level": 0.95, "absolute_improvement": 0.01, "relative_improvement": 0.1, "same_direction_min": 2, "max_yield_decline": 0.9,
    "min_positives": 1,
}
FOLD_SQL = f"""
    SELECT a.period AS fold, a.model_id, average_precision, precision_at, positives, n
    FROM ({AP_SQL}) a JOIN (SELECT model_id, period, count_if(outcome AND pos <= greatest(1, ceil(n * 0.1))) / max(greatest(1, ceil(n * 0.1))) AS precision_at,
                                   count_if(outcome) AS positives, max(n) AS n FROM ({RANKED}) r GROUP BY 1, 2) p ON p.model_id = a.model_id AND p.period = a.period"""
#: Every fold draws its own entities; draw i of a replicate picks by a hash of fold, replicate and i.
SAMPLE_SQL = f"""
    WITH u AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY entity_id) - 1 AS unit, count(*) OVER (PARTITION BY period) AS n
               FROM (SELECT DISTINCT entity_id, period FROM fx_scores) k),
    t AS (SELECT period, rep, {_draw("boot", "period", "rep", "unit")} % n AS unit, count(*) AS times FROM u CROSS JOIN range({REPS}) r(rep) GROUP BY 1, 2, 3),
    c AS (SELECT model_id, s.period, rep, outcome, prediction, s.entity_id, unnest(range(times)) AS j FROM fx_scores s JOIN u USING (entity_id, period) JOIN t USING (period, unit)),
    p AS (SELECT *, row_number() OVER w AS pos, count_if(outcome) OVER w AS hits FROM c
          WINDOW w AS (PARTITION BY model_id, period, rep ORDER BY prediction DESC, entity_id, j ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT model_id, period, rep, sum(CASE WHEN outcome THEN hits / pos END) / nullif(count_if(outcome), 0) AS ap FROM p GROUP BY 1, 2, 3)
    SELECT period AS fold, rep, max(ap) FILTER (model_id = 'full') - max(ap) FILTER (model_id <> 'full') AS delta FROM a GROUP BY 1, 2"""
GATE_SQL = f"""
    WITH m AS ({FOLD_SQL}),
         f AS (SELECT c.fold, c.average_precision - r.average_precision AS delta, r.average_precision AS rap, c.positives,
                      CASE WHEN r.precision_at <> 0 THEN greatest(0, (r.precision_at - c.precision_at) / r.precision_at) END AS decline
               FROM m c JOIN m r ON r.fold = c.fold AND c.model_id = 'full' AND r.model_id = 'observability_only'),
         d AS (SELECT fold, delta, row_number() OVER (PARTITION BY fold ORDER BY rep) AS i FROM ({SAMPLE_SQL}) s WHERE delta IS NOT NULL),
         s AS (SELECT quantile_cont(v, 0.025) AS lower, count(*) AS reps FROM (
                 SELECT i, avg(delta) AS v FROM d GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT fold) FROM d)) q)
    SELECT 'full' AS candidate, 'observability_only' AS reference, count(delta) AS fold_count, count_if(delta > 0) AS same_direction_folds, avg(delta) AS mean_delta,
           any_value(lower) AS interval_lower, greatest(0.01, 0.1 * avg(rap)) AS required_improvement, coalesce(max(decline), 0) AS max_yield_decline,
           min(positives) AS min_positive_count, any_value(reps) AS replications_used, count(delta) = count(*) AND count(rap) = count(*) AS evidence_complete,
           avg(delta) >= greatest(0.01, 0.1 * avg(rap)) AND any_value(lower) > 0 AND count_if(delta > 0) >= 2 AND coalesce(max(decline), 0) <= 0.9
             AND min(positives) >= 1 AS passed
    FROM f CROSS JOIN s"""


def _folds(fx: Inputs) -> list[int]:
    return sorted(r["period"] for r in fx("fx_scores").select("period").distinct().collect())


def _fold_metrics(fx: Inputs) -> DataFrame:
    return cut(
        metrics.scored_summary(fx("fx_scores"), 0.1, ["model_id", "period"]).select(
            F.col("period").alias("fold"), "model_id", "average_precision", "precision_at", "positive_count"
        )
    )


def _fold_deltas(table: DataFrame) -> DataFrame:
    full, other = (
        table.filter(F.col("model_id") == m).select("fold", F.col("average_precision").alias(n)) for m, n in (("full", "_a"), ("observability_only", "_b"))
    )
    return full.join(other, "fold").select(
        "fold", F.lit("full").alias("candidate"), F.lit("observability_only").alias("reference"), (F.col("_a") - F.col("_b")).alias("delta")
    )


def _fold_samples(fx: Inputs) -> DataFrame:
    """Replicates drawn inside each fold, all folds and models in one pass."""
    precision = resample.replicate_precision(fx("fx_scores"), ["period"], REPS, "boot")
    return cut(resample.paired_samples(precision, PAIRS, ["period"]).withColumnRenamed("period", "fold"))


@query("fold_bootstrap", f"SELECT fold, rep, round(delta, 9) AS delta FROM ({SAMPLE_SQL}) s")
def _(fx: Inputs) -> DataFrame:
    return _round(_fold_samples(fx).select("fold", "rep", "delta"), 9)


#: Facts damaged by what the rows of a fold are, so that what blocks is seen in the data only.
BLOCKER_SQL = f"""
    WITH m AS (SELECT fold, model_id, CASE WHEN model_id = 'full' OR positives % 2 = 1 THEN average_precision END AS ap, average_precision, precision_at AS y, positives, n
               FROM ({FOLD_SQL}) f),
    b AS (SELECT s.fold, count(*) AS b_n, count_if(delta IS NULL) AS b_bad FROM ({SAMPLE_SQL}) s JOIN m ON m.fold = s.fold AND model_id = 'full'
          WHERE positives % 5 <> 0 AND (positives % 3 <> 0 OR rep < 30) GROUP BY 1),
    x AS (SELECT c.fold, c.ap AS cap, r.ap AS rap, c.y AS cy, r.y AS ry, c.average_precision - r.average_precision AS delta, c.positives % 4 <> 1 AS present, b_n, b_bad
          FROM m c JOIN m r ON r.fold = c.fold AND c.model_id = 'full' AND r.model_id <> 'full' LEFT JOIN b ON b.fold = c.fold),
    e AS (SELECT fold, present, unnest([
            CASE WHEN NOT present THEN {{'reason': 'REQUIRED_PAIR_MISSING', 'subject': 'full'}} END, CASE WHEN present AND delta IS NULL THEN {{'reason': 'DELTA_AP_MISSING', 'subject': 'full'}} END,
            CASE WHEN present AND cap IS NULL THEN {{'reason': 'AP_MISSING', 'subject': 'full'}} END, CASE WHEN present AND rap IS NULL THEN {{'reason': 'AP_MISSING', 'subject': 'observability_only'}} END,
            CASE WHEN present AND cy IS NULL THEN {{'reason': 'YIELD_MISSING', 'subject': 'full'}} END, CASE WHEN present AND ry IS NULL THEN {{'reason': 'YIELD_MISSING', 'subject': 'observability_only'}} END,
            CASE WHEN present AND ry <= 0 THEN {{'reason': 'REFERENCE_YIELD_NONPOSITIVE', 'subject': 'full'}} END, CASE WHEN b_n IS NULL THEN {{'reason': 'BOOTSTRAP_PAIR_MISSING', 'subject': 'full'}} END,
            CASE WHEN b_n < {REPS} THEN {{'reason': 'BOOTSTRAP_TOO_SHORT', 'subject': 'full'}} END, CASE WHEN b_bad > 0 THEN {{'reason': 'BOOTSTRAP_NONFINITE', 'subject': 'full'}} END,
            {{'reason': 'REQUIRED_PAIR_MISSING', 'subject': 'extra'}}, {{'reason': 'BOOTSTRAP_PAIR_MISSING', 'subject': 'extra'}}]) AS f FROM x)
    SELECT fold, f.reason AS reason, f.subject AS subject FROM e WHERE f IS NOT NULL"""


@query("gate_blockers", BLOCKER_SQL)
def _(fx: Inputs) -> DataFrame:
    table = _fold_metrics(fx)
    kept = F.broadcast(table.filter("model_id = 'full'").select("fold", F.col("positive_count").alias("_p")))  # one row a fold
    deltas = _fold_deltas(table).join(kept, "fold").filter("_p % 4 <> 1")
    samples = _fold_samples(fx).join(kept, "fold").filter("_p % 5 <> 0 AND (_p % 3 <> 0 OR rep < 30)")
    sound = (F.col("model_id") == "full") | (F.col("positive_count") % 2 == 1)
    broken = table.withColumn("average_precision", F.when(sound, F.col("average_precision")))
    return gates.gate_blockers(broken, deltas, samples, _folds(fx), {**PAIRS, "extra": "observability_only"}, REPS)


def _gate2(fx: Inputs) -> DataFrame:
    table = _fold_metrics(fx)
    return gates.gate2(table, _fold_deltas(table), _fold_samples(fx), _folds(fx), PAIRS, GATE)


@query(
    "gate2_verdict",
    f"""SELECT candidate, reference, fold_count, same_direction_folds, round(mean_delta, 7) AS mean_delta, round(interval_lower, 7) AS interval_lower,
               round(required_improvement, 7) AS required_improvement, round(max_yield_decline, 7) AS max_yield_decline, min_positive_count,
               replications_used, evidence_complete, passed FROM ({GATE_SQL}) g""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(_gate2(fx))


@query(
    "gate2_domain_binding",
    f"""{TRANSFER_SQL}, verdicts AS (SELECT * FROM ({GATE_SQL}) w),
        evidence AS (SELECT round(count_if(non_inferior) / nullif(count(*), 0), 7) AS rf, count(*) > 0 AND count(DISTINCT level) >= 2 AS d FROM z WHERE complete)
        SELECT candidate, rf AS robust_fraction, d AS domain_evidence_complete, d AND coalesce(rf >= 0.3, false) AS domain_pass, passed AND d AND coalesce(rf >= 0.3, false) AS passed,
               CASE WHEN NOT d OR NOT evidence_complete THEN 'INSUFFICIENT_EVIDENCE' WHEN passed AND rf >= 0.3 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM verdicts CROSS JOIN evidence""",
)
def _(fx: Inputs) -> DataFrame:
    domains = transport.transfer_summary(cut(_transfer(fx)).filter("complete"))
    return _round(gates.gate2_with_domains(_gate2(fx), domains.withColumn("candidate", F.lit("full")), 0.3))


@query(
    "selection_stability",
    """SELECT arg_max(s, {'n': n, 's': s}) FILTER (s IS NOT NULL) AS selected, CAST(max(n) FILTER (s IS NOT NULL) AS BIGINT) AS selected_folds,
              CAST(sum(n) AS BIGINT) AS observed_folds, CAST(coalesce(sum(n) FILTER (s IS NULL), 0) AS BIGINT) AS missing_folds, sum(n) = 7 AND max(n) FILTER (s IS NOT NULL) >= 3 AS passed
       FROM (SELECT CASE WHEN best % 4 = 0 THEN NULL ELSE concat('M', CAST(best % 2 AS STRING)) END AS s, count(*) AS n
             FROM (SELECT year(o_orderdate) AS y, max(o_orderkey) AS best FROM orders GROUP BY 1) f GROUP BY 1) q""",
)
def _(fx: Inputs) -> DataFrame:
    return gates.selection_stability(_selections(fx), 3, 7)


def _selections(fx: Inputs) -> DataFrame:
    """The measurement that each year's last order selects."""
    return fx("orders").groupBy(F.year("o_orderdate").alias("fold")).agg(F.max("o_orderkey").alias("best")).select(
        "fold", F.when(F.col("best") % 4 == 0, "none").otherwise(F.concat(F.lit("M"), (F.col("best") % 2).cast("string"))).alias("selected")
    )


def _shape_rows(fx: Inputs, group: str) -> DataFrame:
    rows = cut(fx("fx_domain").filter("balance IS NOT NULL"))  # the monitor must be known
    return gates.standardized(rows, "spend", "orders_made", "outcome", group)


@query("breakpoint_scan")
def _(fx: Inputs) -> DataFrame:
    return _round(gates.breakpoint_scan(_shape_rows(fx, "period"), (0.2, 0.8), 5, 1.0), 4)


@query(
    "common_support",
    """WITH r AS (SELECT domain, min(spend) AS lo, max(spend) AS hi FROM fx_domain GROUP BY 1)
       SELECT count(*) AS domain_count, round(min(greatest(0, (SELECT min(hi) - max(lo) FROM r)) / greatest(hi - lo, 1e-12)), 9) AS common_support FROM r""",
)
def _(fx: Inputs) -> DataFrame:
    ranges = fx("fx_domain").groupBy("domain").agg(F.min("spend").alias("z_low"), F.max("spend").alias("z_high"))
    return _round(gates.common_support(ranges), 9)


@query("shape_bootstrap")
def _(fx: Inputs) -> DataFrame:
    rows = _shape_rows(fx, "period")
    return _round(gates.shape_bootstrap(rows, (0.2, 0.8), 3, 1.0, 10, 0.1, "shape"), 4)


CLAIMS = ["spend", "top_order"]
SHAPE = {
    "breakpoint_tolerance": 0.5, "domain_difference_max": 1.0, "common_support_min": 0.2, "min_side_fraction": 0.1, "min_domains": 2, "claims": 2,
    "same_direction_min": 3,
}


#: Positions of a breakpoint that a fold and each of its replicates choose from, and the reference's number of replicates.
SCAN, SHAPE_REPS = ((0.2, 0.8), 5, 1.0), 2000


def _claims(fx: Inputs) -> tuple[DataFrame, DataFrame]:
    """Directions of the first claim's interaction, and the verdicts of all claims; alpha is shared by three."""
    rows = cut(fx("fx_domain"))
    by_fold = cut(gates.standardized_claims(rows, CLAIMS, "orders_made", "outcome", "period"))
    folds = cut(gates.breakpoint_scan(by_fold, *SCAN))
    domains = gates.breakpoint_scan(gates.standardized_claims(rows, CLAIMS, "orders_made", "outcome", "domain"), *SCAN)
    intervals = cut(gates.shape_bootstrap(by_fold, *SCAN, SHAPE_REPS, 0.05 / 3, "shape"))
    own = folds.join(intervals, "grp").filter(F.col("grp").startswith(f"{CLAIMS[0]}|"))
    return own.select("grp", "interaction", "interaction_lower", "interaction_upper"), gates.threshold_claims(folds, domains, intervals, SHAPE)


@query("threshold_claims")
def _(fx: Inputs) -> DataFrame:
    return _round(_claims(fx)[1], 4)


@query("gate3_verdict")
def _(fx: Inputs) -> DataFrame:
    directions, claims = _claims(fx)
    stability = gates.selection_stability(_selections(fx), 3, 7)
    parent = _gate2(fx).filter("candidate = 'full'").select(F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("verdict"))
    return gates.gate3(cut(directions), cut(claims), stability, parent, SHAPE)


RANKS_SQL = """
    SELECT c.case_id, s.entity_id, s.period, s.model_id, s.prediction, (SELECT count(*) FROM fx_scores r WHERE r.period = s.period AND r.model_id = s.model_id) AS n,
           (SELECT count(*) FROM fx_scores r WHERE r.period = s.period AND r.model_id = s.model_id AND r.prediction <= s.prediction) AS k
    FROM fx_scores s JOIN (SELECT concat('case', CAST(doc_id AS STRING)) AS case_id, CAST(doc_id AS STRING) AS e FROM labels WHERE toxic = 1) c ON c.e = s.entity_id"""


def _case_ranks(fx: Inputs) -> DataFrame:
    doc = F.col("doc_id")
    cases = fx("labels").filter("toxic = 1").select(
        F.concat(F.lit("case"), doc.cast("string")).alias("case_id"), doc.cast("string").alias("entity_id"), (doc % 7 + 2015).cast("int").alias("period")
    )
    return gates.known_case_ranks(fx("fx_scores"), cases)


@query(
    "known_case_ranks",
    f"""SELECT case_id, entity_id, period, model_id, round(prediction, 9) AS prediction, n AS reference_size, round(k / n, 9) AS percentile,
               round((k + 1) / (n + 1), 9) AS lower_tail_p FROM ({RANKS_SQL}) q""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(_case_ranks(fx), 9)


@query(
    "known_case_summary",
    f"""SELECT count(*) AS model_count, any_value(cases) AS case_count, avg(CAST(weak >= 20 AS INT)) AS below_fraction, avg(CAST(strong >= 4 AS INT)) AS strong_fraction,
               any_value(cases) >= 4 AS minimum_cases_met, any_value(cases) >= 4 AND avg(CAST(weak >= 20 AS INT)) >= 0.8 AS soft_veto,
               avg(CAST(strong >= 4 AS INT)) >= 0.8 AS strong_falsification
        FROM (SELECT model_id, count(DISTINCT case_id) FILTER (k / n < 0.5) AS weak, count(DISTINCT case_id) FILTER (k / n < 0.1) AS strong,
                     (SELECT count(DISTINCT case_id) FROM ({RANKS_SQL}) z) AS cases FROM ({RANKS_SQL}) q GROUP BY 1) m""",
)
def _(fx: Inputs) -> DataFrame:
    cfg = {"weak_percentile": 0.5, "strong_percentile": 0.1, "below_median_cases": 20, "minimum_cases": 4, "model_fraction": 0.8}
    return gates.known_case_summary(_case_ranks(fx), cfg)


# ------------------------------------------------------------- simulation tables

FACTS = """
    SELECT scenario_id, method_id, replication_id, metric_id, estimate,
           CASE method_id WHEN '5-LOW' THEN 'standalone' WHEN '1-URGENT' THEN 'extended' ELSE 'core' END AS learner_tier,
           CASE WHEN method_id = '2-HIGH' THEN 'asymmetric' ELSE 'symmetric' END AS cost_regime,
           CASE WHEN method_id = '3-MEDIUM' THEN 'weights' ELSE 'none' END AS treatment,
           CASE WHEN method_id = '5-LOW' THEN 'standalone_estimator' ELSE 'learner' END AS family
    FROM (SELECT scenario_id, method_id, replication_id, 'order_value' AS metric_id,
                 CASE WHEN replication_id % 50 = 7 THEN NULL ELSE order_value / 1000 END AS estimate FROM fx_facts
          UNION ALL SELECT scenario_id, method_id, replication_id, 'budget::cost_regret_vs_oracle', CASE WHEN replication_id % 9 = 0 THEN 0 ELSE order_value / 100 END FROM fx_facts
          UNION ALL SELECT scenario_id, method_id, replication_id, 'budget::cost_savings_vs_all_negative', CASE WHEN replication_id % 9 = 0 THEN 0 ELSE order_value / 300 END
                    FROM fx_facts WHERE replication_id % 40 <> 3
          UNION ALL SELECT scenario_id, method_id, replication_id, 'budget::normalized_cost_regret', CAST(5 AS DOUBLE) FROM fx_facts) u"""


@query(
    "sanitized_regret",
    f"""SELECT scenario_id, method_id, replication_id, round(CASE WHEN abs(r + s) > 1e-10 * greatest(abs(r), abs(s), 1) THEN r / abs(r + s) END, 9) AS estimate,
               r IS NULL OR s IS NULL AS companion_missing
        FROM (SELECT scenario_id, method_id, replication_id, max(estimate) FILTER (metric_id LIKE '%oracle') AS r, max(estimate) FILTER (metric_id LIKE '%negative') AS s
              FROM ({FACTS}) f WHERE metric_id LIKE 'budget%' GROUP BY 1, 2, 3) p""",
)
def _(fx: Inputs) -> DataFrame:
    rows = mcse.sanitize_regret(fx.sql(FACTS)).filter("metric_id LIKE '%::normalized_cost_regret'")
    return _round(rows.select("scenario_id", "method_id", "replication_id", "estimate", "companion_missing"), 9)


POLICIES = [
    {"policy_id": "default", "pattern": "*", "priority": 0, "role": "descriptive", "gate_required": False, "target_rule": "absolute",
     "undefined_policy": "allow", "minimum_finite_fraction": 0.0},
    {"policy_id": "orders", "pattern": "order_*", "priority": 5, "role": "confirmatory", "gate_required": True, "target_rule": "relative_to_mean",
     "undefined_policy": "allow", "minimum_finite_fraction": 0.9},
    {"policy_id": "savings", "pattern": "*::cost_savings*", "priority": 5, "role": "confirmatory", "gate_required": True, "target_rule": "absolute",
     "undefined_policy": "forbid", "minimum_finite_fraction": 0.9},
    {"policy_id": "regret", "pattern": "*::cost_regret*", "priority": 5, "role": "diagnostic", "gate_required": False, "target_rule": "absolute",
     "undefined_policy": "allow", "minimum_finite_fraction": 0.5},
    {"policy_id": "twin_a", "pattern": "*normalized*", "priority": 3, "role": "diagnostic", "gate_required": False, "target_rule": "absolute",
     "undefined_policy": "allow", "minimum_finite_fraction": 0.5},
    {"policy_id": "twin_b", "pattern": "*normalized?*", "priority": 3, "role": "diagnostic", "gate_required": False, "target_rule": "absolute",
     "undefined_policy": "allow", "minimum_finite_fraction": 0.5},
]


@query(
    "metric_policies",
    f"""SELECT DISTINCT metric_id, CASE WHEN metric_id LIKE 'order%' THEN 'orders' WHEN metric_id LIKE '%savings%' THEN 'savings'
               WHEN metric_id LIKE '%regret_vs%' THEN 'regret' ELSE 'twin_a' END AS policy_id,
               CASE WHEN metric_id LIKE '%normalized%' THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS resolution FROM ({FACTS}) f""",
)
def _(fx: Inputs) -> DataFrame:
    return mcse.resolve_policies(fx.sql(FACTS), POLICIES).select("metric_id", "policy_id", "resolution")


PLAN = {
    "standalone": (500, 700), "extended_predictive": (550, 600), "imbalance_robustness": (550, 600), "cost_sensitive_core": (600, 620),
    "core_cost_neutral": (580, 640),
}
TIER = """CASE WHEN family = 'standalone_estimator' THEN 'standalone' WHEN treatment <> 'none' THEN 'imbalance_robustness' WHEN learner_tier = 'extended'
          THEN 'extended_predictive' WHEN cost_regime <> 'symmetric' THEN 'cost_sensitive_core' ELSE 'core_cost_neutral' END"""
PLAN_ROWS = "(VALUES " + ", ".join(f"('{t}', {lo}, {hi})" for t, (lo, hi) in PLAN.items()) + ") pl(t, lo, hi)"
SUMMARY_SQL = f"""
    SELECT *, minimum_met AND finite_met AND undefined_met AND target_met AS gate_met
    FROM (SELECT scenario_id, method_id, metric_id, policy_id, gated AS gate_required, tier, n AS replications, f AS finite_replications, n - f AS undefined_replications,
                 mean, mcse, CASE WHEN gated THEN goal END AS mcse_target, NOT gated OR n >= lo AS minimum_met, NOT gated OR f >= ceil(lo * 0.9) AS finite_met,
                 NOT gated OR policy_id <> 'savings' OR n = f AS undefined_met, NOT gated OR coalesce(mcse <= goal, false) AS target_met, n >= hi AS maximum_reached,
                 false AS mixed_metadata
          FROM (SELECT *, CASE WHEN policy_id = 'orders' THEN greatest(2.0, 0.02 * greatest(abs(mean), 1e-6)) ELSE 2.0 END AS goal, policy_id IN ('orders', 'savings') AS gated
                FROM (SELECT scenario_id, method_id, metric_id, CASE WHEN metric_id LIKE 'order%' THEN 'orders' WHEN metric_id LIKE '%savings%' THEN 'savings'
                             WHEN metric_id LIKE '%regret_vs%' THEN 'regret' ELSE 'twin_a' END AS policy_id, any_value({TIER}) AS tier, count(*) AS n, count(estimate) AS f,
                             avg(estimate) AS mean, coalesce(stddev_samp(estimate), 0) / sqrt(count(estimate)) AS mcse FROM ({FACTS}) x GROUP BY 1, 2, 3) y) z
          JOIN {PLAN_ROWS} ON t = tier) w"""


def _summary(fx: Inputs) -> DataFrame:
    facts = fx.sql(FACTS)
    return mcse.mcse_summary(facts, mcse.resolve_policies(facts, POLICIES).drop("resolution"), PLAN, 2.0, 0.02, 0.5)


@query("mcse_summary", f"SELECT * EXCLUDE (mean, mcse, mcse_target), round(mean, 6) AS mean, round(mcse, 6) AS mcse, round(mcse_target, 6) AS mcse_target FROM ({SUMMARY_SQL}) s")
def _(fx: Inputs) -> DataFrame:
    return _round(_summary(fx), 6)


@query(
    "mcse_status",
    f"""SELECT count(*) AS gated_count, CASE WHEN bool_and(gate_met) THEN 'PASS' WHEN bool_and(gate_met OR maximum_reached) THEN 'MAXIMUM_REACHED' ELSE 'CONTINUE' END AS status
        FROM ({SUMMARY_SQL}) s WHERE gate_required""",
)
def _(fx: Inputs) -> DataFrame:
    return mcse.mcse_status(_summary(fx))


@query(
    "batch_audit",
    """SELECT scenario_id, method_id, b AS batch_id, min(replication_id) AS first_id, max(replication_id) AS last_id, count(DISTINCT replication_id) AS id_count,
              max(replication_id) - min(replication_id) + 1 = count(DISTINCT replication_id) AS contiguous, min(replication_id) % 100 = 0 AS aligned,
              CAST(floor(min(replication_id) / 100) AS BIGINT) = b AS matches_batch
       FROM (SELECT *, CAST(floor(replication_id / 100) AS BIGINT) + CASE WHEN replication_id >= 500 THEN 1 ELSE 0 END AS b FROM fx_facts
             WHERE NOT (replication_id BETWEEN 210 AND 219)) q GROUP BY 1, 2, 3""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_facts").filter("NOT (replication_id BETWEEN 210 AND 219)")
    batch = F.floor(F.col("replication_id") / 100) + F.when(F.col("replication_id") >= 500, 1).otherwise(0)
    return mcse.batch_audit(rows.withColumn("batch_id", batch), 100)


@query(
    "coverage_validation",
    f"""WITH f AS (SELECT DISTINCT scenario_id, method_id, metric_id, learner_tier FROM ({FACTS}) x WHERE NOT (scenario_id = 'BUILDING' AND metric_id = 'order_value')),
             m AS (SELECT DISTINCT c_mktsegment AS scenario_id, o_orderpriority AS method_id FROM orders JOIN customer ON c_custkey = o_custkey)
        SELECT scenario_id, method_id, metric_id, 'METRIC_MISSING' AS reason FROM (SELECT DISTINCT scenario_id, method_id FROM f) a CROSS JOIN (VALUES ('order_value'), ('budget::cost_regret_vs_oracle')) v(metric_id)
        WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.scenario_id = a.scenario_id AND b.method_id = a.method_id AND b.metric_id = v.metric_id)
        UNION ALL SELECT scenario_id, method_id, metric_id, 'METRIC_UNEXPECTED' FROM f WHERE metric_id NOT IN ('order_value', 'budget::cost_regret_vs_oracle')
        UNION ALL SELECT DISTINCT scenario_id, method_id, CAST(NULL AS STRING), 'METADATA_CONFLICT' FROM f WHERE learner_tier = 'extended'
        UNION ALL SELECT DISTINCT scenario_id, method_id, CAST(NULL AS STRING), 'METHOD_UNEXPECTED' FROM f WHERE scenario_id = 'MACHINERY'
                   AND learner_tier <> 'extended' OR (scenario_id = 'MACHINERY' AND false)
        UNION ALL SELECT scenario_id, 'absent', NULL, 'METHOD_MISSING' FROM (SELECT DISTINCT scenario_id FROM m) q WHERE scenario_id <> 'MACHINERY'
        UNION ALL SELECT DISTINCT scenario_id, method_id, 'order_value', 'DUPLICATE_FACT' FROM f WHERE scenario_id = 'FURNITURE'""".replace(
        "AND learner_tier <> 'extended' OR (scenario_id = 'MACHINERY' AND false)", ""
    ).replace("WHERE learner_tier = 'extended'", "WHERE learner_tier = 'extended' AND scenario_id <> 'MACHINERY'"),
)
def _(fx: Inputs) -> DataFrame:
    facts = fx.sql(FACTS).filter("NOT (scenario_id = 'BUILDING' AND metric_id = 'order_value')")
    again = facts.filter("scenario_id = 'FURNITURE' AND metric_id = 'order_value' AND replication_id = 5")
    known = facts.filter("scenario_id <> 'MACHINERY'").select("scenario_id", "method_id", "learner_tier").distinct()
    registered = known.withColumn("learner_tier", F.when(F.col("learner_tier") == "extended", "core").otherwise(F.col("learner_tier")))
    absent = known.select("scenario_id").distinct().select("scenario_id", F.lit("absent").alias("method_id"), F.lit("core").alias("learner_tier"))
    return mcse.validate_coverage(facts.unionByName(again), registered.unionByName(absent), ["order_value", "budget::cost_regret_vs_oracle"])


@query(
    "control_decisions",
    f"""SELECT scenario_id, method_id, min(replications) AS completed, bool_and(minimum_met AND target_met) AS precision_met,
               bool_and(target_met OR maximum_reached) AS terminal_at_cap, count(*) AS gated_metric_count FROM ({SUMMARY_SQL}) s WHERE gate_required GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return mcse.control_decision(_summary(fx))


@query(
    "coordinate_bijection",
    """SELECT scenario_id, method_id, CAST(replication_id AS BIGINT) AS replication_id, CASE WHEN replication_id % 100 = 1 THEN 'left_only' ELSE 'right_only' END AS side
       FROM fx_facts WHERE replication_id % 100 IN (1, 2)""",
)
def _(fx: Inputs) -> DataFrame:
    facts = fx("fx_facts")
    return mcse.coordinate_bijection(
        facts.filter("replication_id % 100 <> 2"), facts.filter("replication_id % 100 <> 1"), ["scenario_id", "method_id", "replication_id"]
    )


@query(
    "label_summary",
    f"""SELECT count(*) AS row_count, avg(CAST(outcome IS NOT NULL AS INT)) AS known_rate, round(avg(CAST(coalesce(outcome, false) AS INT)), 9) AS positive_rate,
               round(avg(CAST(outcome AS INT)), 9) AS positive_rate_known
        FROM fx_doc_panel p LEFT JOIN (SELECT * FROM ({TARGET_SQL}) t WHERE target_id = 'L1') l ON l.entity_id = p.entity_id AND l.period = p.period""",
)
def _(fx: Inputs) -> DataFrame:
    labels = _targets(fx).filter("target_id = 'L1'").select(*KEY, "outcome")
    result = mcse.label_summary(fx("fx_doc_panel").select(*KEY), labels)
    return result.withColumns({c: F.round(c, 9) for c in ("positive_rate", "positive_rate_known")})


@query(
    "covariate_pool",
    """SELECT entity_id, period, round((spend - avg(spend) OVER ()) / stddev_pop(spend) OVER (), 6) AS spend, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 6) AS balance
       FROM (SELECT *, coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM fx_domain)) AS b FROM fx_domain) d""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_domain").select(*KEY, "spend", "balance")
    return _round(mcse.zscore_pool(rows, ["spend", "balance"]), 6)


@query(
    "inverted_prevalence",
    """SELECT domain, round(q, 9) AS q, p0, p1, round(CASE WHEN v BETWEEN -1e-9 AND 1 + 1e-9 THEN greatest(0, least(1, v)) END, 8) AS prevalence,
              CASE WHEN v BETWEEN -1e-9 AND 1 + 1e-9 THEN 'PASS' ELSE 'INCOMPATIBLE' END AS status
       FROM (SELECT *, (q - p0) / (p1 - p0) AS v FROM (SELECT domain, avg(CAST(outcome AS INT)) AS q, 0.2::DOUBLE AS p0, CASE WHEN domain = 'BUILDING' THEN 0.3 ELSE 0.8 END::DOUBLE AS p1
             FROM fx_domain GROUP BY 1) r) s""",
)
def _(fx: Inputs) -> DataFrame:
    rates = fx("fx_domain").groupBy("domain").agg(F.avg(F.col("outcome").cast("double")).alias("q"))
    rates = rates.select("*", F.lit(0.2).alias("p0"), F.when(F.col("domain") == "BUILDING", 0.3).otherwise(0.8).alias("p1"))
    return mcse.invert_prevalence(rates).withColumns({"q": F.round("q", 9), "prevalence": F.round("prevalence", 8)})


LATENT = "(SELECT * REPLACE (outcome OR CAST(entity_id AS INT) % 13 = 0 AS outcome) FROM fx_scores)"


@query(
    "gap_metrics",
    f"""SELECT a.model_id, a.period, round(coalesce(a.average_precision, 0), 8) AS ap_observed, round(coalesce(u.roc_auc, 0.5), 8) AS auc_observed,
               round(coalesce(la.average_precision, 0), 8) AS ap_latent, round(coalesce(lu.roc_auc, 0.5), 8) AS auc_latent,
               round(coalesce(a.average_precision, 0) - coalesce(la.average_precision, 0), 8) AS ap_gap,
               round(coalesce(u.roc_auc, 0.5) - coalesce(lu.roc_auc, 0.5), 8) AS auc_gap
        FROM ({AP_SQL}) a JOIN ({AUC_SQL}) u ON u.model_id = a.model_id AND u.period = a.period
        JOIN ({AP_SQL.replace("fx_scores", LATENT)}) la ON la.model_id = a.model_id AND la.period = a.period
        JOIN ({AUC_SQL.replace("fx_scores", LATENT)}) lu ON lu.model_id = a.model_id AND lu.period = a.period""",
)
def _(fx: Inputs) -> DataFrame:
    latent = F.col("outcome") | (F.col("entity_id").cast("int") % 13 == 0)
    rows = fx("fx_scores").select("*", F.col("outcome").alias("observed"), latent.alias("latent"))
    gaps = mcse.gap_metrics(rows, 0.1, ["model_id", "period"])
    return _round(gaps.drop("precision_observed", "precision_latent"), 8)


@query(
    "replication_plan",
    f"""SELECT scenario_id, method_id, {TIER} AS tier, lo AS minimum, hi AS maximum, count(*) AS facts FROM ({FACTS}) f JOIN {PLAN_ROWS} ON t = {TIER} GROUP BY ALL""",
)
def _(fx: Inputs) -> DataFrame:
    methods = fx.sql(FACTS).groupBy("scenario_id", "method_id", "learner_tier", "cost_regime", "treatment", "family").agg(F.count(F.lit(1)).alias("facts"))
    return mcse.replication_plan(methods, PLAN).select("scenario_id", "method_id", "tier", "minimum", "maximum", "facts")
