"""Evidence records, decisions and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.functions import tri
from paneloom.functions.provenance import mine_provenance
from paneloom.functions.sets import derived_key, json_array
from paneloom.functions.text import norm_text
from paneloom.operators import cells, decisions, evidence
from paneloom.operators import panel as panels
from paneloom.operators.ranking import cut
from paneloom.plans.bindings import Inputs, query

# ------------------------------------------------------------- matched pairs

PREPOST = {"amount": ("value_pre", "value_post"), "volume": ("volume_pre", "volume_post")}
PAIR_ENDPOINTS = [
    {"item": "amount", "unit": "U", "scope": "group", "family": "stock", "threshold": 0.05},
    {"item": "volume", "unit": "N", "scope": "group", "family": "stock", "threshold": None},
]


@query(
    "pre_post_rows",
    """SELECT entity_id, period, 'amount' AS item, 'pre' AS status, value_pre AS value FROM fx_prepost
       UNION ALL SELECT entity_id, period, 'amount', 'post', value_post FROM fx_prepost
       UNION ALL SELECT entity_id, period, 'volume', 'pre', volume_pre FROM fx_prepost
       UNION ALL SELECT entity_id, period, 'volume', 'post', volume_post FROM fx_prepost""",
)
def _(fx: Inputs) -> DataFrame:
    return evidence.expand_pre_post(fx("fx_prepost"), PREPOST)


PAIRS_SQL = """
    SELECT entity_id, period, anchor, item, pre_count, post_count, reason,
           CASE reason WHEN 'MATERIAL_ADJUSTMENT' THEN true WHEN 'BELOW_MATERIALITY_THRESHOLD' THEN false END AS outcome,
           reason IN ('MATERIAL_ADJUSTMENT', 'BELOW_MATERIALITY_THRESHOLD', 'EMPIRICAL_RULE_NOT_LOCKED') AS opportunity,
           CASE WHEN reason IN ('MATERIAL_ADJUSTMENT', 'BELOW_MATERIALITY_THRESHOLD', 'EMPIRICAL_RULE_NOT_LOCKED',
                                'INVALID_DENOMINATOR_BELOW_FLOOR') THEN abs(pre - post) / abs(post) END AS ratio
    FROM (
      SELECT *, CASE WHEN pre_count = 0 AND post_count = 0 THEN 'PAIR_MISSING_BOTH' WHEN pre_count = 0 THEN 'PAIR_MISSING_PRE'
             WHEN post_count = 0 THEN 'PAIR_MISSING_POST'
             WHEN (pre_count > 1 OR post_count > 1) AND (pre_kinds > 1 OR post_kinds > 1) THEN 'DUPLICATE_CONFLICT'
             WHEN pre_count > 1 OR post_count > 1 THEN 'DUPLICATE_STATUS_RECORD'
             WHEN pre IS NULL OR post IS NULL THEN 'PAIR_VALUE_MISSING'
             WHEN units <> 1 OR unit <> expected THEN 'INCONSISTENT_UNIT'
             WHEN scopes <> 1 OR scope <> 'group' THEN 'SCOPE_MISMATCH'
             WHEN families <> 1 OR family <> 'stock' THEN 'FAMILY_MISMATCH'
             WHEN post = 0 THEN 'INVALID_DENOMINATOR_ZERO' WHEN abs(post) <= 30000 THEN 'INVALID_DENOMINATOR_BELOW_FLOOR'
             WHEN item = 'volume' THEN 'EMPIRICAL_RULE_NOT_LOCKED'
             WHEN abs(pre - post) / abs(post) > 0.05 THEN 'MATERIAL_ADJUSTMENT' ELSE 'BELOW_MATERIALITY_THRESHOLD' END AS reason
      FROM (SELECT p.entity_id, p.period, p.anchor, e.item, e.expected,
                   count_if(r.status = 'pre') AS pre_count, count_if(r.status = 'post') AS post_count,
                   max(r.value) FILTER (r.status = 'pre') AS pre, max(r.value) FILTER (r.status = 'post') AS post,
                   count(DISTINCT concat(coalesce(CAST(r.value AS STRING), '-'), r.unit, r.scope, r.family))
                     FILTER (r.status = 'pre') AS pre_kinds,
                   count(DISTINCT concat(coalesce(CAST(r.value AS STRING), '-'), r.unit, r.scope, r.family))
                     FILTER (r.status = 'post') AS post_kinds,
                   count(DISTINCT r.unit) AS units, max(r.unit) AS unit, count(DISTINCT r.scope) AS scopes,
                   max(r.scope) AS scope, count(DISTINCT r.family) AS families, max(r.family) AS family
            FROM fx_panel p CROSS JOIN (VALUES ('amount', 'U'), ('volume', 'N')) e(item, expected)
            LEFT JOIN fx_pairs r ON r.entity_id = p.entity_id AND r.period = p.period AND r.item = e.item
            GROUP BY 1, 2, 3, 4, 5) g) c"""


def _pairs(fx: Inputs) -> DataFrame:
    return evidence.matched_pairs(fx("fx_panel"), fx("fx_pairs"), PAIR_ENDPOINTS, 30000.0)


@query("matched_pairs", PAIRS_SQL)
def _(fx: Inputs) -> DataFrame:
    return _pairs(fx)


@query(
    "pair_failures",
    f"""SELECT entity_id, period, item, reason, opportunity, pre_count, post_count FROM ({PAIRS_SQL}) q
        WHERE outcome IS NULL""",
)
def _(fx: Inputs) -> DataFrame:
    return evidence.pair_failures(_pairs(fx))


AUDIT_COLUMNS = """count(*) AS result_count, count_if(opportunity IS TRUE) AS opportunity_count, count_if(outcome IS TRUE) AS positive_count,
                   count_if(outcome IS FALSE) AS observed_zero_count, count_if(outcome IS NULL) AS unknown_count"""


@query("pair_audit", f"SELECT item, {AUDIT_COLUMNS} FROM ({PAIRS_SQL}) q GROUP BY 1")
def _(fx: Inputs) -> DataFrame:
    return evidence.outcome_audit(_pairs(fx), ["item"])


FLAGSHIP_SQL = """
    SELECT period, reason, count_if(outcome IS TRUE) AS positive_count, count_if(outcome IS FALSE) AS observed_zero_count,
           count_if(outcome IS NULL) AS unknown_count
    FROM (SELECT p.period, CASE WHEN value_pre IS NULL AND value_post IS NULL THEN 'PAIR_VALUE_MISSING'
                 WHEN value_pre IS NULL OR value_post IS NULL THEN 'PAIR_VALUE_MISSING'
                 WHEN value_post = 0 THEN 'INVALID_DENOMINATOR_ZERO'
                 WHEN abs(value_post) <= 1 THEN 'INVALID_DENOMINATOR_BELOW_FLOOR'
                 WHEN abs(value_pre - value_post) / abs(value_post) > 0.05 THEN 'MATERIAL_ADJUSTMENT'
                 ELSE 'BELOW_MATERIALITY_THRESHOLD' END AS reason,
                 CASE WHEN value_pre IS NOT NULL AND abs(value_post) > 1
                      THEN abs(value_pre - value_post) / abs(value_post) > 0.05 END AS outcome
          FROM fx_panel p LEFT JOIN fx_prepost v ON v.entity_id = p.entity_id AND v.period = p.period) q
    GROUP BY 1, 2"""


@query("flagship_pair_labels", FLAGSHIP_SQL)
def _(fx: Inputs) -> DataFrame:
    panel = panels.build_panel(fx("fx_obs"), ["orders", "lineitem"])
    rows = evidence.expand_pre_post(fx("fx_prepost"), {"amount": PREPOST["amount"]}).select(
        "*", F.lit("U").alias("unit"), F.lit("group").alias("scope"), F.lit("stock").alias("family")
    )
    pairs = evidence.matched_pairs(panel, rows, PAIR_ENDPOINTS[:1], 1.0)
    labels = pairs.groupBy("entity_id", "period", "reason").agg(
        tri.union_label(F.col("outcome"), F.col("opportunity")).alias("outcome")
    )
    return labels.groupBy("period", "reason").agg(
        F.count_if("outcome").alias("positive_count"),
        F.count_if(~F.col("outcome")).alias("observed_zero_count"),
        F.count_if(F.col("outcome").isNull()).alias("unknown_count"),
    )


# ------------------------------------------------------------- opinions

TAXONOMY = {"5-LOW": "clean", "3-Medium ": "qualified", "2-HIGH": "adverse", "1-urgent": "warning"}


@query(
    "indicator_tokens",
    """SELECT indicator, CASE WHEN trim(indicator) IN ('opinion', 'yes') THEN true WHEN trim(indicator) IN ('', 'no') THEN false END
              AS observed, count(*) AS n
       FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'opinion' WHEN 1 THEN ' yes ' WHEN 2 THEN ' ' WHEN 3 THEN 'no'
                    ELSE 'other' END AS indicator FROM orders) q GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx.sql(
        """SELECT CASE o_orderkey % 5 WHEN 0 THEN 'opinion' WHEN 1 THEN ' yes ' WHEN 2 THEN ' ' WHEN 3 THEN 'no'
                  ELSE 'other' END AS indicator FROM orders"""
    )
    observed = evidence.indicator_observed(F.col("indicator"), "O-pinion")
    return rows.withColumn("observed", observed).groupBy("indicator", "observed").agg(F.count(F.lit(1)).alias("n"))


OPINION_SQL = """
    SELECT p.entity_id, p.period, p.anchor, coalesce(n, 0) AS record_count, reason,
           CASE reason WHEN 'NON_CLEAN_OPINION' THEN true WHEN 'CLEAN_OPINION' THEN false END AS outcome,
           reason IN ('NON_CLEAN_OPINION', 'CLEAN_OPINION', 'CATEGORY_PENDING') AS opportunity,
           CASE WHEN reason IN ('NON_CLEAN_OPINION', 'CLEAN_OPINION', 'CATEGORY_PENDING', 'CATEGORY_UNMAPPED') THEN c1 END
             AS category
    FROM (SELECT p.*, n, c1,
                 CASE WHEN n IS NULL THEN 'OPINION_RECORD_MISSING' WHEN bad > 0 THEN 'PERIOD_OR_SCOPE_MISMATCH'
                      WHEN unmapped > 0 THEN 'OPINION_UNMAPPED' WHEN mapped = 0 THEN 'OPINION_MISSING'
                      WHEN kinds > 1 OR (n > 1 AND mapped < n) THEN 'CONFLICTING_OPINIONS'
                      WHEN c1 IN ('qualified', 'adverse') THEN 'NON_CLEAN_OPINION' WHEN c1 = 'clean' THEN 'CLEAN_OPINION'
                      WHEN c1 = 'warning' THEN 'CATEGORY_PENDING' ELSE 'CATEGORY_UNMAPPED' END AS reason
          FROM fx_panel p LEFT JOIN (
            SELECT entity_id, period, count(*) AS n, count_if(period_type <> 'annual') AS bad, count(cat) AS mapped,
                   count_if(trim(opinion_raw) <> '' AND cat IS NULL) AS unmapped, count(DISTINCT cat) AS kinds, min(cat) AS c1
            FROM (SELECT *, CASE lower(trim(opinion_raw)) WHEN '5-low' THEN 'clean' WHEN '3-medium' THEN 'qualified'
                         WHEN '2-high' THEN 'adverse' WHEN '1-urgent' THEN 'warning' END AS cat
                  FROM fx_opinion WHERE indicator = 'opinion') o GROUP BY 1, 2) g
            ON g.entity_id = p.entity_id AND g.period = p.period) p"""


def _opinions(fx: Inputs) -> DataFrame:
    return evidence.opinion_results(
        fx("fx_panel"),
        fx("fx_opinion"),
        TAXONOMY,
        positive=["qualified", "adverse"],
        negative=["clean"],
        pending=["warning"],
        indicator="opinion",
        expected={"period_type": "annual", "scope": "group", "status": "audited"},
    )


@query("opinion_results", OPINION_SQL)
def _(fx: Inputs) -> DataFrame:
    return _opinions(fx)


@query(
    "normalized_text",
    "SELECT lower(trim(opinion_raw)) AS text, count(*) AS n FROM fx_opinion GROUP BY 1",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_opinion").select(norm_text(F.col("opinion_raw")).alias("text"))
    return rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_reference_rollup",
    """SELECT entity_id, period, 0 AS cell, string_agg(r, ' | ' ORDER BY r) AS refs
       FROM (SELECT DISTINCT entity_id, period, source_ref AS r FROM fx_opinion) q GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return cells.joined_cells(fx("fx_opinion"), ["entity_id", "period"], "source_ref")


@query(
    "kleene_opportunity",
    """SELECT a, b, CASE WHEN a = false OR b = false THEN false WHEN a AND b THEN true END AS opportunity, count(*) AS n
       FROM (SELECT broad_source AS a, broad_observed AS b FROM fx_endpoints) q GROUP BY 1, 2, 3""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_endpoints").select(F.col("broad_source").alias("a"), F.col("broad_observed").alias("b"))
    rows = rows.withColumn("opportunity", tri.effective_opportunity(F.col("a"), F.col("b")))
    return rows.groupBy("a", "b", "opportunity").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- wide endpoints

ENDPOINT_COLUMNS = {
    e: {"outcome": f"{e}_outcome", "source_opportunity": f"{e}_source", "observation_opportunity": f"{e}_observed",
        "provenance": f"{e}_provenance"}
    for e in ("broad", "narrow")
}


def _endpoint_part(name: str) -> str:
    return f"""SELECT p.entity_id, p.period, p.anchor, '{name}' AS endpoint, {name}_outcome AS o,
                      {name}_source AND {name}_observed AS opp, nullif({name}_provenance, '[]') AS provenance,
                      w.entity_id IS NULL AS absent
               FROM fx_panel p LEFT JOIN fx_endpoints w ON w.entity_id = p.entity_id AND w.period = p.period"""


ENDPOINT_SQL = f"""
    SELECT entity_id, period, anchor, endpoint, CASE WHEN opp THEN o END AS outcome, opp AS opportunity, provenance,
           CASE WHEN opp IS DISTINCT FROM true THEN 'OPPORTUNITY_UNKNOWN' WHEN o THEN 'ENDPOINT_POSITIVE'
                WHEN o IS NULL THEN 'UNDETERMINED_WITH_PROVENANCE' ELSE 'COMPLETE_SOURCE_ENDPOINT_ZERO' END AS reason,
           CASE WHEN absent THEN 'PANEL_ROW_MISSING'
                WHEN opp AND o AND provenance IS NULL THEN 'POSITIVE_WITHOUT_PROVENANCE'
                WHEN opp AND o IS NULL AND provenance IS NULL THEN 'UNDETERMINED_WITHOUT_PROVENANCE'
                WHEN opp IS DISTINCT FROM true AND o THEN 'POSITIVE_WITHOUT_OPPORTUNITY' END AS violation
    FROM ({_endpoint_part("broad")} UNION ALL {_endpoint_part("narrow")}) e"""


def _endpoints(fx: Inputs) -> DataFrame:
    return evidence.endpoint_outcomes(fx("fx_panel"), fx("fx_endpoints"), ENDPOINT_COLUMNS)


@query("endpoint_outcomes", ENDPOINT_SQL)
def _(fx: Inputs) -> DataFrame:
    return _endpoints(fx)


@query(
    "mined_provenance",
    """SELECT entity_id, period,
              CASE WHEN bad OR broad_provenance LIKE '%note%' OR broad_provenance = '[]' OR broad_provenance IS NULL THEN []
                   ELSE list_sort(list_distinct(regexp_extract_all(broad_provenance, '"(d[0-9]+)"', 1))) END AS document_ids,
              CASE WHEN bad THEN [] ELSE regexp_extract_all(coalesce(broad_provenance, ''), '[0-9]{4}-[0-9]{2}-[0-9]{2}') END AS date_texts,
              CASE WHEN bad THEN [] ELSE regexp_extract_all(coalesce(broad_provenance, ''), '"(C[0-9])"', 1) END AS codes,
              CASE WHEN bad THEN 'MALFORMED_PROVENANCE' END AS problem
       FROM (SELECT *, CAST(entity_id AS INT) % 17 = 0 AND broad_provenance IS NOT NULL AS bad FROM fx_endpoints) e""",
)
def _(fx: Inputs) -> DataFrame:
    # some cells are cut off in the middle, so that malformed ones are compared too
    cell = F.when(F.col("entity_id").cast("int") % 17 == 0, F.expr("substring(broad_provenance, 1, length(broad_provenance) - 1)")).otherwise(
        F.col("broad_provenance")
    )
    rows = fx("fx_endpoints").withColumn("m", mine_provenance(cell))
    return rows.select("entity_id", "period", "m.document_ids", "m.date_texts", "m.codes", "m.problem")


@query(
    "derived_keys",
    "SELECT event_id, concat('embedded-provenance-', substring(sha256(replace(props, ' ', '')), 1, 16)) AS derived FROM events",
)
def _(fx: Inputs) -> DataFrame:
    canonical = F.col("_m.canonical")
    return fx("events").withColumn("_m", mine_provenance("props")).select("event_id", derived_key(canonical).alias("derived"))


@query(
    "endpoint_decision_ledger",
    f"""SELECT document_id, entity_id, period, to_json(list_sort(list_distinct(list(endpoint)))) AS endpoints,
               to_json(list_sort(list_distinct(flatten(list(codes))))) AS codes, count(DISTINCT provenance) AS reference_count,
               CAST(NULL AS STRING) AS problem
        FROM (SELECT *, unnest(CASE WHEN len(ids) = 0 THEN
                  [concat('embedded-provenance-', substring(sha256(replace(provenance, '": "', '":"')), 1, 16))] ELSE ids END)
                AS document_id
              FROM (SELECT *, list_distinct(regexp_extract_all(provenance, '"(d[0-9]+)"', 1)) AS ids,
                           regexp_extract_all(provenance, '"(C[0-9])"', 1) AS codes
                    FROM ({ENDPOINT_SQL}) e WHERE outcome AND provenance IS NOT NULL) m) x GROUP BY 1, 2, 3""",
)
def _(fx: Inputs) -> DataFrame:
    return evidence.endpoint_decisions(_endpoints(fx).filter("provenance IS NOT NULL"))


# ------------------------------------------------------------- decisions

CODES = decisions.Taxonomy(
    reporting_levels=["REPORTING"], reporting_codes=["C5"], content_codes=["C1", "C2"], timeliness_codes=["C3"],
    broad_levels=["CONDUCT"],
)
YEAR = "coalesce(event_year, CAST(year(decision_date) AS INT), CAST(year(publish_date) AS INT), target_period + 1)"
CLASSIFIED_SQL = f"""
    SELECT *, CASE WHEN inc THEN true END AS broad, CASE WHEN inc AND (rep OR wide) THEN rep END AS reporting,
           CASE WHEN inc AND (rep OR wide) THEN code IN ('c1', 'c2') END AS content,
           CASE WHEN inc AND (rep OR wide) THEN code = 'c3' END AS timeliness,
           CASE WHEN NOT inc THEN 'EXCLUDED_BY_SOURCE_RULE' WHEN NOT (rep OR wide) THEN 'UNMAPPED_TAXONOMY' END AS code_reason
    FROM (SELECT *, {YEAR} AS y, row_included AND hard_positive AS inc,
                 coalesce(upper(trim(level_1)) = 'REPORTING', false) OR code IN ('c1', 'c2', 'c3', 'c5') AS rep,
                 coalesce(upper(trim(level_1)) = 'CONDUCT', false) AS wide FROM fx_decisions) d"""
DEDUPED_SQL = """
    SELECT document_id, entity_id, decision_number, event_year, decision_date, publish_date, known_date, target_period, level_1,
           code, row_included, hard_positive, total_fine, has_fine, has_warning, min(source_ref) AS source_ref, count(*) AS copies
    FROM fx_decisions GROUP BY ALL"""
RESOLVED_SQL = f"""
    SELECT document_id, entity_id, CASE WHEN ok THEN lo END AS resolved_year, CASE WHEN ok THEN lo - 1 END AS period,
           broad, reporting, content, timeliness, unmapped, codes, total_fine, has_fine, has_warning, first_known_date,
           last_known_date
    FROM (SELECT document_id, entity_id, min(y) AS lo, coalesce(min(y) = max(y) AND count(y) = count(*), false) AS ok,
                 true AS broad,
                 CASE WHEN bool_or(reporting) THEN true WHEN count(reporting) = count(*) THEN false END AS reporting,
                 CASE WHEN bool_or(content) THEN true WHEN count(content) = count(*) THEN false END AS content,
                 CASE WHEN bool_or(timeliness) THEN true WHEN count(timeliness) = count(*) THEN false END AS timeliness,
                 bool_or(coalesce(code_reason, '') = 'UNMAPPED_TAXONOMY') AS unmapped,
                 list_sort(list_distinct(list(upper(code)))) AS codes,
                 CASE WHEN count(DISTINCT total_fine) = 1 THEN max(total_fine) END AS total_fine,
                 CASE WHEN bool_or(has_fine) THEN true WHEN count(has_fine) = count(*) THEN false END AS has_fine,
                 CASE WHEN bool_or(has_warning) THEN true WHEN count(has_warning) = count(*) THEN false END AS has_warning,
                 min(coalesce(known_date, publish_date, decision_date)) AS first_known_date,
                 max(coalesce(known_date, publish_date, decision_date)) AS last_known_date
          FROM ({CLASSIFIED_SQL}) c WHERE inc GROUP BY 1, 2) g"""


def _resolved(fx: Inputs) -> DataFrame:
    return decisions.resolve_decisions(fx("fx_decisions"), CODES)


@query(
    "decision_years",
    f"""SELECT source_ref, {YEAR} AS resolved_year, {YEAR} - 1 AS target_period,
               CASE WHEN event_year IS NOT NULL THEN 'event_year' WHEN decision_date IS NOT NULL THEN 'decision_date'
                    WHEN publish_date IS NOT NULL THEN 'publish_date' ELSE 'YEAR_UNRESOLVED' END AS rule FROM fx_decisions""",
)
def _(fx: Inputs) -> DataFrame:
    year = decisions.event_year()
    return fx("fx_decisions").select(
        "source_ref", year.alias("resolved_year"), (year - 1).alias("target_period"), decisions.year_rule().alias("rule")
    )


@query(
    "source_year_completeness",
    "SELECT period, period + 1 <= 2024 AND period + 1 NOT IN (2021, 2023) AS complete, count(*) AS n FROM fx_decision_panel GROUP BY 1, 2",
)
def _(fx: Inputs) -> DataFrame:
    complete = decisions.year_complete(F.col("period") + 1, 2024, (2021, 2023))
    return fx("fx_decision_panel").groupBy("period", complete.alias("complete")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "taxonomy_classes",
    f"""SELECT source_ref, broad, reporting, content, timeliness, code_reason FROM ({CLASSIFIED_SQL}) q""",
)
def _(fx: Inputs) -> DataFrame:
    rows = decisions.classify_taxonomy(fx("fx_decisions"), CODES)
    return rows.select("source_ref", *decisions.ENDPOINTS, "code_reason")


@query("exact_duplicates", DEDUPED_SQL)
def _(fx: Inputs) -> DataFrame:
    return decisions.drop_exact_duplicates(fx("fx_decisions"))


@query(
    "inclusion_split",
    """SELECT CASE WHEN row_included AND hard_positive THEN 'included' ELSE 'excluded' END AS inclusion, count(*) AS n,
              count(DISTINCT document_id) AS documents FROM fx_decisions GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    rows = decisions.split_included(fx("fx_decisions"))
    return rows.groupBy("inclusion").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("documents")
    )


@query(
    "year_consensus",
    f"""SELECT document_id, entity_id, CASE WHEN ok THEN lo END AS resolved_year, CASE WHEN ok THEN lo - 1 END AS target_period,
               CASE WHEN NOT ok THEN 'YEAR_UNRESOLVED' END AS year_reason
        FROM (SELECT document_id, entity_id, min(y) AS lo, coalesce(min(y) = max(y) AND count(y) = count(*), false) AS ok
              FROM ({CLASSIFIED_SQL}) c WHERE inc GROUP BY 1, 2) g""",
)
def _(fx: Inputs) -> DataFrame:
    return decisions.year_consensus(fx("fx_decisions"))


@query(
    "endpoint_any_true",
    f"SELECT document_id, entity_id, broad, reporting, content, timeliness FROM ({RESOLVED_SQL}) q",
)
def _(fx: Inputs) -> DataFrame:
    rows = decisions.classify_taxonomy(fx("fx_decisions").filter(decisions.included()), CODES)
    return rows.groupBy("document_id", "entity_id").agg(
        *[tri.any_true(F.col(e)).alias(e) for e in decisions.ENDPOINTS]
    )


@query(
    "flag_any_true",
    """SELECT entity_id, CASE WHEN bool_or(has_fine) THEN true WHEN count(has_fine) = count(*) THEN false END AS has_fine,
              CASE WHEN bool_or(has_warning) THEN true WHEN count(has_warning) = count(*) THEN false END AS has_warning
       FROM fx_decisions GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    return fx("fx_decisions").groupBy("entity_id").agg(
        tri.any_true(F.col("has_fine")).alias("has_fine"), tri.any_true(F.col("has_warning")).alias("has_warning")
    )


@query(
    "decision_metadata",
    f"""SELECT q.document_id, q.entity_id, decision_numbers, codes, total_fine, has_fine, has_warning, first_known_date, last_known_date
        FROM ({RESOLVED_SQL}) q JOIN (SELECT document_id, entity_id, list_sort(list_distinct(list(decision_number))) AS decision_numbers
              FROM fx_decisions WHERE row_included AND hard_positive GROUP BY 1, 2) n
        ON n.document_id = q.document_id AND n.entity_id = q.entity_id""",
)
def _(fx: Inputs) -> DataFrame:
    return decisions.decision_metadata(fx("fx_decisions").filter(decisions.included()))


@query("resolved_decisions", RESOLVED_SQL)
def _(fx: Inputs) -> DataFrame:
    return _resolved(fx)


LONG_SQL = " UNION ALL ".join(
    f"SELECT *, '{e}' AS endpoint, {e} AS hit FROM resolved WHERE period IS NOT NULL" for e in decisions.ENDPOINTS
)
ENDPOINT_RESULTS_SQL = f"""
    WITH resolved AS ({RESOLVED_SQL}), long AS ({LONG_SQL})
    SELECT g.entity_id, g.period, g.endpoint, g.period + 1 AS required_year,
           CASE WHEN g.period + 1 <= 2024 AND g.period + 1 <> 2021 THEN true END AS opportunity,
           CASE state WHEN 'POSITIVE' THEN true WHEN 'COMPLETE_YEAR_ZERO' THEN false END AS outcome,
           CASE WHEN state NOT IN ('POSITIVE', 'COMPLETE_YEAR_ZERO') THEN state END AS reason,
           CASE WHEN unmapped THEN 'UNMAPPED_TAXONOMY' END AS code_reason
    FROM (SELECT p.*, unmapped, CASE WHEN pos THEN 'POSITIVE' WHEN u.entity_id IS NOT NULL THEN 'YEAR_UNRESOLVED'
                 WHEN NOT (p.period + 1 <= 2024 AND p.period + 1 <> 2021) THEN 'SOURCE_YEAR_INCOMPLETE'
                 WHEN unk THEN 'UNMAPPED_TAXONOMY' ELSE 'COMPLETE_YEAR_ZERO' END AS state
          FROM (SELECT entity_id, period, endpoint FROM fx_decision_panel
                CROSS JOIN (VALUES ('broad'), ('reporting'), ('content'), ('timeliness')) e(endpoint)) p
          LEFT JOIN (SELECT entity_id, period, endpoint, bool_or(hit) AS pos, count_if(hit IS NULL) > 0 AS unk,
                            bool_or(unmapped) AS unmapped FROM long GROUP BY 1, 2, 3) s
            ON s.entity_id = p.entity_id AND s.period = p.period AND s.endpoint = p.endpoint
          LEFT JOIN (SELECT DISTINCT entity_id FROM resolved WHERE period IS NULL) u ON u.entity_id = p.entity_id) g"""


def _settled(fx: Inputs) -> DataFrame:
    """Decisions whose year can be resolved, plus the unresolved ones of a few entities."""
    return _resolved(fx).filter("period IS NOT NULL OR CAST(entity_id AS INT) % 4 = 0")


@query(
    "endpoint_completion",
    ENDPOINT_RESULTS_SQL.replace(
        f"resolved AS ({RESOLVED_SQL})",
        f"resolved AS (SELECT * FROM ({RESOLVED_SQL}) r0 WHERE period IS NOT NULL OR CAST(entity_id AS INT) % 4 = 0)",
    ),
)
def _(fx: Inputs) -> DataFrame:
    return decisions.endpoint_results(fx("fx_decision_panel"), _settled(fx), 2024, (2021,))


@query(
    "endpoint_metadata",
    f"""WITH resolved AS ({RESOLVED_SQL}), long AS ({LONG_SQL}),
        chosen AS (SELECT entity_id, period, endpoint, bool_or(hit) AS pos FROM long GROUP BY 1, 2, 3
                   HAVING bool_or(hit) OR count_if(hit IS NULL) > 0)
        SELECT l.entity_id, l.period, l.endpoint, CASE WHEN pos THEN true END AS hit, count(*) AS decision_count,
               sum(total_fine) AS total_fine, list_sort(list_distinct(flatten(list(codes)))) AS codes,
               CASE WHEN bool_or(has_fine) THEN true WHEN count(has_fine) = count(*) THEN false END AS has_fine,
               CASE WHEN bool_or(has_warning) THEN true WHEN count(has_warning) = count(*) THEN false END AS has_warning,
               min(first_known_date) AS first_known_date, max(last_known_date) AS last_known_date
        FROM long l JOIN chosen c ON c.entity_id = l.entity_id AND c.period = l.period AND c.endpoint = l.endpoint
        WHERE (pos AND hit) OR (pos IS DISTINCT FROM true AND hit IS NULL) GROUP BY 1, 2, 3, 4""",
)
def _(fx: Inputs) -> DataFrame:
    return decisions.endpoint_metadata(_resolved(fx))


CHOSEN_SQL = f"""WITH resolved AS ({RESOLVED_SQL}), long AS ({LONG_SQL}),
        chosen AS (SELECT entity_id, period, endpoint, bool_or(hit) AS pos FROM long GROUP BY 1, 2, 3
                   HAVING bool_or(hit) OR count_if(hit IS NULL) > 0),
        picked AS (SELECT l.* FROM long l JOIN chosen c ON c.entity_id = l.entity_id AND c.period = l.period AND c.endpoint = l.endpoint
                   WHERE (pos AND hit) OR (pos IS DISTINCT FROM true AND hit IS NULL))"""


@query(
    "endpoint_document_cells",
    f"""{CHOSEN_SQL}
        SELECT entity_id, period, endpoint, hit, 0 AS cell, list_sort(list_distinct(list(document_id))) AS values FROM picked GROUP BY 1, 2, 3, 4""",
)
def _(fx: Inputs) -> DataFrame:
    resolved = cut(_resolved(fx))
    documents = resolved.select("document_id", "entity_id", F.col("document_id").alias("document"))
    return decisions.endpoint_cells(resolved, documents, "document")


@query(
    "endpoint_number_cells",
    f"""{CHOSEN_SQL}
        SELECT p.entity_id, period, endpoint, hit, 0 AS cell, list_sort(list_distinct(list(decision_number))) AS values
        FROM picked p JOIN fx_decisions d ON d.document_id = p.document_id AND d.entity_id = p.entity_id AND row_included AND hard_positive
        GROUP BY 1, 2, 3, 4""",
)
def _(fx: Inputs) -> DataFrame:
    return decisions.endpoint_cells(cut(_resolved(fx)), fx("fx_decisions").filter(decisions.included()), "decision_number")


#: A third of the events belongs to one decision, each with a number of its own, so that key needs many cells.
HOT_SQL = """
    SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE concat('d', CAST(event_id % 90 AS STRING)) END AS document_id,
           CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE CAST(user_id % 40 AS STRING) END AS entity_id,
           CASE WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 3 = 0 THEN concat(' n', CAST(event_id AS STRING)) ELSE concat('n', CAST(event_id % 70 AS STRING)) END AS decision_number
    FROM events"""


@query(
    "decision_number_cells",
    f"""SELECT document_id, entity_id, CAST((pos - 1) // 200 AS INT) AS cell, list(n ORDER BY n) AS values FROM (
          SELECT *, row_number() OVER (PARTITION BY document_id, entity_id ORDER BY n) AS pos
          FROM (SELECT DISTINCT document_id, entity_id, trim(decision_number) AS n FROM ({HOT_SQL}) h WHERE trim(decision_number) <> '') d) p GROUP BY 1, 2, 3""",
)
def _(fx: Inputs) -> DataFrame:
    return decisions.decision_cells(fx.sql(HOT_SQL), F.trim("decision_number"), per_cell=200)


LEDGER_SQL = f"""
    WITH d AS ({DEDUPED_SQL}), c AS (
      SELECT *, {YEAR} AS y, row_included AND hard_positive AS inc,
             NOT (coalesce(upper(trim(level_1)) IN ('REPORTING', 'CONDUCT'), false) OR code IN ('c1', 'c2', 'c3', 'c5')) AS un
      FROM d)
    SELECT document_id, entity_id, CASE WHEN ok THEN lo - 1 END AS target_period, f.level_1 AS level_1, f.code AS code,
           true AS hard_positive, true AS row_included, codes, first_ref, source_rows,
           CASE WHEN NOT ok THEN 'YEAR_UNRESOLVED' WHEN unmapped THEN 'UNMAPPED_TAXONOMY' END AS code_reason
    FROM (SELECT document_id, entity_id, min(y) AS lo, coalesce(min(y) = max(y) AND count(y) = count(*), false) AS ok,
                 arg_min({{'level_1': level_1, 'code': code}},
                         {{'a': coalesce(y, 0), 'b': coalesce(code, ''), 'c': coalesce(level_1, ''), 'd': source_ref}}) AS f,
                 list_sort(list_distinct(list(upper(code)))) AS codes, min(source_ref) AS first_ref, count(*) AS source_rows,
                 bool_or(un) AS unmapped
          FROM c WHERE inc GROUP BY 1, 2) g
    UNION ALL
    SELECT document_id, entity_id, NULL, level_1, code, hard_positive, row_included, [upper(code)], source_ref, 1,
           'EXCLUDED_BY_SOURCE_RULE' FROM c WHERE NOT inc"""


def _ledger(fx: Inputs) -> DataFrame:
    return decisions.decision_ledger(fx("fx_decisions"), CODES)


@query("decision_ledger", LEDGER_SQL)
def _(fx: Inputs) -> DataFrame:
    return _ledger(fx)


@query(
    "decision_grain",
    f"""SELECT document_id, entity_id, CASE WHEN any_in OR n = 1 THEN f.target_period END AS target_period, f.level_1 AS level_1,
               f.code AS code, f.first_ref AS first_ref, f.source_rows AS source_rows,
               CASE WHEN any_in OR n = 1 THEN f.hard_positive ELSE false END AS hard_positive,
               CASE WHEN any_in OR n = 1 THEN f.row_included ELSE false END AS row_included,
               CASE WHEN any_in OR n = 1 THEN f.codes ELSE codes END AS codes,
               CASE WHEN any_in OR n = 1 THEN f.code_reason ELSE 'EXCLUDED_BY_SOURCE_RULE' END AS code_reason,
               n - 1 AS collapsed_rows
        FROM (SELECT document_id, entity_id, count(*) AS n, bool_or(row_included AND hard_positive) AS any_in,
                     arg_min({{'target_period': target_period, 'level_1': level_1, 'code': code, 'first_ref': first_ref,
                              'source_rows': source_rows, 'hard_positive': hard_positive, 'row_included': row_included,
                              'codes': codes, 'code_reason': code_reason}},
                             {{'a': CASE WHEN row_included AND hard_positive THEN 0 ELSE 1 END, 'b': first_ref}}) AS f,
                     list_sort(list_distinct(flatten(list(codes)))) AS codes
              FROM ({LEDGER_SQL}) l GROUP BY 1, 2) g""",
)
def _(fx: Inputs) -> DataFrame:
    return decisions.collapse_grain(_ledger(fx))


@query(
    "merged_json_arrays",
    """SELECT user_id, 0 AS cell, to_json(list_sort(list_distinct(list(event_type)))) AS labels,
              count_if(event_id % 50 = 0) AS invalid_cells
       FROM (SELECT user_id, event_id, CASE WHEN event_id % 50 <> 0 THEN event_type END AS event_type FROM events) q
       GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    cell = F.when(F.col("event_id") % 50 == 0, F.lit("oops")).otherwise(F.to_json(F.array("event_type")))
    return decisions.merge_json_arrays(fx("events").withColumn("labels", cell), ["user_id"], "labels")


@query(
    "repaired_document_ids",
    """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN
                 CASE WHEN event_id % 12 = 0 THEN NULL ELSE concat('embedded-provenance-', substring(sha256(
                   concat('["', event_type, '","{\\"k\\":', regexp_extract(props, '[0-9]+'), '}"]')), 1, 16)) END
              ELSE concat('d', CAST(event_id AS STRING)) END AS document_id,
              CASE WHEN event_id % 12 = 0 THEN 'PLACEHOLDER_WITHOUT_REFERENCES' END AS problem
       FROM events""",
)
def _(fx: Inputs) -> DataFrame:
    event = F.col("event_id")
    rows = fx("events").select(
        "event_id",
        F.when(event % 6 == 0, F.when(event % 12 == 0, " [] ").otherwise("None"))
        .otherwise(F.concat(F.lit("d"), event.cast("string")))
        .alias("document_id"),
        F.when(event % 12 == 0, F.to_json(F.array(F.lit(" "), F.lit("[]"), F.lit("{}"))))
        .otherwise(F.to_json(F.array("props", F.lit("nan"), "event_type", "props")))
        .alias("refs"),
    )
    return decisions.repair_document_ids(rows).select("event_id", "document_id", "problem")


@query(
    "conflict_checked_rollup",
    f"""SELECT document_id, entity_id, max(level_1) AS level_1, max(code) AS code,
               CASE WHEN count(DISTINCT target_period) = 1 THEN max(target_period) END AS target_period,
               list_sort(list_distinct(flatten(list(codes)))) AS codes, bool_or(hard_positive) AS hard_positive,
               bool_or(row_included) AS row_included,
               CASE WHEN count(DISTINCT target_period) > 1 THEN 'AMBIGUOUS_TARGET_PERIOD' ELSE max(code_reason) END AS code_reason,
               list_filter([CASE WHEN count(DISTINCT trim(level_1)) > 1 THEN 'level_1' END,
                            CASE WHEN count(DISTINCT code) > 1 THEN 'code' END,
                            CASE WHEN count(DISTINCT code_reason) > 1 AND count(DISTINCT target_period) <= 1
                                 THEN 'code_reason' END], lambda x: x IS NOT NULL) AS conflicts
        FROM (SELECT document_id, entity_id, trim(level_1) AS level_1, code, target_period, codes, hard_positive, row_included,
                     code_reason FROM ({LEDGER_SQL}) l) q GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return decisions.rollup_conflict_checked(_ledger(fx), ["level_1", "code"])


@query(
    "mapped_outcomes",
    """SELECT count_if(i AND d) AS direct_positive, count_if(i AND NOT d) AS direct_zero,
              count_if(i AND d) AS indicator_positive, CAST(0 AS BIGINT) AS indicator_zero, count_if(NOT i) AS excluded
       FROM (SELECT event_id % 7 <> 0 AS i, value > 10 AS d FROM events) q""",
)
def _(fx: Inputs) -> DataFrame:
    included, value = F.col("event_id") % 7 != 0, F.col("value") > 10
    direct = evidence.map_outcome("direct", value, value, included)
    positive = evidence.map_outcome("positive_indicator", value, value, included)
    return fx("events").agg(
        F.count_if(direct).alias("direct_positive"),
        F.count_if(~direct).alias("direct_zero"),
        F.count_if(positive).alias("indicator_positive"),
        F.count_if(~positive).alias("indicator_zero"),
        F.count_if(~included).alias("excluded"),
    )


# ------------------------------------------------------------- process and ledger

OPP = "CASE WHEN outcome IS NOT NULL AND opportunity IS NULL THEN true ELSE opportunity END"
MASK = f"""concat(CASE WHEN {OPP} IS NULL THEN '-' ELSE 'O' END, CASE WHEN verification IS NULL THEN '-' ELSE 'V' END,
                  CASE WHEN determination IS NULL THEN '-' ELSE 'D' END, CASE WHEN recording IS NULL THEN '-' ELSE 'R' END,
                  CASE WHEN outcome IS NULL THEN '-' ELSE 'S' END)"""
REASON = f"""CASE WHEN outcome IS NULL THEN CASE WHEN {OPP} IS NULL THEN 'OBSERVATION_OPPORTUNITY_UNKNOWN'
                  WHEN NOT {OPP} THEN 'NO_OBSERVATION_OPPORTUNITY' WHEN recording = false THEN 'DETERMINATION_NOT_RECORDED'
                  ELSE 'SOURCE_LABEL_UNKNOWN' END END"""


@query(
    "process_violations",
    f"""SELECT * FROM (
        SELECT record_id, CASE WHEN opportunity = false AND outcome IS NOT NULL THEN 'LABEL_WITHOUT_OPPORTUNITY'
               WHEN reason IS NOT NULL AND outcome IS NOT NULL THEN 'REASON_WITH_LABEL'
               WHEN mask <> {MASK} THEN 'MASK_CONFLICT'
               WHEN determination IS NOT NULL AND verification IS DISTINCT FROM true THEN 'DETERMINATION_WITHOUT_VERIFICATION'
               WHEN recording AND determination IS NULL THEN 'RECORDING_WITHOUT_DETERMINATION'
               WHEN verification_date IS NOT NULL AND verification IS NULL THEN 'VERIFICATION_DATE_WITHOUT_STATUS'
               WHEN determination_date IS NOT NULL AND determination IS NULL THEN 'DETERMINATION_DATE_WITHOUT_STATUS'
               WHEN recording_date IS NOT NULL AND recording IS NULL THEN 'RECORDING_DATE_WITHOUT_STATUS'
               WHEN determination IS NOT NULL AND recording IS NOT NULL
                    AND outcome <> (verification AND determination AND recording) THEN 'LABEL_CONFLICTS_WITH_PROCESS' END AS violation
        FROM fx_process) v WHERE violation IS NOT NULL""",
)
def _(fx: Inputs) -> DataFrame:
    return evidence.process_violations(fx("fx_process")).select("record_id", "violation")


@query("layer_masks", f"SELECT record_id, {OPP} AS opportunity, {MASK} AS mask FROM fx_process")
def _(fx: Inputs) -> DataFrame:
    return fx("fx_process").select(
        "record_id", evidence.implied_opportunity().alias("opportunity"), evidence.layer_mask().alias("mask")
    )


@query("unknown_reasons", f"SELECT {REASON} AS reason, count(*) AS n FROM fx_process GROUP BY 1")
def _(fx: Inputs) -> DataFrame:
    return fx("fx_process").groupBy(evidence.reason_unknown().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


LINK_SQL = """
    SELECT r.*, p.anchor, CASE WHEN NOT row_included THEN 'EXCLUDED_BY_SOURCE_RULE' WHEN p.anchor IS NULL THEN 'UNLINKED_ENTITY_PERIOD'
           WHEN role = 'annual_at_anchor' AND availability IS DISTINCT FROM anchor THEN 'ANNUAL_ANCHOR_MISMATCH'
           WHEN role = 'annual_at_anchor' THEN 'ACCEPTED_ANNUAL_MEASUREMENT' WHEN role = 'next_period' THEN 'ACCEPTED_NEXT_PERIOD_RESULT'
           WHEN availability IS NULL THEN 'AVAILABILITY_MISSING' ELSE 'ACCEPTED' END AS status
    FROM fx_records r LEFT JOIN fx_doc_panel p ON p.entity_id = r.entity_id AND p.period = r.period"""


@query("panel_links", f"SELECT record_id, status FROM ({LINK_SQL}) q")
def _(fx: Inputs) -> DataFrame:
    return evidence.link_records(fx("fx_records"), fx("fx_doc_panel")).select("record_id", "status")


@query(
    "duplicate_results",
    """SELECT event_type AS source_id, concat(CAST(user_id AS STRING), ':', props) AS record_id, count(*) AS copies
       FROM events GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_events").select("source_id", F.col("cluster_id").alias("record_id"))
    return evidence.duplicate_results(rows)


CLUSTER_SQL = f"""
    SELECT e.*, CASE WHEN kinds > 1 THEN 'CONFLICTING_UPSTREAM_CLUSTER'
                     WHEN concat(source_id, '|', event_id) = rep THEN 'ACCEPTED' ELSE 'DUPLICATE_UPSTREAM_EVENT' END AS status
    FROM fx_event_copies e JOIN (
      SELECT entity_id, period, cluster_id, min(concat(source_id, '|', event_id)) AS rep,
             count(DISTINCT concat(channel_id, CAST(availability AS STRING), coalesce(CAST(outcome AS STRING), '-'), role,
                                   coalesce(CAST({OPP} AS STRING), '-'))) AS kinds
      FROM fx_event_copies GROUP BY 1, 2, 3) c
      ON c.entity_id = e.entity_id AND c.period = e.period AND c.cluster_id = e.cluster_id"""


@query("event_cluster_dedup", f"SELECT event_id, source_id, cluster_id, status FROM ({CLUSTER_SQL}) q")
def _(fx: Inputs) -> DataFrame:
    rows = evidence.dedupe_event_clusters(fx("fx_event_copies"))
    return rows.select("event_id", "source_id", "cluster_id", "status")


@query(
    "event_cluster_dedup_by_source",
    f"""SELECT source_id, status, count(*) AS n FROM (
        SELECT e.source_id, CASE WHEN kinds > 1 THEN 'CONFLICTING_UPSTREAM_CLUSTER'
               WHEN concat(source_id, '|', event_id) = rep THEN 'ACCEPTED' ELSE 'DUPLICATE_UPSTREAM_EVENT' END AS status
        FROM fx_events e JOIN (SELECT cluster_id, min(concat(source_id, '|', event_id)) AS rep,
             count(DISTINCT concat(channel_id, CAST(availability AS STRING), coalesce(CAST(outcome AS STRING), '-'),
                                   coalesce(CAST({OPP} AS STRING), '-'))) AS kinds FROM fx_events GROUP BY 1) c
          ON c.cluster_id = e.cluster_id) q GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    rows = evidence.dedupe_event_clusters(fx("fx_events"))
    return rows.groupBy("source_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "lag_decomposition",
    f"""SELECT event_id, cluster_id, source_id,
               date_diff('day', make_date(q.period, 12, 31), CAST(anchor AS DATE)) AS report_lag_days,
               date_diff('day', CAST(anchor AS DATE), CAST(availability AS DATE)) AS detection_lag_days,
               date_diff('day', make_date(q.period, 12, 31), CAST(availability AS DATE)) AS total_lag_days,
               0 AS identity_error_days, true AS identity_holds
        FROM ({CLUSTER_SQL}) q JOIN fx_event_panel p ON p.entity_id = q.entity_id AND p.period = q.period
        WHERE status = 'ACCEPTED'""",
)
def _(fx: Inputs) -> DataFrame:
    accepted = evidence.dedupe_event_clusters(fx("fx_event_copies")).filter("status = 'ACCEPTED'")
    return evidence.lag_decomposition(accepted, fx("fx_event_panel"))


@query("ledger_counters", f"SELECT status, count(*) AS record_count FROM ({LINK_SQL}) q GROUP BY 1")
def _(fx: Inputs) -> DataFrame:
    return evidence.ledger_summary(evidence.link_records(fx("fx_records"), fx("fx_doc_panel")))


@query(
    "evidence_ledger",
    f"""SELECT source_id, channel_id, role, mask, reason_unknown, count(*) AS n, count_if(outcome IS TRUE) AS positives,
               count_if(opportunity IS TRUE) AS opportunities, round(sum(value), 4) AS total_value
        FROM (SELECT concat('pair:', item) AS source_id, 'P1' AS channel_id, 'annual_at_anchor' AS role, outcome, opportunity,
                     'O---' || CASE WHEN outcome IS NULL THEN '-' ELSE 'S' END AS mask,
                     CASE WHEN outcome IS NULL THEN reason END AS reason_unknown, ratio AS value FROM ({PAIRS_SQL}) a
              UNION ALL
              SELECT 'opinion', 'P2', 'annual_at_anchor', outcome, opportunity,
                     'O---' || CASE WHEN outcome IS NULL THEN '-' ELSE 'S' END,
                     CASE WHEN outcome IS NULL THEN reason END, NULL FROM ({OPINION_SQL}) b
              UNION ALL
              SELECT concat('endpoint:', endpoint), 'P3', 'next_period', outcome, opportunity,
                     CASE WHEN opportunity IS NULL THEN '-' ELSE 'O' END || CASE WHEN outcome THEN 'VDR' ELSE '---' END
                       || CASE WHEN outcome IS NULL THEN '-' ELSE 'S' END,
                     CASE WHEN outcome IS NULL THEN reason END, NULL FROM ({ENDPOINT_SQL}) c
              UNION ALL
              SELECT source_id, channel_id, role, outcome, {OPP},
                     CASE WHEN {OPP} IS NULL THEN '-' ELSE 'O' END || '---' || CASE WHEN outcome IS NULL THEN '-' ELSE 'S' END,
                     {REASON.replace("WHEN recording = false THEN 'DETERMINATION_NOT_RECORDED'", "")}, NULL
              FROM ({CLUSTER_SQL}) d WHERE status = 'ACCEPTED') u GROUP BY 1, 2, 3, 4, 5""",
)
def _(fx: Inputs) -> DataFrame:
    key = F.concat_ws(":", "source_id", "entity_id", F.col("period").cast("string"))
    pairs = _pairs(fx).select(
        "*", F.concat(F.lit("pair:"), "item").alias("source_id"), F.lit("P1").alias("channel_id"),
        F.lit(evidence.ANNUAL).alias("role"), F.col("anchor").alias("availability"), F.col("ratio").alias("value"),
    )
    opinions = _opinions(fx).select(
        "*", F.lit("opinion").alias("source_id"), F.lit("P2").alias("channel_id"), F.lit(evidence.ANNUAL).alias("role"),
        F.col("anchor").alias("availability"),
    )
    proven = F.when(F.col("outcome"), F.lit(True))
    endpoints = _endpoints(fx).select(
        "*", F.concat(F.lit("endpoint:"), "endpoint").alias("source_id"), F.lit("P3").alias("channel_id"),
        F.lit(evidence.NEXT).alias("role"), proven.alias("verification"), proven.alias("determination"),
        proven.alias("recording"),
    )
    delayed = evidence.dedupe_event_clusters(fx("fx_event_copies")).filter("status = 'ACCEPTED'").drop("status")
    parts = [p.withColumn("record_id", key) for p in (pairs, opinions, endpoints)]
    ledger = evidence.build_ledger(*parts, delayed.withColumn("record_id", F.col("event_id")))
    return ledger.groupBy("source_id", "channel_id", "role", "mask", "reason_unknown").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("outcome").alias("positives"),
        F.count_if("opportunity").alias("opportunities"),
        F.round(F.sum("value"), 4).alias("total_value"),
    )


@query(
    "migrated_ledger",
    """SELECT record_id, verification, determination, recording, label,
              concat(CASE WHEN opportunity IS NULL THEN '-' ELSE 'O' END, CASE WHEN verification IS NULL THEN '-' ELSE 'V' END,
                     CASE WHEN determination IS NULL THEN '-' ELSE 'D' END, CASE WHEN recording IS NULL THEN '-' ELSE 'R' END,
                     CASE WHEN label IS NULL THEN '-' ELSE 'S' END) AS mask,
              CASE WHEN label IS NULL THEN coalesce(r, CASE WHEN opportunity IS NULL THEN 'OBSERVATION_OPPORTUNITY_UNKNOWN'
                   WHEN NOT opportunity THEN 'NO_OBSERVATION_OPPORTUNITY' WHEN recording = false THEN 'DETERMINATION_NOT_RECORDED'
                   ELSE 'SOURCE_LABEL_UNKNOWN' END) END AS reason_unknown,
              CASE WHEN clash THEN 'PROCESS_CONFLICT' WHEN label IS NOT NULL AND r IS NOT NULL THEN 'REASON_WITH_LABEL' END AS conflict
       FROM (SELECT record_id, opportunity, outcome AS label, reason AS r,
                    CASE WHEN pub THEN true ELSE verification END AS verification,
                    CASE WHEN pub THEN true ELSE determination END AS determination,
                    CASE WHEN pub THEN true ELSE recording END AS recording,
                    pub AND (verification = false OR determination = false OR recording = false) IS TRUE AS clash
             FROM (SELECT *, coalesce(record_kind = 'endpoint_result' AND outcome, false) AS pub FROM fx_process) p) m""",
)
def _(fx: Inputs) -> DataFrame:
    old = fx("fx_process").select(
        "record_id", "record_kind", "opportunity", "verification", "determination", "recording", "outcome",
        F.col("reason").alias("reason_unknown"),
    )
    return evidence.migrate_ledger(old).select(
        "record_id", "verification", "determination", "recording", "label", "mask", "reason_unknown", "conflict"
    )


@query(
    "logical_sources",
    """SELECT r.source_id, l.physical_id, l.channel_id, count(*) AS records
       FROM fx_records r LEFT JOIN (VALUES ('labels', 'quality', 'S1'), ('labels', 'toxic', 'S1'), ('pages', 'lang', 'S3'))
            l(physical_id, source_id, channel_id) ON l.source_id = r.source_id GROUP BY 1, 2, 3""",
)
def _(fx: Inputs) -> DataFrame:
    registered = evidence.logical_sources(
        fx.spark,
        [
            {"physical_id": "labels", "channel_id": "S1", "role": evidence.ANNUAL, "zero_allowed": True,
             "endpoints": {"quality": "QUALITY", "toxic": "TOXIC"}},
            {"physical_id": "pages", "channel_id": "S3", "role": evidence.NEXT, "zero_allowed": False,
             "endpoints": {"lang": "LANG"}},
            {"physical_id": "old", "channel_id": "S9", "enabled": False, "endpoints": {"gone": "GONE"}},
        ],
    )
    rows = fx("fx_records").select("source_id")
    joined = rows.join(F.broadcast(registered), "source_id", "left")  # records of unregistered sources stay
    return joined.groupBy("source_id", "physical_id", "channel_id").agg(F.count(F.lit(1)).alias("records"))


@query(
    "decision_source_rows",
    """SELECT concat('d', CAST(event_id % 900 AS STRING)) AS document_id, CAST(user_id AS STRING) AS entity_id,
              CASE WHEN event_id % 6 = 0 THEN 2024 END AS event_year, ts AS decision_date,
              event_id % 7 <> 0 AS row_included, CASE WHEN event_id % 50 <> 0 THEN value > 10 END AS hard_positive,
              value AS total_fine, concat('events.csv#', CAST(event_id AS STRING)) AS source_ref,
              CASE WHEN event_id % 50 = 0 THEN 'FLAG_INVALID' END AS problem FROM events""",
)
def _(fx: Inputs) -> DataFrame:
    event = F.col("event_id")
    raw = fx("events").select(
        F.concat(F.lit(" d"), (event % 900).cast("string")).alias("doc"),
        F.col("user_id").cast("string").alias("who"),
        F.when(event % 6 == 0, "2024.0").otherwise(" ").alias("year"),
        F.col("ts").cast("string").alias("decided"),
        F.when(event % 7 != 0, "Yes").otherwise("n").alias("inc"),
        F.when(event % 50 == 0, "perhaps").when(F.col("value") > 10, "1").otherwise("0").alias("hard"),
        F.col("value").cast("string").alias("fine"),
        F.lit("events.csv").alias("file"),
        event.cast("string").alias("row"),
    )
    rows = decisions.read_decisions(
        raw,
        {"document_id": "doc", "entity_id": "who", "event_year": "year", "decision_date": "decided", "row_included": "inc",
         "hard_positive": "hard", "total_fine": "fine", "source_file": "file", "source_row": "row"},
    )
    return rows.select(
        "document_id", "entity_id", "event_year", "decision_date", "row_included", "hard_positive", "total_fine", "source_ref",
        "problem",
    )
