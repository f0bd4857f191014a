"""Feature derivation, registry rules and diagnostics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators import diagnostics, features
from paneloom.operators.ranking import cut
from paneloom.plans.bindings import Inputs, query

KEY = ["entity_id", "period"]
BASES = ["fs_aud_price", "fs_aud_rebate", "fs_aud_quantity", "fs_aud_tax", "fs_aud_orders", "fs_aud_returns"]


def _placed(fx: Inputs, name: str) -> DataFrame:
    """A binding that an operator reads several times, computed once."""
    return cut(fx(name))


def _round(df: DataFrame, digits: int = 7) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ------------------------------------------------------------- derivation


@query(
    "prepared_long_values",
    """SELECT entity_id, period, status, item, value, CAST(CASE WHEN CAST(entity_id AS INT) % 60 = 0 THEN 2 ELSE 1 END AS BIGINT) AS copies
       FROM fx_long_values WHERE item <> 'N'""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_long_values")
    again = rows.filter("CAST(entity_id AS INT) % 60 = 0")
    raw = rows.unionByName(again).select(
        F.concat(F.lit(" "), "entity_id").alias("entity_id"),
        F.col("period").cast("string").alias("period"),
        "status",
        "item",
        F.col("value").cast("string").alias("value"),
        F.when(F.col("item") == "N", "parent").otherwise("group").alias("scope"),
        F.lit("U").alias("unit"),
    )
    return features.prepare_long_values(raw, "group", "U")


@query(
    "selected_features",
    """SELECT entity_id, period, max(value) FILTER (item = 'A' AND status = 'audited') AS audited_a,
              max(value) FILTER (item = 'R' AND status = 'unaudited') AS unaudited_r FROM fx_long_values GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return features.feat_select(fx("fx_long_values"), {"audited_a": ("A", "audited"), "unaudited_r": ("R", "unaudited")})


@query(
    "component_sums",
    """SELECT entity_id, period, CASE WHEN n = 3 THEN round(s, 4) END AS value, 3 - n AS missing_components
       FROM (SELECT entity_id, period, sum(value) FILTER (status = 'audited') AS s, count(value) FILTER (status = 'audited') AS n
             FROM fx_long_values GROUP BY 1, 2) q""",
)
def _(fx: Inputs) -> DataFrame:
    result = features.feat_component_sum(fx("fx_long_values"), ["A", "R", "N"], "audited")
    return result.withColumn("value", F.round("value", 4))


@query(
    "prepost_differences",
    """SELECT entity_id, period, round(value_post - value_pre, 6) AS signed,
              round((value_post - value_pre) / nullif(abs(value_post), 0), 8) AS relative FROM fx_prepost""",
)
def _(fx: Inputs) -> DataFrame:
    result = features.feat_prepost(
        fx("fx_prepost"),
        {"signed": "value_post - value_pre", "relative": "(value_post - value_pre) / abs(value_post)"},
    )
    return result.select(*KEY, F.round("signed", 6).alias("signed"), F.round("relative", 8).alias("relative"))


RATIOS = {
    "ratio_rebate": "rebate_t / price_t",
    "ratio_growth": "(price_t - price_t_minus_1) / abs(price_t_minus_1)",
    "ratio_average": "tax_t / average(quantity_t,quantity_t_minus_1)",
    "ratio_returns": "orders_t / returns_t",
    "ratio_spread": "(price_t - rebate_t) / abs(quantity_t)",
}
LAGGED = """SELECT c.*, p.fs_aud_price AS price0, p.fs_aud_quantity AS quantity0, p.fs_aud_orders AS orders0
            FROM fx_features c LEFT JOIN fx_features p ON p.entity_id = c.entity_id AND p.period = c.period - 1"""
RATIO_SQL = f"""
    SELECT entity_id, period, fs_aud_rebate / nullif(fs_aud_price, 0) AS ratio_rebate,
           (fs_aud_price - price0) / nullif(abs(price0), 0) AS ratio_growth,
           fs_aud_tax / nullif((fs_aud_quantity + quantity0) / 2, 0) AS ratio_average,
           fs_aud_orders / nullif(fs_aud_returns, 0) AS ratio_returns,
           (fs_aud_price - fs_aud_rebate) / nullif(abs(fs_aud_quantity), 0) AS ratio_spread FROM ({LAGGED}) l"""
ROUND_RATIOS = ", ".join(f"round({r}, 7) AS {r}" for r in RATIOS)


@query("registered_ratios", f"SELECT entity_id, period, {ROUND_RATIOS} FROM ({RATIO_SQL}) q")
def _(fx: Inputs) -> DataFrame:
    return _round(features.feat_ratio(fx("fx_features"), RATIOS))


@query(
    "year_lags",
    f"SELECT entity_id, period, fs_aud_price, price0 AS fs_aud_price__lag, fs_aud_orders, orders0 AS fs_aud_orders__lag FROM ({LAGGED}) l",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_features").select(*KEY, "fs_aud_price", "fs_aud_orders")
    return features.lag_year(rows, ["fs_aud_price", "fs_aud_orders"])


@query(
    "derived_features",
    f"""SELECT entity_id, period, fs_aud_price, fs_aud_orders, round(fs_aud_price - fs_aud_rebate, 6) AS fs_aud_net,
               round((fs_aud_price - fs_aud_rebate) / nullif(fs_aud_orders, 0), 6) AS net_per_order,
               round((fs_aud_price - fs_aud_rebate) / nullif(abs(net0), 0), 6) AS net_growth
        FROM (SELECT c.*, p.fs_aud_price - p.fs_aud_rebate AS net0
              FROM fx_features c LEFT JOIN fx_features p ON p.entity_id = c.entity_id AND p.period = c.period - 1) q""",
)
def _(fx: Inputs) -> DataFrame:
    registry = [
        {"feature_id": "net_growth", "kind": "ratio", "formula": "net_t / abs(net_t_minus_1)"},
        {"feature_id": "net_per_order", "kind": "ratio", "formula": "net_t / orders_t"},
        {"feature_id": "fs_aud_net", "kind": "prepost", "formula": "fs_aud_price - fs_aud_rebate", "dependencies": ["fs_aud_price", "fs_aud_rebate"]},
        {"feature_id": "fs_aud_price", "physical_column": "fs_aud_price"},
        {"feature_id": "fs_aud_rebate", "physical_column": "fs_aud_rebate"},
        {"feature_id": "fs_aud_orders", "physical_column": "fs_aud_orders"},
        {"feature_id": "unlocked", "kind": "ratio", "formula": "absent_t / orders_t", "locked": False},
    ]
    rows = features.derive_features(fx("fx_features"), registry).drop("fs_aud_rebate")
    return rows.select(*KEY, *[F.round(c, 6).alias(c) for c in rows.columns if c not in KEY])


@query(
    "coverage_counts",
    """SELECT entity_id, period, c AS coverage_count, CAST(c = 4 AS INT) AS complete_flag
       FROM (SELECT entity_id, period, CAST(fs_aud_price IS NOT NULL AS INT) + CAST(fs_aud_quantity IS NOT NULL AS INT)
                    + CAST(fs_aud_tax IS NOT NULL AS INT) + CAST(fs_aud_orders IS NOT NULL AS INT) AS c FROM fx_features) q""",
)
def _(fx: Inputs) -> DataFrame:
    return features.feat_coverage(fx("fx_features"), ["fs_aud_price", "fs_aud_quantity", "fs_aud_tax", "fs_aud_orders"], 4)


@query(
    "index_scores",
    f"""SELECT entity_id, period, round(fs_aud_price / nullif(price0, 0), 7) AS sgi, round(fs_aud_tax / nullif(fs_aud_price, 0), 7) AS tata,
               round(-4.84 + 0.892 * (fs_aud_price / nullif(price0, 0)) + 4.679 * (fs_aud_tax / nullif(fs_aud_price, 0)), 6) AS index_score
        FROM ({LAGGED}) l""",
)
def _(fx: Inputs) -> DataFrame:
    weights = {name: features.INDEX_WEIGHTS[name] for name in ("sgi", "tata")}
    formulas = {"sgi": "price_t/price_t_minus_1", "tata": "tax_t/price_t"}
    result = features.feat_index_score(fx("fx_features"), formulas, weights)
    return result.select(*KEY, F.round("sgi", 7).alias("sgi"), F.round("tata", 7).alias("tata"), F.round("index_score", 6).alias("index_score"))


STATEMENT = {
    "accounts_receivable": "fs_aud_tax", "net_revenue": "fs_aud_price", "gross_profit": "fs_aud_rebate", "current_assets": "fs_aud_orders",
    "ppe_net": "fs_aud_returns", "total_assets": "fs_aud_price", "depreciation_expense": "fs_aud_tax", "selling_expense": "fs_aud_orders",
    "administrative_expense": "fs_aud_returns", "operating_profit": "fs_aud_rebate", "operating_cash_flow": "fs_aud_tax",
    "current_liabilities": "fs_aud_orders", "noncurrent_liabilities": "fs_aud_returns", "profit_after_tax": "fs_aud_rebate",
    "total_liabilities": "fs_aud_orders", "equity": "fs_aud_quantity", "inventory_net": "fs_aud_quantity",
    "interest_expense": "fs_aud_returns", "cash_and_equivalents": "fs_aud_tax",
}
_ALL = {**features.REGISTERED_RATIOS, **features.INDEX_RATIOS}


@query(
    "statement_ratios",
    """SELECT period, count(c.fs_aud_rebate / nullif((c.fs_aud_price + p.fs_aud_price) / 2, 0)) AS ratio_roa,
              count(c.fs_aud_orders / nullif(c.fs_aud_orders, 0)) AS ratio_current_ratio,
              count(c.fs_aud_rebate / nullif(c.fs_aud_returns, 0)) AS ratio_interest_coverage,
              round(sum((c.fs_aud_tax / nullif(c.fs_aud_price, 0)) / nullif(p.fs_aud_tax / nullif(p.fs_aud_price, 0), 0)), 3) AS dsri,
              round(sum((p.fs_aud_tax / nullif(p.fs_aud_tax + p.fs_aud_returns, 0))
                        / nullif(c.fs_aud_tax / nullif(c.fs_aud_tax + c.fs_aud_returns, 0), 0)), 4) AS depi
       FROM fx_features c LEFT JOIN (SELECT entity_id, period + 1 AS q, fs_aud_price, fs_aud_tax, fs_aud_returns FROM fx_features) p
         ON p.entity_id = c.entity_id AND q = c.period GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    rows = fx("fx_features").select(*KEY, *[F.col(c).alias(f"fs_aud_{name}") for name, c in STATEMENT.items()])
    ratios = features.feat_ratio(rows, _ALL)
    return ratios.groupBy("period").agg(
        *[F.count(c).alias(c) for c in ("ratio_roa", "ratio_current_ratio", "ratio_interest_coverage")],
        F.round(F.sum("dsri"), 3).alias("dsri"),
        F.round(F.sum("depi"), 4).alias("depi"),
    )


# ------------------------------------------------------------- assembly


@query(
    "key_set_check",
    """SELECT count_if(l AND r) AS both_count, count_if(NOT r) AS left_only_count, count_if(NOT l) AS right_only_count,
              count_if(l AND r AND NOT same) AS anchor_mismatch_count
       FROM (SELECT a.entity_id IS NOT NULL AS l, b.entity_id IS NOT NULL AS r, a.anchor = b.availability AS same
             FROM fx_panel a FULL JOIN (SELECT * FROM fx_obs WHERE source_id = 'orders' AND period > 1995) b
               ON a.entity_id = b.entity_id AND a.period = b.period) q""",
)
def _(fx: Inputs) -> DataFrame:
    other = fx("fx_obs").filter("source_id = 'orders' AND period > 1995").withColumnRenamed("availability", "anchor")
    return features.key_sets(fx("fx_panel"), other)


@query(
    "assembled_panel",
    "SELECT p.entity_id, p.period, fs_aud_price, fs_aud_tax FROM fx_panel p LEFT JOIN fx_features f ON f.entity_id = p.entity_id AND f.period = p.period",
)
def _(fx: Inputs) -> DataFrame:
    values = fx("fx_features").select(*KEY, "fs_aud_price", "fs_aud_tax", "fs_aud_orders")
    return features.assemble_panel(fx("fx_panel"), values, ["fs_aud_orders"])


@query(
    "feature_panel",
    """SELECT f.entity_id, f.period, CAST(fs_aud_price AS FLOAT) AS fs_aud_price, CAST(fs_aud_orders AS INT) AS fs_aud_orders,
              CAST(floor(fs_aud_quantity) AS BIGINT) AS fs_aud_quantity, coalesce(fs_aud_quantity <> floor(fs_aud_quantity), false) AS invalid_integer
       FROM fx_features f JOIN fx_panel p ON p.entity_id = f.entity_id AND p.period = f.period WHERE f.period <= 1999""",
)
def _(fx: Inputs) -> DataFrame:
    risk = fx("fx_panel").withColumn("eligible", F.col("period") <= 1999)
    return features.feature_panel(
        fx("fx_features"), risk, {"fs_aud_price": "float", "fs_aud_orders": "int", "fs_aud_quantity": "bigint"}
    )


@query(
    "feature_missingness",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature_id, count_if({c} IS NULL) AS missing_count, count(*) AS row_count, "
        f"count_if({c} IS NULL) / count(*) AS missing_fraction FROM fx_features"
        for c in BASES
    ),
)
def _(fx: Inputs) -> DataFrame:
    return features.missingness(fx("fx_features"), BASES)


# ------------------------------------------------------------- registry rules

ENTRIES = [
    {"feature_id": "fs_aud_price", "research_status": "LOCKED", "confirmatory_status": "confirmatory", "role": "content",
     "source_specific": False, "target_component": True, "component_of": ["L1_ANNUAL"], "lineage": ["l_extendedprice"]},
    {"feature_id": "fs_aud_rebate", "research_status": "LOCKED", "confirmatory_status": "robustness_only", "role": "content",
     "source_specific": True, "target_component": False, "component_of": [], "lineage": ["l_extendedprice", "l_discount"]},
    {"feature_id": "fs_aud_quantity", "research_status": "LOCKED", "confirmatory_status": "confirmatory", "role": "observability",
     "source_specific": False, "target_component": False, "component_of": [], "lineage": []},
    {"feature_id": "fs_aud_tax", "research_status": "OPEN", "confirmatory_status": "confirmatory", "role": "content",
     "source_specific": False, "target_component": False, "component_of": [], "lineage": ["l_tax"]},
    {"feature_id": "fs_aud_orders", "research_status": "LOCKED", "confirmatory_status": "descriptive", "role": "ambiguous",
     "source_specific": False, "target_component": False, "component_of": [], "lineage": [], "model_eligibility": "fit"},
    {"feature_id": "gone", "research_status": "LOCKED", "confirmatory_status": "confirmatory", "role": "content",
     "source_specific": False, "target_component": False, "component_of": [], "lineage": []},
    {"feature_id": "early_only", "research_status": "LOCKED", "confirmatory_status": "confirmatory", "role": "content",
     "source_specific": False, "target_component": False, "component_of": [], "lineage": []},
]


def _registry_rows() -> str:
    def text(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, list):
            return "[" + ", ".join(f"'{v}'" for v in value) + "]::VARCHAR[]"
        return f"'{value}'"

    names = ["feature_id", "research_status", "confirmatory_status", "role", "source_specific", "target_component", "component_of",
             "lineage", "model_eligibility"]
    rows = ", ".join("(" + ", ".join(text(e.get(n)) for n in names) + ")" for e in ENTRIES)
    return f"(VALUES {rows}) reg({', '.join(names)})"


PRESENT = f"""SELECT reg.*, coalesce(n, 0) AS n FROM {_registry_rows()} LEFT JOIN (
      {" UNION ALL ".join(f"SELECT '{c}' AS f, count({c}) AS n FROM fx_features" for c in BASES)}) c ON f = feature_id"""
LEAK_SQL = f"""
    SELECT *, CASE decision WHEN 'RESEARCH_DECISION_REQUIRED' THEN 'FEATURE_NOT_LOCKED' WHEN 'BLOCK' THEN 'DIRECT_TARGET_COMPONENT'
                   WHEN 'ALLOW_WITH_ABLATION' THEN 'SOURCE_BLIND_EXCLUSION' ELSE 'TEMPORALLY_VALID' END AS reason
    FROM (SELECT *, CASE WHEN research_status <> 'LOCKED' THEN 'RESEARCH_DECISION_REQUIRED'
                 WHEN target_component AND list_contains(component_of, target_id) THEN 'BLOCK'
                 WHEN source_specific THEN 'ALLOW_WITH_ABLATION' ELSE 'ALLOW' END AS decision
          FROM ({PRESENT}) p CROSS JOIN (VALUES ('L1_ANNUAL'), ('BROAD')) t(target_id)) d"""


def _registry(fx: Inputs) -> DataFrame:
    """The registry with the number of values each feature has in the panel."""
    counts = features.missingness(fx("fx_features"), BASES).select(
        "feature_id", (F.col("row_count") - F.col("missing_count")).alias("n")
    )
    return features.registry_table(fx.spark, ENTRIES).join(counts, "feature_id", "left").na.fill(0, ["n"])


@query("leakage_registry", f"SELECT feature_id, target_id, decision, reason, n FROM ({LEAK_SQL}) q")
def _(fx: Inputs) -> DataFrame:
    leaks = features.leakage(_registry(fx), ["L1_ANNUAL", "BROAD"])
    return leaks.select("feature_id", "target_id", "decision", "reason", "n")


VIEW_SQL = f"""
    SELECT target_id, view_id, list_sort(coalesce(list(feature_id) FILTER (m), [])) AS included,
           list_sort(coalesce(list(feature_id) FILTER (NOT m), [])) AS excluded
    FROM (SELECT *, CASE view_id WHEN 'target_reconstruction_diagnostic' THEN decision = 'BLOCK'
                 WHEN 'content_only' THEN ok AND role = 'content' WHEN 'observability_only' THEN ok AND role = 'observability'
                 WHEN 'source_blind' THEN ok AND NOT source_specific WHEN 'target_component_ablation' THEN ok AND NOT target_component
                 WHEN 'core_confirmatory' THEN ok AND confirmatory_status = 'confirmatory'
                 WHEN 'robustness_extended' THEN ok AND confirmatory_status IN ('confirmatory', 'robustness_only') ELSE ok END AS m
          FROM (SELECT *, decision LIKE 'ALLOW%' AS ok FROM ({LEAK_SQL}) l WHERE n > 0)
          CROSS JOIN (VALUES ('full_eligible'), ('content_only'), ('observability_only'), ('source_blind'), ('target_component_ablation'),
                             ('core_confirmatory'), ('robustness_extended'), ('target_reconstruction_diagnostic')) v(view_id)) w GROUP BY 1, 2"""


@query("feature_views", VIEW_SQL)
def _(fx: Inputs) -> DataFrame:
    return features.feature_views(features.leakage(_registry(fx).filter("n > 0"), ["L1_ANNUAL", "BROAD"]))


@query(
    "feature_lineage",
    f"SELECT feature_id, unnest(CASE WHEN len(lineage) > 0 THEN lineage ELSE [feature_id] END) AS source_item FROM ({PRESENT}) p WHERE n > 0",
)
def _(fx: Inputs) -> DataFrame:
    return features.lineage(_registry(fx).filter("n > 0"))


@query(
    "registry_summary",
    f"""SELECT 'role' AS attribute, role AS level, count(*) AS feature_count FROM ({PRESENT}) a WHERE n > 0 GROUP BY 1, 2
        UNION ALL SELECT 'research_status', research_status, count(*) FROM ({PRESENT}) b WHERE n > 0 GROUP BY 1, 2
        UNION ALL SELECT 'source_specific', CAST(source_specific AS STRING), count(*) FROM ({PRESENT}) c WHERE n > 0 GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return features.registry_summary(_registry(fx).filter("n > 0"), ["role", "research_status", "source_specific"])


@query(
    "restored_domains",
    """SELECT p.entity_id, p.period, seg AS segment, CASE WHEN seg IS NULL THEN 'DOMAIN_MISSING'
              WHEN seg NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN 'DOMAIN_OUTSIDE_VOCABULARY' END AS problem
       FROM fx_panel p LEFT JOIN (SELECT entity_id, period, nullif(CASE WHEN CAST(entity_id AS INT) % 40 = 0 THEN '' ELSE domain END, '') AS seg
                                  FROM fx_domain WHERE CAST(entity_id AS INT) % 45 <> 0) d
         ON d.entity_id = p.entity_id AND d.period = p.period""",
)
def _(fx: Inputs) -> DataFrame:
    segment = F.when(F.expr("CAST(entity_id AS INT) % 40 = 0"), " ").otherwise(F.col("domain"))
    source = fx("fx_domain").filter("CAST(entity_id AS INT) % 45 <> 0").select(*KEY, segment.alias("segment"))
    panel = fx("fx_panel").select(*KEY)
    return features.restore_domain(panel, source, "segment", ["BUILDING", "AUTOMOBILE", "MACHINERY"])


@query(
    "identifier_audit",
    """SELECT entity_id, count(p) AS matched_count, count(*) - count(p) AS unmatched_count,
              CASE WHEN count(*) = count(p) THEN 'MATCHED' WHEN count(p) = 0 THEN 'UNMATCHED' ELSE 'PARTIAL' END AS status
       FROM (SELECT f.entity_id, p.period AS p FROM fx_features f
             LEFT JOIN (SELECT * FROM fx_panel WHERE CAST(entity_id AS INT) % 25 <> 0) p ON p.entity_id = f.entity_id AND p.period = f.period) q
       GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    return features.identifier_audit(fx("fx_features"), fx("fx_panel").filter("CAST(entity_id AS INT) % 25 <> 0"))


@query(
    "model_roster",
    f"""SELECT feature_id, column_exists, development_count, outer_count, requested AND reason IS NULL AS included,
               CASE WHEN requested THEN reason END AS exclusion_reason
        FROM (SELECT feature_id, f IS NOT NULL AS column_exists, coalesce(d, 0) AS development_count, coalesce(o, 0) AS outer_count,
                     research_status = 'LOCKED' AND coalesce(model_eligibility, 'fit') = 'fit' AS requested,
                     CASE WHEN f IS NULL THEN 'COLUMN_MISSING' WHEN d = 0 THEN 'ZERO_DEVELOPMENT_COVERAGE'
                          WHEN target_component THEN 'DIRECT_TARGET_COMPONENT' END AS reason
              FROM {_registry_rows()} LEFT JOIN (
                {" UNION ALL ".join(f"SELECT '{c}' AS f, count({c}) FILTER (period < 1999) AS d, count({c}) FILTER (period = 1999) AS o FROM fx_features" for c in BASES)}
                UNION ALL SELECT 'early_only', 0, count(*) FILTER (period = 1999) FROM fx_features) c ON f = feature_id) r""",
)
def _(fx: Inputs) -> DataFrame:
    panel = fx("fx_features").withColumn("early_only", F.when(F.col("period") >= 1999, 1.0))
    return features.model_roster(panel, features.registry_table(fx.spark, ENTRIES), 1999)


# ------------------------------------------------------------- diagnostics


def _coverage_sql(c: str) -> str:
    return f"""
        SELECT '{c}' AS feature_id, CAST(sum(rows) AS BIGINT) AS row_count, CAST(sum(n) AS BIGINT) AS nonmissing_count,
               count_if(n > 0) AS entity_count, min(f) AS first_period, max(l) AS last_period, CAST(sum(p) AS BIGINT) AS consecutive_count,
               count_if(n >= 2) AS entities_with_two_periods, count_if(p > 0) AS entities_with_consecutive,
               CAST(sum(rows) - sum(n) AS BIGINT) AS missing_count, sum(n) / sum(rows) AS coverage, sum(p) / greatest(sum(n), 1) AS consecutive_coverage
        FROM (SELECT c.entity_id, count(*) AS rows, count(c.{c}) AS n, count_if(c.{c} IS NOT NULL AND p.{c} IS NOT NULL) AS p,
                     min(c.period) FILTER (c.{c} IS NOT NULL) AS f, max(c.period) FILTER (c.{c} IS NOT NULL) AS l
              FROM fx_features c LEFT JOIN fx_features p ON p.entity_id = c.entity_id AND p.period = c.period - 1 GROUP BY 1) e"""


@query("coverage_diagnostics", " UNION ALL ".join(_coverage_sql(c) for c in BASES))
def _(fx: Inputs) -> DataFrame:
    return diagnostics.diag_coverage(fx("fx_features"), BASES)


def _scale_sql(c: str) -> str:
    quantiles = ", ".join(f"round(quantile_cont({c}, {p}), 5) AS {n}" for n, p in diagnostics.SCALE_QUANTILES.items())
    return f"""SELECT '{c}' AS feature_id, round(min({c}), 5) AS minimum, round(avg({c}), 5) AS mean, round(max({c}), 5) AS maximum,
               count_if({c} = 0) AS zero_count, count_if({c} < 0) AS negative_count, CAST(0 AS BIGINT) AS nonfinite_count, {quantiles}
               FROM fx_features"""


@query("value_scale_diagnostics", " UNION ALL ".join(_scale_sql(c) for c in BASES))
def _(fx: Inputs) -> DataFrame:
    return _round(diagnostics.diag_value_scale(_placed(fx, "fx_features"), BASES), 5)


@query(
    "identity_diagnostics",
    """SELECT entity_id, period, identity_id, round(r, 5) AS residual, round(r / s, 9) AS scaled_residual, r <= 1 OR r / s <= 1e-6 AS pass_flag
       FROM (SELECT entity_id, period, 'net' AS identity_id, abs(value_post - (value_pre - fs_aud_rebate)) AS r,
                    greatest(1, abs(value_post), abs(value_pre), abs(fs_aud_rebate)) AS s
             FROM fx_prepost JOIN fx_features USING (entity_id, period) WHERE value_post IS NOT NULL AND value_pre IS NOT NULL
             UNION ALL
             SELECT entity_id, period, 'same', abs(value_pre - fs_aud_price), greatest(1, abs(value_pre), abs(fs_aud_price))
             FROM fx_prepost JOIN fx_features USING (entity_id, period) WHERE value_pre IS NOT NULL) q""",
)
def _(fx: Inputs) -> DataFrame:
    panel = fx("fx_prepost").join(fx("fx_features"), KEY)
    result = diagnostics.diag_identities(
        panel,
        {"net": ("value_post", {"value_pre": 1.0, "fs_aud_rebate": -1.0}), "same": ("value_pre", {"fs_aud_price": 1.0}),
         "unavailable": ("value_pre", {"no_such_column": 1.0})},
    )
    return result.withColumns({"residual": F.round("residual", 5), "scaled_residual": F.round("scaled_residual", 9)})


@query(
    "adjustment_diagnostics",
    """SELECT concept_id, period, count(d) AS matched_count, count_if(post IS NOT NULL AND pre IS NULL) AS post_only_count,
              count_if(post IS NULL AND pre IS NOT NULL) AS pre_only_count, round(avg(d), 5) AS signed_mean, round(avg(abs(d)), 5) AS absolute_mean,
              round(avg(d / nullif(abs(post), 0)), 5) AS relative_mean, round(count_if(d = 0) / greatest(count(d), 1), 5) AS zero_rate,
              round(quantile_cont(abs(d), 0.5), 5) AS p50, round(quantile_cont(abs(d), 0.9), 5) AS p90,
              round(quantile_cont(abs(d), 0.95), 5) AS p95, round(quantile_cont(abs(d), 0.99), 5) AS p99
       FROM (SELECT 'value' AS concept_id, period, value_pre AS pre, value_post AS post, value_post - value_pre AS d FROM fx_prepost
             UNION ALL SELECT 'volume', period, volume_pre, volume_post, volume_post - volume_pre FROM fx_prepost) q GROUP BY 1, 2""",
)
def _(fx: Inputs) -> DataFrame:
    return _round(
        diagnostics.diag_adjustments(
            _placed(fx, "fx_prepost"), {"value": ("value_pre", "value_post"), "volume": ("volume_pre", "volume_post")}
        ),
        5,
    )


def _ratio_diag_sql(f: str, operands: str, zero: str) -> str:
    return f"""
        SELECT '{f}' AS feature_id, r.period, count(*) AS row_count, count({f}) AS value_count, count_if({operands}) AS missing_operand_count,
               count_if(NOT ({operands}) AND {zero} = 0) AS zero_denominator_count, CAST(0 AS BIGINT) AS nonfinite_count,
               round(any_value(lo), 5) AS minimum, round(any_value(md), 5) AS median, round(any_value(hi), 5) AS maximum,
               count_if({f} < p1 OR {f} > p99) AS extreme_count, round(count({f}) / count(*), 5) AS coverage
        FROM (SELECT * FROM ({RATIO_SQL}) a JOIN fx_features USING (entity_id, period)) r
        JOIN (SELECT period, min({f}) AS lo, quantile_cont({f}, 0.5) AS md, max({f}) AS hi, quantile_cont({f}, 0.01) AS p1,
                     quantile_cont({f}, 0.99) AS p99 FROM ({RATIO_SQL}) a GROUP BY 1) s ON s.period = r.period GROUP BY 1, 2"""


@query(
    "ratio_diagnostics",
    _ratio_diag_sql("ratio_returns", "fs_aud_orders IS NULL OR fs_aud_returns IS NULL", "fs_aud_returns")
    + " UNION ALL "
    + _ratio_diag_sql("ratio_spread", "fs_aud_price IS NULL OR fs_aud_rebate IS NULL OR fs_aud_quantity IS NULL", "fs_aud_quantity"),
)
def _(fx: Inputs) -> DataFrame:
    names = ["ratio_returns", "ratio_spread"]
    base = _placed(fx, "fx_features")
    panel = features.feat_ratio(base, {n: RATIOS[n] for n in names}).join(base, KEY)
    operands = {n: sorted(features.formula_inputs(RATIOS[n])) for n in names}
    return _round(
        diagnostics.diag_ratios(panel, names, operands, {"ratio_returns": "fs_aud_returns", "ratio_spread": "abs(fs_aud_quantity)"}), 5
    )


@query(
    "temporal_diagnostics",
    """SELECT feature_id, count(v) AS value_count, count_if(prior AND v IS NOT NULL AND period = first) AS first_year_value_count,
              CASE WHEN count_if(prior AND v IS NOT NULL AND period = first) > 0 THEN 'REVIEW' ELSE 'PASS' END AS temporal_status
       FROM (SELECT 'fs_aud_price' AS feature_id, fs_aud_price AS v, true AS prior, period, min(period) OVER (PARTITION BY entity_id) AS first FROM fx_features
             UNION ALL SELECT 'fs_aud_tax', fs_aud_tax, false, period, min(period) OVER (PARTITION BY entity_id) FROM fx_features) q GROUP BY 1""",
)
def _(fx: Inputs) -> DataFrame:
    return diagnostics.diag_temporal(fx("fx_features"), {"fs_aud_price": True, "fs_aud_tax": False})


DUPLICATED = ["fs_aud_price", "fs_aud_quantity", "fs_aud_tax", "double_tax", "minus_tax"]
WITH_COPIES = "SELECT *, fs_aud_tax * 2 AS double_tax, -fs_aud_tax AS minus_tax FROM fx_features"


def _redundancy_sql(a: str, b: str) -> str:
    return f"""
        SELECT '{a}' AS feature_left, '{b}' AS feature_right, count(*) AS paired_count, round(corr(x, y), 7) AS pearson,
               round(corr(rx, ry), 7) AS spearman, bool_and(x = y) AS exact_duplicate, bool_and(x = -y) AS sign_reversed,
               coalesce(stddev_samp(x / nullif(y, 0)) <= 1e-12, false) AS constant_scale,
               CASE WHEN stddev_samp(x / nullif(y, 0)) <= 1e-12 THEN round(min(x / nullif(y, 0)), 7) END AS scaling_factor
        FROM (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
                     rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
              FROM (SELECT {a} AS x, {b} AS y FROM ({WITH_COPIES}) f WHERE {a} IS NOT NULL AND {b} IS NOT NULL) p) r"""


@query("redundancy_diagnostics", " UNION ALL ".join(_redundancy_sql(a, b) for a, b in combinations(DUPLICATED, 2)))
def _(fx: Inputs) -> DataFrame:
    panel = _placed(fx, "fx_features").withColumns({"double_tax": F.col("fs_aud_tax") * 2, "minus_tax": -F.col("fs_aud_tax")})
    return _round(diagnostics.diag_redundancy(panel, DUPLICATED))
