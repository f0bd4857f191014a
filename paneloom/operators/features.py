"""Feature derivation: selections, sums, differences, ratios, lags and their registry rules."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.functions.grid import registry as table
from paneloom.functions.grid import with_grid
from paneloom.functions.profile import profile
from paneloom.functions.text import blank_to_null
from paneloom.operators.ranking import attach

KEY = ["entity_id", "period"]
BASE = "fs_aud_"

# The registered ratios. x_t is the value of the period, x_t_minus_1 of the one before.
REGISTERED_RATIOS = {
    "ratio_roa": "profit_after_tax_t / average(total_assets_t,total_assets_t_minus_1)",
    "ratio_current_ratio": "current_assets_t / current_liabilities_t",
    "ratio_debt_to_assets": "total_liabilities_t / total_assets_t",
    "ratio_liabilities_to_equity": "total_liabilities_t / equity_t",
    "ratio_ocf_to_assets": "operating_cash_flow_t / average(total_assets_t,total_assets_t_minus_1)",
    "ratio_accruals_to_assets": "(profit_after_tax_t - operating_cash_flow_t) / average(total_assets_t,total_assets_t_minus_1)",
    "ratio_receivables_to_sales": "accounts_receivable_t / net_revenue_t",
    "ratio_inventory_to_sales": "inventory_net_t / net_revenue_t",
    "ratio_gross_margin": "gross_profit_t / net_revenue_t",
    "ratio_sales_growth": "(net_revenue_t - net_revenue_t_minus_1) / abs(net_revenue_t_minus_1)",
    "ratio_asset_growth": "(total_assets_t - total_assets_t_minus_1) / abs(total_assets_t_minus_1)",
    "ratio_sga_to_sales": "(selling_expense_t + administrative_expense_t) / net_revenue_t",
    "ratio_interest_coverage": "operating_profit_t / abs(interest_expense_t)",
    "ratio_cash_to_assets": "cash_and_equivalents_t / total_assets_t",
    "ratio_working_capital_to_assets": "(current_assets_t - current_liabilities_t) / total_assets_t",
    "ratio_net_profit_margin": "profit_after_tax_t / net_revenue_t",
}

# The ratio-index block and the weights of its score.
INDEX_RATIOS = {
    "dsri": "(accounts_receivable_t/net_revenue_t)/(accounts_receivable_t_minus_1/net_revenue_t_minus_1)",
    "gmi": "(gross_profit_t_minus_1/net_revenue_t_minus_1)/(gross_profit_t/net_revenue_t)",
    "aqi": "(1-(current_assets_t+ppe_net_t)/total_assets_t)/(1-(current_assets_t_minus_1+ppe_net_t_minus_1)/total_assets_t_minus_1)",
    "sgi": "net_revenue_t/net_revenue_t_minus_1",
    "depi": "(depreciation_expense_t_minus_1/(depreciation_expense_t_minus_1+ppe_net_t_minus_1))"
    "/(depreciation_expense_t/(depreciation_expense_t+ppe_net_t))",
    "sgai": "((selling_expense_t+administrative_expense_t)/net_revenue_t)"
    "/((selling_expense_t_minus_1+administrative_expense_t_minus_1)/net_revenue_t_minus_1)",
    "tata": "(operating_profit_t-operating_cash_flow_t)/total_assets_t",
    "lvgi": "((current_liabilities_t+noncurrent_liabilities_t)/total_assets_t)"
    "/((current_liabilities_t_minus_1+noncurrent_liabilities_t_minus_1)/total_assets_t_minus_1)",
}
INDEX_INTERCEPT = -4.84
INDEX_WEIGHTS = {
    "dsri": 0.920, "gmi": 0.528, "aqi": 0.404, "sgi": 0.892, "depi": 0.115, "sgai": -0.172, "tata": 4.679, "lvgi": -0.327,
}


# ------------------------------------------------------------- long values


def prepare_long_values(df: DataFrame, scope: str, unit: str) -> DataFrame:
    """Typed long values of one scope and unit; ``copies`` above one marks a repeated cell."""
    rows = df.filter((F.col("scope") == scope) & (F.col("unit") == unit)).select(
        blank_to_null(F.col("entity_id")).alias("entity_id"),
        F.trim("period").try_cast("int").alias("period"),
        "status",
        "item",
        blank_to_null(F.col("value")).try_cast("double").alias("value"),
    )
    rows = rows.filter("entity_id IS NOT NULL AND period IS NOT NULL")
    return rows.groupBy(*KEY, "status", "item").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("copies"))


def feat_select(long: DataFrame, selections: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One column per (item, status) selection; one shuffle for all of them."""
    picks = [
        F.max(F.when((F.col("item") == item) & (F.col("status") == status), F.col("value"))).alias(name)
        for name, (item, status) in selections.items()
    ]
    return long.groupBy(*KEY).agg(*picks)


def feat_component_sum(long: DataFrame, items: Sequence[str], status: str) -> DataFrame:
    """Sum over items, only if all are present; ``missing_components`` counts the rest."""
    mine = F.col("item").isin(*items) & (F.col("status") == status)
    grouped = long.groupBy(*KEY).agg(
        F.sum(F.when(mine, F.col("value"))).alias("_sum"), F.count(F.when(mine, F.col("value"))).alias("_found")
    )
    return grouped.select(
        *KEY,
        F.when(F.col("_found") == len(items), F.col("_sum")).alias("value"),
        (len(items) - F.col("_found")).alias("missing_components"),
    )


# ------------------------------------------------------------- formulas


def _guard_division(formula: str) -> str:
    """Wrap every divisor in nullif(…, 0), so a zero denominator gives null."""
    out, i = [], 0
    while i < len(formula):
        if formula[i] != "/":
            out.append(formula[i])
            i += 1
            continue
        start = i + 1
        while formula[start] == " ":
            start += 1
        end = re.compile(r"[\w.`]*").match(formula, start).end()
        if end < len(formula) and formula[end] == "(":
            depth = 0
            for end in range(end, len(formula)):
                depth += {"(": 1, ")": -1}.get(formula[end], 0)
                if depth == 0:
                    end += 1
                    break
        out.append(f"/ nullif({_guard_division(formula[start:end])}, 0)")
        i = end
    return "".join(out)


def formula_column(formula: str, base: str = BASE) -> Column:
    """Registered arithmetic as a Spark expression: x_t reads ``base``x, x_t_minus_1 its lagged copy."""
    text = re.sub(r"average\(([^,()]+),([^()]+)\)", r"((\1 + \2) / 2)", formula)
    text = re.sub(r"\b([a-z][a-z0-9_]*?)_t_minus_1\b", rf"{base}\1__lag", _guard_division(text))
    return F.expr(re.sub(r"\b([a-z][a-z0-9_]*?)_t\b", rf"{base}\1", text)).cast("double")


def lagged_inputs(formulas: Sequence[str], base: str = BASE) -> list[str]:
    return sorted({base + name for f in formulas for name in re.findall(r"\b([a-z][a-z0-9_]*?)_t_minus_1\b", f)})


def formula_inputs(formula: str, base: str = BASE) -> set[str]:
    return {base + n for n in re.findall(r"\b([a-z][a-z0-9_]*?)_t(?:_minus_1)?\b", formula)}


def lag_year(df: DataFrame, columns: Sequence[str], suffix: str = "__lag") -> DataFrame:
    """Values of exactly the year before; a gap gives null, unlike a positional lag."""
    before = df.select("entity_id", (F.col("period") + 1).alias("period"), *[F.col(c).alias(c + suffix) for c in columns])
    return df.join(before, KEY, "left")


def feat_prepost(df: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    """Signed and relative post-minus-pre differences, as their formulas say."""
    return df.select(*KEY, *[F.expr(_guard_division(f)).alias(n) for n, f in formulas.items()])


def feat_ratio(df: DataFrame, formulas: Mapping[str, str], base: str = BASE) -> DataFrame:
    """Ratios over base features; the previous year is joined once for all of them."""
    lags = lagged_inputs(list(formulas.values()), base)
    rows = lag_year(df, lags) if lags else df
    return rows.select(*KEY, *[formula_column(f, base).alias(n) for n, f in formulas.items()])


def feat_coverage(df: DataFrame, columns: Sequence[str], required: int) -> DataFrame:
    """Count of available concepts and whether all required ones are there."""
    count = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.select(*KEY, count.alias("coverage_count"), (count == required).cast("int").alias("complete_flag"))


def feat_index_score(
    df: DataFrame, formulas: Mapping[str, str] = INDEX_RATIOS, weights: Mapping[str, float] = INDEX_WEIGHTS,
    intercept: float = INDEX_INTERCEPT, base: str = BASE,
) -> DataFrame:
    """Index ratios and their weighted score, null unless every component is known."""
    parts = feat_ratio(df, formulas, base)
    score = F.lit(intercept)
    for name, weight in weights.items():
        score = score + F.lit(weight) * F.col(name)
    return parts.withColumn("index_score", score)


def derive_features(df: DataFrame, registry: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Columns of a feature registry, in dependency order.

    Entries have feature_id and either physical_column or formula (with kind ratio or prepost).
    Present columns bind first. A locked entry that cannot be derived is an error.
    """
    bound = [e for e in registry if e.get("physical_column") in df.columns]
    rows = df.select(*KEY, *[F.col(e["physical_column"]).cast("double").alias(e["feature_id"]) for e in bound])
    pending = [e for e in registry if e not in bound]
    while pending:
        have = set(rows.columns)
        needs = {
            e["feature_id"]: formula_inputs(e["formula"]) if e["kind"] == "ratio" else set(e["dependencies"])
            for e in pending
            if e.get("formula")
        }
        ready = [e for e in pending if needs.get(e["feature_id"]) and needs[e["feature_id"]] <= have]
        if not ready:
            break
        ratios = [e for e in ready if e["kind"] == "ratio"]
        lags = [c for c in lagged_inputs([e["formula"] for e in ratios]) if f"{c}__lag" not in have]
        rows = lag_year(rows, lags) if lags else rows
        rows = rows.select(
            "*",
            *[
                (formula_column(e["formula"]) if e["kind"] == "ratio" else F.expr(_guard_division(e["formula"]))).alias(e["feature_id"])
                for e in ready
            ],
        )
        pending = [e for e in pending if e not in ready]
    stuck = [e["feature_id"] for e in pending if e.get("locked", True)]
    if stuck:
        raise ValueError(f"locked features cannot be derived: {stuck}")
    return rows.select(*[c for c in rows.columns if not c.endswith("__lag")])


# ------------------------------------------------------------- assembly


def key_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in both tables, in one only, and with different anchors."""
    a = left.select(*KEY, F.col("anchor").alias("_a"), F.lit(True).alias("_l"))
    b = right.select(*KEY, F.col("anchor").alias("_b"), F.lit(True).alias("_r"))
    both = F.col("_l") & F.col("_r")
    return a.join(b, KEY, "full_outer").agg(
        F.count_if(both).alias("both_count"),
        F.count_if(F.col("_r").isNull()).alias("left_only_count"),
        F.count_if(F.col("_l").isNull()).alias("right_only_count"),
        F.count_if(both & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("anchor_mismatch_count"),
    )


def assemble_panel(spine: DataFrame, values: DataFrame, metadata: Sequence[str] = ()) -> DataFrame:
    """Spine with its features; metadata columns stay out of the feature matrix."""
    return spine.select(*KEY).join(values.drop(*metadata), KEY, "left")


FORBIDDEN = ("outcome", "known_case", "sanction_event", "post_outcome")


def feature_panel(panel: DataFrame, risk: DataFrame, dtypes: Mapping[str, str]) -> DataFrame:
    """Panel joined one-to-one with the risk set, in registered types; ``invalid_integer`` marks
    rows whose value does not fit an integer feature."""
    clash = [c for c in panel.columns if any(token in c for token in FORBIDDEN)]
    if clash:
        raise ValueError(f"forbidden columns in the feature panel: {clash}")
    whole = {"tinyint", "smallint", "int", "bigint"}
    broken = F.lit(False)
    for c, dtype in dtypes.items():
        if dtype in whole:
            broken = broken | F.coalesce(F.col(c) != F.floor(F.col(c)), F.lit(False))
    keys = risk.filter("eligible").select(*KEY)
    return panel.join(keys, KEY).select(
        *KEY,
        *[(F.floor(F.col(c)) if t in whole else F.col(c)).cast(t).alias(c) for c, t in dtypes.items()],
        broken.alias("invalid_integer"),
    )


def missingness(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    fields = {f: {"missing_count": F.count_if(F.col(f).isNull()), "row_count": F.count(F.lit(1))} for f in features}
    rows = profile(panel, fields, label="feature_id")
    return rows.withColumn("missing_fraction", F.try_divide("missing_count", "row_count"))


# ------------------------------------------------------------- registry rules

REGISTRY = {
    "feature_id": "string", "research_status": "string", "confirmatory_status": "string", "role": "string",
    "source_specific": "boolean", "target_component": "boolean", "component_of": "array<string>",
    "model_eligibility": "string", "computation_status": "string", "unit": "string", "lineage": "array<string>",
}
ALLOWED = ("ALLOW", "ALLOW_WITH_ABLATION")
VIEWS = (
    "full_eligible", "content_only", "observability_only", "source_blind", "target_component_ablation", "core_confirmatory",
    "robustness_extended", "target_reconstruction_diagnostic",
)


def registry_table(spark: SparkSession, entries: Sequence[Mapping[str, Any]]) -> DataFrame:
    return table(spark, entries, REGISTRY)


def leakage(registry: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Decision per feature and target: unlocked, target component, source specific, or allowed."""
    grid = with_grid(registry, [{"target_id": t} for t in targets], {"target_id": "string"})
    direct = F.col("target_component") & F.array_contains("component_of", F.col("target_id"))
    decision = (
        F.when(F.col("research_status") != "LOCKED", "RESEARCH_DECISION_REQUIRED")
        .when(direct, "BLOCK")
        .when(F.col("source_specific"), "ALLOW_WITH_ABLATION")
        .otherwise("ALLOW")
    )
    reason = (
        F.when(F.col("decision") == "RESEARCH_DECISION_REQUIRED", "FEATURE_NOT_LOCKED")
        .when(F.col("decision") == "BLOCK", "DIRECT_TARGET_COMPONENT")
        .when(F.col("decision") == "ALLOW_WITH_ABLATION", "SOURCE_BLIND_EXCLUSION")
        .otherwise("TEMPORALLY_VALID")
    )
    return grid.withColumn("decision", decision).withColumn("reason", reason)


def feature_views(leaks: DataFrame) -> DataFrame:
    """Included and excluded features of the eight views, per target."""
    grid = with_grid(leaks, [{"view_id": v} for v in VIEWS], {"view_id": "string"})
    allowed, view = F.col("decision").isin(*ALLOWED), F.col("view_id")
    member = (
        F.when(view == "target_reconstruction_diagnostic", F.col("decision") == "BLOCK")
        .when(view == "content_only", allowed & (F.col("role") == "content"))
        .when(view == "observability_only", allowed & (F.col("role") == "observability"))
        .when(view == "source_blind", allowed & ~F.col("source_specific"))
        .when(view == "target_component_ablation", allowed & ~F.col("target_component"))
        .when(view == "core_confirmatory", allowed & (F.col("confirmatory_status") == "confirmatory"))
        .when(view == "robustness_extended", allowed & F.col("confirmatory_status").isin("confirmatory", "robustness_only"))
        .otherwise(allowed)
    )
    return grid.groupBy("target_id", "view_id").agg(
        F.array_sort(F.collect_list(F.when(member, F.col("feature_id")))).alias("included"),
        F.array_sort(F.collect_list(F.when(~member, F.col("feature_id")))).alias("excluded"),
    )


def lineage(registry: DataFrame) -> DataFrame:
    """One row per feature and source; a feature without lineage names itself."""
    sources = F.when(F.size("lineage") > 0, F.col("lineage")).otherwise(F.array("feature_id"))
    return registry.select("feature_id", F.explode(sources).alias("source_item"))


def registry_summary(registry: DataFrame, attributes: Sequence[str]) -> DataFrame:
    long = registry.select(*[F.col(a).cast("string").alias(a) for a in attributes]).unpivot([], list(attributes), "attribute", "level")
    return long.groupBy("attribute", "level").agg(F.count(F.lit(1)).alias("feature_count"))


def restore_domain(panel: DataFrame, source: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Attach a domain column and name the problem of a row: absent, repeated, or outside the vocabulary."""
    per_key = source.groupBy(*KEY).agg(
        F.min(blank_to_null(F.col(column))).alias(column), F.max(blank_to_null(F.col(column))).alias("_last")
    )
    problem = (
        F.when(F.col(column).isNull(), "DOMAIN_MISSING")
        .when(F.col(column) != F.col("_last"), "DOMAIN_CONFLICT")
        .when(~F.col(column).isin(*allowed), "DOMAIN_OUTSIDE_VOCABULARY")
    )
    return panel.join(per_key, KEY, "left").withColumn("problem", problem).drop("_last")


def identifier_audit(features: DataFrame, panel: DataFrame) -> DataFrame:
    """Per entity of the features: panel periods found and missed, and the link status."""
    rows = features.select(*KEY).distinct().join(panel.select(*KEY, F.lit(True).alias("_found")), KEY, "left")
    counts = rows.groupBy("entity_id").agg(
        F.count_if("_found").alias("matched_count"), F.count_if(F.col("_found").isNull()).alias("unmatched_count")
    )
    return counts.withColumn(
        "status",
        F.when(F.col("unmatched_count") == 0, "MATCHED").when(F.col("matched_count") == 0, "UNMATCHED").otherwise("PARTIAL"),
    )


def model_roster(panel: DataFrame, registry: DataFrame, outer_period: int, eligible: Sequence[str] = ("fit", "confirmatory")) -> DataFrame:
    """Features usable for a fold, with the first reason against each other one.

    Only the development rows decide; the outer count is reported next to it.
    """
    known = [c for c in panel.columns if c not in KEY]
    development, outer = F.col("period") < outer_period, F.col("period") == outer_period
    fields = {
        f: {
            "development_count": F.count(F.when(development, F.col(f))),
            "outer_count": F.count(F.when(outer, F.col(f))),
        }
        for f in known
    }
    counts = profile(panel, fields, label="feature_id").withColumn("column_exists", F.lit(True))
    rows = attach(registry, counts, ["feature_id"]).na.fill(0, ["development_count", "outer_count"])
    rows = rows.na.fill(False, ["column_exists"])
    requested = F.coalesce(F.col("research_status"), F.lit("LOCKED")) == "LOCKED"
    requested = requested & (F.col("model_eligibility").isNull() | F.col("model_eligibility").isin(*eligible))
    reason = F.when(
        requested,
        F.when(~F.col("column_exists"), "COLUMN_MISSING")
        .when(F.coalesce(F.col("computation_status"), F.lit("PASS")) != "PASS", "COMPUTATION_NOT_PASS")
        .when(F.col("development_count") == 0, "ZERO_DEVELOPMENT_COVERAGE")
        .when(F.col("target_component"), "DIRECT_TARGET_COMPONENT"),
    )
    return rows.select(
        "feature_id", "column_exists", "development_count", "outer_count",
        (requested & reason.isNull()).alias("included"), reason.alias("exclusion_reason"),
    )
