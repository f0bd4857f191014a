"""Analytics on simulation result tables: Monte-Carlo error, policies, coverage and control.

Facts are long: scenario_id, method_id, replication_id, metric_id, estimate, and method metadata.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.grid import registry, with_grid
from paneloom.functions.profile import melt
from paneloom.operators.metrics import average_precision, precision_at, roc_auc
from paneloom.operators.ranking import attach, cut, quantiles

CELL = ["scenario_id", "method_id", "metric_id"]
COMPANIONS = ("normalized_cost_regret", "cost_regret_vs_oracle", "cost_savings_vs_all_negative")


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def sanitize_regret(facts: DataFrame) -> DataFrame:
    """Normalised regret recomputed from its companions; unknown when the scale vanishes.

    ``companion_missing`` marks rows whose companions are absent.
    """
    split = r"^(.*)::([^:]*)$"
    prefix, suffix = F.regexp_extract("metric_id", split, 1), F.regexp_extract("metric_id", split, 2)
    rows = facts.withColumn("_p", prefix).withColumn("_s", suffix)
    keys = ["scenario_id", "method_id", "replication_id", "_p"]
    value = _finite(F.col("estimate"))
    pairs = (
        rows.filter(F.col("_s").isin(*COMPANIONS[1:]))
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("_s") == COMPANIONS[1], value)).alias("_regret"),
            F.max(F.when(F.col("_s") == COMPANIONS[2], value)).alias("_savings"),
        )
    )
    joined = attach(rows, pairs, keys)
    avoidable = F.abs(F.col("_regret") + F.col("_savings"))
    scale = F.greatest(F.abs("_regret"), F.abs("_savings"), F.lit(1.0))
    mine = F.col("_s") == COMPANIONS[0]
    fresh = F.when(avoidable > 1e-10 * scale, F.col("_regret") / avoidable)
    return joined.select(
        *[F.when(mine, fresh).otherwise(F.col("estimate")).alias("estimate") if c == "estimate" else F.col(c) for c in facts.columns],
        (mine & (F.col("_regret").isNull() | F.col("_savings").isNull())).alias("companion_missing"),
    )


POLICY = {
    "policy_id": "string", "pattern": "string", "priority": "int", "role": "string", "gate_required": "boolean",
    "target_rule": "string", "undefined_policy": "string", "minimum_finite_fraction": "double",
}


def resolve_policies(facts: DataFrame, policies: Sequence[Mapping[str, Any]]) -> DataFrame:
    """The policy of each metric: highest priority, then the pattern with most literal characters.

    ``resolution`` tells missing and ambiguous ones. Metrics and policies are configuration-sized.
    """
    names = facts.select("metric_id").distinct()
    rows = [
        {**p, "_regex": fnmatch.translate(p["pattern"]), "_specific": len(p["pattern"].replace("*", "").replace("?", ""))} for p in policies
    ]
    grid = with_grid(names, rows, {**POLICY, "_regex": "string", "_specific": "int"}).filter("metric_id RLIKE _regex")
    best = grid.groupBy("metric_id").agg(F.max(F.struct("priority", "_specific")).alias("_top"))
    top = attach(grid, best, ["metric_id"]).filter("priority = _top.priority AND _specific = _top._specific")
    payload = F.struct(*[c for c in POLICY])
    chosen = top.groupBy("metric_id").agg(F.min(payload).alias("_w"), F.count(F.lit(1)).alias("_n"))
    return attach(names, chosen, ["metric_id"]).select(
        "metric_id", "_w.*", F.when(F.col("_n").isNull(), "MISSING").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("RESOLVED").alias("resolution")
    )


def replication_tier() -> Column:
    """Tier of a method from its metadata; standalone before imbalance, extended and cost tiers."""
    robust = ~F.coalesce("treatment", F.lit("none")).isin("none", "not_applicable")
    return (
        F.when((F.col("family") == "standalone_estimator") | (F.col("learner_tier") == "standalone"), "standalone")
        .when(robust, "imbalance_robustness")
        .when(F.col("learner_tier").isin("extended", "methodological"), "extended_predictive")
        .when((F.col("learner_tier") == "core") & (F.coalesce("cost_regime", F.lit("symmetric")) != "symmetric"), "cost_sensitive_core")
        .otherwise("core_cost_neutral")
    )


def replication_plan(methods: DataFrame, plan: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Minimum and maximum replications of each method by tier."""
    tiers = [{"tier": t, "minimum": lo, "maximum": hi} for t, (lo, hi) in plan.items()]
    table = registry(methods.sparkSession, tiers, {"tier": "string", "minimum": "int", "maximum": "int"})
    return methods.withColumn("tier", replication_tier()).join(F.broadcast(table), "tier", "left")


def mcse_summary(
    facts: DataFrame, policies: DataFrame, plan: Mapping[str, tuple[int, int]], target: float, relative_fraction: float, mmi_target: float
) -> DataFrame:
    """Mean, Monte-Carlo error and gate flags per (scenario, method, metric). One aggregation of the facts.

    Facts carry learner_tier, cost_regime, treatment and family; mixed values are flagged.
    """
    value, meta = _finite(F.col("estimate")), ("learner_tier", "cost_regime", "treatment", "family")
    cells = facts.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("replications"),
        F.count(value).alias("finite_replications"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_sd"),
        *[F.max(m).alias(m) for m in meta],
        *[(F.min(m) < F.max(m)).alias(f"_mixed_{m}") for m in meta],
    )
    mixed = F.lit(False)
    for m in meta:
        mixed = mixed | F.coalesce(F.col(f"_mixed_{m}"), F.lit(False))
    sized = replication_plan(cells, plan)
    rows = attach(sized, policies, ["metric_id"])
    rows = rows.withColumn("mcse", F.when(F.col("finite_replications") > 0, F.col("_sd") / F.sqrt("finite_replications")))
    rule, gated = F.col("target_rule"), F.col("gate_required")
    goal = (
        F.when(rule == "relative_to_mean", F.greatest(F.lit(target), relative_fraction * F.greatest(F.abs("mean"), F.lit(1e-6))))
        .when(rule == "mmi_scaled", F.least(F.lit(target), F.lit(mmi_target)))
        .otherwise(F.lit(target))
    )
    rows = rows.withColumn("mcse_target", F.when(gated, goal))
    need = F.ceil(F.col("minimum") * F.col("minimum_finite_fraction"))
    undefined = F.col("replications") - F.col("finite_replications")
    flags = {
        "minimum_met": ~gated | (F.col("replications") >= F.col("minimum")),
        "finite_met": ~gated | (F.col("finite_replications") >= need),
        "undefined_met": ~gated | ~((F.col("undefined_policy") == "forbid") & (undefined > 0)),
        "target_met": ~gated | F.coalesce(F.col("mcse") <= F.col("mcse_target"), F.lit(False)),
    }
    rows = rows.withColumns(flags)
    return rows.select(
        *CELL, "policy_id", "gate_required", "tier", "replications", "finite_replications", undefined.alias("undefined_replications"), "mean", "mcse",
        "mcse_target", *flags, (F.col("minimum_met") & F.col("finite_met") & F.col("undefined_met") & F.col("target_met")).alias("gate_met"),
        (F.col("replications") >= F.col("maximum")).alias("maximum_reached"), mixed.alias("mixed_metadata"),
    )


def mcse_status(summary: DataFrame) -> DataFrame:
    gated = summary.filter("gate_required")
    stats = gated.agg(
        F.count(F.lit(1)).alias("gated_count"), F.bool_and("gate_met").alias("_met"),
        F.bool_and(F.col("gate_met") | F.col("maximum_reached")).alias("_end"),
    )
    return stats.select(
        "gated_count",
        F.when(F.col("gated_count") == 0, "FAIL").when(F.col("_met"), "PASS").when(F.col("_end"), "MAXIMUM_REACHED").otherwise("CONTINUE").alias("status"),
    )


def control_decision(summary: DataFrame) -> DataFrame:
    """Adaptive state per (scenario, method) from gated metrics only."""
    return summary.filter("gate_required").groupBy("scenario_id", "method_id").agg(
        F.min("replications").alias("completed"),
        F.bool_and(F.col("minimum_met") & F.col("target_met")).alias("precision_met"),
        F.bool_and(F.col("target_met") | F.col("maximum_reached")).alias("terminal_at_cap"),
        F.count(F.lit(1)).alias("gated_metric_count"),
    )


def batch_audit(facts: DataFrame, size: int) -> DataFrame:
    """Replication range per batch: contiguous, aligned to the batch size, of the stated batch."""
    per_id = facts.groupBy("scenario_id", "method_id", "batch_id", "replication_id").agg(F.count(F.lit(1)).alias("_n"))
    ranges = per_id.groupBy("scenario_id", "method_id", "batch_id").agg(
        F.min("replication_id").alias("first_id"), F.max("replication_id").alias("last_id"), F.count(F.lit(1)).alias("id_count")
    )
    return ranges.select(
        "*",
        (F.col("last_id") - F.col("first_id") + 1 == F.col("id_count")).alias("contiguous"),
        (F.pmod("first_id", F.lit(size)) == 0).alias("aligned"),
        (F.floor(F.col("first_id") / size) == F.col("batch_id")).alias("matches_batch"),
    )


def validate_coverage(facts: DataFrame, methods: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Missing and unexpected methods, missing metrics, conflicting metadata and repeated facts as coded rows.

    methods: scenario_id, method_id, learner_tier (the registered value).
    """
    spark, who = facts.sparkSession, ["scenario_id", "method_id"]
    tiers = cut(facts.groupBy(*who, "metric_id", "learner_tier").agg(F.count(F.lit(1)).alias("n")))  # a few rows a cell
    seen = tiers.groupBy(*who).agg(F.min("learner_tier").alias("_lo"), F.max("learner_tier").alias("_hi"))
    both = methods.withColumnRenamed("learner_tier", "_reg").withColumn("_m", F.lit(True)).join(seen.withColumn("_f", F.lit(True)), who, "full_outer")
    code = (
        F.when(F.col("_f").isNull(), "METHOD_MISSING")
        .when(F.col("_m").isNull(), "METHOD_UNEXPECTED")
        .when((F.col("_lo") != F.col("_hi")) | (F.col("_lo") != F.col("_reg")), "METADATA_CONFLICT")
    )
    none = F.lit(None).cast("string")
    first = both.select(*who, none.alias("metric_id"), code.alias("reason")).filter("reason IS NOT NULL")
    names = registry(spark, [{"metric_id": m} for m in metrics], {"metric_id": "string"})
    cells = tiers.select(*who, "metric_id").distinct()
    wanted = with_grid(tiers.select(*who).distinct(), [{"metric_id": m} for m in metrics], {"metric_id": "string"})
    second = wanted.join(cells, [*who, "metric_id"], "left_anti").withColumn("reason", F.lit("METRIC_MISSING"))
    extra = cells.join(F.broadcast(names), "metric_id", "left_anti").select(*who, "metric_id").withColumn("reason", F.lit("METRIC_UNEXPECTED"))
    twice = (
        facts.groupBy(*who, "metric_id", "replication_id").count().filter("count > 1").select(*who, "metric_id").distinct()
        .withColumn("reason", F.lit("DUPLICATE_FACT"))
    )
    return first.unionByName(second).unionByName(extra).unionByName(twice)


def coordinate_bijection(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coordinates that only one of two tables has; one aggregation of both."""
    sides = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    found = sides.groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r")).filter("_l + _r = 1")
    return found.select(*keys, F.when(F.col("_l") == 1, "left_only").otherwise("right_only").alias("side"))


def label_summary(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """Positive and known rates over all rows, and the positive rate among known rows."""
    rows = panel.join(labels, ["entity_id", "period"], "left")
    known = F.col("outcome").isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(known.cast("double")).alias("known_rate"),
        F.avg(F.coalesce(F.col("outcome"), F.lit(False)).cast("double")).alias("positive_rate"),
        F.avg(F.col("outcome").cast("double")).alias("positive_rate_known"),
    )


def zscore_pool(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Median-filled z-scores (population sd, 1 when it is 0), statistics from the rows given."""
    long = melt(panel, [], features).filter("value IS NOT NULL")
    middle = quantiles(long, ["feature"], "value", {"m": 0.5})
    fills = middle.groupBy().agg(*[F.max(F.when(F.col("feature") == f, F.col("m"))).alias(f"_m_{f}") for f in features])
    filled = attach(panel, fills, []).select(
        *[c for c in panel.columns if c not in features], *[F.coalesce(F.col(f).cast("double"), F.col(f"_m_{f}")).alias(f) for f in features]
    )
    stats = filled.agg(
        *[F.avg(f).alias(f"_a_{f}") for f in features], *[F.coalesce(F.nullif(F.stddev_pop(f), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{f}") for f in features]
    )
    return attach(filled, stats, []).select(
        *[c for c in panel.columns if c not in features], *[((F.col(f) - F.col(f"_a_{f}")) / F.col(f"_s_{f}")).alias(f) for f in features]
    )


def invert_prevalence(rates: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Latent prevalence (q - p0) / (p1 - p0); out-of-range values are incompatible."""
    raw = F.try_divide(F.col("q") - F.col("p0"), F.col("p1") - F.col("p0"))
    ok = raw.between(-tolerance, 1 + tolerance)
    return rates.select(
        "*", F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).alias("prevalence"),
        F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("INCOMPATIBLE").alias("status"),
    )


def gap_metrics(scored: DataFrame, fraction: float, by: Sequence[str]) -> DataFrame:
    """Ranking quality against the observed and the latent label, and their gaps.

    Undefined average precision counts as 0 and undefined AUC as one half. Needs observed and latent.
    """
    whole = None
    for kind in ("observed", "latent"):
        rows = scored.filter(F.col(kind).isNotNull()).withColumn("outcome", F.col(kind))
        part = (
            average_precision(rows, by).join(roc_auc(rows, by), list(by)).join(precision_at(rows, fraction, by).drop("review_count"), list(by))
        )
        part = part.select(
            *by, F.coalesce("average_precision", F.lit(0.0)).alias(f"ap_{kind}"), F.coalesce("roc_auc", F.lit(0.5)).alias(f"auc_{kind}"),
            F.col("precision").alias(f"precision_{kind}"),
        )
        whole = part if whole is None else whole.join(part, list(by))
    return whole.withColumns(
        {"ap_gap": F.col("ap_observed") - F.col("ap_latent"), "auc_gap": F.col("auc_observed") - F.col("auc_latent")}
    )
