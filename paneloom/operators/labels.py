"""Three-valued labels from admitted evidence.

The canonical form is long: one row per (entity, period, registered source). Sources without a
record stay in that grid as unknown, so absence can never become a negative.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.functions import tri
from paneloom.functions.dates import add_months, elapsed_days
from paneloom.functions.grid import lookup, registry, with_grid
from paneloom.functions.sets import sorted_set
from paneloom.operators.evidence import ANNUAL, DELAYED, NEXT

KEY = ["entity_id", "period"]


def admit_events(risk: DataFrame, records: DataFrame, sources: Sequence[Mapping[str, Any]], months: int) -> DataFrame:
    """Records admitted by their source's role: at the anchor, any time, or inside (anchor, anchor + horizon].

    ``violation`` marks records that break the contract instead of raising.
    """
    role = lookup({s["source_id"]: s["role"] for s in sources}, F.col("source_id"))
    zero_ok = lookup({s["source_id"]: s.get("zero_allowed", True) for s in sources}, F.col("source_id"))
    joined = records.join(risk.select(*KEY, "anchor"), KEY).withColumn("registered_role", role)
    seen, anchor = F.col("availability"), F.col("anchor")
    delayed = F.col("registered_role") == DELAYED
    outside = delayed & ((seen <= anchor) | (seen > add_months(anchor, months)))
    violation = (
        F.when(F.col("registered_role").isNull(), "SOURCE_UNREGISTERED")
        .when(F.col("role") != F.col("registered_role"), "ROLE_DRIFT")
        .when((F.col("registered_role") == ANNUAL) & ~seen.eqNullSafe(anchor), "ANNUAL_NOT_AT_ANCHOR")
        .when(delayed & seen.isNull(), "DELAYED_WITHOUT_DATE")
        .when((F.col("outcome") == F.lit(False)) & ~zero_ok, "ZERO_NOT_ALLOWED")
    )
    lag = F.when(F.col("registered_role") == ANNUAL, F.lit(0)).otherwise(elapsed_days(seen, anchor))
    return joined.filter(~F.coalesce(outside, F.lit(False))).select(
        *KEY, "record_id", "source_id", "outcome", "opportunity", lag.cast("int").alias("lag_days"), violation.alias("violation")
    )


def source_outcomes(risk: DataFrame, admitted: DataFrame, sources: Sequence[Mapping[str, Any]]) -> DataFrame:
    """One row per panel row and registered source: outcome, opportunity, matching lag, maturity, masked label.

    The lag is the smallest lag among the records that agree with the aggregated outcome.
    """
    outcome = F.col("outcome")
    grouped = (
        admitted.filter("violation IS NULL")
        .groupBy(*KEY, "source_id")
        .agg(
            tri.union_label(outcome, F.col("opportunity")).alias("outcome"),
            tri.any_true(F.col("opportunity")).alias("opportunity"),
            F.min(F.when(outcome, F.col("lag_days"))).alias("_lag_true"),
            F.min(F.when(~outcome, F.col("lag_days"))).alias("_lag_false"),
        )
    )
    grid = with_grid(
        risk.select(*KEY, "eligible", "annual_mature", "next_mature", "mature"),
        sources,
        {"source_id": "string", "channel_id": "string", "role": "string"},
    )
    ready = (
        F.when(F.col("role") == ANNUAL, F.col("annual_mature"))
        .when(F.col("role") == NEXT, F.col("next_mature"))
        .otherwise(F.col("mature"))
    )
    return grid.join(grouped, [*KEY, "source_id"], "left").select(
        *KEY,
        "source_id",
        "channel_id",
        "role",
        "eligible",
        ready.alias("mature"),
        "outcome",
        "opportunity",
        F.when(outcome, F.col("_lag_true")).when(~outcome, F.col("_lag_false")).alias("lag_days"),
        F.when(ready & F.col("eligible"), outcome).alias("label"),
    )


def candidate_targets(sources: DataFrame, targets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Union label per target over its required sources; mature only if all of them are."""
    wanted = with_grid(sources, [{"target_id": t, "_need": list(s)} for t, s in targets.items()],
                       {"target_id": "string", "_need": "array<string>"})
    wanted = wanted.filter(F.array_contains("_need", F.col("source_id"))).withColumn("_n", F.size("_need"))
    return (
        wanted.groupBy(*KEY, "target_id")
        .agg(
            tri.union_label(F.col("outcome"), F.col("opportunity"), F.col("_n")).alias("_raw"),
            F.bool_and("eligible").alias("eligible"),
            F.bool_and("mature").alias("mature"),
        )
        .select(*KEY, "target_id", "eligible", "mature", F.when(F.col("mature") & F.col("eligible"), F.col("_raw")).alias("outcome"))
    )


def sealed_outcomes(targets: DataFrame) -> DataFrame:
    return targets.filter("outcome IS NOT NULL").select(*KEY, "target_id", "outcome")


def channel_outcomes(sources: DataFrame, primary: Sequence[str]) -> DataFrame:
    """Channel union label and opportunity over the primary sources."""
    return (
        sources.filter(F.col("source_id").isin(*primary))
        .groupBy(*KEY, "channel_id")
        .agg(
            tri.union_label(F.col("outcome"), F.col("opportunity")).alias("outcome"),
            tri.any_true(F.col("opportunity")).alias("opportunity"),
        )
    )


def l2_channel_scores(sources: DataFrame, quality: Mapping[str, float], half_life: float) -> DataFrame:
    """Mean of outcome x quality x half-life decay over the observed sources of a channel."""
    weight = F.pow(F.lit(2.0), -F.greatest(F.lit(0), F.col("lag_days")) / F.lit(half_life))
    value = F.col("outcome").cast("double") * lookup(quality, F.col("source_id")) * weight
    usable = F.col("outcome").isNotNull() & F.col("lag_days").isNotNull()
    return (
        sources.filter(F.col("source_id").isin(*quality))
        .groupBy(*KEY, "channel_id")
        .agg(F.avg(F.when(usable, value)).alias("channel_score"))
    )


def l2_score(channel_scores: DataFrame) -> DataFrame:
    return channel_scores.groupBy(*KEY).agg(
        F.avg("channel_score").alias("l2_score"), F.count("channel_score").alias("observed_channel_count")
    )


def matrix_rows(sources: DataFrame) -> DataFrame:
    """Per panel row: source maps and the counters. Maps hold one entry per registered source."""

    def as_map(value: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", F.col(value)))))

    return sources.groupBy(*KEY).agg(
        as_map("outcome").alias("source_outcomes"),
        as_map("opportunity").alias("source_opportunities"),
        F.bool_and("eligible").alias("eligible"),
        F.bool_and("mature").alias("mature"),
        F.count("outcome").alias("observed_source_count"),
        F.size(F.collect_set(F.when(F.col("outcome").isNotNull(), F.col("channel_id")))).alias("observed_channel_count"),
        F.count_if("outcome").alias("positive_source_count"),
        F.count_if(~F.col("outcome")).alias("observed_zero_source_count"),
        F.count_if(F.col("outcome").isNull()).alias("unknown_source_count"),
        F.count_if("opportunity").alias("opportunity_count"),
        F.count_if(~F.col("opportunity")).alias("opportunity_absent_count"),
        F.count_if(F.col("opportunity").isNull()).alias("opportunity_unknown_count"),
    )


def channel_capability(channels: DataFrame, anchors: Sequence[str], registered: Sequence[str]) -> DataFrame:
    """Channels with any observed outcome; strict holdout needs two."""
    found = sorted(set(anchors) & set(registered))
    seen = channels.agg(sorted_set(F.when(F.col("outcome").isNotNull(), F.col("channel_id"))).alias("valid_channels"))
    count = F.size("valid_channels")
    return seen.select(
        "valid_channels",
        count.alias("channel_count"),
        (count >= 2).alias("strict_holdout_possible"),
        F.when(count >= 2, "AVAILABLE").otherwise("UNAVAILABLE").alias("status"),
        F.lit("AVAILABLE" if found else "UNAVAILABLE").alias("anchor_status"),
    )


def variable_registry(spark: SparkSession, sources: Sequence[Mapping[str, Any]], targets: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [
        {"variable_id": f"L0:{s['source_id']}", "role": "single_source_benchmark", "required_sources": [s["source_id"]]}
        for s in sources
    ]
    rows += [
        {"variable_id": t, "role": "candidate_binary_aggregation", "required_sources": sorted(s)}
        for t, s in sorted(targets.items())
    ]
    rows.append({"variable_id": "L2", "role": "observed_channel_normalized_score", "required_sources": []})
    return registry(spark, rows, {"variable_id": "string", "role": "string", "required_sources": "array<string>"})


def fold_eligibility(
    targets: DataFrame, years: Mapping[int, str], confirmatory_minimum: int, sensitivity: tuple[int, int]
) -> DataFrame:
    """Counts and the assigned role per (target, fold year). ``years`` maps a year to initial / nested / prospective."""
    outcome = F.col("outcome")
    counts = targets.groupBy("target_id", "period").agg(
        F.count_if("eligible").alias("eligible_count"),
        F.count_if(F.col("eligible") & F.col("mature")).alias("mature_count"),
        F.count(outcome).alias("labelled_count"),
        F.count_if(outcome).alias("positive_count"),
    )
    grid = with_grid(
        targets.select("target_id").distinct(),
        [{"period": y, "configured_role": r} for y, r in years.items()],
        {"period": "int", "configured_role": "string"},
    )
    rows = grid.join(counts, ["target_id", "period"], "left").na.fill(0)
    rows = rows.withColumn("observed_zero_count", F.col("labelled_count") - F.col("positive_count"))
    rows = rows.withColumn("unknown_count", F.col("mature_count") - F.col("labelled_count"))
    pos, neg = F.col("positive_count") > 0, F.col("observed_zero_count") > 0
    classes = (
        F.when(pos & neg, F.lit(None).cast("string"))
        .when(~pos & ~neg, "NO_OBSERVED_BINARY_CLASSES")
        .when(~pos, "POSITIVE_CLASS_MISSING")
        .otherwise("ZERO_CLASS_MISSING")
    )
    separate = F.col("configured_role").isin("initial", "prospective")
    confirmed = F.col("positive_count") >= confirmatory_minimum
    near = F.col("positive_count").between(*sensitivity)
    return rows.select(
        "*",
        (pos & neg).alias("both_classes"),
        F.when(separate, F.concat("configured_role", F.lit("_separate")))
        .when(~(pos & neg), "descriptive")
        .when(confirmed, "confirmatory")
        .when(near, "sensitivity")
        .otherwise("descriptive")
        .alias("assigned_role"),
        F.when(separate, F.coalesce(classes, F.lit("NONCONFIRMATORY_FOLD_ROLE")))
        .when(~(pos & neg), classes)
        .when(confirmed, F.lit(None).cast("string"))
        .when(near, "POSITIVE_COUNT_BELOW_CONFIRMATORY")
        .otherwise("INSUFFICIENT_POSITIVES")
        .alias("reason"),
        (F.col("unknown_count") < 0).alias("violation"),
    )


def fold_blockers(eligibility: DataFrame, folds: Sequence[int], target: str) -> DataFrame:
    """Reasons why a requested fold is not confirmatory; a missing or repeated row is one."""
    spark = eligibility.sparkSession
    wanted = registry(spark, [{"period": y, "target_id": target} for y in folds], {"period": "int", "target_id": "string"})
    found = eligibility.groupBy("target_id", "period").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max("assigned_role").alias("_role"),
        F.max("positive_count").alias("_pos"),
        F.max("observed_zero_count").alias("_neg"),
        F.bool_and("both_classes").alias("_both"),
    )
    one = F.col("_rows") == 1
    blockers = F.array_compact(
        F.array(
            F.when(one & (F.col("_neg") <= 0), "EXPLICIT_ZERO_CLASS_MISSING"),
            F.when(~F.coalesce(one, F.lit(False)), "FOLD_ELIGIBILITY_BINDING_MISSING"),
            F.when(one & (F.col("_role") != "confirmatory"), "FOLD_ROLE_NOT_CONFIRMATORY"),
            F.when(one & (F.col("_pos") <= 0), "POSITIVE_CLASS_MISSING"),
            F.when(one & ~F.col("_both"), "TWO_OBSERVED_CLASSES_REQUIRED"),
        )
    )
    return wanted.join(found, ["target_id", "period"], "left").select("target_id", "period", blockers.alias("blockers"))


def target_frame(scores: DataFrame, value: str, minimum_channels: int) -> DataFrame:
    """Soft target, unknown below the minimum of observed channels; ``in_range`` checks [0, 1]."""
    target = F.when(F.col("observed_channel_count") >= minimum_channels, F.col(value))
    return scores.select(*KEY, target.alias("target_value"), F.coalesce(target.between(0, 1), F.lit(True)).alias("in_range"))


def fold_target_frame(rows: DataFrame, outer_year: int) -> DataFrame:
    """Fold-local soft targets with the reason a row may not be used."""
    counts = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_copies"), F.min("target_value").alias("target_value"), F.max("target_value").alias("_high")
    )
    violation = (
        F.when(F.col("period") >= outer_year, "OUTER_OR_FUTURE_ROW")
        .when(~F.col("target_value").between(0, 1) | ~F.col("_high").between(0, 1), "OUTSIDE_UNIT_INTERVAL")
        .when(F.col("_copies") > 1, "DUPLICATE_ROW")
    )
    return counts.select(*KEY, "target_value", violation.alias("violation"))
