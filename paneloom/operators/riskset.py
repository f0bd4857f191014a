"""Maturity, censoring and the risk set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.dates import add_months, elapsed_days, year_complete
from paneloom.functions.grid import with_grid
from paneloom.functions.profile import profile
from paneloom.functions.sets import sorted_set
from paneloom.operators.evidence import ANNUAL, DELAYED
from paneloom.operators.ranking import quantiles

KEY = ["entity_id", "period"]

# Which maturity each primary target needs.
ANNUAL_TARGETS = ("L1_ANNUAL",)
NEXT_TARGETS = ("BROAD", "REPORTING", "CONTENT", "TIMELINESS")
BOTH_TARGETS = ("L1_REPORTING", "L1_CONTENT_STRICT")


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def maturity_flags(panel: DataFrame, cutoff: str, through: int, incomplete: tuple[int, ...] = ()) -> DataFrame:
    required = F.col("period") + 1
    return panel.select(
        "*",
        F.lit(True).alias("eligible"),
        (F.col("anchor") <= moment(cutoff)).alias("annual_mature"),
        required.alias("required_year"),
        year_complete(required, through, incomplete).alias("next_mature"),
    )


def horizon_mature(panel: DataFrame, months: int, cutoff: str) -> DataFrame:
    return panel.withColumn("mature", add_months(F.col("anchor"), months) <= moment(cutoff))


def primary_maturity(flags: DataFrame, target: str | None) -> DataFrame:
    """Maturity and status text of the primary target; no target means nothing is mature."""
    if target is None:
        return flags.withColumn("mature", F.lit(False)).withColumn("maturity_status", F.lit("PRIMARY_TARGET_NOT_LOCKED"))
    if target in ANNUAL_TARGETS:
        ready, rule = F.col("annual_mature"), "ANNUAL_MEASUREMENT_MATURE"
    elif target in NEXT_TARGETS:
        ready, rule = F.col("next_mature"), "NEXT_PERIOD_MATURE"
    elif target in BOTH_TARGETS:
        ready, rule = F.col("annual_mature") & F.col("next_mature"), "ANNUAL_AND_NEXT_MATURE"
    else:
        raise ValueError(f"unknown primary target: {target}")
    return flags.withColumn("mature", ready).withColumn(
        "maturity_status", F.when(ready, rule).otherwise(f"{rule}_INCOMPLETE")
    )


def split_prospective(risk: DataFrame) -> DataFrame:
    """Retrospective and prospective rows as one labelled set; filter on ``risk_side``."""
    return risk.withColumn("risk_side", F.when(F.col("mature"), "retrospective").otherwise("prospective"))


def censoring_registry(risk: DataFrame) -> DataFrame:
    return risk.select(
        *KEY,
        F.when(F.col("mature"), "complete_mature_followup").otherwise(F.col("maturity_status")).alias("classification"),
        F.col("mature").alias("retrospective"),
        F.lit(False).alias("assigned_negative"),
    )


def maturity_counts(panel: DataFrame, horizons: Sequence[int], cutoff: str) -> DataFrame:
    """Mature rows per horizon, all horizons in one pass."""
    fields = {
        str(h): {"mature_count": F.count_if(add_months(F.col("anchor"), h) <= moment(cutoff))}
        for h in sorted(set(horizons))
    }
    return profile(panel, fields, label="months").withColumn("months", F.col("months").cast("int"))


def maturity_curves(panel: DataFrame, events: DataFrame, horizons: Sequence[int], cutoff: str) -> DataFrame:
    """Timing of delayed events per (source, channel) and horizon, over all linked events."""
    linked = events.filter(F.col("role") == DELAYED).join(panel.select(*KEY, "anchor"), KEY)
    seen, anchor, by = F.col("availability"), F.col("anchor"), ["source_id", "channel_id"]
    rows = linked.select(*by, "availability", "anchor", elapsed_days(seen, anchor).cast("double").alias("lag_days"))
    late = seen > moment(cutoff)
    per_horizon = with_grid(rows, [{"months": h} for h in sorted(set(horizons))], {"months": "int"})
    end = add_months(anchor, F.col("months"))
    counts = per_horizon.groupBy(*by, "months").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(seen < anchor).alias("pre_anchor_count"),
        F.count_if(F.col("lag_days") < 0).alias("negative_lag_count"),
        F.count_if(seen == anchor).alias("same_moment_count"),
        F.count_if(seen > anchor).alias("future_count"),
        F.count_if(late).alias("post_cutoff_count"),
        F.count_if((seen > anchor) & (seen <= end) & ~late).alias("in_horizon_count"),
        F.count_if((seen > end) & ~late).alias("post_horizon_count"),
    )
    medians = quantiles(rows, by, "lag_days", {"median_lag_days": 0.5})
    return counts.join(medians, by, "left").withColumn(
        "in_horizon_fraction", F.try_divide("in_horizon_count", "event_count")
    )


def annual_availability(panel: DataFrame, ledger: DataFrame) -> DataFrame:
    """Annual records per (source, channel): at the anchor or not, opportunity counts, bases."""
    linked = ledger.filter(F.col("role") == ANNUAL).join(panel.select(*KEY, "anchor"), KEY)
    at_anchor = F.coalesce(F.col("availability") == F.col("anchor"), F.lit(False))
    return linked.groupBy("source_id", "channel_id").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(at_anchor).alias("at_anchor_count"),
        F.count_if(~at_anchor).alias("anchor_mismatch_count"),
        F.count_if("opportunity").alias("opportunity_true_count"),
        F.count_if(~F.col("opportunity")).alias("opportunity_false_count"),
        F.count_if(F.col("opportunity").isNull()).alias("opportunity_unknown_count"),
        sorted_set(F.col("availability_basis")).alias("availability_bases"),
    )


def maturity_audit(risk: DataFrame) -> DataFrame:
    return risk.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("eligible").alias("eligible_count"),
        F.count_if("mature").alias("mature_count"),
        F.count_if(~F.col("mature")).alias("prospective_count"),
        F.count_if("annual_mature").alias("annual_mature_count"),
        F.count_if("next_mature").alias("next_mature_count"),
        F.lit(0).cast("long").alias("assigned_negative_count"),
    )
