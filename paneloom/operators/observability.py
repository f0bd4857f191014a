"""What was observed, per source, channel and channel combination."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions import tri
from paneloom.functions.profile import profile

KEY = ["entity_id", "period"]


def classify_verification(status: Column) -> Column:
    return (
        F.when(status == "observed_verification", "observed_verification")
        .when(status.isin("observed", "derived_from_audited_filings", "observed_opportunity_only"), "observed_opportunity_only")
        .otherwise("unknown")
    )


def channel_verification(sources: DataFrame) -> DataFrame:
    """Best class among the sources of a channel: verification > opportunity > unknown."""
    kind = classify_verification(F.col("status"))
    return sources.groupBy("channel_id").agg(
        F.when(F.bool_or(kind == "observed_verification"), "observed_verification")
        .when(F.bool_or(kind == "observed_opportunity_only"), "observed_opportunity_only")
        .otherwise("unknown")
        .alias("verification")
    )


def _counters(rows: DataFrame, by: str) -> DataFrame:
    seen = F.col("outcome").isNotNull()
    counted = rows.filter("eligible").groupBy(by).agg(
        F.count(F.lit(1)).alias("eligible_count"),
        F.count_if("mature").alias("mature_count"),
        F.count_if(~F.col("mature")).alias("prospective_count"),
        F.count_if(seen).alias("observed_count"),
        F.count_if(seen & F.col("mature")).alias("mature_observed_count"),
        F.count_if(seen & ~F.col("mature")).alias("prospective_observed_count"),
        F.count_if("outcome").alias("positive_count"),
        F.count_if(~F.col("outcome")).alias("observed_zero_count"),
        F.count_if("opportunity").alias("opportunity_count"),
        F.count_if(~F.col("opportunity")).alias("opportunity_absent_count"),
    )
    known = F.col("opportunity_count") + F.col("opportunity_absent_count")
    return counted.select(
        "*",
        (F.col("eligible_count") - known).alias("opportunity_unknown_count"),
        (F.col("eligible_count") - F.col("observed_count")).alias("unknown_count"),
        (F.col("mature_count") - F.col("mature_observed_count")).alias("mature_unknown_count"),
        F.try_divide("positive_count", "eligible_count").alias("positive_fraction"),
        F.try_divide("observed_count", "eligible_count").alias("observed_fraction"),
        F.try_divide("mature_observed_count", "mature_count").alias("mature_observed_fraction"),
        F.when(known > 0, F.try_divide("opportunity_count", "eligible_count")).alias("coverage_rate"),
    )


def source_observability(sources: DataFrame) -> DataFrame:
    """Counters per source from the long source grid."""
    return _counters(sources, "source_id")


def channel_rows(sources: DataFrame) -> DataFrame:
    """Channel grain: union outcome, opportunity, and maturity only if all its sources are mature."""
    return sources.groupBy(*KEY, "channel_id").agg(
        tri.union_label(F.col("outcome"), F.col("opportunity")).alias("outcome"),
        tri.any_true(F.col("opportunity")).alias("opportunity"),
        F.bool_and("eligible").alias("eligible"),
        F.bool_and("mature").alias("mature"),
    )


def channel_observability(sources: DataFrame) -> DataFrame:
    return _counters(channel_rows(sources), "channel_id")


def _wide(channels: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per key with two booleans per registered channel; channels are configuration."""
    picks = []
    for i, c in enumerate(sorted(names)):
        mine = F.col("channel_id") == c
        picks.append(F.coalesce(F.bool_or(mine & F.col("outcome").isNotNull()), F.lit(False)).alias(f"_s{i}"))
        picks.append(F.coalesce(F.bool_or(mine & F.coalesce("opportunity", F.lit(False))), F.lit(False)).alias(f"_o{i}"))
    return channels.filter("eligible").groupBy(*KEY).agg(*picks, F.bool_and("mature").alias("mature"))


def channel_overlap(channels: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows per combination of observed channels, by outcome and by opportunity."""
    wide = _wide(channels, names)

    def pattern(kind: str) -> Column:
        seen = F.array_compact(F.array(*[F.when(F.col(f"_{kind}{i}"), c) for i, c in enumerate(sorted(names))]))
        return F.when(F.size(seen) > 0, F.array_join(seen, "∩")).otherwise("NONE")

    both = F.array(
        F.struct(F.lit("observed_outcome").alias("basis"), pattern("s").alias("channel_pattern")),
        F.struct(F.lit("observed_opportunity").alias("basis"), pattern("o").alias("channel_pattern")),
    )
    return (
        wide.select("mature", F.explode(both).alias("_p"))
        .groupBy("_p.basis", "_p.channel_pattern")
        .agg(
            F.count(F.lit(1)).alias("eligible_count"),
            F.count_if("mature").alias("mature_count"),
            F.count_if(~F.col("mature")).alias("prospective_count"),
        )
    )


def pair_overlap(channels: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows in which both channels of a pair are observed; all pairs of registered channels in one pass."""
    wide = _wide(channels, names)
    order = sorted(names)
    fields: dict[str, Mapping[str, Column]] = {}
    for (i, a), (j, b) in combinations(enumerate(order), 2):
        fields[f"{a}|{b}"] = {
            "outcome_overlap": F.count_if(F.col(f"_s{i}") & F.col(f"_s{j}")),
            "opportunity_overlap": F.count_if(F.col(f"_o{i}") & F.col(f"_o{j}")),
        }
    rows = profile(wide, fields, label="pair")
    return rows.select(
        F.split("pair", r"\|")[0].alias("channel_a"), F.split("pair", r"\|")[1].alias("channel_b"),
        "outcome_overlap", "opportunity_overlap",
    )
