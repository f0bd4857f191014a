"""Count tables, reconciliations and digests for reporting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.dates import add_months, elapsed_days
from paneloom.functions.sets import sorted_set
from paneloom.functions.tri import differs
from paneloom.operators.ranking import attach, quantiles

KEY = ["entity_id", "period"]


def _outcomes() -> list[Column]:
    o = F.col("outcome")
    return [
        F.count_if(o).alias("positive"), F.count_if(~o).alias("observed_zero"), F.count_if(o.isNull()).alias("unknown"),
    ]


def _opportunities() -> list[Column]:
    o = F.col("opportunity")
    return [
        F.count_if(o).alias("opportunity_observed"), F.count_if(~o).alias("opportunity_absent"),
        F.count_if(o.isNull()).alias("opportunity_unknown"),
    ]


# ------------------------------------------------------------- result tables


def final_ledger(*parts: DataFrame) -> DataFrame:
    """Gate and check results as one long ledger: section, subject, verdict, value."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.select("section", "subject", "verdict", "value")


def verdict_matrix(ledger: DataFrame, sections: Sequence[str]) -> DataFrame:
    """One row per subject with the verdict of every section."""
    return ledger.groupBy("subject").agg(*[F.max(F.when(F.col("section") == s, F.col("verdict"))).alias(s) for s in sections])


def result_tables(ledger: DataFrame) -> DataFrame:
    """Row, pass and value counts per section."""
    return ledger.groupBy("section").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("verdict") == "PASS").alias("pass_count"), F.count("value").alias("value_count")
    )


# ------------------------------------------------------------- count tables


def s1_counts(pairs: DataFrame) -> DataFrame:
    """Matched-pair counts by item and period; reasons are matched by prefix."""
    known = F.count("outcome")
    return pairs.groupBy("item", "period").agg(
        F.count(F.lit(1)).alias("record_count"),
        *_opportunities(),
        *_outcomes(),
        F.count_if(F.startswith("reason", F.lit("INVALID_DENOMINATOR"))).alias("invalid_denominator"),
        F.count_if(F.startswith("reason", F.lit("DUPLICATE"))).alias("duplicate_or_conflict"),
        F.count("ratio").alias("ratio_computed"),
        F.try_divide(F.count_if("outcome"), known).alias("prevalence"),
        (F.count_if(F.col("reason") == "EMPIRICAL_RULE_NOT_LOCKED") == 0).alias("rule_locked"),
    )


def s2_counts(opinions: DataFrame, categories: Sequence[str]) -> DataFrame:
    reason = F.col("reason")
    return opinions.groupBy("period").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if("opportunity").alias("opinion_observed"),
        *[F.count_if(F.col("category") == c).alias(c) for c in categories],
        F.count_if(reason.isin("OPINION_RECORD_MISSING", "OPINION_MISSING")).alias("missing"),
        *_outcomes(),
        F.count_if(reason == "CONFLICTING_OPINIONS").alias("conflicting"),
        F.count_if(reason.isin("OPINION_UNMAPPED", "CATEGORY_PENDING", "CATEGORY_UNMAPPED")).alias("unmapped_or_pending"),
    )


def l1_counts(targets: DataFrame, folds: DataFrame, default_role: str = "not_a_fold") -> DataFrame:
    """Target counts by period with the fold role; periods that are no fold get the default."""
    counts = targets.groupBy("target_id", "period").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if("mature").alias("mature_count"), *_outcomes()
    )
    roles = folds.select("target_id", "period", "assigned_role")
    return counts.join(roles, ["target_id", "period"], "left").na.fill(default_role, ["assigned_role"])


def l0_counts(sources: DataFrame) -> DataFrame:
    """Counts by source and period; immature rows apart, opportunities from the grid itself."""
    ready = F.col("mature")
    return sources.groupBy("source_id", "period").agg(
        F.count_if(ready).alias("mature_count"),
        F.count_if(~ready).alias("immature_count"),
        F.count_if(ready & F.col("outcome")).alias("positive"),
        F.count_if(ready & ~F.col("outcome")).alias("observed_zero"),
        F.count_if(ready & F.col("outcome").isNull()).alias("unknown"),
        *_opportunities(),
    )


def failure_counts(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Counts per field combination, null groups kept."""
    return rows.groupBy(*fields).agg(F.count(F.lit(1)).alias("row_count"))


def decision_counts(ledger: DataFrame) -> DataFrame:
    """Decisions and documents by target year, with a bucket for unresolved years."""
    year = F.coalesce(F.col("target_period").cast("string"), F.lit("UNRESOLVED"))
    return ledger.groupBy(year.alias("target_year")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("document_id").alias("document_count"),
        F.count_if(F.col("hard_positive") & F.col("row_included")).alias("included_count"),
    )


def endpoint_counts(results: DataFrame, first_outer: int) -> DataFrame:
    return results.groupBy("endpoint", "period").agg(
        F.count(F.lit(1)).alias("row_count"), *_outcomes(), *_opportunities(), (F.first("period") < first_outer).alias("development")
    )


def unknown_reasons(results: DataFrame) -> DataFrame:
    return results.filter("outcome IS NULL").groupBy("endpoint", "period", "reason").agg(F.count(F.lit(1)).alias("row_count"))


# ------------------------------------------------------------- reconciliation


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every (key, source) of two tables with what differs: presence, outcome, opportunity."""
    keys = [*KEY, "source_id"]
    a = left.select(*keys, F.col("outcome").alias("left_outcome"), F.col("opportunity").alias("left_opportunity"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col("outcome").alias("right_outcome"), F.col("opportunity").alias("right_opportunity"), F.lit(True).alias("_r"))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return a.join(b, keys, "full_outer").select(
        *keys,
        F.col("_l").isNull().alias("left_missing"),
        F.col("_r").isNull().alias("right_missing"),
        (both & differs(F.col("left_outcome"), F.col("right_outcome"))).alias("outcome_mismatch"),
        (both & differs(F.col("left_opportunity"), F.col("right_opportunity"))).alias("opportunity_mismatch"),
    )


def reconcile_detail(compared: DataFrame) -> DataFrame:
    return compared.filter("left_missing OR right_missing OR outcome_mismatch OR opportunity_mismatch")


def reconcile_summary(compared: DataFrame) -> DataFrame:
    flags = ("left_missing", "right_missing", "outcome_mismatch", "opportunity_mismatch")
    return compared.groupBy("period", "source_id").agg(F.count(F.lit(1)).alias("compared_keys"), *[F.count_if(f).alias(f) for f in flags])


def earliest_positive(counts: DataFrame) -> DataFrame:
    return counts.groupBy("endpoint").agg(F.min(F.when(F.col("positive") > 0, F.col("period"))).alias("earliest_positive_period"))


def source_coverage(sources: DataFrame, first_outer: int) -> DataFrame:
    """Development coverage and observed positive rate per source."""
    rows = sources.filter((F.col("period") < first_outer) & F.col("eligible"))
    return rows.groupBy("source_id", "channel_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("outcome").alias("observed_count"), F.count_if("outcome").alias("positive_count"),
        F.try_divide(F.count("outcome"), F.count(F.lit(1))).alias("coverage"),
        F.try_divide(F.count_if("outcome"), F.count("outcome")).alias("observed_positive_rate"),
    )


def channel_coverage(channels: DataFrame, sources: DataFrame, first_outer: int) -> DataFrame:
    """The same per channel, with the sorted sources behind it."""
    rows = channels.filter((F.col("period") < first_outer) & F.col("eligible"))
    counts = rows.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("outcome").alias("observed_count"), F.count_if("outcome").alias("positive_count"),
        F.try_divide(F.count("outcome"), F.count(F.lit(1))).alias("coverage"),
        F.try_divide(F.count_if("outcome"), F.count("outcome")).alias("observed_positive_rate"),
    )
    members = sources.groupBy("channel_id").agg(sorted_set(F.col("source_id")).alias("source_ids"))
    return attach(counts, members, ["channel_id"])


def lag_distribution(risk: DataFrame, records: DataFrame, first_outer: int) -> DataFrame:
    """Lag statistics per source over eligible development rows; exact quantiles."""
    keys = risk.filter((F.col("period") < first_outer) & F.col("eligible")).select(*KEY, "anchor")
    rows = records.filter("availability IS NOT NULL").join(keys, KEY).select(
        "source_id", "outcome", elapsed_days(F.col("availability"), F.col("anchor")).cast("double").alias("lag")
    )
    by = ["source_id"]
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("record_count"), F.count("outcome").alias("observed_count"), F.avg("lag").alias("lag_mean")
    )
    spread = quantiles(rows, by, "lag", {"lag_p25": 0.25, "lag_p50": 0.5, "lag_p75": 0.75, "lag_p90": 0.9})
    seen = quantiles(rows.filter("outcome IS NOT NULL"), by, "lag", {"observed_lag_p50": 0.5})
    return attach(attach(stats, spread, by), seen, by)


def anchor_quantiles(coverage: DataFrame) -> DataFrame:
    """Quantiles of the observed positive rates, one rate per channel (a configured number)."""
    rate = F.col("observed_positive_rate")
    marks = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    return coverage.agg(
        F.count(rate).alias("channel_count"), *[F.percentile(rate, F.lit(p)).alias(n) for n, p in marks.items()]
    )


def event_reconciliation(statuses: DataFrame, panel: DataFrame, cutoff: str) -> DataFrame:
    """Event timing per (source, channel, period) and in total, from link statuses.

    Needs source_id, channel_id, key, availability, status. The grand total comes from the same
    aggregation as a grouping set (its group columns are null).
    """
    joined = statuses.drop("anchor").join(panel.select(*KEY, "anchor"), KEY, "left")
    seen, anchor, limit = F.col("availability"), F.col("anchor"), F.lit(cutoff).cast("timestamp_ntz")
    linked = F.col("status").isin("ACCEPTED", "DUPLICATE_UPSTREAM_EVENT")
    timed = linked & anchor.isNotNull()
    year1, year2, open_ = add_months(anchor, 12), add_months(anchor, 24), seen <= limit
    after = timed & (seen > anchor)
    flags = {
        "linked_events": linked,
        "unlinked_events": F.col("status") == "UNLINKED_ENTITY_PERIOD",
        "duplicate_events": F.col("status") == "DUPLICATE_UPSTREAM_EVENT",
        "excluded_events": F.col("status") == "EXCLUDED_BY_SOURCE_RULE",
        "pre_anchor_events": timed & (seen < anchor),
        "same_moment_events": timed & (seen == anchor),
        "in_12_month_events": after & (seen <= year1) & open_,
        "month_12_to_24_events": after & (seen > year1) & (seen <= year2) & open_,
        "in_24_month_events": after & (seen <= year2) & open_,
        "post_horizon_events": after & (seen > year2) & open_,
        "post_cutoff_events": seen > limit,
    }
    rows = joined.select("source_id", "channel_id", "period", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])
    return rows.groupingSets([["source_id", "channel_id", "period"], []], "source_id", "channel_id", "period").agg(
        F.count(F.lit(1)).alias("raw_event_rows"), *[F.count_if(n).alias(n) for n in flags]
    )


def label_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value) pairs that only one of two label tables has, as added or removed."""
    a, b = old.select(*KEY, "outcome"), new.select(*KEY, "outcome")
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def table_digest(df: DataFrame) -> DataFrame:
    """Row count and order-free content hash of a table: the sum of 60 bits of the md5 of each row.

    Every value carries its length, so no two rows share a text form; a null is told from any text.
    """

    def part(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    row = F.md5(F.concat(*[part(c) for c in sorted(df.columns)]).cast("binary"))
    bits = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(bits).cast("decimal(38,0)").alias("content_hash"))
