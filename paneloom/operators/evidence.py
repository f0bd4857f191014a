"""Evidence records: matched pairs, categorical opinions, endpoints, delayed events and the ledger."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.functions import tri
from paneloom.functions.dates import anchor, calendar_days
from paneloom.functions.grid import lookup, registry, with_grid
from paneloom.functions.provenance import mine_provenance
from paneloom.functions.sets import derived_key
from paneloom.functions.text import blank_to_null, norm_text, parse_flag, token
from paneloom.operators.ranking import attach

KEY = ["entity_id", "period"]
ANNUAL, NEXT, DELAYED = "annual_at_anchor", "next_period", "delayed_verification"

# ------------------------------------------------------------- matched pairs


def expand_pre_post(df: DataFrame, bindings: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Wide pre and post columns to rows (item, status, value): two per entity-period and item."""
    rows = F.array(
        *[
            F.struct(F.lit(item).alias("item"), F.lit(status).alias("status"), F.col(column).cast("double").alias("value"))
            for item, pair in bindings.items()
            for status, column in zip(("pre", "post"), pair, strict=True)
        ]
    )
    return df.select(*KEY, F.explode(rows).alias("_r")).select(*KEY, "_r.*")


def matched_pairs(
    panel: DataFrame, rows: DataFrame, endpoints: Sequence[Mapping[str, Any]], floor: float | None
) -> DataFrame:
    """One result per panel row and endpoint: is the post value materially different from the pre value?

    ``endpoints`` rows give item, unit, scope, family and threshold (null = not locked). The first
    failing condition names the reason, and the outcome stays unknown then.
    """
    side = {s: F.col("status") == s for s in ("pre", "post")}
    signature = F.struct("value", "unit", "scope", "family")
    aggregates = []
    for name, match in side.items():
        aggregates += [
            F.count_if(match).alias(f"{name}_count"),
            F.min(F.when(match, signature)).alias(f"_{name}"),
            F.max(F.when(match, signature)).alias(f"_{name}_last"),
        ]
    items = [e["item"] for e in endpoints]
    pairs = rows.filter(F.col("item").isin(*items)).groupBy(*KEY, "item").agg(*aggregates)
    grid = with_grid(
        panel.select(*KEY, "anchor"),
        [{**e, "expected_unit": e["unit"], "expected_scope": e["scope"], "expected_family": e["family"]} for e in endpoints],
        {"item": "string", "expected_unit": "string", "expected_scope": "string", "expected_family": "string",
         "threshold": "double"},
    )
    joined = grid.join(pairs, [*KEY, "item"], "left")
    pre_n, post_n = F.coalesce("pre_count", F.lit(0)), F.coalesce("post_count", F.lit(0))
    pre, post = F.col("_pre.value"), F.col("_post.value")

    def unlike(part: str, expected: str) -> Column:
        return ~(
            F.col(f"_pre.{part}").eqNullSafe(F.col(expected)) & F.col(f"_post.{part}").eqNullSafe(F.col(expected))
        )

    conflict = ~F.col("_pre").eqNullSafe(F.col("_pre_last")) | ~F.col("_post").eqNullSafe(F.col("_post_last"))
    ratio = F.try_divide(F.abs(pre - post), F.abs(post))
    locked = F.col("threshold").isNotNull() & F.lit(floor is not None)
    floor_value = F.lit(floor).cast("double")
    reason = (
        F.when((pre_n == 0) & (post_n == 0), "PAIR_MISSING_BOTH")
        .when(pre_n == 0, "PAIR_MISSING_PRE")
        .when(post_n == 0, "PAIR_MISSING_POST")
        .when(((pre_n > 1) | (post_n > 1)) & conflict, "DUPLICATE_CONFLICT")
        .when((pre_n > 1) | (post_n > 1), "DUPLICATE_STATUS_RECORD")
        .when(pre.isNull() | post.isNull(), "PAIR_VALUE_MISSING")
        .when(unlike("unit", "expected_unit"), "INCONSISTENT_UNIT")
        .when(unlike("scope", "expected_scope"), "SCOPE_MISMATCH")
        .when(unlike("family", "expected_family"), "FAMILY_MISMATCH")
        .when(post == 0, "INVALID_DENOMINATOR_ZERO")
        .when(F.abs(post) <= floor_value, "INVALID_DENOMINATOR_BELOW_FLOOR")
        .when(~locked, "EMPIRICAL_RULE_NOT_LOCKED")
        .when(ratio > F.col("threshold"), "MATERIAL_ADJUSTMENT")
        .otherwise("BELOW_MATERIALITY_THRESHOLD")
    )
    judged = ("MATERIAL_ADJUSTMENT", "BELOW_MATERIALITY_THRESHOLD")
    rated = (*judged, "EMPIRICAL_RULE_NOT_LOCKED", "INVALID_DENOMINATOR_BELOW_FLOOR")
    return joined.withColumn("reason", reason).select(
        *KEY,
        "anchor",
        "item",
        F.when(F.col("reason").isin(*judged), F.col("reason") == judged[0]).alias("outcome"),
        F.col("reason").isin(*judged, "EMPIRICAL_RULE_NOT_LOCKED").alias("opportunity"),
        F.when(F.col("reason").isin(*rated), ratio).alias("ratio"),
        "reason",
        pre_n.alias("pre_count"),
        post_n.alias("post_count"),
    )


def pair_failures(results: DataFrame) -> DataFrame:
    return results.filter("outcome IS NULL").select(*KEY, "item", "reason", "opportunity", "pre_count", "post_count")


def outcome_audit(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Result, opportunity, positive, observed-zero and unknown counts."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("result_count"),
        F.count_if("opportunity").alias("opportunity_count"),
        F.count_if("outcome").alias("positive_count"),
        F.count_if(F.col("outcome") == F.lit(False)).alias("observed_zero_count"),
        F.count_if(F.col("outcome").isNull()).alias("unknown_count"),
    )


# ------------------------------------------------------------- categorical opinions


def indicator_observed(text: Column, registered: str) -> Column:
    """Boolean text or the registered token; blank is false, anything else is null (a violation)."""
    flag = parse_flag(text)
    return (
        F.when(flag.isNotNull(), flag)
        .when(blank_to_null(text).isNull(), F.lit(False))
        .when(token(text) == token(F.lit(registered)), F.lit(True))
    )


def opinion_results(
    panel: DataFrame,
    rows: DataFrame,
    taxonomy: Mapping[str, str],
    *,
    positive: Sequence[str],
    negative: Sequence[str],
    pending: Sequence[str] = (),
    indicator: str,
    expected: Mapping[str, str],
) -> DataFrame:
    """One categorical result per panel row. ``expected`` fixes period_type, scope and status."""
    normal = {" ".join(k.strip().casefold().split()): v for k, v in taxonomy.items()}
    written = blank_to_null(F.col("opinion_raw"))
    category = lookup(normal, norm_text(written))
    mismatch = F.lit(False)
    for column, value in expected.items():
        mismatch = mismatch | ~F.col(column).eqNullSafe(F.lit(value))
    grouped = (
        rows.filter(F.col("indicator") == indicator)
        .select(*KEY, written.alias("_written"), category.alias("_category"), mismatch.alias("_mismatch"))
        .groupBy(*KEY)
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            F.bool_or("_mismatch").alias("_mismatch"),
            F.count_if(F.col("_written").isNotNull() & F.col("_category").isNull()).alias("_unmapped"),
            F.count("_category").alias("_mapped"),
            F.min("_category").alias("_first"),
            F.max("_category").alias("_last"),
        )
    )
    count = F.coalesce("record_count", F.lit(0))
    reason = (
        F.when(count == 0, "OPINION_RECORD_MISSING")
        .when(F.col("_mismatch"), "PERIOD_OR_SCOPE_MISMATCH")
        .when(F.col("_unmapped") > 0, "OPINION_UNMAPPED")
        .when(F.col("_mapped") == 0, "OPINION_MISSING")
        .when((F.col("_first") != F.col("_last")) | ((count > 1) & (F.col("_mapped") < count)), "CONFLICTING_OPINIONS")
        .when(F.col("_first").isin(*positive), "NON_CLEAN_OPINION")
        .when(F.col("_first").isin(*negative), "CLEAN_OPINION")
    )
    if pending:
        reason = reason.when(F.col("_first").isin(*pending), "CATEGORY_PENDING")
    reason = reason.otherwise("CATEGORY_UNMAPPED")
    known = ("NON_CLEAN_OPINION", "CLEAN_OPINION")
    return (
        panel.select(*KEY, "anchor")
        .join(grouped, KEY, "left")
        .withColumn("reason", reason)
        .select(
            *KEY,
            "anchor",
            F.when(F.col("reason").isin(*known), F.col("reason") == known[0]).alias("outcome"),
            F.col("reason").isin(*known, "CATEGORY_PENDING").alias("opportunity"),
            F.when(F.col("reason").isin(*known, "CATEGORY_PENDING", "CATEGORY_UNMAPPED"), F.col("_first")).alias("category"),
            "reason",
            count.alias("record_count"),
        )
    )


# ------------------------------------------------------------- wide endpoints


def endpoint_outcomes(panel: DataFrame, wide: DataFrame, endpoints: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Endpoint result per panel row under its opportunity and provenance.

    Each endpoint names the columns outcome, source_opportunity, observation_opportunity and
    provenance. ``violation`` marks rows that break the contract.
    """
    names = ("outcome", "source_opportunity", "observation_opportunity", "provenance")
    cells = F.array(
        *[
            F.struct(F.lit(e).alias("endpoint"), *[F.col(columns[n]).alias(f"_{n}") for n in names])
            for e, columns in endpoints.items()
        ]
    )
    found = wide.select(*KEY, F.lit(True).alias("_present"), F.explode(cells).alias("_c")).select(*KEY, "_present", "_c.*")
    grid = with_grid(panel.select(*KEY, "anchor"), [{"endpoint": e} for e in endpoints], {"endpoint": "string"})
    rows = grid.join(found, [*KEY, "endpoint"], "left")
    opportunity = tri.effective_opportunity(F.col("_source_opportunity"), F.col("_observation_opportunity"))
    text = blank_to_null(F.col("_provenance"))
    provenance = F.when(~F.regexp_replace(text, r"\s", "").isin("{}", "[]"), text)
    rows = rows.withColumn("opportunity", opportunity).withColumn("provenance", provenance)
    open_ = F.coalesce("opportunity", F.lit(False))
    violation = (
        F.when(F.col("_present").isNull(), "PANEL_ROW_MISSING")
        .when(open_ & F.col("_outcome") & F.col("provenance").isNull(), "POSITIVE_WITHOUT_PROVENANCE")
        .when(open_ & F.col("_outcome").isNull() & F.col("provenance").isNull(), "UNDETERMINED_WITHOUT_PROVENANCE")
        .when(~open_ & F.col("_outcome"), "POSITIVE_WITHOUT_OPPORTUNITY")
    )
    reason = (
        F.when(~open_, "OPPORTUNITY_UNKNOWN")
        .when(F.col("_outcome"), "ENDPOINT_POSITIVE")
        .when(F.col("_outcome").isNull(), "UNDETERMINED_WITH_PROVENANCE")
        .otherwise("COMPLETE_SOURCE_ENDPOINT_ZERO")
    )
    return rows.select(
        *KEY,
        "anchor",
        "endpoint",
        F.when(open_, F.col("_outcome")).alias("outcome"),
        "opportunity",
        reason.alias("reason"),
        "provenance",
        violation.alias("violation"),
    )


def endpoint_decisions(results: DataFrame) -> DataFrame:
    """Positive endpoints exploded to (document, entity, period) with endpoints and codes.

    Records without a document id get a key derived from their canonical provenance. Malformed
    provenance gives rows without a document, with the problem named.
    """
    mined = results.filter("outcome").withColumn("_m", mine_provenance("provenance"))
    ids = F.when(F.size("_m.document_ids") > 0, F.col("_m.document_ids")).otherwise(
        F.array(derived_key(F.col("_m.canonical")))
    )
    rows = mined.select(
        *KEY, "endpoint", F.col("_m.codes").alias("codes"), F.col("_m.canonical").alias("ref"), F.col("_m.problem").alias("problem"),
        F.explode(ids).alias("document_id"),
    )
    return rows.groupBy("document_id", *KEY).agg(
        F.to_json(F.array_sort(F.collect_set("endpoint"))).alias("endpoints"),
        F.to_json(F.array_sort(F.array_distinct(F.flatten(F.collect_set("codes"))))).alias("codes"),
        F.count_distinct("ref").alias("reference_count"),
        F.max("problem").alias("problem"),
    )


# ------------------------------------------------------------- the measurement process


def map_outcome(mode: str, direct: Column, indicator: Column, included: Column) -> Column:
    """Outcome of a source row: a false indicator is unknown, never a negative."""
    if mode == "direct":
        return F.when(included, direct)
    if mode == "positive_indicator":
        return F.when(included & indicator, F.lit(True))
    raise ValueError(f"unknown outcome mode: {mode}")


def implied_opportunity() -> Column:
    """An observed label proves that its opportunity existed."""
    return F.when(F.col("outcome").isNotNull() & F.col("opportunity").isNull(), F.lit(True)).otherwise(F.col("opportunity"))


def layer_mask() -> Column:
    layers = (
        ("O", implied_opportunity()),
        ("V", F.col("verification")),
        ("D", F.col("determination")),
        ("R", F.col("recording")),
        ("S", F.col("outcome")),
    )
    return F.concat(*[F.when(value.isNotNull(), name).otherwise("-") for name, value in layers])


def reason_unknown() -> Column:
    """Default reason for a missing label; null when the label is observed."""
    opportunity = implied_opportunity()
    return F.when(
        F.col("outcome").isNull(),
        F.when(opportunity.isNull(), "OBSERVATION_OPPORTUNITY_UNKNOWN")
        .when(~opportunity, "NO_OBSERVATION_OPPORTUNITY")
        .when(F.col("recording") == F.lit(False), "DETERMINATION_NOT_RECORDED")
        .otherwise("SOURCE_LABEL_UNKNOWN"),
    )


def process_violations(df: DataFrame) -> DataFrame:
    """Rows that break the opportunity-verification-determination-recording-label process, first rule only."""
    v, d, r, s = (F.col(c) for c in ("verification", "determination", "recording", "outcome"))
    rule = (
        F.when((F.col("opportunity") == F.lit(False)) & s.isNotNull(), "LABEL_WITHOUT_OPPORTUNITY")
        .when(F.col("reason").isNotNull() & s.isNotNull(), "REASON_WITH_LABEL")
        .when(F.col("mask").isNotNull() & (F.col("mask") != layer_mask()), "MASK_CONFLICT")
        .when(d.isNotNull() & ~F.coalesce(v, F.lit(False)), "DETERMINATION_WITHOUT_VERIFICATION")
        .when(F.coalesce(r, F.lit(False)) & d.isNull(), "RECORDING_WITHOUT_DETERMINATION")
        .when(F.col("verification_date").isNotNull() & v.isNull(), "VERIFICATION_DATE_WITHOUT_STATUS")
        .when(F.col("determination_date").isNotNull() & d.isNull(), "DETERMINATION_DATE_WITHOUT_STATUS")
        .when(F.col("recording_date").isNotNull() & r.isNull(), "RECORDING_DATE_WITHOUT_STATUS")
        .when(v.isNotNull() & d.isNotNull() & r.isNotNull() & s.isNotNull() & (s != (v & d & r)), "LABEL_CONFLICTS_WITH_PROCESS")
    )
    return df.withColumn("violation", rule).filter("violation IS NOT NULL")


def link_records(records: DataFrame, panel: DataFrame) -> DataFrame:
    """Link status of each record to the panel."""
    joined = records.join(panel.select(*KEY, "anchor"), KEY, "left")
    status = (
        F.when(~F.coalesce("row_included", F.lit(True)), "EXCLUDED_BY_SOURCE_RULE")
        .when(F.col("anchor").isNull(), "UNLINKED_ENTITY_PERIOD")
        .when((F.col("role") == ANNUAL) & ~F.col("availability").eqNullSafe(F.col("anchor")), "ANNUAL_ANCHOR_MISMATCH")
        .when(F.col("role") == ANNUAL, "ACCEPTED_ANNUAL_MEASUREMENT")
        .when(F.col("role") == NEXT, "ACCEPTED_NEXT_PERIOD_RESULT")
        .when((F.col("role") == DELAYED) & F.col("availability").isNull(), "AVAILABILITY_MISSING")
        .when(F.col("role") == DELAYED, "ACCEPTED")
        .otherwise("UNSUPPORTED_ROLE")
    )
    return joined.withColumn("status", status)


def duplicate_results(records: DataFrame) -> DataFrame:
    return records.groupBy("source_id", "record_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


SIGNATURE = (
    "channel_id", "availability", "outcome", "outcome_basis", "link_source", "link_confidence", "role",
    "availability_basis", "opportunity", "verification", "determination", "recording",
)


def dedupe_event_clusters(events: DataFrame) -> DataFrame:
    """Status per event of a cluster: one accepted representative, duplicates, or a conflict.

    Copies agree when the smallest and largest signature are the same; the representative is the
    smallest (source, event). Both are plain minima, so a hot cluster folds before the shuffle.
    """
    keys = [*KEY, "cluster_id"]
    signature = F.struct(
        *[(implied_opportunity() if c == "opportunity" else F.col(c)).alias(c) for c in SIGNATURE if c in events.columns]
    )
    clusters = events.groupBy(*keys).agg(
        F.min(F.struct("source_id", "event_id")).alias("_rep"),
        F.min(signature).alias("_low"),
        F.max(signature).alias("_high"),
    )
    status = (
        F.when(~F.col("_low").eqNullSafe(F.col("_high")), "CONFLICTING_UPSTREAM_CLUSTER")
        .when((F.col("source_id") == F.col("_rep.source_id")) & (F.col("event_id") == F.col("_rep.event_id")), "ACCEPTED")
        .otherwise("DUPLICATE_UPSTREAM_EVENT")
    )
    return attach(events, clusters, keys).withColumn("status", status).drop("_rep", "_low", "_high")


def lag_decomposition(accepted: DataFrame, panel: DataFrame, month_day: str = "12-31", tolerance: int = 0) -> DataFrame:
    """Calendar-day lags: period end to anchor, anchor to event, and their total with the identity error."""
    month, day = (int(x) for x in month_day.split("-"))
    joined = accepted.join(panel.select(*KEY, "anchor"), KEY)
    end = anchor(F.col("period"), month, day)
    report, detect = calendar_days(F.col("anchor"), end), calendar_days(F.col("availability"), F.col("anchor"))
    total = calendar_days(F.col("availability"), end)
    return joined.select(
        "event_id",
        "cluster_id",
        "source_id",
        report.alias("report_lag_days"),
        detect.alias("detection_lag_days"),
        total.alias("total_lag_days"),
        (total - report - detect).alias("identity_error_days"),
        (F.abs(total - report - detect) <= tolerance).alias("identity_holds"),
    )


def ledger_summary(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("record_count"))


# The ledger layout, in order.
LEDGER = {
    "entity_id": "string", "period": "smallint", "source_id": "string", "profile_id": "string",
    "channel_id": "string", "record_id": "string", "record_kind": "string", "event_id": "string",
    "cluster_id": "string", "role": "string", "availability_basis": "string", "source_opportunity": "boolean",
    "opportunity": "boolean", "opportunity_basis": "string", "verification": "boolean",
    "determination": "boolean", "recording": "boolean", "label": "boolean", "verification_date": "timestamp_ntz",
    "determination_date": "timestamp_ntz", "recording_date": "timestamp_ntz", "mask": "string",
    "reason_unknown": "string", "value": "double", "category": "string", "refs": "string",
    "event_year": "smallint", "target_period": "smallint", "decision_count": "bigint",
    "document_ids": "array<string>", "decision_numbers": "array<string>", "total_fine": "double",
    "has_fine": "boolean", "has_suspension": "boolean", "has_warning": "boolean", "has_remedy": "boolean",
    "first_known_date": "timestamp_ntz", "last_known_date": "timestamp_ntz", "codes": "array<string>",
    "code_reason": "string", "link_source": "string", "link_confidence": "string", "outcome_basis": "string",
    "availability": "timestamp_ntz", "outcome": "boolean",
}


def build_ledger(*parts: DataFrame) -> DataFrame:
    """Union of evidence parts in the ledger layout; derived layers are filled the same way for all."""
    whole = None
    for part in parts:
        for column, dtype in (("opportunity", "boolean"), ("outcome", "boolean"), ("verification", "boolean"),
                              ("determination", "boolean"), ("recording", "boolean"), ("reason", "string")):
            if column not in part.columns:
                part = part.withColumn(column, F.lit(None).cast(dtype))
        filled = part.withColumn("mask", layer_mask()).withColumn(
            "reason_unknown", F.when(F.col("outcome").isNull(), F.coalesce("reason", reason_unknown()))
        )
        filled = filled.withColumn("opportunity", implied_opportunity())
        filled = filled.withColumn("source_opportunity", F.col("opportunity")).withColumn("label", F.col("outcome"))
        shaped = filled.select(
            *[
                (F.col(c) if c in filled.columns else F.lit(None)).cast(t).alias(c)
                for c, t in LEDGER.items()
            ]
        )
        whole = shaped if whole is None else whole.unionByName(shaped)
    return whole


def migrate_ledger(old: DataFrame) -> DataFrame:
    """Older ledger (no process layers) to the current one, with the first conflict of each row.

    A positive public endpoint proves verification, determination and recording. Nothing else is
    promoted and no date is invented.
    """
    have = set(old.columns)

    def tri_column(name: str) -> Column:
        return F.col(name).cast("boolean") if name in have else F.lit(None).cast("boolean")

    public = F.coalesce((F.col("record_kind") == "endpoint_result") & F.col("outcome"), F.lit(False))
    stated = {c: tri_column(c) for c in ("verification", "determination", "recording")}
    clash = F.lit(False)
    for value in stated.values():
        clash = clash | (public & F.coalesce(~value, F.lit(False)))
    given_label = tri_column("label") if "label" in have else F.col("outcome")
    given_reason = F.col("reason_unknown") if "reason_unknown" in have else F.lit(None).cast("string")
    rows = old.select(
        *[c for c in old.columns if c not in (*stated, "label", "reason_unknown", "mask")],
        *[F.when(public, F.lit(True)).otherwise(value).alias(c) for c, value in stated.items()],
        F.col("outcome").alias("label"),
        given_reason.alias("_reason"),
        (F.col("mask") if "mask" in have else F.lit(None).cast("string")).alias("_mask"),
        clash.alias("_clash"),
        tri.differs(given_label, F.col("outcome")).alias("_alias"),
    )
    opportunity = F.col("opportunity")
    default = (
        F.when(opportunity.isNull(), "OBSERVATION_OPPORTUNITY_UNKNOWN")
        .when(~opportunity, "NO_OBSERVATION_OPPORTUNITY")
        .when(F.col("recording") == F.lit(False), "DETERMINATION_NOT_RECORDED")
        .otherwise("SOURCE_LABEL_UNKNOWN")
    )
    layers = (("O", "opportunity"), ("V", "verification"), ("D", "determination"), ("R", "recording"), ("S", "label"))
    mask = F.concat(*[F.when(F.col(c).isNotNull(), n).otherwise("-") for n, c in layers])
    return rows.select(
        *[c for c in rows.columns if not c.startswith("_")],
        mask.alias("mask"),
        F.when(F.col("label").isNull(), F.coalesce("_reason", default)).alias("reason_unknown"),
        F.when(F.col("_alias"), "LABEL_ALIAS_CONFLICT")
        .when(F.col("_clash"), "PROCESS_CONFLICT")
        .when(F.col("_mask") != mask, "MASK_CONFLICT")
        .when(F.col("label").isNotNull() & F.col("_reason").isNotNull(), "REASON_WITH_LABEL")
        .alias("conflict"),
    )


def logical_sources(spark: SparkSession, sources: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Physical source registry expanded to one row per logical endpoint."""
    rows = [
        {**{k: v for k, v in source.items() if k != "endpoints"}, "source_id": logical, "endpoint": endpoint}
        for source in sources
        if source.get("enabled", True)
        for logical, endpoint in source["endpoints"].items()
    ]
    names = [r["source_id"] for r in rows]
    if len(names) != len(set(names)):
        raise ValueError("logical source ids must be unique")
    return registry(
        spark,
        rows,
        {"physical_id": "string", "source_id": "string", "endpoint": "string", "channel_id": "string", "role": "string",
         "zero_allowed": "boolean"},
    )
