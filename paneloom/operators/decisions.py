"""Dated decisions: year resolution, taxonomy, duplicates, consensus and panel completion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions import tri
from paneloom.functions.dates import year_complete
from paneloom.functions.grid import with_grid
from paneloom.functions.provenance import canonical_references, is_placeholder
from paneloom.functions.sets import derived_key, disagree, json_array, merged_arrays, single_or_null, sorted_set
from paneloom.functions.text import blank_to_null, norm_code, parse_flag
from paneloom.operators.cells import PER_CELL, rollup_cells
from paneloom.operators.ranking import attach

PAIR = ["document_id", "entity_id"]
ENDPOINTS = ("broad", "reporting", "content", "timeliness")
FLAGS = ("has_fine", "has_suspension", "has_warning", "has_remedy")


@dataclass(frozen=True)
class Taxonomy:
    """Codes and level-one values per endpoint; content and timeliness lie inside reporting."""

    reporting_levels: Sequence[str]
    reporting_codes: Sequence[str]
    content_codes: Sequence[str]
    timeliness_codes: Sequence[str]
    broad_levels: Sequence[str]

    def __post_init__(self) -> None:
        if set(self.content_codes) & set(self.timeliness_codes):
            raise ValueError("content and timeliness codes must be disjoint")


def read_decisions(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Typed projection of an event-level decision source; ``problem`` marks unusable rows."""

    def text(name: str) -> Column:
        return blank_to_null(F.col(columns[name]).cast("string")) if name in columns else F.lit(None).cast("string")

    def whole(name: str) -> Column:
        return F.floor(text(name).try_cast("double")).cast("int")

    problem = (
        F.when(text("document_id").isNull(), "DOCUMENT_ID_MISSING")
        .when(text("entity_id").isNull(), "ENTITY_ID_MISSING")
        .when(parse_flag(text("row_included")).isNull() | parse_flag(text("hard_positive")).isNull(), "FLAG_INVALID")
    )
    return df.select(
        text("document_id").alias("document_id"),
        text("entity_id").alias("entity_id"),
        text("decision_number").alias("decision_number"),
        whole("event_year").alias("event_year"),
        *[text(d).try_cast("timestamp_ntz").alias(d) for d in ("decision_date", "publish_date", "known_date")],
        whole("target_period").alias("target_period"),
        text("level_1").alias("level_1"),
        text("code").alias("code"),
        parse_flag(text("row_included")).alias("row_included"),
        parse_flag(text("hard_positive")).alias("hard_positive"),
        text("total_fine").try_cast("double").alias("total_fine"),
        *[parse_flag(text(f)).alias(f) for f in FLAGS],
        F.concat_ws(
            "#", F.coalesce(text("source_file"), F.lit("registered_source")), F.coalesce(text("source_row"), F.lit("unavailable"))
        ).alias("source_ref"),
        problem.alias("problem"),
    )


def event_year() -> Column:
    """Year by precedence: stated, decision date, publish date, target period plus one."""
    return F.coalesce("event_year", F.year("decision_date"), F.year("publish_date"), F.col("target_period") + 1)


def year_rule() -> Column:
    return (
        F.when(F.col("event_year").isNotNull(), "event_year")
        .when(F.col("decision_date").isNotNull(), "decision_date")
        .when(F.col("publish_date").isNotNull(), "publish_date")
        .when(F.col("target_period").isNotNull(), "target_period")
        .otherwise("YEAR_UNRESOLVED")
    )


def included() -> Column:
    return F.col("row_included") & F.col("hard_positive")


def classify_taxonomy(df: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Nested endpoint flags from codes. Unmapped rows are broad only; excluded rows are unknown."""
    level, code = norm_code(F.col("level_1")), norm_code(F.col("code"))

    def hit(value: Column, allowed: Sequence[str]) -> Column:
        return F.coalesce(value.isin(*allowed), F.lit(False)) if allowed else F.lit(False)

    content, timely = hit(code, taxonomy.content_codes), hit(code, taxonomy.timeliness_codes)
    reporting = content | timely | hit(level, taxonomy.reporting_levels) | hit(code, taxonomy.reporting_codes)
    mapped = reporting | hit(level, taxonomy.broad_levels)
    usable = included() & mapped
    return df.select(
        "*",
        F.when(included(), F.lit(True)).alias("broad"),
        F.when(usable, reporting).alias("reporting"),
        F.when(usable, content).alias("content"),
        F.when(usable, timely).alias("timeliness"),
        F.when(~included(), "EXCLUDED_BY_SOURCE_RULE").when(~mapped, "UNMAPPED_TAXONOMY").alias("code_reason"),
    )


def drop_exact_duplicates(df: DataFrame, ref: str = "source_ref") -> DataFrame:
    """Rows equal in everything but their source reference collapse to the smallest reference."""
    signature = [c for c in df.columns if c != ref]
    return df.groupBy(*signature).agg(F.min(ref).alias(ref), F.count(F.lit(1)).alias("copies"))


def split_included(df: DataFrame) -> DataFrame:
    """Included and excluded rows stay in one ledger; excluded ones carry no endpoint evidence."""
    return df.withColumn("inclusion", F.when(included(), "included").otherwise("excluded"))


def year_consensus(df: DataFrame) -> DataFrame:
    """Included rows of a (document, entity) must agree on one year, none missing."""
    year = event_year()
    groups = (
        df.filter(included())
        .groupBy(*PAIR)
        .agg(F.min(year).alias("_low"), F.max(year).alias("_high"), F.count_if(year.isNull()).alias("_missing"))
    )
    agreed = (F.col("_low") == F.col("_high")) & (F.col("_missing") == 0)
    return groups.select(
        *PAIR,
        F.when(agreed, F.col("_low")).alias("resolved_year"),
        F.when(agreed, F.col("_low") - 1).alias("target_period"),
        F.when(~F.coalesce(agreed, F.lit(False)), "YEAR_UNRESOLVED").alias("year_reason"),
    )


def decision_metadata(df: DataFrame, by: Sequence[str] = tuple(PAIR)) -> DataFrame:
    """Decision numbers, codes, single-valued fine, tri-state flags and known-date range per decision.

    One decision has a handful of numbers and codes of the taxonomy, so both are sets in a column.
    """
    known = F.coalesce("known_date", "publish_date", "decision_date")
    flags = [tri.any_true(F.col(f)).alias(f) for f in FLAGS if f in df.columns]
    numbers = [sorted_set(blank_to_null(F.trim("decision_number"))).alias("decision_numbers")] if "decision_number" in df.columns else []
    return df.groupBy(*by).agg(
        *numbers,
        sorted_set(norm_code(F.col("code"))).alias("codes"),
        single_or_null(F.col("total_fine")).alias("total_fine"),
        *flags,
        F.min(known).alias("first_known_date"),
        F.max(known).alias("last_known_date"),
    )


def decision_cells(df: DataFrame, value: Column, by: Sequence[str] = tuple(PAIR), per_cell: int = PER_CELL) -> DataFrame:
    """Sorted distinct ``value`` of each decision in bounded cells; for keys that may hold any share of the rows."""
    return rollup_cells(df.select(*by, value.alias("_value")), list(by), "_value", per_cell)


def resolve_decisions(df: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """One row per included (document, entity): year consensus, endpoint flags and metadata.

    A single aggregation on one key: duplicates go first, then every rollup shares the shuffle.
    """
    rows = classify_taxonomy(drop_exact_duplicates(df).drop("copies").filter(included()), taxonomy)
    year = event_year()
    known = F.coalesce("known_date", "publish_date", "decision_date")
    grouped = rows.groupBy(*PAIR).agg(
        F.min(year).alias("_low"),
        F.max(year).alias("_high"),
        F.count_if(year.isNull()).alias("_missing"),
        *[tri.any_true(F.col(e)).alias(e) for e in ENDPOINTS],
        F.bool_or(F.coalesce(F.col("code_reason") == "UNMAPPED_TAXONOMY", F.lit(False))).alias("unmapped"),
        sorted_set(norm_code(F.col("code"))).alias("codes"),
        single_or_null(F.col("total_fine")).alias("total_fine"),
        *[tri.any_true(F.col(f)).alias(f) for f in FLAGS if f in df.columns],
        F.min(known).alias("first_known_date"),
        F.max(known).alias("last_known_date"),
    )
    agreed = F.coalesce((F.col("_low") == F.col("_high")) & (F.col("_missing") == 0), F.lit(False))
    return grouped.select(
        *PAIR,
        F.when(agreed, F.col("_low")).alias("resolved_year"),
        F.when(agreed, F.col("_low") - 1).alias("period"),
        *[c for c in grouped.columns if c not in PAIR and not c.startswith("_")],
    )


def _endpoint_rows(resolved: DataFrame) -> DataFrame:
    """Positive and unknown decisions per endpoint."""
    cells = F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col(e).alias("hit")) for e in ENDPOINTS])
    long = resolved.filter("period IS NOT NULL").select("*", F.explode(cells).alias("_c")).select("*", "_c.*").drop("_c")
    return long.filter("hit IS NULL OR hit")


def endpoint_cells(resolved: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Sorted distinct ``value`` of the decisions that an endpoint's rollup is made of, in bounded cells.

    ``values`` has the value per (document, entity). Positive decisions count where there are any, else
    the unknown ones; ``cell`` is part of the key.
    """
    rows = _endpoint_rows(resolved).select(*PAIR, "period", "endpoint", "hit")
    states = rows.groupBy("entity_id", "period", "endpoint").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("_positive"))
    chosen = rows.join(states, ["entity_id", "period", "endpoint"]).filter(F.coalesce("hit", F.lit(False)) == F.col("_positive"))
    return rollup_cells(chosen.join(values.select(*PAIR, value), PAIR), ["entity_id", "period", "endpoint", "hit"], value)


def endpoint_metadata(resolved: DataFrame) -> DataFrame:
    """Rollup per (entity, period, endpoint) of the positive decisions, or else of the unknown ones."""
    flags = [f for f in FLAGS if f in resolved.columns]
    per_state = (
        _endpoint_rows(resolved)
        .groupBy("entity_id", "period", "endpoint", "hit")
        .agg(
            F.count(F.lit(1)).alias("decision_count"),
            F.sum("total_fine").alias("total_fine"),
            merged_arrays(F.col("codes")).alias("codes"),
            *[tri.any_true(F.col(f)).alias(f) for f in flags],
            F.min("first_known_date").alias("first_known_date"),
            F.max("last_known_date").alias("last_known_date"),
        )
    )
    payload = [c for c in per_state.columns if c not in ("entity_id", "period", "endpoint")]
    chosen = F.max_by(F.struct(*payload), F.coalesce("hit", F.lit(False)).cast("int"))
    return per_state.groupBy("entity_id", "period", "endpoint").agg(chosen.alias("_m")).select(
        "entity_id", "period", "endpoint", "_m.*"
    )


def endpoint_results(
    panel: DataFrame, resolved: DataFrame, through: int, incomplete: tuple[int, ...] = ()
) -> DataFrame:
    """Every panel row and endpoint: positive, unknown with its reason, or a zero in a complete year."""
    grid = with_grid(panel.select("entity_id", "period"), [{"endpoint": e} for e in ENDPOINTS], {"endpoint": "string"})
    cells = F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col(e).alias("hit")) for e in ENDPOINTS])
    states = (
        resolved.filter("period IS NOT NULL")
        .select("entity_id", "period", "unmapped", F.explode(cells).alias("_c"))
        .groupBy("entity_id", "period", "_c.endpoint")
        .agg(
            F.bool_or("_c.hit").alias("_positive"),
            (F.count_if(F.col("_c.hit").isNull()) > 0).alias("_unknown"),
            F.bool_or("unmapped").alias("_unmapped"),
        )
    )
    unresolved = resolved.filter("period IS NULL").select("entity_id").distinct().withColumn("_unresolved", F.lit(True))
    rows = grid.join(states, ["entity_id", "period", "endpoint"], "left")
    rows = attach(rows, unresolved, ["entity_id"])
    complete = year_complete(F.col("period") + 1, through, incomplete)
    state = (
        F.when(F.col("_positive"), "POSITIVE")
        .when(F.col("_unresolved"), "YEAR_UNRESOLVED")
        .when(~complete, "SOURCE_YEAR_INCOMPLETE")
        .when(F.col("_unknown"), "UNMAPPED_TAXONOMY")
        .otherwise("COMPLETE_YEAR_ZERO")
    )
    return rows.withColumn("_state", state).select(
        "entity_id",
        "period",
        "endpoint",
        F.when(F.col("_state") == "POSITIVE", F.lit(True)).when(F.col("_state") == "COMPLETE_YEAR_ZERO", F.lit(False)).alias("outcome"),
        F.when(complete, F.lit(True)).alias("opportunity"),
        F.when(~F.col("_state").isin("POSITIVE", "COMPLETE_YEAR_ZERO"), F.col("_state")).alias("reason"),
        F.when(F.col("_unmapped"), "UNMAPPED_TAXONOMY").alias("code_reason"),
        (F.col("period") + 1).alias("required_year"),
    )


def decision_ledger(df: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Ledger rows: one per included (document, entity) and one per excluded source row."""
    rows = classify_taxonomy(drop_exact_duplicates(df).drop("copies"), taxonomy)
    order = F.struct(F.coalesce(event_year(), F.lit(0)), F.coalesce("code", F.lit("")), F.coalesce("level_1", F.lit("")), "source_ref")
    unmapped = F.bool_or(F.coalesce(F.col("code_reason") == "UNMAPPED_TAXONOMY", F.lit(False)))
    kept = (
        rows.filter(included())
        .groupBy(*PAIR)
        .agg(
            F.min_by(F.struct("level_1", "code"), order).alias("_f"),
            F.bool_or("hard_positive").alias("hard_positive"),
            F.bool_or("row_included").alias("row_included"),
            sorted_set(norm_code(F.col("code"))).alias("codes"),
            F.min("source_ref").alias("first_ref"),
            F.count(F.lit(1)).alias("source_rows"),
            unmapped.alias("_unmapped"),
        )
        .join(year_consensus(df), PAIR, "left")
        .select(
            *PAIR, "target_period", "_f.level_1", "_f.code", "hard_positive", "row_included", "codes", "first_ref", "source_rows",
            F.coalesce("year_reason", F.when(F.col("_unmapped"), "UNMAPPED_TAXONOMY")).alias("code_reason"),
        )
    )
    code = norm_code(F.col("code"))
    dropped = rows.filter(~included()).select(
        *PAIR, F.lit(None).cast("int").alias("target_period"), "level_1", "code", "hard_positive", "row_included",
        F.array_compact(F.array(code)).alias("codes"), F.col("source_ref").alias("first_ref"),
        F.lit(1).cast("long").alias("source_rows"), F.lit("EXCLUDED_BY_SOURCE_RULE").alias("code_reason"),
    )
    return kept.unionByName(dropped)


def collapse_grain(ledger: DataFrame) -> DataFrame:
    """One row per (document, entity): the included row wins; excluded rows merge and lose their year."""
    wins = F.coalesce(included(), F.lit(False))
    rest = [c for c in ledger.columns if c not in PAIR]
    order = F.struct((~wins).cast("int"), "first_ref")
    grouped = ledger.groupBy(*PAIR).agg(
        F.min_by(F.struct(*rest), order).alias("_first"),
        F.bool_or(wins).alias("_any"),
        merged_arrays(F.col("codes")).alias("_codes"),
        (F.count(F.lit(1)) - 1).alias("collapsed_rows"),
    )
    merge = ~F.col("_any") & (F.col("collapsed_rows") > 0)
    special = {
        "target_period": F.when(~merge, F.col("_first.target_period")),
        "hard_positive": F.when(merge, F.lit(False)).otherwise(F.col("_first.hard_positive")),
        "row_included": F.when(merge, F.lit(False)).otherwise(F.col("_first.row_included")),
        "code_reason": F.when(merge, F.lit("EXCLUDED_BY_SOURCE_RULE")).otherwise(F.col("_first.code_reason")),
        "codes": F.when(merge, F.col("_codes")).otherwise(F.col("_first.codes")),
    }
    return grouped.select(
        *PAIR, *[special.get(c, F.col(f"_first.{c}")).alias(c) for c in rest], "collapsed_rows"
    )


def merge_json_arrays(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Sorted distinct union of JSON string arrays, with the count of cells that are no such array.

    A key with a very long union continues in further cells, so no group is gathered whole.
    """
    parsed = json_array(F.col(column))
    broken = F.col(column).isNotNull() & (F.col(column) != "") & parsed.isNull()
    checked = df.groupBy(*keys).agg(F.count_if(broken).alias("invalid_cells"))
    merged = rollup_cells(df.select(*keys, F.explode(parsed).alias("_value")), keys, "_value")
    return attach(checked, merged, keys).select(
        *keys,
        F.coalesce("cell", F.lit(0)).alias("cell"),
        F.to_json(F.coalesce("values", F.array().cast("array<string>"))).alias(column),
        "invalid_cells",
    )


def repair_document_ids(df: DataFrame) -> DataFrame:
    """Placeholder document ids become a key derived from the references; none left is a problem."""
    broken = is_placeholder(F.col("document_id"))
    rows = df.withColumn("_refs", canonical_references("refs"))
    return rows.select(
        *[c for c in df.columns if c != "document_id"],
        F.when(broken, derived_key(F.col("_refs"))).otherwise(F.col("document_id")).alias("document_id"),
        F.when(broken & F.col("_refs").isNull(), "PLACEHOLDER_WITHOUT_REFERENCES").alias("problem"),
    )


def rollup_conflict_checked(ledger: DataFrame, scalars: Sequence[str]) -> DataFrame:
    """(document, entity) rollup: scalars must agree, differing periods become unknown, arrays merge."""
    grouped = ledger.groupBy(*PAIR).agg(
        *[F.max(blank_to_null(F.col(c))).alias(c) for c in scalars],
        *[disagree(blank_to_null(F.col(c))).alias(f"_x_{c}") for c in scalars],
        single_or_null(F.col("target_period")).alias("target_period"),
        disagree(F.col("target_period")).alias("_ambiguous"),
        merged_arrays(F.col("codes")).alias("codes"),
        tri.any_true(F.coalesce("hard_positive", F.lit(False))).alias("hard_positive"),
        tri.any_true(F.coalesce("row_included", F.lit(False))).alias("row_included"),
        F.max("code_reason").alias("_reason"),
        disagree(F.col("code_reason")).alias("_x_reason"),
    )
    clashes = [F.when(F.col(f"_x_{c}"), F.lit(c)) for c in scalars]
    clashes.append(F.when(F.col("_x_reason") & ~F.col("_ambiguous"), F.lit("code_reason")))
    return grouped.select(
        *PAIR,
        *scalars,
        "target_period",
        "codes",
        "hard_positive",
        "row_included",
        F.when(F.col("_ambiguous"), "AMBIGUOUS_TARGET_PERIOD").otherwise(F.col("_reason")).alias("code_reason"),
        F.array_compact(F.array(*clashes)).alias("conflicts"),
    )
