"""Entity resolution and the as-of panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.dates import anchor, parse_timestamp, year_of
from paneloom.functions.grid import lookup
from paneloom.functions.text import blank_to_null, normalize_entity

KEY = ["entity_id", "period"]


def resolve_entities(df: DataFrame, aliases: DataFrame, allow_identity: bool = True) -> DataFrame:
    """Canonical entity per row: raw alias, then normalised alias, then the id itself.

    Only the distinct raw ids are normalised and joined with the alias table; the rows then
    pick up their mapping.
    """
    ids = df.select("source_id", "raw_entity").distinct()
    normal = ids.withColumn("normalized_id", normalize_entity(F.col("raw_entity")))
    table = aliases.select(
        F.col("source_id").alias("_s"), F.col("alias").alias("_a"), normalize_entity(F.col("target")).alias("_t")
    )
    raw, tidy = table.alias("raw"), table.alias("tidy")
    mapped = (
        normal.join(raw, (F.col("source_id") == F.col("raw._s")) & (F.col("raw_entity") == F.col("raw._a")), "left")
        .join(tidy, (F.col("source_id") == F.col("tidy._s")) & (F.col("normalized_id") == F.col("tidy._a")), "left")
        .select(
            F.col("source_id").alias("_source"),
            F.col("raw_entity").alias("_raw"),
            "normalized_id",
            F.coalesce(
                F.col("raw._t"), F.col("tidy._t"), F.col("normalized_id") if allow_identity else F.lit(None)
            ).alias("entity_id"),
            F.when(F.col("raw._t").isNotNull(), "registered_raw_alias")
            .when(F.col("tidy._t").isNotNull(), "registered_normalized_alias")
            .when(F.col("normalized_id").isNotNull() & F.lit(allow_identity), "normalized_identity")
            .otherwise("unmapped")
            .alias("method"),
        )
    )
    return df.join(
        mapped, F.col("source_id").eqNullSafe(F.col("_source")) & F.col("raw_entity").eqNullSafe(F.col("_raw")), "left"
    ).drop("_source", "_raw")


def entity_collisions(resolved: DataFrame, aliases: DataFrame) -> DataFrame:
    """Canonical ids fed by several normalised ids of which one is not a registered alias."""
    origins = resolved.filter("entity_id IS NOT NULL").select("source_id", "normalized_id", "entity_id").distinct()
    registered = aliases.select(
        F.col("source_id"),
        normalize_entity(F.col("alias")).alias("normalized_id"),
        normalize_entity(F.col("target")).alias("entity_id"),
        F.lit(True).alias("registered"),
    ).distinct()
    return (
        origins.join(registered, ["source_id", "normalized_id", "entity_id"], "left")
        .groupBy("entity_id")
        .agg(
            F.count_distinct("normalized_id").alias("normalized_count"),
            F.count_if((F.col("normalized_id") != F.col("entity_id")) & F.col("registered").isNull()).alias(
                "unregistered_count"
            ),
        )
        .filter("normalized_count > 1 AND unregistered_count > 0")
    )


def availability_date(text: Column | None, period: Column, month_day: str | None = None) -> Column:
    """Availability from a column, or a fixed month and day in the year after the period."""
    if month_day is None:
        return parse_timestamp(text, partial=False)
    month, day = (int(x) for x in month_day.split("-"))
    return anchor(period, month, day, shift=1)


def fiscal_year_end(
    period: Column, entity: Column, stated: Column | None = None, exceptions: Mapping[str, str] | None = None,
    default: str = "12-31",
) -> Column:
    """Period end: stated date, else the entity's registered month-day, else the default."""
    month_day = F.coalesce(lookup(exceptions, entity), F.lit(default)) if exceptions else F.lit(default)
    registered = F.to_date(F.concat(period.cast("string"), F.lit("-"), month_day), "yyyy-MM-dd")
    return F.coalesce(parse_timestamp(stated, partial=False).cast("date"), registered) if stated is not None else registered


def type_observations(resolved: DataFrame, low: int, high: int, month_days: Mapping[str, str] | None = None) -> DataFrame:
    """Typed observations with the first reason that excludes a row (null keeps the row)."""
    period = year_of(F.col("period_text"))
    rows = resolved.withColumn("period", period)
    derived = F.lit(None).cast("timestamp_ntz")
    for source, month_day in (month_days or {}).items():
        derived = F.when(F.col("source_id") == source, availability_date(None, F.col("period"), month_day)).otherwise(derived)
    rows = rows.withColumn(
        "availability", F.coalesce(derived, availability_date(F.col("available_text"), F.col("period")))
    )
    reason = (
        F.when(blank_to_null(F.col("raw_entity")).isNull(), "MISSING_ENTITY_ID")
        .when(F.col("period").isNull(), "INVALID_PERIOD")
        .when(~F.col("period").between(low, high), "OUTSIDE_SAMPLE_WINDOW")
        .when(F.col("availability").isNull(), "MISSING_OR_INVALID_AVAILABILITY_DATE")
    )
    return rows.withColumn("reason", reason)


def exclusion_ledger(typed: DataFrame) -> DataFrame:
    return typed.filter("reason IS NOT NULL")


def early_reports(obs: DataFrame, period_end: Column, exceptions: DataFrame | None = None) -> DataFrame:
    """Observations available before their period ended and not registered as early."""
    early = obs.filter(F.to_date("availability") < period_end)
    return early if exceptions is None else early.join(exceptions, ["entity_id", "period", "source_id"], "left_anti")


def dedupe_source_rows(obs: DataFrame, row_key: str) -> DataFrame:
    """One row per (source, entity, period): the first row in source order, with the collapsed count.

    The choice is a minimum, so copies of a hot key fold map-side.
    """
    payload = [c for c in obs.columns if c not in ("source_id", *KEY)]
    first = F.min_by(F.struct(*payload), F.col(row_key))
    return (
        obs.groupBy("source_id", *KEY)
        .agg(first.alias("_first"), (F.count(F.lit(1)) - 1).alias("collapsed_rows"))
        .select("source_id", *KEY, "_first.*", "collapsed_rows")
    )


def entity_master(obs: DataFrame, contributing: Sequence[str]) -> DataFrame:
    return obs.filter(F.col("source_id").isin(*contributing)).select("entity_id").distinct()


def _presence(obs: DataFrame, core: Sequence[str]) -> DataFrame:
    present = [F.bool_or(F.col("source_id") == s).alias(f"_has_{i}") for i, s in enumerate(core)]
    core_rows = obs.filter(F.col("source_id").isin(*core))
    return core_rows.groupBy(*KEY).agg(*present, F.max("availability").alias("anchor"))


def build_panel(obs: DataFrame, core: Sequence[str]) -> DataFrame:
    """Entity-periods that every core source covers; the anchor is the latest availability."""
    complete = F.lit(True)
    for i in range(len(core)):
        complete = complete & F.col(f"_has_{i}")
    return _presence(obs, core).filter(complete).select(*KEY, "anchor")


def incomplete_core(obs: DataFrame, core: Sequence[str]) -> DataFrame:
    """Entity-periods that lack a core source, with the sorted list of what is missing."""
    missing = F.array_compact(
        F.array(*[F.when(~F.col(f"_has_{i}"), F.lit(s)) for i, s in sorted(enumerate(core), key=lambda x: x[1])])
    )
    return (
        _presence(obs, core)
        .select(*KEY, missing.alias("missing_sources"))
        .filter(F.size("missing_sources") > 0)
        .withColumn("reason", F.lit("INCOMPLETE_CORE_AVAILABILITY"))
    )


def resolution_report(obs: DataFrame) -> DataFrame:
    return obs.groupBy("source_id", "raw_entity", "normalized_id", "entity_id", "method").agg(
        F.count(F.lit(1)).alias("occurrence_count")
    )


def panel_summary(typed: DataFrame, core: Sequence[str], row_key: str) -> DataFrame:
    """Observation, entity, panel, exclusion and collapse counts in one row."""
    excluded = typed.agg(F.count_if(F.col("reason").isNotNull()).alias("excluded_row_count"))
    kept = dedupe_source_rows(typed.filter("reason IS NULL").drop("reason"), row_key)
    counts = kept.agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.sum("collapsed_rows").alias("collapsed_row_count"),
        F.count_distinct("entity_id").alias("entity_count"),
    )
    states = _presence(kept, core)
    complete = F.lit(True)
    for i in range(len(core)):
        complete = complete & F.col(f"_has_{i}")
    panel = states.agg(
        F.count_if(complete).alias("panel_row_count"), F.count_if(~complete).alias("incomplete_period_count")
    )
    one_row = F.lit(True)
    return excluded.join(F.broadcast(counts), one_row).join(F.broadcast(panel), one_row)
