"""Partial identification and robust comparison of models over scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.functions.grid import with_grid
from paneloom.operators.ranking import attach


def prevalence_bounds(rates: DataFrame, justified: bool = False) -> DataFrame:
    """Bounds on prevalence from an observed rate and optional restrictions.

    Needs rate, false_positive_upper and sensitivity_lower (null = not imposed).
    """
    p, alpha, se = F.col("rate"), F.col("false_positive_upper"), F.col("sensitivity_lower")
    lower = F.coalesce(F.greatest(F.lit(0.0), (p - alpha) / (1 - alpha)), F.lit(0.0))
    upper = F.coalesce(F.least(F.lit(1.0), p / se), F.lit(1.0))
    used = alpha.isNotNull() | se.isNotNull()
    rows = rates.withColumns({"lower": lower, "upper": upper})
    return rows.select(
        *rates.columns,
        "lower",
        "upper",
        F.when(F.col("lower") > F.col("upper") + 1e-12, "INCOMPATIBLE_RESTRICTIONS")
        .when(used, "BOUNDED")
        .otherwise("UNINFORMATIVE_WITHOUT_RESTRICTIONS")
        .alias("status"),
        F.when(used & F.lit(justified), "identified_set").otherwise("sensitivity_region").alias("domain_type"),
    )


def corner_bounds(rates: DataFrame, sensitivity: tuple[float, float], false_positive: tuple[float, float]) -> DataFrame:
    """Envelope of (rate - fp) / (se - fp) over the four corners; no usable corner gives (0.5, 0, 1)."""
    corners = [{"se": s, "fp": f} for s in sensitivity for f in false_positive]
    rows = with_grid(rates, corners, {"se": "double", "fp": "double"})
    gap = F.col("se") - F.col("fp")
    value = F.when(
        F.col("rate").isNotNull() & (gap > 1e-6),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("rate") - F.col("fp"), gap))),
    )
    bounds = rows.groupBy(*rates.columns).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return bounds.select(
        *rates.columns,
        F.coalesce((F.col("_lo") + F.col("_hi")) / 2, F.lit(0.5)).alias("estimate"),
        F.coalesce("_lo", F.lit(0.0)).alias("lower"),
        F.coalesce("_hi", F.lit(1.0)).alias("upper"),
    )


#: Models that a surface may compare with each other.
MOST_MODELS = 2000


def _signed(surface: DataFrame, higher_is_better: bool) -> DataFrame:
    return surface.select("model_id", "scenario_id", (F.col("value") * (1.0 if higher_is_better else -1.0)).alias("value"))


def paired_dominance(surface: DataFrame, higher_is_better: bool = True, tolerance: float = 0.0) -> DataFrame:
    """Worst difference of each ordered model pair over their common scenarios.

    The surface has one row per registered model and scenario; models are a registry of at most
    ``MOST_MODELS``. A pair without a common scenario has no worst difference and dominates nothing.
    """
    rows = _signed(surface, higher_is_better)
    left = rows.withColumnsRenamed({"model_id": "model_a", "value": "_a"})
    right = rows.withColumnsRenamed({"model_id": "model_b", "value": "_b"})
    pairs = left.join(right, "scenario_id").filter(F.col("model_a") != F.col("model_b"))
    worst = pairs.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("common_count"), F.min(F.col("_a") - F.col("_b")).alias("worst_difference")
    )
    names = [r["model_id"] for r in rows.select("model_id").distinct().limit(MOST_MODELS + 1).collect()]
    if len(names) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    every = rows.select(F.col("model_id").alias("model_a")).distinct().select(
        "model_a", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("model_b")
    )
    return every.filter(F.col("model_a") != F.col("model_b")).join(worst, ["model_a", "model_b"], "left").select(
        "model_a", "model_b", F.coalesce("common_count", F.lit(0)).alias("common_count"), "worst_difference",
        F.coalesce(F.col("worst_difference") > tolerance, F.lit(False)).alias("dominates"),
    )


def separated_dominance(surface: DataFrame, higher_is_better: bool = True, tolerance: float = 0.0) -> DataFrame:
    """Lowest value of one model against the highest of the other."""
    ranges = _signed(surface, higher_is_better).groupBy("model_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    a = ranges.select(F.col("model_id").alias("model_a"), "lo")
    b = ranges.select(F.col("model_id").alias("model_b"), "hi")
    pairs = a.join(F.broadcast(b), F.col("model_a") != F.col("model_b"))
    rows = pairs.select("model_a", "model_b", (F.col("lo") - F.col("hi")).alias("margin"))
    return rows.withColumn("dominates", F.col("margin") > tolerance)


def selection_set(surface: DataFrame, higher_is_better: bool = True, tolerance: float = 0.0) -> DataFrame:
    """Models that no other model dominates."""
    beaten = paired_dominance(surface, higher_is_better, tolerance).filter("dominates").select(F.col("model_b").alias("model_id"))
    return surface.select("model_id").distinct().join(beaten, "model_id", "left_anti")


def minimax_regret(surface: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """Largest regret per model over scenarios that all models share, and the minimax set."""
    rows = _signed(surface, higher_is_better)
    models = rows.agg(F.count_distinct("model_id").alias("_models"))
    best = rows.groupBy("scenario_id").agg(F.max("value").alias("_best"), F.count_distinct("model_id").alias("_n"))
    common = attach(attach(rows, best, ["scenario_id"]), models, []).filter("_n = _models")
    regret = common.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("common_count"), F.max(F.col("_best") - F.col("value")).alias("max_regret")
    )
    least = regret.agg(F.min("max_regret").alias("_least"))
    return attach(regret, least, []).select(
        "model_id", "common_count", "max_regret", (F.abs(F.col("max_regret") - F.col("_least")) <= 1e-12).alias("minimax")
    )


def restriction_audit(restrictions: DataFrame, bases: DataFrame, required: Sequence[str]) -> DataFrame:
    """Whether each active restriction has evidence that meets every condition, with the reasons against it.

    restrictions: restriction_id, value, basis_ids (array); bases: basis_id and boolean condition columns.
    """
    exploded = restrictions.select("restriction_id", "value", F.explode_outer("basis_ids").alias("basis_id"))
    joined = exploded.join(bases.withColumn("_found", F.lit(True)), "basis_id", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("value").isNull(), "VALUE_NOT_SET"),
            F.when(F.col("basis_id").isNull(), "NO_EVIDENCE_BASIS"),
            F.when(F.col("basis_id").isNotNull() & F.col("_found").isNull(), "BASIS_UNREGISTERED"),
            *[F.when(F.col("_found") & ~F.coalesce(c, F.lit(False)), f"{c.upper()}_NOT_MET") for c in required],
        )
    )
    return (
        joined.withColumn("_r", reasons)
        .groupBy("restriction_id")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_r")))).alias("reasons"))
        .withColumn("eligible", F.size("reasons") == 0)
    )
