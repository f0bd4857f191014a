"""Rolling-origin splits, inverse-probability weights and balance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.draws import hash_number
from paneloom.functions.grid import with_grid
from paneloom.functions.profile import profile
from paneloom.operators.models import fit, kept_features, score
from paneloom.operators.ranking import attach, positions

KEY = ["entity_id", "period"]


def rolling_splits(panel: DataFrame, risk: DataFrame, years: Sequence[int], require_mature: bool = True) -> DataFrame:
    """(fold, key, side): train rows lie before the fold year, test rows in it.

    Every row meets only the folds at or after its period, so no pair of tables is crossed.
    """
    usable = F.col("eligible") & (F.col("mature") if require_mature else F.lit(True))
    rows = panel.select(*KEY).join(risk.filter(usable).select(*KEY), KEY)
    grid = with_grid(rows, [{"fold": y} for y in years], {"fold": "int"}).filter("period <= fold")
    return grid.withColumn("side", F.when(F.col("period") < F.col("fold"), "train").otherwise("test"))


def split_audit(splits: DataFrame) -> DataFrame:
    train = F.col("side") == "train"
    return splits.groupBy("fold").agg(
        F.count_if(train).alias("train_rows"),
        F.count_if(~train).alias("test_rows"),
        F.max(F.when(train, F.col("period"))).alias("fit_max_period"),
        F.bool_or(train & (F.col("period") >= F.col("fold"))).alias("leak"),
    )


def verified_keys(sources: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Whether any verification channel observed the row."""
    seen = F.col("channel_id").isin(*channels) & F.col("outcome").isNotNull()
    return sources.groupBy(*KEY).agg(F.bool_or(seen).alias("verified"))


def verification_propensity(
    train: DataFrame, features: Sequence[str], flag: str = "verified", inverse_regularization: float = 1.0, tolerance: float = 1e-6,
    rows: DataFrame | None = None,
) -> tuple[DataFrame, str | None]:
    """``rows`` (by default those of the fit) with their verification propensity, or a reason why none can be fitted."""
    rows = train if rows is None else rows
    if not features:
        return rows.withColumn("propensity", F.lit(None).cast("double")), "NO_PREDECISION_VERIFICATION_FEATURES"
    classes = train.agg(F.count_if(flag).alias("yes"), F.count_if(~F.col(flag)).alias("no")).first()
    reason = None
    if classes["yes"] == 0:
        reason = "NO_OBSERVED_VERIFICATION"
    elif classes["no"] == 0:
        reason = "INSUFFICIENT_VERIFICATION_CLASSES"
    kept = kept_features(train, features) if reason is None else []
    if reason is None and not kept:
        reason = "NO_ESTIMABLE_VERIFICATION_FEATURES"
    if reason is not None:
        return rows.withColumn("propensity", F.lit(None).cast("double")), reason
    model = fit(train.withColumn("_y", F.col(flag).cast("double")), kept, "_y", "logistic", {"C": inverse_regularization, "tol": tolerance})
    return score(model, rows, "propensity"), None


def stabilized_ipw(
    train: DataFrame, features: Sequence[str], flag: str = "verified", inverse_regularization: float = 1.0, tolerance: float = 1e-6,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Stabilised weights p/p(x) and (1-p)/(1-p(x)) of ``rows``, by default those of the fit.

    Propensity and rate are those of ``train``. Weight one with a reason when no model can be fitted.
    """
    scored, reason = verification_propensity(train, features, flag, inverse_regularization, tolerance, rows)
    rate = train.agg(F.avg(F.col(flag).cast("double")).alias("_rate"))
    weight = (
        F.lit(1.0)
        if reason
        else F.when(F.col(flag), F.col("_rate") / F.col("propensity")).otherwise((1 - F.col("_rate")) / (1 - F.col("propensity")))
    )
    return (
        attach(scored, rate, []).withColumn("weight", weight).withColumn("reason", F.lit(reason).cast("string")).drop("_rate")
    )


def capped_ipw(propensity: Column) -> Column:
    return F.least(1 / F.greatest(F.lit(0.05), F.least(F.lit(1.0), propensity)), F.lit(20.0))


def ess(df: DataFrame, weight: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """Effective sample size; zero for no rows."""
    w = F.col(weight) if isinstance(weight, str) else weight
    total = F.sum(w) * F.sum(w)
    return df.groupBy(*by).agg(F.coalesce(F.try_divide(total, F.sum(w * w)), F.lit(0.0)).alias("effective_sample_size"))


def ipw_decision(
    df: DataFrame, bounds: tuple[float, float], ess_minimum: float, ess_fraction: float, support_minimum: float
) -> DataFrame:
    """Accept the weights only with enough effective rows and propensity support; else the reason.

    Needs weight, propensity, verified and reason (of the propensity fit).
    """
    w = F.col("weight")
    stats = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)), F.lit(0.0)).alias("effective_sample_size"),
        F.avg(F.col("propensity").between(*bounds).cast("double")).alias("support_fraction"),
        F.bool_or("verified").alias("_verified"),
        F.max("reason").alias("_reason"),
    ).withColumn("required_ess", F.greatest(F.lit(float(ess_minimum)), F.col("row_count") * ess_fraction))
    good = (F.col("effective_sample_size") >= F.col("required_ess")) & (F.col("support_fraction") >= support_minimum)
    reason = (
        F.when(~F.coalesce("_verified", F.lit(False)), "NO_OBSERVED_VERIFICATION")
        .when(F.col("_reason").isNotNull(), F.col("_reason"))
        .when(~F.coalesce(good, F.lit(False)), "WEIGHT_DIAGNOSTICS_FAILED")
    )
    return stats.select(
        "row_count", "effective_sample_size", "support_fraction", "required_ess", reason.alias("reason"),
        F.when(reason.isNull(), "stabilized_verification_ipw").otherwise("unweighted").alias("weight_method"),
    )


def smd(df: DataFrame, features: Sequence[str], flag: str, weight: str) -> DataFrame:
    """Standardised mean difference per feature, before and after weighting, in one pass."""
    fields = {}
    for f in features:
        x, w, side = F.col(f).cast("double"), F.col(weight), F.col(flag)
        has = x.isNotNull()

        def mean(inside: Column, weighted: bool, x: Column = x, w: Column = w, has: Column = has) -> Column:
            unit = w if weighted else F.lit(1.0)
            return F.try_divide(F.sum(F.when(inside & has, unit * x)), F.sum(F.when(inside & has, unit)))

        sd = F.coalesce(F.stddev_samp(x), F.lit(0.0))
        fields[f] = {
            name: F.when(sd <= 0, F.lit(0.0)).otherwise(F.try_divide(mean(side, weighted) - mean(~side, weighted), sd))
            for name, weighted in (("smd_before", False), ("smd_after", True))
        }
    return profile(df, fields, label="feature_id")


def overlap_weights(propensity: Column, flag: Column) -> Column:
    return F.when(flag, 1 - propensity).otherwise(propensity)


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null count per column and whether the fit sample keeps it."""
    counts = profile(df, {c: {"value_count": F.count(c)} for c in columns}, label="feature_id")
    return counts.withColumn("kept", F.col("value_count") > 0)


def holdout_split(df: DataFrame, fraction: float, seed: str) -> DataFrame:
    """Validation rows are those with the smallest hashes: exactly round(n x fraction), kept between
    10 and n - 10. Below 20 rows every row is on both sides."""
    hashed = df.withColumn("_h", hash_number(seed, F.col("entity_id"), F.col("period")))
    placed = positions(hashed, [], [("_h", True), ("entity_id", True), ("period", True)])
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    cut_at = F.greatest(F.lit(10), F.least(F.col("_n") - 10, F.round(F.col("_n") * fraction).cast("long")))
    side = F.when(F.col("_n") < 20, "both").when(F.col("position") <= cut_at, "validation").otherwise("train")
    return attach(placed, size, []).withColumn("side", side).drop("_h", "_n", "position")


def cost_weights(df: DataFrame, regime: Mapping[str, float], cap: float) -> DataFrame:
    """Class cost times selection weight, clipped and scaled to mean one; needs outcome and weight."""
    positive = regime["false_negative_cost"] + regime["true_positive_benefit"]
    combined = F.col("weight") * F.when(F.col("outcome"), positive).otherwise(regime["false_positive_cost"])
    rows = df.withColumn("_c", F.greatest(F.lit(1e-12), F.least(F.lit(float(cap)), combined)))
    mean = rows.agg(F.avg("_c").alias("_m"))
    return attach(rows, mean, []).withColumn("training_weight", F.when(F.col("_m") > 0, F.col("_c") / F.col("_m")).otherwise(1.0)).drop("_c", "_m")


def training_view(df: DataFrame, strategy: str) -> DataFrame:
    """Rows, label and weight of a label strategy; needs verified, outcome and propensity."""
    observed = F.coalesce(F.col("outcome"), F.lit(False))
    if strategy in ("naive_observed_as_negative", "pu"):
        return df.withColumn("label", observed).withColumn("weight", F.lit(1.0))
    rows = df.filter("verified").withColumn("label", observed)
    if strategy == "verified_only":
        return rows.withColumn("weight", F.lit(1.0))
    if strategy == "ipw":
        return rows.withColumn("weight", capped_ipw(F.col("propensity")))
    raise ValueError(f"unknown label strategy: {strategy}")
