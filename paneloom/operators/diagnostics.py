"""Feature diagnostics. Config-sized feature lists run as wide aggregates over one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.profile import melt, profile
from paneloom.operators.features import lag_year
from paneloom.operators.ranking import attach, average_ranks, cut, quantiles

KEY = ["entity_id", "period"]
INFINITY = float("inf")


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != INFINITY)


def diag_coverage(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Counts, span and year-on-year coverage per feature: one self-join, then one row per entity."""
    rows = lag_year(panel.select(*KEY, *features), features)
    entity, total = [], {}
    for i, f in enumerate(features):
        here, both = F.col(f).isNotNull(), F.col(f).isNotNull() & F.col(f"{f}__lag").isNotNull()
        entity += [
            F.count_if(here).alias(f"_n{i}"),
            F.count_if(both).alias(f"_p{i}"),
            F.min(F.when(here, F.col("period"))).alias(f"_f{i}"),
            F.max(F.when(here, F.col("period"))).alias(f"_l{i}"),
        ]
        n, p = F.col(f"_n{i}"), F.col(f"_p{i}")
        total[f] = {
            "row_count": F.sum("_rows"),
            "nonmissing_count": F.sum(n),
            "entity_count": F.count_if(n > 0),
            "first_period": F.min(f"_f{i}"),
            "last_period": F.max(f"_l{i}"),
            "consecutive_count": F.sum(p),
            "entities_with_two_periods": F.count_if(n >= 2),
            "entities_with_consecutive": F.count_if(p > 0),
        }
    per_entity = rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_rows"), *entity)
    result = profile(per_entity, total, label="feature_id")
    return result.select(
        "*",
        (F.col("row_count") - F.col("nonmissing_count")).alias("missing_count"),
        F.try_divide("nonmissing_count", "row_count").alias("coverage"),
        (F.col("consecutive_count") / F.greatest(F.col("nonmissing_count"), F.lit(1))).alias("consecutive_coverage"),
    )


SCALE_QUANTILES = {"p1": 0.01, "p5": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}


def diag_value_scale(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Range, exact quantiles and sign counts over finite values."""
    fields = {}
    for f in features:
        v = F.col(f).cast("double")
        ok = F.when(_finite(v), v)
        fields[f] = {
            "minimum": F.min(ok),
            "mean": F.avg(ok),
            "maximum": F.max(ok),
            "zero_count": F.count_if(v == 0),
            "negative_count": F.count_if(v < 0),
            "nonfinite_count": F.count_if(v.isNotNull() & ~_finite(v)),
        }
    long = melt(panel, [], features, "feature_id").filter(_finite(F.col("value")))
    return attach(profile(panel, fields, label="feature_id"), quantiles(long, ["feature_id"], "value", SCALE_QUANTILES), ["feature_id"])


def diag_identities(panel: DataFrame, identities: Mapping[str, tuple[str, Mapping[str, float]]]) -> DataFrame:
    """Accounting identities per row: left side against a signed sum, complete rows only."""
    cells = []
    for name, (left, terms) in identities.items():
        if not {left, *terms} <= set(panel.columns):
            continue
        expected = sum((F.lit(sign) * F.col(c) for c, sign in terms.items()), F.lit(0.0))
        columns = [F.col(left), *[F.col(c) for c in terms]]
        complete = F.lit(True)
        for c in columns:
            complete = complete & c.isNotNull()
        residual = F.abs(F.col(left) - expected)
        scale = F.greatest(F.lit(1.0), *[F.abs(c) for c in columns])
        cells.append(
            F.when(
                complete,
                F.struct(F.lit(name).alias("identity_id"), residual.alias("residual"), (residual / scale).alias("scaled_residual")),
            )
        )
    rows = panel.select(*KEY, F.explode(F.array_compact(F.array(*cells))).alias("_i")).select(*KEY, "_i.*")
    return rows.withColumn("pass_flag", (F.col("residual") <= 1.0) | (F.col("scaled_residual") <= 1e-6))


def diag_adjustments(panel: DataFrame, concepts: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Pre / post adjustment statistics per concept and period."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("concept_id"), F.col(pre).cast("double").alias("pre"), F.col(post).cast("double").alias("post"))
            for c, (pre, post) in concepts.items()
        ]
    )
    rows = panel.select("period", F.explode(cells).alias("_c")).select("period", "_c.*")
    signed = F.col("post") - F.col("pre")
    rows = rows.withColumns({"signed": signed, "absolute": F.abs(signed)})
    by = ["concept_id", "period"]
    matched = F.col("signed").isNotNull()
    counts = rows.groupBy(*by).agg(
        F.count_if(matched).alias("matched_count"),
        F.count_if(F.col("post").isNotNull() & F.col("pre").isNull()).alias("post_only_count"),
        F.count_if(F.col("post").isNull() & F.col("pre").isNotNull()).alias("pre_only_count"),
        F.avg("signed").alias("signed_mean"),
        F.avg("absolute").alias("absolute_mean"),
        F.avg(F.try_divide(F.col("signed"), F.abs("post"))).alias("relative_mean"),
        (F.count_if(F.col("signed") == 0) / F.greatest(F.count_if(matched), F.lit(1))).alias("zero_rate"),
    )
    spread = quantiles(rows.filter(matched), by, "absolute", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return attach(counts, spread, by)


def diag_ratios(
    panel: DataFrame, features: Sequence[str], operands: Mapping[str, Sequence[str]], denominators: Mapping[str, str]
) -> DataFrame:
    """Ratio health per feature and period. A null operand and a zero denominator are counted apart."""
    fields = {}
    for f in features:
        v = F.col(f)
        absent = F.lit(False)
        for c in operands[f]:
            absent = absent | F.col(c).isNull()
        fields[f] = {
            "row_count": F.count(F.lit(1)),
            "value_count": F.count(v),
            "missing_operand_count": F.count_if(absent),
            "zero_denominator_count": F.count_if(~absent & (F.expr(denominators[f]) == 0)),
            "nonfinite_count": F.count_if(v.isNotNull() & ~_finite(v)),
        }
    by = ["feature_id", "period"]
    counts = profile(panel, fields, ["period"], "feature_id")
    long = melt(panel, ["period"], features, "feature_id").filter(_finite(F.col("value")))
    spread = quantiles(long, by, "value", {"minimum": 0.0, "_p1": 0.01, "median": 0.5, "_p99": 0.99, "maximum": 1.0})
    spread = cut(spread)
    outside = attach(long, spread.select(*by, "_p1", "_p99"), by).groupBy(*by).agg(
        F.count_if((F.col("value") < F.col("_p1")) | (F.col("value") > F.col("_p99"))).alias("extreme_count")
    )
    joined = attach(attach(counts, spread.drop("_p1", "_p99"), by), outside, by)
    return joined.na.fill(0, ["extreme_count"]).withColumn("coverage", F.try_divide("value_count", "row_count"))


def diag_temporal(panel: DataFrame, needs_prior: Mapping[str, bool]) -> DataFrame:
    """Values that need a prior year although they sit at the entity's first panel year."""
    first = panel.groupBy("entity_id").agg(F.min("period").alias("_first"))
    rows = attach(panel, first, ["entity_id"])
    fields = {
        f: {
            "value_count": F.count(f),
            "first_year_value_count": F.count_if(F.lit(prior) & F.col(f).isNotNull() & (F.col("period") == F.col("_first"))),
        }
        for f, prior in needs_prior.items()
    }
    result = profile(rows, fields, label="feature_id")
    return result.withColumn("temporal_status", F.when(F.col("first_year_value_count") > 0, "REVIEW").otherwise("PASS"))


def feature_pairs(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """(pair, x, y) rows of every feature pair, complete cases only. The list comes from configuration."""
    cells = [
        F.struct(F.lit(a).alias("feature_left"), F.lit(b).alias("feature_right"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for a, b in combinations(features, 2)
    ]
    rows = panel.select(F.explode(F.array(*cells)).alias("_p")).select("_p.*")
    return rows.filter("x IS NOT NULL AND y IS NOT NULL")


def diag_redundancy(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson, Spearman and duplicate checks per feature pair, on pairwise-complete rows.

    The exploded pairs feed partial aggregates in the same stage, so only one row per pair and
    task is shuffled for the moments. Ranks are taken per pair by distributed sorting.
    """
    by = ["feature_left", "feature_right"]
    pairs = feature_pairs(panel, features)
    ratio = F.try_divide(F.col("x"), F.nullif(F.col("y"), F.lit(0.0)))
    moments = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("paired_count"),
        F.when(F.count(F.lit(1)) >= 3, F.corr("x", "y")).alias("pearson"),
        F.bool_and(F.col("x") == F.col("y")).alias("exact_duplicate"),
        F.bool_and(F.col("x") == -F.col("y")).alias("sign_reversed"),
        ((F.count(ratio) >= 3) & (F.stddev_samp(ratio) <= 1e-12)).alias("constant_scale"),
        F.min(ratio).alias("_ratio"),
    )
    ranked = average_ranks(average_ranks(pairs, by, "x", "_rx"), by, "y", "_ry")
    ranks = ranked.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= 3, F.corr("_rx", "_ry")).alias("spearman"))
    return attach(moments, ranks, by).select(
        *by, "paired_count", "pearson", "spearman", "exact_duplicate", "sign_reversed", "constant_scale",
        F.when(F.col("constant_scale"), F.col("_ratio")).alias("scaling_factor"),
    )
