"""Latent-label posteriors from source accuracies. All are closed-form column arithmetic."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.functions.grid import lookup, with_grid
from paneloom.operators.ranking import attach

KEY = ["entity_id", "period"]
Accuracy = Mapping[str, tuple[float, float]]
SMALL = 1e-9


def _expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: float) -> float:
    p = min(1 - SMALL, max(SMALL, p))
    return math.log(p / (1 - p))


def posterior_fixed_pi(outcomes: DataFrame, accuracy: Accuracy, pi: float) -> DataFrame:
    """Conditional-independence posterior: prior log-odds plus one term per observed source."""
    if not 0 < pi < 1:
        raise ValueError("the prevalence must lie in (0, 1)")
    yes, no = {}, {}
    for source, (sensitivity, specificity) in accuracy.items():
        se, sp = (min(1 - SMALL, max(SMALL, x)) for x in (sensitivity, specificity))
        yes[source], no[source] = math.log(se / (1 - sp)), math.log((1 - se) / sp)
    source = F.col("source_id")
    term = F.when(F.col("outcome"), lookup(yes, source)).when(~F.col("outcome"), lookup(no, source))
    odds = F.lit(math.log(pi / (1 - pi))) + F.coalesce(F.sum(term), F.lit(0.0))
    return outcomes.groupBy(*KEY).agg(_expit(F.greatest(F.lit(-35.0), F.least(F.lit(35.0), odds))).alias("posterior"))


def wide_outcomes(outcomes: DataFrame, sources: Sequence[str], extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per key with a column per registered source."""
    return outcomes.groupBy(*KEY).agg(
        *[F.max(F.when(F.col("source_id") == s, F.col("outcome"))).alias(s) for s in sources],
        *[e.alias(n) for n, e in (extra or {}).items()],
    )


def posterior_quadrature(
    outcomes: DataFrame, channels: Mapping[str, str], accuracy: Accuracy, channel_sd: Mapping[str, float], pi: float,
    points: int = 20,
) -> DataFrame:
    """Posterior with a shared random effect per channel, integrated on Gauss-Hermite nodes."""
    wide = wide_outcomes(outcomes, list(channels))
    return wide.select(*KEY, quadrature_posterior(channels, accuracy, channel_sd, pi, points).alias("posterior"))


def quadrature_posterior(
    channels: Mapping[str, str], accuracy: Accuracy, channel_sd: Mapping[str, float], pi: float, points: int = 20
) -> Column:
    """The same as an expression over one boolean column per source."""
    nodes, weights = np.polynomial.hermite.hermgauss(points)
    grid = F.array(
        *[
            F.struct(F.lit(float(math.sqrt(2) * n)).alias("n"), F.lit(float(w / math.sqrt(math.pi))).alias("w"))
            for n, w in zip(nodes, weights, strict=True)
        ]
    )
    log_odds = F.lit(math.log(pi / (1 - pi)))
    for channel in sorted(set(channels.values())):
        members = [s for s, c in channels.items() if c == channel]
        any_observed = F.coalesce(*[F.col(s) for s in members]).isNotNull()

        def integral(latent: bool, members: list[str] = members, channel: str = channel) -> Column:
            def step(total: Column, node: Column) -> Column:
                product = node["w"]
                for s in members:
                    base = _logit(accuracy[s][0] if latent else 1 - accuracy[s][1])
                    p = _expit(F.lit(base) + F.lit(channel_sd[channel]) * node["n"])
                    product = product * F.when(F.col(s), p).when(~F.col(s), 1 - p).otherwise(F.lit(1.0))
                return total + product

            return F.aggregate(grid, F.lit(0.0), step)

        floor = F.lit(1e-300)
        term = F.ln(F.greatest(integral(True), floor)) - F.ln(F.greatest(integral(False), floor))
        log_odds = log_odds + F.when(any_observed, term).otherwise(F.lit(0.0))
    return _expit(log_odds)


def posterior_grid_mean(posteriors: DataFrame, eligible: Sequence[float]) -> DataFrame:
    """Mean posterior over the eligible prevalence values; unknown when there is none."""
    usable = F.col("pi").isin(*eligible)
    return posteriors.groupBy(*KEY).agg(F.avg(F.when(usable, F.col("posterior"))).alias("posterior_mean"))


def prevalence_posterior(weighted: DataFrame, grid: Sequence[float], mass: float = 0.95) -> DataFrame:
    """Mean and equal-tail interval of the prevalence on a grid.

    ``weighted`` has one row per distinct answer pattern: rows, like_one, like_zero. Patterns are
    few whatever the table size, and the grid is configuration.
    """
    points = with_grid(weighted, [{"pi": float(p)} for p in grid], {"pi": "double"})
    mix = F.col("pi") * F.col("like_one") + (1 - F.col("pi")) * F.col("like_zero")
    logs = points.groupBy("pi").agg(F.sum(F.col("rows") * F.ln(F.greatest(mix, F.lit(1e-12)))).alias("ll"))
    best = logs.agg(F.max("ll").alias("_best"))
    mass_at = attach(logs, best, []).withColumn("m", F.exp(F.col("ll") - F.col("_best")))
    total = mass_at.agg(F.sum("m").alias("_total"))
    share = attach(mass_at, total, []).withColumn("p", F.col("m") / F.col("_total"))
    # the window spans the prevalence grid, a few hundred configured points
    share = share.withColumn("_one", F.lit(1))
    upto = F.sum("p").over(Window.partitionBy("_one").orderBy("pi").rowsBetween(Window.unboundedPreceding, 0))
    tail = (1 - mass) / 2
    last = float(max(grid))
    return share.withColumn("c", upto).agg(
        F.sum(F.col("pi") * F.col("p")).alias("estimate"),
        F.coalesce(F.min(F.when(F.col("c") >= tail, F.col("pi"))), F.lit(last)).alias("lower"),
        F.coalesce(F.min(F.when(F.col("c") >= 1 - tail, F.col("pi"))), F.lit(last)).alias("upper"),
    )


def independent_patterns(wide: DataFrame, accuracy: Accuracy) -> DataFrame:
    """Distinct answer patterns with their counts and likelihoods under independence."""
    one, zero = F.lit(1.0), F.lit(1.0)
    for s, (se, sp) in accuracy.items():
        one = one * F.when(F.col(s), se).when(~F.col(s), 1 - se).otherwise(1.0)
        zero = zero * F.when(F.col(s), 1 - sp).when(~F.col(s), sp).otherwise(1.0)
    return (
        wide.groupBy(*accuracy)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("*", one.alias("like_one"), zero.alias("like_zero"))
    )


@dataclass(frozen=True)
class PatternModel:
    """Two dependent sources with selective verification and maturity."""

    accuracy: Accuracy
    pi: float
    dependence: float = 0.0
    selective: float = 0.0
    anchor_verification: float = 1.0
    weak_verification: float = 1.0
    horizon_days: float = 365.0
    delay_mean_days: float = 30.0

    def variant(self, name: str, pi_offset: float = 0.1, bounds: tuple[float, float] = (0.001, 0.5)) -> PatternModel:
        """Deliberately misspecified versions."""
        if name == "ignore_dependence":
            return replace(self, dependence=0.0)
        if name == "wrong_fixed_pi":
            return replace(self, pi=min(max(self.pi + pi_offset, bounds[0]), bounds[1]))
        if name == "clean_anchor":
            return replace(self, accuracy={**self.accuracy, "anchor": (self.accuracy["anchor"][0], 1.0)})
        if name == "correct":
            return self
        raise ValueError(f"unknown variant: {name}")


def pattern_probability(model: PatternModel, latent: bool, risk: Column) -> Column:
    """Likelihood of the (anchor, weak) answer pattern, including which answers are present."""
    a, w = F.col("anchor"), F.col("weak")
    pa, pw = (model.accuracy[s][0] if latent else 1 - model.accuracy[s][1] for s in ("anchor", "weak"))
    both = model.dependence * min(pa, pw) + (1 - model.dependence) * pa * pw
    answer = (
        F.when(a.isNull() & w.isNull(), 1.0)
        .when(w.isNull(), F.when(a, pa).otherwise(1 - pa))
        .when(a.isNull(), F.when(w, pw).otherwise(1 - pw))
        .when(a & w, both)
        .when(a, pa - both)
        .when(w, pw - both)
        .otherwise(1 - pa - pw + both)
    )

    def verified(base: float) -> Column:
        raw = F.lit(base + 0.75 * model.selective * latent) + 0.25 * model.selective * risk
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))

    qa, qw = verified(model.anchor_verification), verified(model.weak_verification)
    ready = 1 - math.exp(-model.horizon_days / model.delay_mean_days)
    present = (
        F.when(a.isNotNull() & w.isNotNull(), ready * qa * qw)
        .when(a.isNotNull(), ready * qa * (1 - qw))
        .when(w.isNotNull(), ready * (1 - qa) * qw)
        .otherwise(1 - ready + ready * (1 - qa) * (1 - qw))
    )
    return F.greatest(F.lit(1e-12), F.least(F.lit(1.0), answer * present))


def pattern_posterior(model: PatternModel, risk: Column) -> Column:
    one = model.pi * pattern_probability(model, True, risk)
    zero = (1 - model.pi) * pattern_probability(model, False, risk)
    share = one / F.greatest(one + zero, F.lit(1e-300))
    return F.greatest(F.lit(SMALL), F.least(F.lit(1 - SMALL), share))


def posterior_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Posterior quality against the truth: needs truth, posterior, reference, l1_proxy, l2_proxy (doubles)."""
    t, p = F.col("truth"), F.col("posterior")
    clipped = F.greatest(F.lit(SMALL), F.least(F.lit(1 - SMALL), p))

    def residual(value: str) -> Column:
        return F.coalesce(F.var_samp(t - F.col(value)), F.lit(0.0))

    def ratio(value: str) -> Column:
        return F.when(F.col(value) > 1e-15, F.col("residual_variance") / F.col(value))

    base = df.groupBy(*by).agg(
        F.avg((t - p) * (t - p)).alias("brier"),
        F.avg((t - F.col("reference")) * (t - F.col("reference"))).alias("_reference_brier"),
        (-F.avg(t * F.ln(clipped) + (1 - t) * F.ln(1 - clipped))).alias("log_loss"),
        F.avg(p - t).alias("calibration_bias"),
        residual("posterior").alias("residual_variance"),
        residual("l1_proxy").alias("_l1"),
        residual("l2_proxy").alias("_l2"),
        F.avg(p).alias("probability_mean"),
        F.stddev_samp(p).alias("probability_sd"),
    )
    return base.select(
        *by, "brier", (F.col("brier") - F.col("_reference_brier")).alias("brier_regret"), "log_loss", "calibration_bias",
        "residual_variance", "probability_mean", "probability_sd", ratio("_l1").alias("size_ratio_vs_l1"),
        ratio("_l2").alias("size_ratio_vs_l2"), (1 - ratio("_l1")).alias("variance_reduction_vs_l1"),
        (1 - ratio("_l2")).alias("variance_reduction_vs_l2"),
    )


def ppc_rate_error(outcomes: DataFrame, accuracy: Accuracy, pi: float) -> DataFrame:
    """Largest gap between the observed and the expected positive rate of a source."""
    expected = {s: pi * se + (1 - pi) * (1 - sp) for s, (se, sp) in accuracy.items()}
    rates = (
        outcomes.filter(F.col("outcome").isNotNull() & F.col("source_id").isin(*accuracy))
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("observed_count"), F.avg(F.col("outcome").cast("double")).alias("observed_rate"))
    )
    gap = F.abs(F.col("observed_rate") - lookup(expected, F.col("source_id")))
    return rates.agg(F.max(gap).alias("rate_error"), F.sum("observed_count").alias("observed_count"))


def latent_risk(
    wide: DataFrame, scenarios: Mapping[str, float], fits: Mapping[float, Sequence[Mapping[str, Mapping]]],
    channels: Mapping[str, str],
) -> DataFrame:
    """Risk per (scenario, parameter draw, row) from frozen fits; a scenario without a fit gives no rows.

    ``scenarios`` maps a scenario to its prevalence, and ``fits`` a prevalence to its parameter
    draws (accuracy and channel effect sizes). Prevalences match within 1e-12.
    """
    cells = []
    for scenario, pi in scenarios.items():
        draws = next((d for fitted, d in fits.items() if abs(fitted - pi) <= 1e-12), ())
        for i, draw in enumerate(draws):
            risk = quadrature_posterior(channels, draw["accuracy"], draw["sd"], pi)
            cells.append(F.struct(F.lit(scenario).alias("scenario_id"), F.lit(i).alias("draw"), risk.alias("risk")))
    if not cells:
        raise ValueError("no scenario has a fitted prevalence")
    return wide.select(*KEY, F.explode(F.array(*cells)).alias("_r")).select(*KEY, "_r.*")
