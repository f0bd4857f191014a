"""Ranking, calibration, cost and bootstrap metrics on scored rows.

Scored rows carry: entity_id, period, prediction (double), outcome (boolean). Positions come
from distributed running sums, so a model that holds most of the rows is still spread out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.draws import hash_number
from paneloom.functions.grid import registry, with_grid
from paneloom.operators.ranking import attach, average_ranks, cut, positions, quantile_rows, running, value_counts, with_average_rank
from paneloom.operators.resample import paired_samples, replicate_precision, replicate_sums

KEY = ["entity_id", "period"]


def _hit() -> Column:
    return F.col("outcome").cast("long")


def ranked(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Position and running hits by falling score; equal scores go by key, so the order is total."""
    return running(
        df, by, [("prediction", False), ("entity_id", True), ("period", True)],
        {"position": F.lit(1).cast("long"), "hits": _hit()},
    )


def average_precision(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean precision at the positives; unknown when there are none."""
    gain = F.when(F.col("outcome"), F.col("hits") / F.col("position"))
    return ranked(df, by).groupBy(*by).agg((F.sum(gain) / F.nullif(F.sum(_hit()), F.lit(0))).alias("average_precision"))


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum AUC with ties at one half. Works on distinct scores, not on row pairs."""
    return _rank_sum(value_counts(df, by, "prediction", {"hits": F.sum(_hit())}), by)


def roc_auc_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from (by, prediction, rows, hits), one row per distinct score of a group."""
    return _rank_sum(with_average_rank(counts, by, "prediction"), by)


def _rank_sum(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    sums = scores.groupBy(*by).agg(
        F.sum("hits").alias("p"), F.sum("rows").alias("n"), F.sum(F.col("hits") * F.col("average_rank")).alias("r")
    )
    p, n = F.col("p").cast("double"), F.col("n").cast("double")  # pair counts pass 64 bits
    return sums.select(*by, F.try_divide(F.col("r") - p * (p + 1) / 2, p * (n - p)).alias("roc_auc"))


def brier(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    gap = F.col("outcome").cast("double") - F.col("prediction")
    return df.groupBy(*by).agg(F.avg(gap * gap).alias("brier"))


def precision_at(df: DataFrame, fraction: float, by: Sequence[str] = ()) -> DataFrame:
    """Precision among the top max(1, ceil(n x fraction)) rows."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must lie in (0, 1]")
    rows = positions(df, by, [("prediction", False), ("entity_id", True), ("period", True)], totals=True)
    size = F.greatest(F.lit(1), F.ceil(F.col("position_total") * F.lit(fraction)))
    top = rows.withColumn("review_count", size).filter("position <= review_count")
    return top.groupBy(*by).agg(
        F.max("review_count").alias("review_count"), (F.sum(_hit()) / F.max("review_count")).alias("precision")
    )


def scored_summary(df: DataFrame, fraction: float, by: Sequence[str]) -> DataFrame:
    """Average precision, AUC, Brier and precision at a fraction, one row per group."""
    ranks = running(
        df, by, [("prediction", False), ("entity_id", True), ("period", True)],
        {"position": F.lit(1).cast("long"), "hits": _hit()}, totals=True,
    )
    k = F.greatest(F.lit(1), F.ceil(F.col("position_total") * F.lit(fraction)))
    gap = F.col("outcome").cast("double") - F.col("prediction")
    top = ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(_hit()).alias("positive_count"),
        F.avg(gap * gap).alias("brier"),
        (F.sum(F.when(F.col("outcome"), F.col("hits") / F.col("position"))) / F.nullif(F.sum(_hit()), F.lit(0))).alias(
            "average_precision"
        ),
        (F.count_if(F.col("outcome") & (F.col("position") <= k)) / F.max(k)).alias("precision_at"),
    )
    return attach(top, roc_auc(df, by), list(by))


def calibrated(scores: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Platt-scaled scores: model_id, intercept and slope come from the fitted table (one row per model)."""
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("prediction")))
    linear = F.col("intercept") + F.col("slope") * F.ln(clipped / (1 - clipped))
    return (
        attach(scores, coefficients, ["model_id"])
        .withColumn("prediction", 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), linear)))))
        .drop("intercept", "slope")
    )


# ------------------------------------------------------------- pairs


def pairing_audit(predictions: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Support of each candidate-reference pair: matched, one-sided and repeated keys, and the verdict."""
    rows = [{"candidate": c, "reference": r} for c, r in pairs.items()]
    members = with_grid(
        predictions.groupBy("model_id", *KEY).agg(F.count(F.lit(1)).alias("_copies")),
        rows, {"candidate": "string", "reference": "string"},
    ).filter("model_id = candidate OR model_id = reference")
    sides = members.groupBy("candidate", "reference", *KEY).agg(
        F.bool_or(F.col("model_id") == F.col("candidate")).alias("left"),
        F.bool_or(F.col("model_id") == F.col("reference")).alias("right"),
        F.count_if(F.col("_copies") > 1).alias("repeated"),
    )
    counts = sides.groupBy("candidate", "reference").agg(
        F.count_if(F.col("left") & F.col("right")).alias("paired_count"),
        F.count_if(~F.col("right")).alias("candidate_only_count"),
        F.count_if(~F.col("left")).alias("reference_only_count"),
        F.sum("repeated").alias("duplicate_count"),
    )
    wanted = registry(predictions.sparkSession, rows, {"candidate": "string", "reference": "string"})
    joined = wanted.join(counts, ["candidate", "reference"], "left").na.fill(0)
    broken = F.col("candidate_only_count") + F.col("reference_only_count") + F.col("duplicate_count")
    return joined.withColumn(
        "status", F.when((broken == 0) & (F.col("paired_count") > 0), "PASS").otherwise("PAIRED_COMPARISON_BLOCKED")
    )


def paired_delta(df: DataFrame, pairs: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Average-precision difference of candidate and reference; unequal support is unknown."""
    scores = average_precision(df, [*by, "model_id"])
    sizes = df.groupBy(*by, "model_id").agg(F.count(F.lit(1)).alias("n"))
    table = scores.join(sizes, [*by, "model_id"])
    wanted = with_grid(table, [{"candidate": c, "reference": r} for c, r in pairs.items()],
                       {"candidate": "string", "reference": "string"})
    first, second = F.col("model_id") == F.col("candidate"), F.col("model_id") == F.col("reference")
    wide = wanted.groupBy(*by, "candidate", "reference").agg(
        F.max(F.when(first, F.col("average_precision"))).alias("candidate_ap"),
        F.max(F.when(second, F.col("average_precision"))).alias("reference_ap"),
        F.max(F.when(first, F.col("n"))).alias("_n1"),
        F.max(F.when(second, F.col("n"))).alias("_n2"),
    )
    same = F.col("_n1") == F.col("_n2")
    return wide.select(
        *by, "candidate", "reference", "candidate_ap", "reference_ap",
        F.when(same, F.col("candidate_ap") - F.col("reference_ap")).alias("delta"),
    )


# ------------------------------------------------------------- bootstrap


def multiplicities(units: DataFrame, replications: int, seed: str) -> DataFrame:
    """How often each unit is drawn in each replicate: n draws of n with replacement.

    ``units`` has a dense 0-based ``unit`` and the unit count ``n``. Draw i of replicate r picks
    hash(seed, r, i) mod n, so the result does not depend on partitioning or retries.
    """
    reps = F.explode(F.sequence(F.lit(0), F.lit(replications - 1))).alias("rep")
    draws = units.select(reps, "unit", "n").select(
        "rep", F.pmod(hash_number(seed, F.col("rep"), F.col("unit")), F.col("n")).alias("unit")
    )
    return draws.groupBy("rep", "unit").agg(F.count(F.lit(1)).alias("times"))


def bootstrap_units(df: DataFrame) -> DataFrame:
    """Dense index over the entities: an entity is drawn with all its periods."""
    keys = df.select("entity_id").distinct()
    placed = positions(keys, [], [("entity_id", True)], "_position")
    size = keys.agg(F.count(F.lit(1)).alias("n"))
    return attach(placed.select("entity_id", (F.col("_position") - 1).alias("unit")), size, [])


def bootstrap_rows(df: DataFrame, replications: int, seed: str) -> DataFrame:
    """Scored rows per replicate with their multiplicity; both models of a pair share the draws."""
    units = cut(bootstrap_units(df))
    times = multiplicities(units.select("unit", "n"), replications, seed)
    return df.join(units, "entity_id").join(times, "unit").drop("unit", "n")


def bootstrap_delta(
    df: DataFrame, candidate: str, reference: str, replications: int, level: float, seed: str
) -> DataFrame:
    """Replicate differences of average precision; unknown where a replicate has no positive.

    Replicates are arrays of a row, not rows of their own (``resample``).
    """
    rows = df.filter(F.col("model_id").isin(candidate, reference))
    return paired_samples(replicate_precision(rows, [], replications, seed), {candidate: reference}).select("rep", "delta")


def interval(samples: DataFrame, value: str, level: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean and percentile interval; the samples number the configured replications."""
    alpha = (1 - level) / 2
    return samples.groupBy(*by).agg(
        F.count(value).alias("valid_replications"),
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(alpha)).alias("lower"),
        F.percentile(value, F.lit(1 - alpha)).alias("upper"),
    )


# ------------------------------------------------------------- agreement with a soft target


#: Whole numbers beyond 64 bits: factors of a pair count, and pair counts.
PAIRS, COUNT = "decimal(19,0)", "decimal(38,0)"


def concordance(df: DataFrame, target: str, score: str) -> DataFrame:
    """Share of pairs with different targets that the score orders the same way; score ties count half.

    Pairs are never formed. Scores become dense ranks; two ranks first differ at one bit, so a
    pair is counted once, at the (level, higher bits) cell where its bits part: rows with bit 0
    and a smaller target before rows with bit 1. One running sum counts all levels.
    """
    cells = df.filter(F.col(target).isNotNull() & F.col(score).isNotNull()).groupBy(
        F.col(target).alias("t"), F.col(score).alias("s")
    ).agg(F.count(F.lit(1)).alias("c"))
    cells = cut(cells)
    dense = positions(cells.select("s").distinct(), [], [("s", True)], "rank")
    rows = cut(cells.join(dense.withColumn("rank", F.col("rank") - 1), "s"))
    highest = rows.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("m")).first()["m"]
    levels = max(1, int(highest).bit_length())
    bits = rows.select("t", "c", "rank", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    bit = F.expr("shiftright(rank, level)").bitwiseAND(F.lit(1))
    per_target = bits.groupBy("level", F.expr("shiftright(rank, level + 1)").alias("prefix"), "t").agg(
        F.sum(F.when(bit == 0, F.col("c")).otherwise(0)).alias("zeros"),
        F.sum(F.when(bit == 1, F.col("c")).otherwise(0)).alias("ones"),
    )
    upto = running(per_target, ["level", "prefix"], [("t", True)], {"zeros_upto": F.col("zeros")})
    smaller = (F.col("zeros_upto") - F.col("zeros")).cast(PAIRS)
    ordered = upto.agg(F.sum((F.col("ones").cast(PAIRS) * smaller).cast(COUNT)).cast(COUNT).alias("ordered"))

    def unlike_pairs(inner: str) -> Column:
        count = F.col(inner).cast(PAIRS)
        whole = F.sum(inner).cast(PAIRS)
        return ((whole * whole).cast(COUNT) - F.sum((count * count).cast(COUNT)).cast(COUNT)).cast(COUNT)

    per_t = rows.groupBy("t").agg(F.sum("c").alias("c"))
    comparable = per_t.agg(unlike_pairs("c").alias("comparable"))
    tied = rows.groupBy("s").agg(unlike_pairs("c").alias("tied")).agg(F.sum("tied").cast(COUNT).alias("tied"))
    one_row = F.lit(True)
    whole = comparable.join(F.broadcast(ordered), one_row).join(F.broadcast(tied), one_row)
    return whole.select(
        (F.col("comparable") / 2).cast(COUNT).alias("comparable_pairs"),  # each pair was counted from both ends
        F.try_divide(
            F.col("ordered").cast("double") + F.col("tied").cast("double") / 4, F.col("comparable").cast("double") / 2
        ).alias("concordance"),
    )


def spearman(df: DataFrame, left: str, right: str) -> DataFrame:
    """Correlation of average ranks over rows where both are known; unknown without variation."""
    rows = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(
        F.col(left).alias("_l"), F.col(right).alias("_r")
    )
    ranks = average_ranks(average_ranks(rows, [], "_l", "_lr"), [], "_r", "_rr")
    varied = (F.stddev_pop("_lr") > 0) & (F.stddev_pop("_rr") > 0)
    return ranks.agg(F.when(varied, F.corr("_lr", "_rr")).alias("spearman"))


def soft_log_loss(df: DataFrame, target: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    s = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(score)))
    t = F.col(target)
    return df.groupBy(*by).agg((-F.avg(t * F.ln(s) + (1 - t) * F.ln(1 - s))).alias("soft_log_loss"))


def track_metrics(df: DataFrame, target: str = "target_value", score: str = "prediction") -> DataFrame:
    """Soft log-loss, rank correlation and concordance of scores with a soft target."""
    rows = df.filter(F.col(target).isNotNull())
    one_row = F.lit(True)
    return (
        soft_log_loss(rows, target, score)
        .join(F.broadcast(spearman(rows, target, score)), one_row)
        .join(F.broadcast(concordance(rows, target, score)), one_row)
    )


# ------------------------------------------------------------- utility and cost

UTILITY = {
    "scenario_id": "string", "true_positive_benefit": "double", "review_cost": "double",
    "false_positive_cost": "double", "false_negative_cost": "double", "review_fraction": "double",
}


def _utility_sums(df: DataFrame, by: Sequence[str], units: Column, risk: Column, size: str) -> DataFrame:
    """Utility of reviewing ``units`` copies of each row on latent risk."""
    sums = df.groupBy(*by, *UTILITY).agg(
        F.max("_k").alias("reviewed_cases"),
        F.sum(units * risk).alias("expected_true_positives"),
        F.sum(units * (1 - risk)).alias("expected_false_positives"),
        F.sum((F.col(size) - units) * risk).alias("expected_false_negatives"),
    )
    net = (
        F.col("true_positive_benefit") * F.col("expected_true_positives")
        - F.col("false_positive_cost") * F.col("expected_false_positives")
        - F.col("false_negative_cost") * F.col("expected_false_negatives")
        - F.col("review_cost") * F.col("reviewed_cases")
    )
    return sums.select(
        *by, "scenario_id", "reviewed_cases", "expected_true_positives", "expected_false_positives", "expected_false_negatives",
        net.alias("net_utility"),
    )


def _review_size(count: Column) -> Column:
    return F.least(count, F.greatest(F.lit(1), F.ceil(count * F.col("review_fraction"))))


def utility(df: DataFrame, scenarios: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Expected net utility per (model, scenario) of reviewing the top scores; needs a ``risk`` column.

    A scenario with a missing risk is reported with its reason instead of a value.
    """
    rows = positions(df, ["model_id"], [("prediction", False), ("entity_id", True), ("period", True)])
    sizes = df.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("risk").isNull()).alias("_missing")
    )
    grid = with_grid(attach(rows, sizes, ["model_id"]), scenarios, UTILITY).withColumn("_k", _review_size(F.col("_n")))
    reviewed = (F.col("position") <= F.col("_k")).cast("int")
    result = _utility_sums(grid.withColumn("_one", F.lit(1)), ["model_id"], reviewed, F.col("risk"), "_one")
    checked = attach(result, sizes.select("model_id", "_missing"), ["model_id"])
    ok = F.col("_missing") == 0
    values = ["expected_true_positives", "expected_false_positives", "expected_false_negatives", "net_utility"]
    return checked.select(
        "model_id", "scenario_id", "reviewed_cases", *[F.when(ok, F.col(v)).alias(v) for v in values],
        F.when(ok, "PASS").otherwise("LATENT_RISK_MISSING").alias("status"),
    )


def utility_replicates(df: DataFrame, scenarios: Sequence[Mapping[str, Any]], draws: int, replications: int, seed: str) -> DataFrame:
    """Net utility per (model, scenario, replicate).

    ``df`` has risk as an array with one value per parameter draw; each replicate takes one draw
    by hash. Candidate and reference share the resample and the draw. An unknown risk counts nowhere.
    """
    pick = np.array([int(hashlib.md5(f"{seed}:draw:{r}".encode()).hexdigest()[:15], 16) % draws for r in range(replications)])

    def visit(rows: pa.RecordBatch, times: np.ndarray, before: np.ndarray, _: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        values = np.array([[np.nan if x is None else x for x in (v or [None] * draws)] for v in rows.column("risk").to_pylist()], float)
        risk = values[:, pick]
        out = {}
        for i, s in enumerate(scenarios):
            size = np.minimum(n, np.maximum(1, np.ceil(n * s["review_fraction"])))
            units = np.clip(size - before, 0, times)
            out[f"tp{i}"], out[f"fp{i}"] = np.nansum(units * risk, 0), np.nansum(units * (1 - risk), 0)
            out[f"fn{i}"] = np.nansum((times - units) * risk, 0)
            out[f"k{i}"] = np.zeros(replications)
            if (before[0] == 0).all():  # the first rows of a model bring the size, once
                out[f"k{i}"] = size
        return out

    names = [f"{part}{i}" for i in range(len(scenarios)) for part in ("tp", "fp", "fn", "k")]
    found = replicate_sums(df, [], replications, seed, visit, names, ["risk"])
    wide = found.groupBy("model_id").agg(*[F.max_by("sums", F.col("name") == n).alias(n) for n in names])
    whole = None
    for i, s in enumerate(scenarios):
        each = F.posexplode(F.arrays_zip(*[F.col(f"{p}{i}").alias(p) for p in ("tp", "fp", "fn", "k")])).alias("rep", "v")
        net = (
            s["true_positive_benefit"] * F.col("v.tp") - s["false_positive_cost"] * F.col("v.fp") - s["false_negative_cost"] * F.col("v.fn")
            - s["review_cost"] * F.col("v.k")
        )
        part = wide.select("model_id", F.lit(s["scenario_id"]).alias("scenario_id"), each).select(
            "model_id", "rep", "scenario_id", F.col("v.k").cast("long").alias("reviewed_cases"), F.col("v.tp").alias("expected_true_positives"),
            F.col("v.fp").alias("expected_false_positives"), F.col("v.fn").alias("expected_false_negatives"), net.alias("net_utility"),
        )
        whole = part if whole is None else whole.unionByName(part)
    return whole


def utility_bootstrap(
    df: DataFrame, scenarios: Sequence[Mapping[str, Any]], pairs: Mapping[str, str], draws: int, replications: int,
    level: float, seed: str,
) -> DataFrame:
    """Net and incremental utility intervals per (candidate, scenario)."""
    samples = utility_replicates(df, scenarios, draws, replications, seed)
    grid = with_grid(samples, [{"candidate": c, "reference": r} for c, r in pairs.items()],
                     {"candidate": "string", "reference": "string"})
    wide = grid.groupBy("candidate", "reference", "scenario_id", "rep").agg(
        F.max(F.when(F.col("model_id") == F.col("candidate"), F.col("net_utility"))).alias("net"),
        F.max(F.when(F.col("model_id") == F.col("reference"), F.col("net_utility"))).alias("other"),
    )
    wide = wide.withColumn("gain", F.col("net") - F.col("other"))
    by = ["candidate", "reference", "scenario_id"]
    net = interval(wide, "net", level, by).withColumnsRenamed({"lower": "net_lower", "upper": "net_upper"}).drop("mean")
    gain = interval(wide, "gain", level, by).withColumnsRenamed({"lower": "gain_lower", "upper": "gain_upper"})
    return net.join(gain.drop("mean", "valid_replications"), by)


COSTS = {
    "regime_id": "string", "review_cost": "double", "false_positive_cost": "double",
    "false_negative_cost": "double", "true_positive_benefit": "double",
}


def bayes_threshold() -> Column:
    top = F.col("false_positive_cost") + F.col("review_cost")
    bottom = F.col("false_positive_cost") + F.col("false_negative_cost") + F.col("true_positive_benefit")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), top / F.greatest(bottom, F.lit(1e-12))))


def _cost(tp: Column, fp: Column, fn: Column) -> Column:
    return (
        (tp + fp) * F.col("review_cost")
        + fp * F.col("false_positive_cost")
        + fn * F.col("false_negative_cost")
        - tp * F.col("true_positive_benefit")
    )


def threshold_cost(df: DataFrame, regimes: Sequence[Mapping[str, Any]], threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Cost of flagging scores at or above a threshold, with regret against the per-row oracle.

    Rows are counted once; the regimes are applied to the counts.
    """
    flagged, truth = F.col("prediction") >= threshold, F.col("outcome")
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(truth).alias("p"),
        F.count_if(truth & flagged).alias("tp"),
        F.count_if(~truth & flagged).alias("fp"),
        F.count_if(truth & ~flagged).alias("fn"),
    )
    rows = with_grid(counts, regimes, COSTS)
    oracle = F.col("p") * F.least(
        F.col("review_cost") - F.col("true_positive_benefit"), F.col("false_negative_cost")
    ) + (F.col("n") - F.col("p")) * F.least(F.col("review_cost") + F.col("false_positive_cost"), F.lit(0.0))
    rows = rows.withColumns(
        {
            "total_cost": _cost(F.col("tp"), F.col("fp"), F.col("fn")),
            "_none": F.col("p") * F.col("false_negative_cost"),
            "_oracle": oracle,
        }
    )
    gap = F.col("total_cost") - F.col("_oracle")
    return rows.select(
        *by, "regime_id", "total_cost", (F.col("total_cost") / F.greatest(F.col("n"), F.lit(1))).alias("cost_per_row"),
        (gap / F.greatest(F.abs(F.col("_none") - F.col("_oracle")), F.lit(1e-12))).alias("normalized_regret"),
        (F.col("_none") - F.col("total_cost")).alias("savings_vs_none"), gap.alias("regret"),
        ((F.col("tp") + F.col("fp")) * F.col("review_cost")).alias("review_component"),
        (F.col("fp") * F.col("false_positive_cost")).alias("false_positive_component"),
        (F.col("fn") * F.col("false_negative_cost")).alias("false_negative_component"),
        (F.col("tp") * F.col("true_positive_benefit")).alias("benefit_component"),
    )


def budget_cost(
    df: DataFrame, fractions: Sequence[float], regimes: Sequence[Mapping[str, Any]], by: Sequence[str] = ()
) -> DataFrame:
    """Cost of reviewing the top fraction. The best possible review of the same size is closed-form:
    savings take two values, one for positives and one for negatives."""
    rows = running(
        df, by, [("prediction", False), ("entity_id", True), ("period", True)], {"position": F.lit(1).cast("long"), "hits": _hit()},
        totals=True,
    ).withColumnsRenamed({"position_total": "n", "hits_total": "p"})
    grid = with_grid(rows, [{"fraction": f} for f in fractions], {"fraction": "double"})
    k = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.col("n") * F.col("fraction"))))
    counts = grid.groupBy(*by, "fraction", "n", "p").agg(
        F.count_if(F.col("outcome") & (F.col("position") <= k)).alias("tp"), F.max(k).alias("k")
    )
    table = with_grid(counts, regimes, COSTS)
    tp, fp, fn = F.col("tp"), F.col("k") - F.col("tp"), F.col("p") - F.col("tp")
    positive_first = (
        F.col("false_negative_cost") - F.col("review_cost") + F.col("true_positive_benefit")
        >= -F.col("review_cost") - F.col("false_positive_cost")
    )
    negatives = F.col("n") - F.col("p")
    best_tp = F.when(positive_first, F.least(F.col("k"), F.col("p"))).otherwise(F.greatest(F.lit(0), F.col("k") - negatives))
    oracle = _cost(best_tp, F.col("k") - best_tp, F.col("p") - best_tp)
    table = table.withColumns(
        {"total_cost": _cost(tp, fp, fn), "_oracle": oracle, "_none": F.col("p") * F.col("false_negative_cost")}
    )
    gap = F.col("total_cost") - F.col("_oracle")
    return table.select(
        *by, "fraction", "regime_id", F.col("k").alias("review_count"), "total_cost", gap.alias("regret"),
        (gap / F.greatest(F.abs(F.col("_none") - F.col("_oracle")), F.lit(1e-12))).alias("normalized_regret"),
        (F.col("_none") - F.col("total_cost")).alias("savings_vs_none"),
        (tp / F.greatest(F.col("k"), F.lit(1))).alias("precision"),
        (tp / F.greatest(F.col("p"), F.lit(1))).alias("recall"),
    )


def select_threshold(df: DataFrame, regimes: Sequence[Mapping[str, Any]], steps: int = 101) -> DataFrame:
    """Cheapest threshold among score quantiles, 0, one half, 1 and the Bayes threshold; needs ``weight``.

    Rows are counted into the gaps between the sorted candidates (a bounded list), and suffix sums
    over the gaps give the cost at every candidate. Cost ties go to the threshold nearest Bayes.
    """
    rows = df.filter("prediction IS NOT NULL AND NOT isnan(prediction) AND weight > 0")
    cuts = quantile_rows(rows, [], "prediction", [i / (steps - 1) for i in range(steps)])
    table = registry(df.sparkSession, regimes, COSTS).withColumn("bayes", bayes_threshold())
    lists = table.join(F.broadcast(cuts.agg(F.collect_set("quantile").alias("_q"))), F.lit(True)).withColumn(
        "_c", F.array_sort(F.array_distinct(F.concat("_q", F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0), F.col("bayes")))))
    )
    lists = cut(lists)
    totals = rows.agg(F.count(F.lit(1)).alias("_n"), F.count_if("outcome").alias("_p"))
    # regimes are configuration and each list has about a hundred entries
    placed = rows.join(F.broadcast(lists.select("regime_id", "_c")), F.lit(True)).select(
        "regime_id", F.size(F.filter("_c", lambda c: c <= F.col("prediction"))).alias("_gap"), "outcome", "weight"
    )
    sums = placed.groupBy("regime_id", "_gap").agg(
        F.sum(F.when(F.col("outcome"), F.col("weight")).otherwise(0.0)).alias("_pos"),
        F.sum(F.when(F.col("outcome"), 0.0).otherwise(F.col("weight"))).alias("_neg"),
    )
    gaps = sums.groupBy("regime_id").agg(F.collect_list(F.struct("_gap", "_pos", "_neg")).alias("_s"))
    points = lists.join(gaps, "regime_id").select("*", F.posexplode("_c").alias("_i", "threshold"))

    def total(field: str, flagged: bool) -> Column:
        return F.aggregate(
            "_s", F.lit(0.0),
            lambda acc, g: acc + F.when((g["_gap"] > F.col("_i")) == F.lit(flagged), g[field]).otherwise(0.0),
        )

    cost = _cost(total("_pos", True), total("_neg", True), total("_pos", False))
    costed = points.withColumn("cost", cost).select("regime_id", "bayes", "threshold", "cost")
    least = costed.groupBy("regime_id").agg(F.min("cost").alias("_least"))
    best = costed.join(least, "regime_id").filter(F.col("cost") <= F.col("_least") + 1e-12)
    chosen = best.groupBy("regime_id", "bayes").agg(
        F.min_by("threshold", F.struct(F.abs(F.col("threshold") - F.col("bayes")), "threshold")).alias("_t"),
        F.min("cost").alias("cost"),
    )
    enough = (F.col("_n") >= 10) & (F.col("_p") > 0) & (F.col("_p") < F.col("_n"))
    return chosen.join(F.broadcast(totals), F.lit(True)).select(
        "regime_id",
        F.when(enough, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_t")))).otherwise(F.col("bayes")).alias("threshold"),
        enough.alias("searched"),
        F.when(enough, F.col("cost")).alias("cost"),
    )
