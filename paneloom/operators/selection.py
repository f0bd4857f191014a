"""Measurement selection on development history: channel holdout, refit grids and calibration."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.functions.grid import registry, with_grid
from paneloom.operators.fits import ONE_CLASS, OPEN, Cell, SharedFits
from paneloom.operators.nested import members
from paneloom.operators.ranking import attach, cut

KEY = ["entity_id", "period"]
#: Losses that differ by no more are equal: sums of one model's terms differ in their last digits by their order.
EQUAL = 1e-9


def clipped(p: Column, eps: float) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def cross_entropy(target: Column, p: Column) -> Column:
    return -(target * F.ln(p) + (1 - target) * F.ln(1 - p))


def channel_holdout_ce(channels: DataFrame, outer_year: int, minimum_channels: int) -> DataFrame:
    """Cross-entropy of each held channel against the mean score of the others, earlier periods only.

    The mean of the others is (total - own) / (count - 1), so no channel pairs are formed. A held
    channel without an own score takes the whole total. Needs channel_id, outcome, channel_score.
    """
    rows = channels.filter(F.col("period") < outer_year)
    totals = rows.groupBy(*KEY).agg(F.sum("channel_score").alias("_sum"), F.count("channel_score").alias("_n"))
    own = F.coalesce(F.col("channel_score"), F.lit(0.0))
    left = F.col("_n") - F.col("channel_score").isNotNull().cast("int")
    joined = rows.filter("outcome IS NOT NULL").join(totals, KEY).filter(left >= minimum_channels).filter(left > 0)
    p = clipped((F.col("_sum") - own) / left, 1e-6)
    scored = joined.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg(cross_entropy(F.col("outcome").cast("double"), p)).alias("cross_entropy")
    )
    every = rows.select("channel_id").distinct()
    return every.join(scored, "channel_id", "left").na.fill(0, ["row_count"])


def holdout_objective(holdout: DataFrame, candidate: str) -> DataFrame:
    """Mean over channels; eligible only if every channel has rows."""
    complete = F.coalesce(F.bool_and(F.col("row_count") > 0), F.lit(False))
    return holdout.agg(complete.alias("eligible"), F.avg("cross_entropy").alias("_o")).select(
        F.lit(candidate).alias("candidate"), "eligible", F.when(F.col("eligible"), F.col("_o")).alias("objective"),
        F.when(~F.col("eligible"), "INSUFFICIENT_CHANNELS").alias("reason"),
    )


def select_candidate(results: DataFrame, order: Sequence[str]) -> DataFrame:
    """Eligible candidate with the smallest objective (first in order on ties), else none."""
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("candidate"))
    usable = F.col("eligible") & F.col("objective").isNotNull()
    best = F.min_by(F.when(usable, F.col("candidate")), F.when(usable, F.struct(F.col("objective"), rank)))
    return results.agg(best.alias("_b")).select(
        F.coalesce("_b", F.lit("none")).alias("selected"),
        F.when(F.col("_b").isNull(), "NO_ELIGIBLE_CANDIDATE").alias("reason"),
    )


# ------------------------------------------------------------- calibration


def _coefficients(spark: SparkSession, rows: Sequence[Mapping]) -> DataFrame:
    types = {"model_id": "string", "intercept": "double", "slope": "double", "status": "string"}
    return registry(spark, rows, {c: t for c, t in types.items() if c in rows[0]})


def soft_platt(df: DataFrame, target: str = "target_value") -> DataFrame:
    """Intercept and slope on the logit of the score, fitted to a soft target; identity without variation."""
    return _coefficients(df.sparkSession, [{k: v for k, v in r.items() if k != "model_id"} for r in _soft_fits(df, target, [None], F.lit(0))])


def soft_platt_by_model(df: DataFrame, target: str = "target_value") -> DataFrame:
    """``soft_platt`` of every model_id; the models share the passes of one fit."""
    models = [r["model_id"] for r in df.select("model_id").distinct().orderBy("model_id").collect()]
    if not models:
        return soft_platt(df).select(F.lit("").alias("model_id"), "*").limit(0)
    number = F.coalesce(*[F.when(F.col("model_id").eqNullSafe(F.lit(m)), F.lit(i)) for i, m in enumerate(models)])
    return _coefficients(df.sparkSession, _soft_fits(df, target, models, number))


def _soft_fits(df: DataFrame, target: str, models: Sequence, number: Column) -> list[dict]:
    s = clipped(F.col("prediction"), 1e-6)
    rows = df.filter(F.col(target).isNotNull() & F.col("prediction").isNotNull()).select(
        F.ln(s / (1 - s)).alias("x"), F.lit(1.0).alias("weight"), F.array(number.cast("int")).alias("sets"), F.array(F.col(target).cast("double")).alias("labels")
    )
    fits = SharedFits(cut(rows), [Cell(str(i), i, ("x",), 0, 0.0) for i in range(len(models))], steps=100)
    out = []
    for i, model in enumerate(models):
        fit = fits.fits[str(i)]
        if fit.raw is None:
            status = "IDENTITY_INSUFFICIENT_TARGET_VARIATION" if fit.status == ONE_CLASS else "IDENTITY_NONCONVERGENCE"
            out.append({"model_id": model, "intercept": 0.0, "slope": 1.0, "status": status})
            continue
        slope = float(fit.raw[1] / fits.spread[0])
        out.append({"model_id": model, "intercept": float(fit.raw[0]) - slope * float(fits.middle[0]), "slope": slope, "status": "SOFT_PLATT"})
    return out


def hard_platt(df: DataFrame, inverse_regularization: float = 1.0) -> DataFrame:
    """Platt coefficients per model_id from 0/1 outcomes; identity for a model without both classes."""
    spark = df.sparkSession
    rows = df.filter("outcome IS NOT NULL AND prediction IS NOT NULL")
    counts = rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("outcome").cast("int")).alias("p")).collect()
    fitted = []
    for row in sorted(counts, key=lambda r: r["model_id"]):
        if row["p"] in (0, row["n"]):
            fitted.append({"model_id": row["model_id"], "intercept": 0.0, "slope": 1.0, "status": "IDENTITY_INSUFFICIENT_CLASSES"})
            continue
        s = clipped(F.col("prediction"), 1e-6)
        mine = rows.filter(F.col("model_id") == row["model_id"]).select(
            F.ln(s / (1 - s)).alias("x"), F.col("outcome").cast("double").alias("label")
        )
        vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(mine).persist()
        try:
            model = LogisticRegression(
                regParam=1 / (inverse_regularization * row["n"]), standardization=False, maxIter=200, tol=1e-10
            ).fit(vectors)
        finally:
            vectors.unpersist()
        fitted.append(
            {"model_id": row["model_id"], "intercept": float(model.intercept), "slope": float(model.coefficients[0]), "status": "PLATT"}
        )
    return _coefficients(spark, fitted)


def apply_platt(prediction: Column, intercept: Column, slope: Column) -> Column:
    s = clipped(prediction, 1e-6)
    linear = intercept + slope * F.ln(s / (1 - s))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), linear))))


# ------------------------------------------------------------- refit cells


def score_cell(oof: DataFrame, targets: DataFrame, held: DataFrame) -> DataFrame:
    """One refit cell: calibrate out-of-fold scores on the soft target, then score the held outcome.

    ``oof`` has prediction, ``targets`` target_value, ``held`` outcome; all unique by key.
    """
    joined = cut(oof.select(*KEY, "prediction").join(targets.select(*KEY, "target_value"), KEY))
    table = soft_platt(joined).select("intercept", "slope")
    p = clipped(apply_platt(F.col("prediction"), F.col("intercept"), F.col("slope")), 1e-6)
    scored = attach(joined, table, []).join(held.filter("outcome IS NOT NULL").select(*KEY, "outcome"), KEY)
    return scored.agg(
        F.count(F.lit(1)).alias("row_count"), F.avg(cross_entropy(F.col("outcome").cast("double"), p)).alias("cross_entropy")
    )


def first_of_least(found: Sequence[tuple[float, int]]) -> tuple[float, int]:
    """(loss, setting) of the first setting whose loss is the smallest, up to EQUAL."""
    least = min(loss for loss, _ in found)
    return min((f for f in found if f[0] <= least + EQUAL), key=lambda f: f[1])


def nested_refit(
    panel: DataFrame, channels: DataFrame, outer_year: int, features: Mapping[str, Sequence[str]], learner: str,
    targets: Mapping[str, Callable[[DataFrame], DataFrame]], settings: Sequence[Mapping[str, Any]] = ({},),
) -> DataFrame:
    """(candidate x held channel) refits. The held channel leaves the target, the feature list (its own
    entry in ``features`` is dropped), tuning and calibration; only earlier periods are read.

    ``targets`` builds a soft target (key, target_value) from channel rows. Each cell tunes ``settings`` on
    the soft cross-entropy of its out-of-fold scores; the fits of all (cell, setting, period) share their
    passes, the cells' targets being one array of a row, and so do the calibrations. Losses within EQUAL of
    the smallest are equal, and the first such setting is taken. A setting with a fit that did not converge
    is void; a cell without a valid one has status MODEL_NONCONVERGENCE.
    """
    if learner != "logistic":
        raise ValueError("refit cells share logistic fits")
    development = cut(channels.filter(F.col("period") < outer_year))
    names = sorted(r["channel_id"] for r in development.select("channel_id").distinct().collect())  # a registry
    grid = [(candidate, held) for candidate in targets for held in names]
    if not grid:
        return registry(panel.sparkSession, [], CELL_TYPES)
    whole = None
    for i, (candidate, held) in enumerate(grid):
        part = targets[candidate](development.filter(F.col("channel_id") != held)).filter("target_value IS NOT NULL")
        part = part.select(*KEY, F.lit(i).alias("i"), F.col("target_value").cast("double").alias("y"))
        whole = part if whole is None else whole.unionByName(part)
    listed = whole.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("i", "y"))).alias("_m"))  # one entry a cell
    labels = F.transform(F.sequence(F.lit(0), F.lit(len(grid) - 1)), lambda i: F.try_element_at("_m", i))
    rows = cut(panel.filter(F.col("period") < outer_year).join(listed, KEY).withColumn("labels", labels).drop("_m"))
    years = sorted(r["period"] for r in rows.select("period").distinct().collect())[1:]
    used = {held: tuple(sorted({f for channel, fs in features.items() if channel != held for f in fs})) for held in names}
    every = sorted({f for fs in used.values() for f in fs})
    prepared = rows.select(
        *[F.col(f).cast("double").alias(f) for f in every], F.lit(1.0).alias("weight"), members(F.col("period"), years).alias("sets"), "labels"
    )
    cells = [
        Cell(f"{i}|{k}|{y}", j, used[held], i, 1 / float(p.get("C", 1.0)))
        for i, (_, held) in enumerate(grid) for k, p in enumerate(settings) for j, y in enumerate(years)
    ]
    most = {f"{i}|{k}": int(p.get("maxIter", 100)) for i in range(len(grid)) for k, p in enumerate(settings)}
    fits = SharedFits(cut(prepared.filter(F.size("sets") > 0)), cells, 100, most=most)
    void = {tuple(n.split("|")[:2]) for n, f in fits.fits.items() if f.status == OPEN}
    asked = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(len(grid) - 1)),
            lambda i: F.when(F.col("labels")[i].isNotNull(), F.array(*[F.concat_ws("|", i, F.lit(k), F.col("period")) for k in range(len(settings))]))
            .otherwise(F.array().cast("array<string>")),
        )
    )
    at = F.split("cell", r"\|")
    found = fits.score(rows, [*KEY, "labels"], asked).select(*KEY, at[0].cast("int").alias("i"), at[1].cast("int").alias("k"), "prediction", "labels")
    oof = cut(found.select(*KEY, "i", "k", "prediction", F.col("labels")[F.col("i")].alias("target_value")))
    p = clipped(F.col("prediction"), 1e-9)
    losses = oof.groupBy("i", "k").agg(F.avg(cross_entropy(F.col("target_value"), p)).alias("loss")).collect()  # one row a (cell, setting)
    tuned: dict[int, list[tuple[float, int]]] = {}
    for r in losses:
        if (str(r["i"]), str(r["k"])) not in void:
            tuned.setdefault(r["i"], []).append((r["loss"], r["k"]))
    best = {i: first_of_least(found) for i, found in tuned.items()}
    facts = [
        {"i": i, "candidate": candidate, "held_channel": held, "setting": best[i][1] if i in best else None,
         "tuning_loss": best[i][0] if i in best else None,
         "failed": None if i in best else "MODEL_NONCONVERGENCE" if any(v[0] == str(i) for v in void) else "NO_ROWS"}
        for i, (candidate, held) in enumerate(grid)
    ]
    kinds = {"i": "int", "candidate": "string", "held_channel": "string", "setting": "int", "tuning_loss": "double", "failed": "string"}
    table = registry(panel.sparkSession, facts, kinds)
    mine = cut(oof.join(F.broadcast(table.filter("failed IS NULL")), "i").filter("k = setting").withColumn("model_id", F.col("i").cast("string")))
    curve = soft_platt_by_model(mine).select(F.col("model_id").cast("int").alias("i"), "intercept", "slope")
    p = clipped(apply_platt(F.col("prediction"), F.col("intercept"), F.col("slope")), 1e-6)
    seen = development.filter("outcome IS NOT NULL").select(*KEY, F.col("channel_id").alias("held_channel"), F.col("outcome").cast("double").alias("_y"))
    scored = mine.join(F.broadcast(curve), "i").join(seen, [*KEY, "held_channel"])
    sums = scored.groupBy("i").agg(F.count(F.lit(1)).alias("row_count"), F.avg(cross_entropy(F.col("_y"), p)).alias("cross_entropy"))
    joined = attach(table, sums, ["i"]).na.fill(0, ["row_count"])
    status = F.coalesce("failed", F.when(F.col("row_count") > 0, "PASS").otherwise("NO_ROWS"))
    return joined.select(
        "candidate", "held_channel", "setting", "tuning_loss", "row_count", "cross_entropy", status.alias("status"), F.lit(0).alias("outer_rows_used")
    )


CELL_TYPES = {
    "candidate": "string", "held_channel": "string", "setting": "int", "tuning_loss": "double", "row_count": "long", "cross_entropy": "double",
    "status": "string", "outer_rows_used": "int",
}


def receipt_violations(cells: DataFrame, channels: Sequence[str], candidates: Sequence[str]) -> DataFrame:
    """Missing, repeated or failed cells of the full candidate x channel grid."""
    spark = cells.sparkSession
    wanted = with_grid(
        registry(spark, [{"candidate": c} for c in candidates], {"candidate": "string"}),
        [{"held_channel": c} for c in channels], {"held_channel": "string"},
    )
    value = F.col("cross_entropy")
    found = cells.groupBy("candidate", "held_channel").agg(
        F.count(F.lit(1)).alias("_copies"),
        F.bool_and(F.col("status") == "PASS").alias("_pass"),
        F.min("row_count").alias("_rows"),
        F.bool_and(value.isNotNull() & ~F.isnan(value)).alias("_finite"),
        F.max("outer_rows_used").alias("_outer"),
    )
    joined = wanted.join(found, ["candidate", "held_channel"], "full_outer")
    rule = (
        F.when(F.col("_copies").isNull(), "CELL_MISSING")
        .when(~F.col("held_channel").isin(*channels) | ~F.col("candidate").isin(*candidates), "CELL_UNEXPECTED")
        .when(F.col("_copies") > 1, "CELL_REPEATED")
        .when(~F.col("_pass"), "CELL_NOT_PASS")
        .when(F.col("_rows") < 1, "CELL_ROWS_INVALID")
        .when(~F.col("_finite"), "CELL_OBJECTIVE_INVALID")
        .when(F.col("_outer") > 0, "CELL_SCOPE_INVALID")
    )
    return joined.select("candidate", "held_channel", rule.alias("violation")).filter("violation IS NOT NULL")


def select_pi(scores: DataFrame, robust_fraction: float) -> DataFrame:
    """Prevalence scenario with the smallest mean held-channel loss, if enough scenarios are complete.

    ``scores`` has one row per (pi, held_channel) with cross_entropy and diagnostics_eligible.
    """
    per_pi = scores.groupBy("pi").agg(
        F.bool_and(F.col("diagnostics_eligible") & F.col("cross_entropy").isNotNull()).alias("eligible"),
        F.avg("cross_entropy").alias("objective"),
    )
    usable = F.col("eligible")
    chosen = per_pi.agg(
        F.avg(usable.cast("double")).alias("eligible_fraction"),
        F.min_by(F.when(usable, F.col("pi")), F.when(usable, F.struct("objective", "pi"))).alias("_pi"),
        F.min(F.when(usable, F.col("objective"))).alias("_objective"),
    )
    ok = F.col("_pi").isNotNull() & (F.col("eligible_fraction") >= robust_fraction)
    return chosen.select(
        "eligible_fraction",
        F.when(ok, F.col("_pi")).alias("selected_pi"),
        F.when(ok, F.col("_objective")).alias("objective"),
        F.when(ok, "PASS").otherwise("INSUFFICIENT_EVIDENCE").alias("status"),
    )
