"""Learners, temporal out-of-fold scores and ensembles on Spark ML.

Fits loop over a handful of configured folds, learners and settings; every fit is a distributed
job over its rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import product
from typing import Any

from pyspark.ml import Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.functions.draws import hash_number
from paneloom.functions.grid import registry
from paneloom.functions.profile import melt, profile
from paneloom.operators.fits import OPEN, PASS, Cell, SharedFits
from paneloom.operators.metrics import average_precision, soft_log_loss
from paneloom.operators.nested import members, nested_ecdf, nested_medians
from paneloom.operators.ranking import attach, cut, positions, quantile_rows, running

KEY = ["entity_id", "period"]


# ------------------------------------------------------------- preparation


def feature_groups(registry_rows: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    """Feature lists of the groups: observability, content, and full (both plus ambiguous).

    With a panel, ``value_counts`` gives the values that each feature has in it, in the features' order;
    a feature without a column has none.
    """
    usable = registry_rows.filter(
        (F.coalesce("research_status", F.lit("LOCKED")) == "LOCKED")
        & (F.col("model_eligibility").isNull() | F.col("model_eligibility").isin("fit", "confirmatory"))
    )
    groups = F.array_compact(
        F.array(
            F.when(F.col("role") == "observability", "observability_only"),
            F.when(F.col("role") == "content", "content_only"),
            F.when(F.col("role").isin("observability", "content", "ambiguous"), "full"),
        )
    )
    rows = usable.select("feature_id", F.explode(groups).alias("feature_group"))
    if panel is None:
        return rows.groupBy("feature_group").agg(F.array_sort(F.collect_list("feature_id")).alias("features"))
    names = [r["feature_id"] for r in usable.select("feature_id").distinct().collect() if r["feature_id"] in panel.columns]  # a registry
    counted = profile(panel, {n: {"values": F.count(n)} for n in names}, label="feature_id")
    counted = rows.join(counted, "feature_id", "left").na.fill(0, ["values"])
    listed = counted.groupBy("feature_group").agg(F.array_sort(F.collect_list(F.struct("feature_id", "values"))).alias("_l"))
    return listed.select("feature_group", F.col("_l.feature_id").alias("features"), F.col("_l.values").alias("value_counts"))


def kept_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with at least one value in the fit sample."""
    counts = df.agg(*[F.count(f).alias(f) for f in features]).first()
    return [f for f in features if counts[f] > 0]


def medians(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Exact medians from values ranked across partitions; one number per feature comes to the driver."""
    rows = quantile_rows(melt(df, [], features).filter("value IS NOT NULL"), ["feature"], "value", [0.5]).collect()
    return {r["feature"]: r["quantile"] for r in rows}


def medians_before(df: DataFrame, features: Sequence[str], periods: Sequence[int]) -> dict[int, dict[str, float]]:
    """The medians of the rows before each of the configured periods, selected in one sort; no row is copied per period."""
    marked = df.withColumn("_sets", members(F.col("period"), periods))
    return dict(zip((int(p) for p in periods), nested_medians(marked, features, len(periods), "_sets"), strict=True))


class Prepared(Transformer):
    """Median fill and vector assembly fixed on a fit sample."""

    def __init__(self, features: Sequence[str], fill: Mapping[str, float]) -> None:
        super().__init__()
        self.features, self.fill = list(features), dict(fill)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = dataset.select(
            "*", *[F.coalesce(F.col(f).cast("double"), F.lit(float(self.fill[f]))).alias(f"_x_{f}") for f in self.features]
        )
        vectors = VectorAssembler(inputCols=[f"_x_{f}" for f in self.features], outputCol="_features").transform(filled)
        return vectors.drop(*[f"_x_{f}" for f in self.features])


def prepare(df: DataFrame, features: Sequence[str], fill: Mapping[str, float] | None = None) -> Prepared:
    """Features without any value have no median and are dropped. ``fill`` gives medians taken before."""
    fill = medians(df, features) if fill is None else fill
    if not fill:
        raise ValueError("no feature has a value in the rows to fit on")
    return Prepared([f for f in features if f in fill], fill)


def make_learner(name: str, params: Mapping[str, Any], total_weight: float, columns: int) -> Any:
    """Spark ML estimator of a registered learner.

    ``C`` is an inverse regularisation against the summed loss. Spark divides the loss by the sum of
    weights, so the penalty is divided by it too.
    """
    common = {"featuresCol": "_features", "labelCol": "_label", "weightCol": "_weight"}
    p = dict(params)
    if name in ("logistic", "elastic_net_logistic"):
        c = float(p.pop("C", 1.0))
        return LogisticRegression(regParam=1 / (c * total_weight), maxIter=p.pop("maxIter", 100), tol=p.pop("tol", 1e-6), **common, **p)
    if name == "linear_svm":
        c = float(p.pop("C", 1.0))
        return LinearSVC(regParam=1 / (c * total_weight), **common, **p)
    if name == "random_forest":
        return RandomForestClassifier(seed=p.pop("seed", 7), **common, **p)
    if name == "gradient_boosting":
        return GBTClassifier(seed=p.pop("seed", 7), **common, **p)
    if name == "decision_tree":
        return DecisionTreeClassifier(seed=p.pop("seed", 7), **common, **p)
    if name == "gaussian_nb":
        return NaiveBayes(modelType="gaussian", **common, **p)
    if name == "mlp":
        layers = [columns, *p.pop("hidden", [8]), 2]
        return MultilayerPerceptronClassifier(featuresCol="_features", labelCol="_label", layers=layers, seed=p.pop("seed", 7), **p)
    raise ValueError(f"unknown learner: {name}")


def _probability(scored: DataFrame, output: str) -> DataFrame:
    if "probability" in scored.columns:
        value = vector_to_array("probability")[1]
    else:  # the margin classifier has no probability column
        value = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    extra = [c for c in ("_features", "_scaled", "rawPrediction", "probability", "prediction") if c in scored.columns]
    return scored.withColumn("_p", value).drop(*extra).withColumnRenamed("_p", output)


class Fitted:
    """Preparation and model of one fit."""

    def __init__(self, prepared: Prepared, model: Any, scaler: Any = None) -> None:
        self.prepared, self.model, self.scaler = prepared, model, scaler

    def score(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        rows = self.prepared.transform(df)
        if self.scaler is not None:
            rows = self.scaler.transform(rows).drop("_features").withColumnRenamed("_scaled", "_features")
        return _probability(self.model.transform(rows), output)


def resampled(rows: DataFrame) -> DataFrame:
    """Rows repeated in proportion to their weight, for learners that take none; equal weights change nothing.

    The fraction of a copy is settled by a hash of the row, so that a repeated task draws it again.
    """
    mean = rows.agg(F.avg("_weight").alias("m")).first()["m"] or 1.0
    share = F.pmod(F.xxhash64("_features", "_label", "_weight"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.col("_weight") / mean + share).cast("int")
    return rows.withColumn("_copies", copies).filter("_copies > 0").select(*rows.columns, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).drop("_copy")


def fit(
    df: DataFrame, features: Sequence[str], label: str, learner: str, params: Mapping[str, Any] | None = None, weight: str | None = None,
    soft: bool = False, fill: Mapping[str, float] | None = None,
) -> Fitted:
    """Fit a learner on rows with a 0/1 label, or with a target in [0, 1] if ``soft``; margin learners see
    standardised features.

    A soft row counts once for each class, with its weight shared out by the target; it is one row
    where features are prepared.
    """
    base = df.select(
        *features, F.col(label).cast("double").alias("_label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_weight")
    ).persist()
    rows = None
    try:
        prepared = prepare(base, features, fill)
        rows = prepared.transform(base).select("_features", "_label", "_weight")
        scaler = None
        if learner in ("logistic", "elastic_net_logistic", "linear_svm", "mlp"):
            scaler = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True).fit(rows)
            rows = scaler.transform(rows).drop("_features").withColumnRenamed("_scaled", "_features")
        if soft:
            halves = expand_soft(rows.filter("_label BETWEEN 0 AND 1"), "_label", "_weight")
            rows = halves.select("_features", F.col("label").alias("_label"), F.col("label_weight").alias("_weight"))
        if learner == "mlp":
            rows = resampled(rows)
        rows = rows.persist()
        total = rows.agg(F.sum("_weight").alias("w")).first()["w"] or 0.0
        if total <= 0:
            raise ValueError("the rows to fit on have no weight")
        estimator = make_learner(learner, params or {}, total, len(prepared.features))
        return Fitted(prepared, estimator.fit(rows), scaler)
    finally:
        base.unpersist()
        if rows is not None:
            rows.unpersist()


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, *, inverse_regularization: float = 1.0, weight: str | None = None) -> Fitted:
    return fit(df, features, label, "logistic", {"C": inverse_regularization}, weight)


def score(model: Fitted, df: DataFrame, output: str = "prediction") -> DataFrame:
    return model.score(df, output)


# ------------------------------------------------------------- targets


def expand_soft(df: DataFrame, target: str, weight: str) -> DataFrame:
    """Each row twice: label 1 with weight w x p, label 0 with weight w x (1 - p); zero weights drop out.

    ``out_of_range`` marks targets outside [0, 1].
    """
    p, w = F.col(target), F.col(weight)
    halves = F.array(
        F.struct(F.lit(1.0).alias("label"), (w * p).alias("label_weight")),
        F.struct(F.lit(0.0).alias("label"), (w * (1 - p)).alias("label_weight")),
    )
    rows = df.withColumn("out_of_range", ~p.between(0, 1)).select("*", F.explode(halves).alias("_h")).select("*", "_h.*").drop("_h")
    return rows.filter("label_weight > 0")


def train_ecdf(values: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """Rank of each value among the training values, (count ≤ v - 0.5) / n, clipped.

    Distinct values of both sides are sorted together once; no row is compared with another.
    """
    both = (
        values.filter(F.col(value).isNotNull())
        .select(F.col(value).alias("_v"), F.lit(0).cast("long").alias("_r"))
        .unionByName(reference.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v"), F.lit(1).cast("long").alias("_r")))
        .groupBy("_v")
        .agg(F.sum("_r").alias("_r"))
    )
    placed = running(both, [], [("_v", True)], {"_upto": F.col("_r")}, totals=True).withColumnRenamed("_upto_total", "_n")
    share = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (F.col("_upto") - 0.5) / F.col("_n")))
    table = placed.select(F.col("_v").alias(value), F.when(F.col("_n") > 0, share).alias("ecdf"))
    return attach(values, table, [value])


def estimable(df: DataFrame, target: str, soft: bool, by: Sequence[str] = ()) -> DataFrame:
    """At least two known targets and two classes (or, for soft targets, some spread)."""
    t = F.col(target).cast("double")
    spread = F.max(t) - F.min(t) > 1e-12 if soft else F.max(t.cast("int")) > F.min(t.cast("int"))
    return df.groupBy(*by).agg(
        F.count(t).alias("known_count"), F.coalesce((F.count(t) >= 2) & spread, F.lit(False)).alias("estimable")
    )


# ------------------------------------------------------------- folds


def grid(base: Mapping[str, Any], space: Mapping[str, Sequence[Any]], maximum: int) -> list[dict[str, Any]]:
    """Every combination of the settings, at most ``maximum`` of them."""
    combinations = [{**base, **dict(zip(space, values, strict=True))} for values in product(*space.values())]
    if len(combinations) > maximum:
        raise ValueError(f"the grid has {len(combinations)} points, {len(combinations) - maximum} too many")
    return combinations


def estimable_before(df: DataFrame, label: str, periods: Sequence[int], soft: bool) -> list[int]:
    """The periods that can be estimated from the rows before them: counts and extremes of each period, run up."""
    t = F.col(label).cast("double")
    stats = df.groupBy("period").agg(F.count(t).alias("n"), F.min(t).alias("low"), F.max(t).alias("high")).collect()  # one row a period
    found = []
    for p in periods:
        some = [r for r in stats if r["period"] is not None and r["period"] < p and r["n"]]
        low, high = min((r["low"] for r in some), default=0.0), max((r["high"] for r in some), default=0.0)
        spread = high - low > 1e-12 if soft else int(high) > int(low)
        if spread and sum(r["n"] for r in some) >= 2:
            found.append(int(p))
    return found


def shared(learner: str, params: Mapping[str, Any] | None) -> bool:
    """Whether fits of this learner go through the shared passes."""
    own = {"logistic": {"C", "tol", "maxIter"}, "elastic_net_logistic": {"C", "tol", "maxIter", "elasticNetParam"}}
    return learner in own and set(params or {}) <= own[learner]


def receipt_of(model: Any, learner: str, params: Mapping[str, Any] | None) -> dict[str, Any]:
    """Steps and verdict of a library fit; learners without an optimiser's history always end."""
    summary = getattr(model, "summary", None)
    summary = summary() if callable(summary) else summary
    if summary is None or not hasattr(summary, "totalIterations"):
        return {"steps": None, "loss": None, "converged": True}
    most = int((params or {}).get("maxIter", model.getOrDefault("maxIter")))
    history = list(summary.objectiveHistory)
    # a model of the intercept alone needs no step
    return {"steps": int(summary.totalIterations), "loss": float(history[-1]) if history else None, "converged": summary.totalIterations < most}


RECEIPT = "model_id string, setting int, period int, row_count long, status string, converged boolean, steps int, loss double"


def oof_candidates(
    df: DataFrame, groups: Mapping[str, Sequence[str]], learners: Mapping[str, Sequence[Mapping[str, Any]]], label: str, weight: str | None = None,
    soft: bool = False, years: Sequence[int] | None = None, ranked: bool = False, final: int | None = None,
) -> tuple[DataFrame | None, list[tuple], SharedFits | None]:
    """Out-of-fold scores of every candidate (learner, group, setting), with a receipt of every fit.

    A period is scored by fits on strictly earlier periods; periods that can't be estimated from those
    before them are left out. A candidate with a fit that did not converge is void: it has receipts but no
    scores. With ``ranked`` the target of a fit, and of the rows it scores, is its rank among the targets
    before the scored period, so that no later row shapes it. ``final`` adds a fit on all rows before that
    period to the shared ones.

    Logistic candidates of all groups, settings and periods share their passes; others are fitted one by one.
    Scores are (key, model_id, setting, target, prediction). Receipts follow ``RECEIPT``.
    """
    if years is None:
        years = sorted(r["period"] for r in df.select("period").distinct().collect() if r["period"] is not None)
    known = df.filter(F.col(label).isNotNull())
    tops = [int(y) for y in years if final is None or y < final] + ([int(final)] if final is not None else [])
    fitting = estimable_before(df, label, tops, soft)
    scored_years = [y for y in fitting if y != final]
    empty = (None, [], None)
    if not fitting:
        return empty
    place = {y: i for i, y in enumerate(fitting)}
    if ranked:
        rows = nested_ecdf(df, label, "period", fitting, "_targets")
        target = F.try_element_at("_targets", lookup_number(F.col("period"), place) + 1)
    else:
        rows, target = df.withColumn("_targets", F.array(F.col(label).cast("double"))), F.col(label).cast("double")
    rows = cut(rows.withColumn("_target", target))
    receipts: list[tuple] = []
    parts: list[DataFrame] = []
    features = sorted({f for fs in groups.values() for f in fs})
    cells, void = [], set()
    settings = [(f"{n}:{g}", n, g, k, p) for g in groups for n, ps in learners.items() for k, p in enumerate(ps)]
    for model_id, learner, group, k, params in settings:
        if not shared(learner, params):
            continue
        for y in fitting:
            penalty, lasso = 1 / float(params.get("C", 1.0)), float(params.get("elasticNetParam", 0.0))
            cells.append(Cell(f"{model_id}|{k}|{y}", place[y], tuple(groups[group]), place[y] if ranked else 0, penalty, lasso=lasso))
    fits = None
    if cells:
        steps = max(int(p.get("maxIter", 100)) for _, n, _, _, p in settings if shared(n, p))
        tolerance = min(float(p.get("tol", 1e-8)) for _, n, _, _, p in settings if shared(n, p))
        load = F.col(weight).cast("double") if weight else F.lit(1.0)
        base = rows.select(
            *[F.col(f).cast("double").alias(f) for f in features], load.alias("weight"), members(F.col("period"), fitting).alias("sets"),
            F.col("_targets").alias("labels"),
        )
        most = {f"{m}|{k}": int(p.get("maxIter", 100)) for m, n, _, k, p in settings if shared(n, p)}
        fits = SharedFits(cut(base.filter(F.col("labels").isNotNull() & (F.size("sets") > 0))), cells, steps, tolerance, most)
        for one in fits.fits.values():
            model_id, k, y = one.cell.name.rsplit("|", 2)
            receipts.append((model_id, int(k), int(y), one.row_count, one.status, one.status == PASS, one.steps, one.losses[-1] if one.losses else None))
            if one.status == OPEN and int(y) != final:
                void.add((model_id, int(k)))
        asked = {y: [f"{m}|{k}|{y}" for m, n, _, k, p in settings if shared(n, p) and (m, k) not in void] for y in scored_years}
        names = F.coalesce(*[F.when(F.col("period") == y, F.array(*map(F.lit, a))) for y, a in asked.items() if a], F.array().cast("array<string>"))
        found = fits.score(rows, [*KEY, "_target"], names)
        bits = F.split("cell", r"\|")
        parts.append(found.select(*KEY, bits[0].alias("model_id"), bits[1].cast("int").alias("setting"), F.col("_target").alias("target"), "prediction"))
    others = [s for s in settings if not shared(s[1], s[4])]
    if others:
        fills = medians_before(known, features, fitting)
    for model_id, learner, group, k, params in others:
        mine, whole = [], None
        for y in scored_years:
            goal = F.col("_targets")[place[y] if ranked else 0]
            train = rows.filter(F.col("period") < y).withColumn("_goal", goal).filter("_goal IS NOT NULL")
            fill = {f: v for f, v in fills[y].items() if f in groups[group]}
            if not fill:
                mine.append((model_id, k, y, None, "NO_FEATURE_WITH_VALUES", False, None, None))
                continue
            model = fit(train, groups[group], "_goal", learner, params, weight, soft, fill)
            facts = receipt_of(model.model, learner, params)
            status = PASS if facts["converged"] else OPEN
            mine.append((model_id, k, y, None, status, facts["converged"], facts["steps"], facts["loss"]))
            if status == OPEN:
                break
            part = model.score(rows.filter(F.col("period") == y)).select(
                *KEY, F.lit(model_id).alias("model_id"), F.lit(k).alias("setting"), F.col("_target").alias("target"), "prediction"
            )
            whole = part if whole is None else whole.unionByName(part)
        receipts += mine
        if whole is not None and all(r[4] != OPEN for r in mine):
            parts.append(whole)
    scores = None
    for part in parts:
        scores = part if scores is None else scores.unionByName(part)
    return scores, receipts, fits


def lookup_number(column: Column, numbers: Mapping[int, int]) -> Column:
    return F.coalesce(*[F.when(column == F.lit(k), F.lit(v)) for k, v in numbers.items()]) if numbers else F.lit(None).cast("int")


def temporal_oof(
    df: DataFrame, features: Sequence[str], label: str, learner: str, params: Mapping[str, Any] | None = None, weight: str | None = None,
    soft: bool = False, years: Sequence[int] | None = None,
) -> DataFrame | None:
    """Scores of every period from a fit on strictly earlier periods; periods that can't be estimated
    from those before them are left out. Null when no period can be scored, or when a fit did not converge.

    ``years`` configures the scored periods; without it they are those of the rows.
    """
    scores, _, _ = oof_candidates(df, {"": features}, {learner: [dict(params or {})]}, label, weight, soft, years)
    return None if scores is None else scores.select(*KEY, F.col("target").alias(label), "prediction")


def objective(predictions: DataFrame, target: str, soft: bool) -> float | None:
    """Tuning loss over pooled out-of-fold rows: negative average precision, or soft cross-entropy."""
    if soft:
        return soft_log_loss(predictions, target, "prediction").first()["soft_log_loss"]
    rows = predictions.withColumn("outcome", F.col(target).cast("boolean"))
    value = average_precision(rows).first()["average_precision"]
    return None if value is None else -value


def tune_fold(
    panel: DataFrame, labels: DataFrame, weights: DataFrame, outer_year: int, groups: Mapping[str, Sequence[str]],
    learners: Mapping[str, Sequence[Mapping[str, Any]]], target: str = "outcome", soft: bool = False, ecdf: bool = False,
) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Tune on earlier periods, refit on all of them, score the outer period: (predictions, models, receipts).

    ``labels`` holds ``target``: a boolean outcome, or a number in [0, 1] if ``soft``. With ``ecdf`` a soft
    target is replaced, for every fit, by its rank among the targets before the period that the fit scores.
    Predictions are (model_id, split, key, outcome, target, prediction) with split oof or outer; a soft target
    gives no outcome. Outer labels are never joined to fitted rows, and a missing weight counts as one.

    ``models`` has one row per (learner, group): status, reason, settings tried and valid, the chosen one and
    its loss. A setting whose inner fits did not all converge is not valid; a model whose final fit did not
    converge scores nothing. ``receipts`` has one row per fit, period being the one that it scores.
    """
    spark = panel.sparkSession
    known = labels.select(*KEY, F.col(target).cast("double").alias("_y"))
    development = cut(panel.filter(F.col("period") < outer_year).join(known, KEY).join(weights, KEY, "left").na.fill(1.0, ["weight"]))
    outer = panel.filter(F.col("period") == outer_year)
    outcome = F.lit(None).cast("boolean") if soft else F.col("target") > 0
    scores, receipts, fits = oof_candidates(development, groups, learners, "_y", "weight", soft, ranked=soft and ecdf, final=outer_year)
    losses: dict[tuple[str, int], float] = {}
    if scores is not None:
        scores = cut(scores)
        losses = {k: v for k, v in objectives(scores, soft).items() if v is not None}
    finals = {(r[0], r[1]): r for r in receipts if r[2] == outer_year}
    rows, chosen, whole = [], {}, None
    for group, features in groups.items():
        for learner, settings in learners.items():
            model_id = f"{learner}:{group}"
            valid = {k: losses[model_id, k] for k in range(len(settings)) if (model_id, k) in losses}
            facts = [model_id, "SKIPPED", "INSUFFICIENT_POSITIVES", len(settings), len(valid), None, None]
            if valid:
                k = min(valid, key=lambda i: (valid[i], i))
                facts[5:] = [k, valid[k]]
                chosen[model_id] = k
                if shared(learner, settings[k]):
                    ok = finals.get((model_id, k), (None,) * 5)[4] == PASS
                else:
                    goal = development.withColumn("_goal", F.col("_y")).filter("_goal IS NOT NULL")
                    if soft and ecdf:
                        goal = nested_ecdf(goal, "_y", "period", [outer_year], "_e").withColumn("_goal", F.col("_e")[0])
                    model = fit(goal, features, "_goal", learner, settings[k], "weight", soft)
                    receipt = receipt_of(model.model, learner, settings[k])
                    ok = receipt["converged"]
                    receipts.append((model_id, k, outer_year, None, PASS if ok else OPEN, ok, receipt["steps"], receipt["loss"]))
                    if ok:
                        part = model.score(outer).select(F.lit(model_id).alias("model_id"), *KEY, "prediction")
                        whole = part if whole is None else whole.unionByName(part)
                facts[1:3] = [PASS, None] if ok else ["SKIPPED", OPEN]
            rows.append(tuple(facts))
    names = [f"{m}|{k}|{outer_year}" for m, k in chosen.items() if fits is not None and f"{m}|{k}|{outer_year}" in fits.fits]
    if names:
        part = fits.score(outer, KEY, F.array(*map(F.lit, names))).select(F.split("cell", r"\|")[0].alias("model_id"), *KEY, "prediction")
        whole = part if whole is None else whole.unionByName(part)
    models = spark.createDataFrame(
        rows, "model_id string, status string, reason string, evaluated_settings int, valid_settings int, setting int, loss double"
    )
    table = spark.createDataFrame(receipts, RECEIPT)
    if not chosen:
        return None, models, table
    pick = F.coalesce(*[F.when(F.col("model_id") == m, F.lit(k)) for m, k in chosen.items()])
    predictions = scores.filter(F.col("setting") == pick).select(
        "model_id", F.lit("oof").alias("split"), *KEY, outcome.alias("outcome"), "target", "prediction"
    )
    if whole is not None:
        nothing = {"outcome": F.lit(None).cast("boolean"), "target": F.lit(None).cast("double"), "split": F.lit("outer")}
        predictions = predictions.unionByName(whole.withColumns(nothing))
    return predictions, models, table


def objectives(scores: DataFrame, soft: bool) -> dict[tuple[str, int], float | None]:
    """Tuning loss of every candidate over its pooled out-of-fold rows, in one pass."""
    by = ["model_id", "setting"]
    rows = scores.filter(F.col("target").isNotNull())
    if soft:
        return {(r["model_id"], r["setting"]): r["soft_log_loss"] for r in soft_log_loss(rows, "target", "prediction", by).collect()}
    values = average_precision(rows.withColumn("outcome", F.col("target") > 0), by).collect()
    return {(r["model_id"], r["setting"]): None if r["average_precision"] is None else -r["average_precision"] for r in values}


def fit_fold(
    panel: DataFrame, labels: DataFrame, weights: DataFrame, outer_year: int, groups: Mapping[str, Sequence[str]],
    learners: Mapping[str, Sequence[Mapping[str, Any]]], target: str = "outcome", soft: bool = False, ecdf: bool = False,
) -> DataFrame:
    """The predictions of ``tune_fold``; an error when no learner can be fitted."""
    predictions, _, _ = tune_fold(panel, labels, weights, outer_year, groups, learners, target, soft, ecdf)
    if predictions is None:
        raise ValueError(f"fold {outer_year}: no learner can be fitted")
    return predictions


def combine_predictions(*parts: DataFrame) -> DataFrame:
    """Union of prediction tables with the number of copies of each (model, key)."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("model_id", *KEY).agg(F.min("prediction").alias("prediction"), F.count(F.lit(1)).alias("copies"))


# ------------------------------------------------------------- positive-unlabelled bagging


#: Leading bits of a hash by which the size of a bag is first located.
BIN_BITS = 12


def bag_limits(df: DataFrame, positive: Column, bags: int, ratio: float, seed: str) -> list[tuple] | None:
    """For each bag the (hash, entity, period) of its last unlabelled row, the ceil(P x ratio)-th in that
    order; null when either side has fewer than two rows.

    Hashes are first counted by their leading bits, so rows are neither copied per bag nor sorted but for
    the one bin of each bag where its size is reached.
    """
    counts = df.agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("u")).first()
    if counts["p"] < 2 or counts["u"] < 2:
        return None
    size = min(counts["u"], max(1, math.ceil(counts["p"] * ratio)))
    unlabelled = df.filter(~positive).select(*KEY)
    draws = F.array(*[bag_hash(seed, b) for b in range(bags)])
    bins = unlabelled.select(F.posexplode(F.transform(draws, lambda h: F.shiftright(h, 60 - BIN_BITS))).alias("bag", "bin"))
    table: dict[int, list] = {b: [] for b in range(bags)}
    for r in bins.groupBy("bag", "bin").agg(F.count(F.lit(1)).alias("n")).collect():  # bags times 2^BIN_BITS numbers at most
        table[r["bag"]].append((r["bin"], r["n"]))
    edge: dict[int, tuple[int, int]] = {}
    for bag, found in table.items():
        before = 0
        for bin_, n in sorted(found):
            if before + n >= size:
                edge[bag] = (bin_, size - before)
                break
            before += n
    near = unlabelled.select(*KEY, F.posexplode(draws).alias("bag", "h")).filter(
        F.coalesce(*[F.when(F.col("bag") == b, F.shiftright("h", 60 - BIN_BITS) == e[0]) for b, e in edge.items()])
    )
    place = positions(near, ["bag"], [("h", True), ("entity_id", True), ("period", True)])
    last = place.filter(F.coalesce(*[F.when(F.col("bag") == b, F.col("position") == e[1]) for b, e in edge.items()]))
    limits = {r["bag"]: (r["h"], r["entity_id"], r["period"]) for r in last.collect()}  # one row a bag
    return [limits[b] for b in range(bags)]


def bag_hash(seed: str, bag: int) -> Column:
    return hash_number(seed, bag, F.col("entity_id"), F.col("period"))


def bag_sets(positive: Column, limits: Sequence[tuple], seed: str) -> Column:
    """Numbers of the bags that hold a row: all for a positive, for others those whose limit it doesn't pass."""
    inside = []
    for bag, (h, entity, period) in enumerate(limits):
        draw = bag_hash(seed, bag)
        tie = (F.col("entity_id") < F.lit(entity)) | ((F.col("entity_id") == F.lit(entity)) & (F.col("period") <= F.lit(period)))
        drawn = (draw < F.lit(h)) | ((draw == F.lit(h)) & tie)
        inside.append(F.when(positive | (~positive & drawn), F.lit(bag)))  # nothing where it is unknown
    return F.array_compact(F.array(*inside))


def pu_bags(df: DataFrame, positive: Column, bags: int, ratio: float, seed: str) -> DataFrame:
    """Membership of the bags: all positives, and the ceil(P x ratio) unlabelled rows with the
    smallest hashes of the bag. Nothing when either side has fewer than two rows."""
    limits = bag_limits(df, positive, bags, ratio, seed)
    if limits is None:
        return df.limit(0).select("*", F.lit(0).alias("bag"), F.lit(0.0).alias("label"))
    return df.select("*", F.explode(bag_sets(positive, limits, seed)).alias("bag"), F.coalesce(positive, F.lit(False)).cast("double").alias("label"))


def pu_bagging(
    train: DataFrame, held: DataFrame, features: Sequence[str], positive: Column, bags: int, ratio: float, seed: str,
    inverse_regularization: float = 1.0, tolerance: float = 1e-8,
) -> DataFrame | None:
    """Mean score of one logistic model per bag; null when the bags cannot be drawn.

    A row carries the numbers of its bags, so the bags are fitted together in shared passes and scored by
    one product. A bag whose fit did not converge scores nothing; null when that holds for all.
    """
    limits = bag_limits(train, positive, bags, ratio, seed)
    if limits is None:
        return None
    rows = train.select(
        *[F.col(f).cast("double").alias(f) for f in features], F.lit(1.0).alias("weight"), bag_sets(positive, limits, seed).alias("sets"),
        F.array(F.coalesce(positive, F.lit(False)).cast("double")).alias("labels"),
    )
    cells = [Cell(str(b), b, tuple(features), 0, 1 / inverse_regularization) for b in range(bags)]
    fits = SharedFits(cut(rows.filter(F.size("sets") > 0)), cells, tolerance=tolerance)
    return fits.mean_score(held) if fits.fitted() else None


# ------------------------------------------------------------- tracks


def track_plan(spark: SparkSession, candidates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Required primary track first, then optional tracks that run only if their candidate is eligible."""
    if len(order) != len(set(order)) or not order:
        raise ValueError("the track order must be non-empty and unique")
    rows = registry(spark, [{"measurement_id": m, "position": i} for i, m in enumerate(order)],
                    {"measurement_id": "string", "position": "int"})
    joined = rows.join(candidates.select(F.col("candidate").alias("measurement_id"), "eligible", "reason"), "measurement_id", "left")
    primary, ok = F.col("position") == 0, F.coalesce("eligible", F.lit(False))
    return joined.select(
        "measurement_id",
        "position",
        F.when(primary, "primary").otherwise("optional").alias("role"),
        F.when(primary, "REQUIRED").when(ok, "AVAILABLE").otherwise("SKIPPED").alias("status"),
        (primary | ok).alias("eligible"),
        F.when(~primary & ~ok, F.coalesce("reason", F.lit("CAPABILITY_UNAVAILABLE"))).alias("reason"),
    )
