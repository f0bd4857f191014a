"""Source exclusion, domain transfer, domain support and feature shift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.draws import hash_number
from paneloom.functions.grid import lookup, with_grid
from paneloom.functions.profile import melt, profile
from paneloom.functions.sets import sorted_set
from paneloom.operators.fits import OPEN, PASS, Cell, SharedFits
from paneloom.operators.metrics import average_precision, roc_auc, roc_auc_of_counts
from paneloom.operators.nested import members
from paneloom.operators.ranking import attach, cut, quantiles, running

KEY = ["entity_id", "period"]
#: Scored rows that a task ranks, about 0.5 KB each with the counts of all folds.
RANGE_ROWS = 200_000
#: Scored rows that a task makes; it writes them to all ranges, sorted by range.
SCORED_ROWS = 1_000_000


def select_outcomes(df: DataFrame, target: str) -> DataFrame:
    """Outcomes of one target with the number of copies per key."""
    rows = df.filter((F.col("target_id") == target) & F.col("outcome").isNotNull())
    return rows.groupBy(*KEY).agg(F.bool_or("outcome").alias("outcome"), F.count(F.lit(1)).alias("copies"))


def exclusions(channels: Mapping[str, str]) -> list[dict[str, Any]]:
    """One exclusion per source and one per channel."""
    rows = [{"exclusion_id": f"source:{s}", "excluded": [s]} for s in sorted(channels)]
    rows += [
        {"exclusion_id": f"channel:{c}", "excluded": sorted(s for s in channels if channels[s] == c)}
        for c in sorted(set(channels.values()))
    ]
    return rows


def relabel_without(sources: DataFrame, channels: Mapping[str, str]) -> DataFrame:
    """Union label over the remaining sources, per exclusion; outcomes alone decide, mature rows only."""
    rows = with_grid(sources, exclusions(channels), {"exclusion_id": "string", "excluded": "array<string>"})
    kept = ~F.array_contains("excluded", F.col("source_id"))
    # a row stays even if nothing is left, so that its label is unknown
    outcome = F.when(kept, F.col("outcome"))
    return rows.groupBy("exclusion_id", *KEY).agg(
        F.when(
            F.bool_and("mature"),
            F.when(F.bool_or(outcome), F.lit(True)).when(
                (F.count_if(outcome == F.lit(False)) == F.count_if(kept)) & (F.count_if(kept) > 0), F.lit(False)
            ),
        ).alias("outcome")
    )


def exclusion_refits(
    panel: DataFrame, relabelled: DataFrame, fixed: DataFrame, outer_period: int, features: Sequence[str], learner: str = "logistic",
    inverse_regularization: float = 1.0,
) -> DataFrame:
    """Average precision on the fixed outer outcome of models trained on each exclusion's labels.

    The labels of all exclusions are one array of a row, and their models share the passes of one fit.
    """
    names = sorted(r["exclusion_id"] for r in relabelled.select("exclusion_id").distinct().collect())  # a registry
    held = cut(panel.filter(F.col("period") == outer_period).join(fixed.filter("outcome IS NOT NULL").select(*KEY, "outcome"), KEY))
    number = lookup({n: i for i, n in enumerate(names)}, F.col("exclusion_id"))
    listed = (
        relabelled.filter("outcome IS NOT NULL")
        .groupBy(*KEY)
        .agg(F.map_from_entries(F.collect_set(F.struct(number.alias("i"), F.col("outcome").cast("double").alias("y")))).alias("_m"))
    )
    train = panel.filter(F.col("period") < outer_period).join(listed, KEY)
    labels = F.transform(F.sequence(F.lit(0), F.lit(max(0, len(names) - 1))), lambda i: F.try_element_at("_m", i))
    rows = cut(
        train.select(*[F.col(f).cast("double").alias(f) for f in features], F.lit(1.0).alias("weight"), F.array(F.lit(0)).alias("sets"), labels.alias("labels"))
    )
    if learner != "logistic":
        raise ValueError("exclusion refits share logistic fits")
    fits = SharedFits(rows, [Cell(n, 0, tuple(features), i, 1 / inverse_regularization) for i, n in enumerate(names)])
    scored = fits.score(held, [*KEY, "outcome"], F.array(*map(F.lit, names)).cast("array<string>"))
    by = ["cell"]
    found = attach(fits.receipts().select("cell", F.col("row_count").alias("train_rows"), "status"), average_precision(scored, by), by)
    table = attach(found, held.agg(F.count(F.lit(1)).alias("outer_rows")), [])
    return table.select(F.col("cell").alias("exclusion_id"), "train_rows", "outer_rows", "average_precision", "status")


def ablation(refits: DataFrame, baseline: float | DataFrame) -> DataFrame:
    """Difference of every refit to the baseline, a number or a one-row table with average_precision."""
    if isinstance(baseline, DataFrame):
        rows = attach(refits, baseline.select(F.col("average_precision").alias("_base")), [])
    else:
        rows = refits.withColumn("_base", F.lit(float(baseline)))
    return rows.select("exclusion_id", "average_precision", (F.col("average_precision") - F.col("_base")).alias("delta_to_baseline"), "status")


def source_summary(ledger: DataFrame) -> DataFrame:
    """Sources and channels with an observed outcome, and whether each has at least two."""
    seen = F.col("outcome").isNotNull()
    rows = ledger.agg(
        sorted_set(F.when(seen, F.col("source_id"))).alias("sources"), sorted_set(F.when(seen, F.col("channel_id"))).alias("channels")
    )
    return rows.select(
        "sources", "channels", (F.size("sources") >= 2).alias("two_sources"), (F.size("channels") >= 2).alias("two_channels")
    )


# ------------------------------------------------------------- domain support


def domain_levels(panel: DataFrame, domain: str) -> list[str]:
    """The levels of a domain in order; a domain is a registry."""
    return sorted(r[0] for r in panel.filter(F.col(domain).isNotNull()).select(F.col(domain).cast("string")).distinct().collect())


def support_scores(
    panel: DataFrame, domain: str, features: Sequence[str], folds: int, seed: str, periods: Sequence[int] | None = None,
    drop: bool = False, inverse_regularization: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """Cross-fitted scores of belonging to each level of a domain, and the receipts of their fits.

    A level's development rows are those of the other levels. With ``periods`` each of them is a case of its
    own: the level's rows of the period against the other levels' earlier rows. Classes are balanced by
    weight, and an entity is always in one fold. With ``drop`` every case is also fitted without each
    feature, on the sub-matrix of its curvature. All fits share their passes.

    Scores are (level, fold_period, feature_id, key, is_held, prediction); feature_id is empty for all features.
    """
    levels = domain_levels(panel, domain)
    tops = [None] if periods is None else [int(p) for p in periods]
    spans = len(tops)
    level = lookup({n: i for i, n in enumerate(levels)}, F.col(domain).cast("string"))
    rows = panel.filter(F.col(domain).isNotNull()).withColumn("_level", level)
    rows = rows.withColumn("_fold", F.pmod(hash_number(seed, F.col("entity_id")), F.lit(folds)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(max(0, len(levels) - 1)))
    if periods is None:
        cases = every
    else:
        own = F.array_compact(F.array(*[F.when(F.col("period") == p, F.col("_level") * spans + j) for j, p in enumerate(tops)]))
        later = members(F.col("period"), tops)
        others = F.filter(every, lambda i: i != F.col("_level"))
        cases = F.concat(own, F.flatten(F.transform(others, lambda i: F.transform(later, lambda j: i * spans + j))))
    rows = rows.withColumn("_cases", cases.cast("array<int>"))
    sets = F.flatten(
        F.transform("_cases", lambda c: F.array_compact(F.array(*[F.when(F.col("_fold") != k, c * folds + k) for k in range(folds)])))
    )
    labels = F.transform(every, lambda i: (i == F.col("_level")).cast("double"))
    rows = cut(rows)
    prepared = rows.select(
        *[F.col(f).cast("double").alias(f) for f in features], F.lit(1.0).alias("weight"), sets.cast("array<int>").alias("sets"), labels.alias("labels")
    )
    left_out = ["", *features] if drop and len(features) > 1 else [""]
    cells = []
    for i in range(len(levels)):
        for j in range(spans):
            for k in range(folds):
                case = i * spans + j
                for f in left_out:
                    used = tuple(x for x in features if x != f)
                    cells.append(Cell(f"{case}|{k}|{f}", case * folds + k, used, i, 1 / inverse_regularization, True, f"{case}|{k}|" if f else None))
    fits = SharedFits(cut(prepared.filter(F.size("sets") > 0)), cells)
    # cells lie by case, fold and feature left out; a row that dozens of them score carries their places
    width = len(left_out)
    asked = F.flatten(F.transform("_cases", lambda c: F.array(*[((c * folds + F.col("_fold")) * width + k).cast("int") for k in range(width)])))
    scored = fits.score(rows, [*KEY, "_level"], asked, places=True)

    def named(df: DataFrame, case: Column, feature: Column) -> DataFrame:
        names = F.get(F.array(*map(F.lit, levels)).cast("array<string>"), F.floor(case / spans).cast("int"))
        period = F.get(F.array(*map(F.lit, tops)).cast("array<int>"), case % spans)
        return df.withColumns({"level": names, "fold_period": period, "feature_id": feature})

    case = F.floor(F.col("cell") / (folds * width)).cast("int")
    held = F.col("_level") == F.floor(case / spans).cast("int")
    scores = named(scored, case, F.get(F.array(*map(F.lit, left_out)), F.col("cell") % width))
    parts = F.split("cell", r"\|", 3)
    receipts = named(fits.receipts(rows.sparkSession), parts[0].cast("int"), parts[2]).withColumn("crossfit_fold", parts[1].cast("int"))
    return scores.select("level", "fold_period", "feature_id", *KEY, held.alias("is_held"), "prediction"), receipts.drop("cell")


def domain_support(scores: DataFrame, bounds: tuple[float, float], by: Sequence[str] = ()) -> DataFrame:
    """Share of held rows inside the bounds and the AUC of the domain score."""
    hits, inside = F.col("hits"), F.col("prediction").between(*bounds)
    # every row counts once: equal scores of a group collapse as they are made, and only counts are kept
    counts = cut(scores.groupBy(*by, "prediction").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_held").alias("hits")))
    share = counts.groupBy(*by).agg(
        F.sum("hits").alias("held_rows"),
        F.try_divide(F.sum(F.when(inside, hits).otherwise(F.when(F.col("prediction").isNotNull(), 0))), F.sum(F.when(F.col("prediction").isNotNull(), hits))).alias("support_fraction"),
    )
    return attach(share, roc_auc_of_counts(counts.filter("prediction IS NOT NULL"), by), list(by))


def support_drivers(support: DataFrame, minimum: float, by: Sequence[str] = ("level", "fold_period")) -> DataFrame:
    """Support and AUC without each feature: gain, AUC drop, and whether it restores the support.

    ``support`` has one row per case and feature left out; the empty one stands for all features.
    """
    base = support.filter("feature_id = ''").select(*by, F.col("support_fraction").alias("_s"), F.col("roc_auc").alias("_a"))
    return attach(support.filter("feature_id <> ''"), base, list(by)).select(
        *by,
        "feature_id",
        "support_fraction",
        (F.col("support_fraction") - F.col("_s")).alias("support_gain"),
        (F.col("_a") - F.col("roc_auc")).alias("auc_drop"),
        ((F.col("_s") < minimum) & (F.col("support_fraction") >= minimum)).alias("restores_support"),
    )


def feature_shift(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Shift of each feature from development to held rows.

    Needs is_held and supported (held rows only). AUC is taken after a pooled-median fill and
    folded above one half; robust z uses the development median and quartile range, else its sd.
    """
    dev, held = ~F.col("is_held"), F.col("is_held")
    fields = {}
    for f in features:
        x = F.col(f).cast("double")
        fields[f] = {
            "development_missing_rate": F.avg(F.when(dev, x.isNull().cast("double"))),
            "held_missing_rate": F.avg(F.when(held, x.isNull().cast("double"))),
            "development_mean": F.avg(F.when(dev, x)),
            "held_mean": F.avg(F.when(held, x)),
            "_v1": F.var_samp(F.when(dev, x)),
            "_v2": F.var_samp(F.when(held, x)),
            "_n1": F.count(F.when(dev, x)),
            "_n2": F.count(F.when(held, x)),
        }
    base = profile(rows, fields, label="feature_id")
    long = cut(melt(rows, ["is_held", "supported"], features, "feature_id"))
    by = ["feature_id"]
    dev_q = quantiles(long.filter("NOT is_held AND value IS NOT NULL"), by, "value",
                      {"development_median": 0.5, "_q25": 0.25, "_q75": 0.75})
    held_q = quantiles(long.filter("is_held AND value IS NOT NULL"), by, "value", {"held_median": 0.5})
    pooled = quantiles(long.filter("value IS NOT NULL"), by, "value", {"_fill": 0.5})
    filled = attach(long, pooled, by).select(
        "feature_id", F.coalesce("value", "_fill").alias("prediction"), F.col("is_held").alias("outcome")
    )
    auc = roc_auc(filled.filter("prediction IS NOT NULL"), by)
    table = cut(attach(attach(attach(attach(base, dev_q, by), held_q, by), auc, by), pooled, by))
    spread = F.col("_q75") - F.col("_q25")
    scale = F.when(spread > 0, spread).when(F.col("_v1") > 0, F.sqrt("_v1"))
    z = attach(
        long.filter("is_held"), table.filter("_n1 >= 2").select("feature_id", F.col("development_median").alias("_m"), scale.alias("_s")), by
    ).withColumn("_z", F.abs(F.col("value") - F.col("_m")) / F.col("_s"))
    excess = z.groupBy(*by).agg(
        (F.avg(F.when(~F.col("supported"), F.col("_z"))) - F.avg(F.when(F.col("supported"), F.col("_z")))).alias("unsupported_excess_z")
    )
    sd = F.sqrt((F.col("_v1") + F.col("_v2")) / 2)
    enough = (F.col("_n1") >= 2) & (F.col("_n2") >= 2) & (sd > 0)
    joined = attach(table, excess, by)
    return joined.select(
        "feature_id", "development_missing_rate", "held_missing_rate", "development_mean", "held_mean", "development_median",
        "held_median", F.when(enough, (F.col("held_mean") - F.col("development_mean")) / sd).alias("smd"),
        F.greatest(F.col("roc_auc"), 1 - F.col("roc_auc")).alias("separation_auc"), "unsupported_excess_z",
    )


def aggregate_drivers(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Driver statistics per group, null groups kept; sorted by mean gain, unknown last."""
    spread = quantiles(rows.filter("support_gain IS NOT NULL"), by, "support_gain", {"median_gain": 0.5})
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.avg("support_gain").alias("mean_gain"),
        F.max("support_gain").alias("max_gain"),
        F.count_if("restores_support").alias("restored_cells"),
    )
    return attach(stats, spread, by).orderBy(F.col("mean_gain").desc_nulls_last(), *by)


def scenario_consistency(rows: DataFrame, by: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Scenario rows that must share one support value; disagreement and baseline drift are flagged."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scenario_count"),
        F.min("support_fraction").alias("support_fraction"),
        (F.max("support_fraction") - F.min("support_fraction") > tolerance).alias("support_disagrees"),
        (F.max(F.abs(F.col("support_fraction") - F.col("baseline_support"))) > tolerance).alias("baseline_drift"),
    )


def censoring_summary(decisions: DataFrame, registry: DataFrame) -> DataFrame:
    """Folds whose weights passed on development rows only, and the rows that are not mature."""
    good = F.col("diagnostics_pass") & (F.col("fit_scope") == "development_history") & (F.col("outer_rows_used") == 0)
    folds = decisions.agg(sorted_set(F.when(good, F.col("fold"))).alias("eligible_folds"))
    open_rows = registry.agg(F.count_if(~F.col("retrospective")).alias("not_mature_count"))
    reason = F.when(F.size("eligible_folds") > 0, "CENSORING_TIME_OR_EXIT_SOURCE_UNAVAILABLE").otherwise("IPCW_DIAGNOSTICS_UNAVAILABLE")
    return attach(folds, open_rows, []).select("eligible_folds", "not_mature_count", F.lit("SKIPPED").alias("status"), reason.alias("reason"))


# ------------------------------------------------------------- domain transfer


def domain_transfer(
    panel: DataFrame, domain: str, candidate: Sequence[str], reference: Sequence[str], margin: float, support: DataFrame, support_minimum: float,
    settings: Sequence[Mapping[str, Any]] = ({},), folds: Sequence[int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Leave-one-domain-out grid over all levels and periods of the panel: (cells, receipts).

    A cell trains on the other levels' earlier periods and scores its level in its period. With several
    settings each cell tunes on those rows alone: a setting's loss is the negative average precision of its
    scores pooled over the inner periods. The fit that leaves out a level before a period serves that cell
    and the tuning of all later ones, so there is one model per (level, period, features, setting), and all
    share the passes of one fit. Rows of one period are scored once per model, and one sort ranks the pools
    of all folds.

    ``folds`` are the scored periods (by default those with an earlier one). ``support`` has (level, fold,
    support_fraction). Non-inferior means AP at least the reference AP less the margin, with enough support.
    A cell that can't be fitted or scored stays, with its reason. Equal losses choose the first setting.
    """
    levels, spark = domain_levels(panel, domain), panel.sparkSession
    level = lookup({n: i for i, n in enumerate(levels)}, F.col(domain).cast("string"))
    rows = cut(panel.filter(F.col(domain).isNotNull()).withColumn("_level", level).withColumn("_y", F.col("outcome").cast("double")))
    years = sorted(r["period"] for r in rows.select("period").distinct().collect() if r["period"] is not None)
    folds = sorted(int(f) for f in (years[1:] if folds is None else folds))
    tops = sorted({*folds, *(y for y in years[1:] if len(settings) > 1 and folds and y < folds[-1])})
    span, every = len(tops), F.sequence(F.lit(0), F.lit(max(0, len(levels) - 1)))
    groups = {"candidate": list(candidate), "reference": list(reference)}
    later = members(F.col("period"), tops)
    sets = F.flatten(F.transform(F.filter(every, lambda i: i != F.col("_level")), lambda i: F.transform(later, lambda j: i * span + j)))
    features = sorted({f for fs in groups.values() for f in fs})
    prepared = rows.filter("_y IS NOT NULL").select(
        *[F.col(f).cast("double").alias(f) for f in features], F.lit(1.0).alias("weight"), sets.cast("array<int>").alias("sets"),
        F.array("_y").alias("labels"),
    )
    cells = [
        Cell(f"{i}|{y}|{g}|{k}", i * span + j, tuple(fs), 0, 1 / float(p.get("C", 1.0)))
        for i in range(len(levels)) for j, y in enumerate(tops) for g, fs in groups.items() for k, p in enumerate(settings)
    ]
    fits = SharedFits(cut(prepared.filter(F.size("sets") > 0)), cells)
    at = F.split("cell", r"\|")
    kinds = [at[0].cast("int").alias("_out"), at[1].cast("int").alias("fold"), at[2].alias("side"), at[3].cast("int").alias("setting")]
    receipts = cut(fits.receipts(spark).select(*kinds, "row_count", "status", "converged", "steps", "loss"))
    # cells lie by level, period, side and setting; a row that all levels score carries their places
    width = len(groups) * len(settings)
    top = F.array_position(F.array(*map(F.lit, tops)).cast("array<int>"), F.col("period")) - 1
    asked = F.when(
        F.col("_top") >= 0,
        F.flatten(
            F.transform(every if len(settings) > 1 else F.array("_level"), lambda i: F.array(
                *[((i * span + F.col("_top")) * width + k).cast("int") for k in range(width)]))
        ),
    )
    made = width * (len(levels) if len(settings) > 1 else 1)
    found = fits.score(spread(rows, made).withColumn("_top", top), [*KEY, "_level", "outcome"], asked, places=True)
    place = F.floor(F.col("cell") / width).cast("int")
    sides = F.get(F.array(*map(F.lit, groups)), F.floor(F.col("cell") % width / len(settings)).cast("int"))
    scored = cut(
        found.select(
            *KEY, "_level", "outcome", F.floor(place / span).cast("int").alias("_out"), F.get(F.array(*map(F.lit, tops)).cast("array<int>"), place % span).alias("fold"),
            sides.alias("side"), (F.col("cell") % len(settings)).alias("setting"), "prediction",
        )
    )
    by = ["_out", "side"]
    if len(settings) > 1:
        known = scored.filter((F.col("_out") != F.col("_level")) & F.col("outcome").isNotNull())
        hit, order = F.col("outcome").cast("long"), [("prediction", False), ("entity_id", True), ("period", True)]
        sums = {f"_h{f}": F.when(F.col("period") < f, hit).otherwise(0) for f in folds} | {f"_n{f}": (F.col("period") < f).cast("long") for f in folds}
        known = known.select(*by, "setting", "outcome", *[c for c, _ in order])
        ranked = running(known, [*by, "setting"], order, sums, ranges=1 + known.count() // RANGE_ROWS)  # of a checkpoint
        inside = [F.col("outcome") & (F.col("period") < f) for f in folds]
        values = ranked.groupBy(*by, "setting").agg(
            *[F.sum(F.when(c, F.col(f"_h{f}") / F.col(f"_n{f}"))).alias(f"_s{f}") for c, f in zip(inside, folds, strict=True)],
            *[F.count_if(c).alias(f"_p{f}") for c, f in zip(inside, folds, strict=True)],
        )
        pools = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), F.try_divide(f"_s{f}", f"_p{f}").alias("inner_ap")) for f in folds]))
        values = values.select(*by, "setting", pools.alias("_p")).select(*by, "setting", "_p.*")
        # a setting with an inner fit that did not converge is void
        bad = receipts.filter(F.col("status") == OPEN).groupBy(*by, "setting").agg(F.min("fold").alias("_bad"))
        values = attach(values, bad, [*by, "setting"]).filter(F.col("inner_ap").isNotNull() & (F.col("_bad").isNull() | (F.col("_bad") >= F.col("fold"))))
        chosen = first_of_best(values, [*by, "fold"]).withColumnRenamed("setting", "_setting")
    else:
        chosen = receipts.filter(F.col("fold").isin(folds)).select(*by, "fold", F.col("setting").alias("_setting"))
    chosen = cut(chosen)
    final = scored.filter(F.col("_out") == F.col("_level")).join(chosen, [*by, "fold"]).filter("setting = _setting")
    ap = average_precision(final.filter("outcome IS NOT NULL"), [*by, "fold"])
    wide = {}
    for side in groups:
        rest = attach(chosen.filter(F.col("side") == side), ap, [*by, "fold"]).drop("side")
        fit = receipts.filter(F.col("side") == side).select("_out", "fold", F.col("setting").alias("_setting"), F.col("status").alias(f"{side}_fit"))
        wide[side] = attach(rest, fit, ["_out", "fold", "_setting"]).withColumnsRenamed({"_setting": f"{side}_setting", "average_precision": f"{side}_ap"})
    held = rows.filter(F.col("period").isin(folds)).groupBy(F.col("_level").alias("_out"), F.col("period").alias("fold")).agg(
        F.any_value(F.col(domain).cast("string")).alias("level"), F.count(F.lit(1)).alias("held_rows"), F.count("outcome").alias("observed_rows"),
        F.count_if("outcome").alias("held_positives"),
    )
    trained = receipts.groupBy("_out", "fold").agg(F.max("row_count").alias("train_rows"))
    cell = ["_out", "fold"]
    joined = attach(attach(attach(attach(held, trained, cell), wide["candidate"], cell), wide["reference"], cell), support.select("level", "fold", "support_fraction"), ["level", "fold"])
    reason = (
        F.when(F.coalesce("train_rows", F.lit(0)) == 0, "NO_OTHER_DOMAIN_DEVELOPMENT_ROWS")
        .when(F.coalesce("candidate_fit", F.lit("")) == OPEN, OPEN)
        .when(F.coalesce("reference_fit", F.lit("")) == OPEN, OPEN)
        .when((F.coalesce("candidate_fit", F.lit("")) != PASS) | (F.coalesce("reference_fit", F.lit("")) != PASS), "DOMAIN_REFIT_PREDICTIONS_UNAVAILABLE")
        .when((F.col("held_positives") == 0) | (F.col("held_positives") == F.col("observed_rows")), "HELD_DOMAIN_TEST_CLASS_UNAVAILABLE")
        .when(F.col("support_fraction").isNull(), "DOMAIN_SUPPORT_UNAVAILABLE")
    )
    inside = F.col("support_fraction") >= support_minimum
    table = joined.withColumn("reason", reason).withColumn("complete", F.col("reason").isNull())
    better = F.col("candidate_ap") >= F.col("reference_ap") * (1 - margin)
    result = table.select(
        "level", "fold", F.coalesce("train_rows", F.lit(0).cast("long")).alias("train_rows"), "held_rows", "observed_rows", "held_positives",
        "candidate_setting", "reference_setting", "candidate_ap", "reference_ap", "support_fraction", "complete",
        (F.col("complete") & inside & better).alias("non_inferior"), "reason",
    )
    names = F.try_element_at(F.array(*map(F.lit, levels)).cast("array<string>"), F.col("_out") + 1)
    return result, receipts.select(names.alias("level"), "fold", "side", "setting", "row_count", "status", "converged", "steps", "loss")


def spread(rows: DataFrame, made: int) -> DataFrame:
    """Rows of a checkpoint over so many tasks that one makes about SCORED_ROWS rows, of up to ``made`` per row."""
    return rows.repartition(1 + rows.count() * made // SCORED_ROWS, *KEY)


def first_of_best(values: DataFrame, by: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Per group the first setting whose inner_ap is the largest. Models that rank alike have values that
    differ by the order of their sums, so what lies within the tolerance counts as equal."""
    listed = values.groupBy(*by).agg(F.max("inner_ap").alias("_top"), F.collect_list(F.struct("setting", "inner_ap")).alias("_all"))  # a few settings
    best = F.filter("_all", lambda x: x["inner_ap"] >= F.col("_top") - tolerance)
    return listed.select(*by, F.array_min(F.transform(best, lambda x: x["setting"])).alias("setting"))


def transfer_summary(cells: DataFrame, minimum_levels: int = 2) -> DataFrame:
    """Robust share over the expected grid, which is every level with rows in a fold; an incomplete grid, or
    one with too few levels, is no evidence."""
    return cells.agg(
        F.count_if("complete").alias("complete_cells"),
        F.count(F.lit(1)).alias("expected_cells"),
        F.count_distinct("level").alias("level_count"),
        F.try_divide(F.count_if("non_inferior"), F.count(F.lit(1))).alias("robust_fraction"),
        ((F.count_if("complete") == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0) & (F.count_distinct("level") >= minimum_levels)).alias("evidence_complete"),
    )
