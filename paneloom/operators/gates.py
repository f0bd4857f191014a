"""Gate verdicts and known-case checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneloom.functions.grid import registry, with_grid
from paneloom.operators.nested import block_quantiles
from paneloom.operators.newton import NOWHERE, drawn_rows, fit_many, hinge_design, packed
from paneloom.operators.ranking import attach, cut, quantile_rows, value_counts
from paneloom.operators.resample import DRAWS, multiplicity_arrays

KEY = ["entity_id", "period"]


def _bad(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def _expected(spark: SparkSession, folds: Sequence[int], pairs: Mapping[str, str]) -> DataFrame:
    rows = [{"fold": f, "candidate": c, "reference": r} for f in folds for c, r in pairs.items()]
    return registry(spark, rows, {"fold": "int", "candidate": "string", "reference": "string"})


def gate_blockers(
    metrics: DataFrame, deltas: DataFrame, samples: DataFrame, folds: Sequence[int], pairs: Mapping[str, str], minimum_replications: int
) -> DataFrame:
    """Every missing, repeated or non-finite fact of the (fold x candidate) grid as a coded row.

    metrics: fold, model_id, average_precision, precision_at, positive_count; deltas: fold,
    candidate, reference, delta; samples: fold, candidate, rep, delta.
    """
    grid = _expected(metrics.sparkSession, folds, pairs)
    model = metrics.groupBy("fold", "model_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("average_precision").alias("ap"), F.max("precision_at").alias("yield"),
        F.max("positive_count").alias("positives"),
    )
    left = model.select(*[F.col(c).alias(f"c_{c}") for c in model.columns])
    right = model.select(*[F.col(c).alias(f"r_{c}") for c in model.columns])
    pair = deltas.groupBy("fold", "candidate").agg(
        F.count(F.lit(1)).alias("d_n"), F.max("reference").alias("d_reference"), F.max("delta").alias("d_delta")
    )
    boot = samples.groupBy("fold", "candidate").agg(
        F.count(F.lit(1)).alias("b_n"), F.count_if(_bad(F.col("delta"))).alias("b_bad")
    )
    rows = (
        grid.join(left, (F.col("fold") == F.col("c_fold")) & (F.col("candidate") == F.col("c_model_id")), "left")
        .join(right, (F.col("fold") == F.col("r_fold")) & (F.col("reference") == F.col("r_model_id")), "left")
        .join(pair, ["fold", "candidate"], "left")
        .join(boot, ["fold", "candidate"], "left")
    )
    present = F.col("c_n").isNotNull() & F.col("r_n").isNotNull() & F.col("d_n").isNotNull()

    def fact(condition: Column, code: str, who: str) -> Column:
        return F.when(condition, F.struct(F.lit(code).alias("reason"), F.col(who).alias("subject")))

    facts = F.array_compact(
        F.array(
            fact(~present, "REQUIRED_PAIR_MISSING", "candidate"),
            fact(present & ((F.col("c_n") > 1) | (F.col("r_n") > 1) | (F.col("d_n") > 1)), "DUPLICATE_FACT", "candidate"),
            fact(present & (F.col("d_reference") != F.col("reference")), "REFERENCE_MISMATCH", "candidate"),
            fact(present & _bad(F.col("d_delta")), "DELTA_AP_MISSING", "candidate"),
            fact(present & _bad(F.col("c_ap")), "AP_MISSING", "candidate"),
            fact(present & _bad(F.col("r_ap")), "AP_MISSING", "reference"),
            fact(present & _bad(F.col("c_yield")), "YIELD_MISSING", "candidate"),
            fact(present & _bad(F.col("r_yield")), "YIELD_MISSING", "reference"),
            fact(present & (F.col("r_yield") <= 0), "REFERENCE_YIELD_NONPOSITIVE", "candidate"),
            fact(present & F.col("c_positives").isNull(), "POSITIVE_COUNT_MISSING", "candidate"),
            fact(F.col("b_n").isNull(), "BOOTSTRAP_PAIR_MISSING", "candidate"),
            fact(F.col("b_n") < minimum_replications, "BOOTSTRAP_TOO_SHORT", "candidate"),
            fact(F.col("b_bad") > 0, "BOOTSTRAP_NONFINITE", "candidate"),
        )
    )
    return rows.select("fold", F.explode(facts).alias("_f")).select("fold", "_f.reason", "_f.subject")


def gate2(metrics: DataFrame, deltas: DataFrame, samples: DataFrame, folds: Sequence[int], pairs: Mapping[str, str], cfg: Mapping[str, float]) -> DataFrame:
    """Verdict per candidate from fold improvements, simultaneous interval, direction, yield and support.

    The lower quantile is taken over replicates of the fold-mean difference, at a level shared by
    the candidate family. Replicates are a configured number.
    """
    grid = _expected(metrics.sparkSession, folds, pairs)
    model = metrics.select("fold", "model_id", "average_precision", "precision_at", "positive_count")
    cand = model.select("fold", F.col("model_id").alias("candidate"), F.col("precision_at").alias("_cy"), F.col("positive_count").alias("_pos"))
    ref = model.select(
        "fold", F.col("model_id").alias("reference"), F.col("average_precision").alias("_rap"), F.col("precision_at").alias("_ry")
    )
    rows = (
        grid.join(deltas.select("fold", "candidate", "delta"), ["fold", "candidate"], "left")
        .join(cand, ["fold", "candidate"], "left")
        .join(ref, ["fold", "reference"], "left")
    )
    decline = F.when(F.col("_ry") != 0, F.greatest(F.lit(0.0), (F.col("_ry") - F.col("_cy")) / F.col("_ry")))
    per = rows.groupBy("candidate", "reference").agg(
        F.count("delta").alias("fold_count"),
        F.count_if(F.col("delta") > 0).alias("same_direction_folds"),
        F.avg("delta").alias("mean_delta"),
        F.coalesce(F.avg("_rap"), F.lit(0.0)).alias("_rap"),
        F.count("_rap").alias("_raps"),
        F.coalesce(F.max(decline), F.lit(0.0)).alias("max_yield_decline"),
        F.min("_pos").alias("min_positive_count"),
        F.count("_pos").alias("_poss"),
    )
    # replicates renumbered without the dropped ones: windows of a configured number of rows
    order = Window.partitionBy("fold", "candidate").orderBy("rep")
    kept = samples.join(grid.select("fold", "candidate"), ["fold", "candidate"]).filter("delta IS NOT NULL")
    numbered = kept.withColumn("_i", F.row_number().over(order))
    means = numbered.groupBy("candidate", "_i").agg(F.avg("delta").alias("_m"), F.count(F.lit(1)).alias("_f"))
    shared = numbered.groupBy("candidate").agg(F.count_distinct("fold").alias("_folds"))
    usable = attach(means, shared, ["candidate"]).filter("_f = _folds")
    alpha = (1 - cfg["interval_level"]) / (2 * max(1, len(pairs)))
    lower = usable.groupBy("candidate").agg(
        F.percentile("_m", F.lit(alpha)).alias("interval_lower"), F.count(F.lit(1)).alias("replications_used"),
        F.max("_folds").alias("_boot_folds"),
    )
    table = attach(per, lower, ["candidate"])
    required = F.greatest(F.lit(float(cfg["absolute_improvement"])), F.lit(float(cfg["relative_improvement"])) * F.col("_rap"))
    n = len(folds)
    complete = (
        (F.col("fold_count") == n) & (F.coalesce("_boot_folds", F.lit(0)) == n) & (F.col("_raps") == n) & (F.col("_poss") == n)
    )
    passed = (
        complete
        & (F.col("mean_delta") >= required)
        & (F.col("interval_lower") > 0)
        & (F.col("same_direction_folds") >= cfg["same_direction_min"])
        & (F.col("max_yield_decline") <= cfg["max_yield_decline"])
        & (F.col("min_positive_count") >= cfg["min_positives"])
    )
    return table.select(
        "candidate", "reference", "fold_count", "same_direction_folds", "mean_delta", "interval_lower", required.alias("required_improvement"),
        "max_yield_decline", "min_positive_count", "replications_used", complete.alias("evidence_complete"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def gate2_with_domains(gate: DataFrame, domains: DataFrame, required: float) -> DataFrame:
    """Bind each candidate to its own transfer evidence; incomplete evidence is insufficient, not a failure.

    domains: candidate, robust_fraction, evidence_complete.
    """
    joined = gate.join(
        domains.select("candidate", "robust_fraction", F.col("evidence_complete").alias("_d")), "candidate", "left"
    )
    complete = F.coalesce("_d", F.lit(False))
    domain_pass = complete & F.coalesce(F.col("robust_fraction") >= required, F.lit(False))
    passed = F.col("passed") & domain_pass
    return joined.select(
        "candidate",
        "robust_fraction",
        complete.alias("domain_evidence_complete"),
        domain_pass.alias("domain_pass"),
        passed.alias("passed"),
        F.when(~complete | ~F.col("evidence_complete"), "INSUFFICIENT_EVIDENCE").when(passed, "PASS").otherwise("FAIL").alias("verdict"),
    )


def selection_stability(selections: DataFrame, required: int, denominator: int) -> DataFrame:
    """Most often selected measurement over the folds; passes only on the full set of folds."""
    value = F.when(~F.coalesce(F.trim("selected"), F.lit("")).isin("", "none"), F.col("selected"))
    counts = selections.groupBy(value.alias("selected")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("selected").isNotNull()
    return counts.agg(
        F.max_by(F.when(known, F.col("selected")), F.when(known, F.struct("n", "selected"))).alias("selected"),
        F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("selected_folds"),
        F.sum("n").alias("observed_folds"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing_folds"),
    ).withColumn("passed", (F.col("observed_folds") == denominator) & (F.col("selected_folds") >= required))


# ------------------------------------------------------------- shape claims


def standardized(df: DataFrame, feature: str, monitor: str, outcome: str, group: str) -> DataFrame:
    """Rows for the shape fits: grp, z (population sd over all rows), monitor, label, weight."""
    stats = df.agg(F.avg(feature).alias("_m"), F.stddev_pop(feature).alias("_s"))
    return attach(df, stats, []).select(
        *KEY, F.col(group).cast("string").alias("grp"), ((F.col(feature) - F.col("_m")) / F.col("_s")).alias("z"),
        F.col(monitor).cast("double").alias("monitor"), F.col(outcome).cast("double").alias("label"), F.lit(1.0).alias("weight"),
    ).filter("z IS NOT NULL AND monitor IS NOT NULL AND label IS NOT NULL")


def breakpoint_scan(rows: DataFrame, quantile_range: tuple[float, float], points: int, inverse_regularization: float, minimum: int = 8) -> DataFrame:
    """Best hinge position and interaction coefficient per group.

    Candidate positions are score quantiles of the group; all (group, position) fits share their
    passes. Groups below the minimum, or with one class, are left out.
    """
    rows = cut(rows)
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).collect()
    groups = [r["grp"] for r in sizes if r["n"] >= minimum and r["lo"] < r["hi"]]
    low, high = quantile_range
    wanted = [low + (high - low) * i / (points - 1) for i in range(points)]
    table = quantile_rows(rows.filter(F.col("grp").isin(*groups)), ["grp"], "z", wanted).collect()
    candidates = {g: sorted({r["quantile"] for r in table if r["grp"] == g}) for g in groups}
    penalty = 1 / inverse_regularization
    fits = fit_many(rows, "grp", {g: [*ps, NOWHERE] for g, ps in candidates.items()}, hinge_design, 6, penalty)
    hinge, plain = fits[fits["point"] < NOWHERE], fits[fits["point"] == NOWHERE]
    best = hinge.sort_values(["grp", "loss", "point"]).groupby("grp", as_index=False).first()[["grp", "point", "loss"]]
    merged = best.merge(plain[["grp", "b3"]], on="grp").rename(columns={"point": "breakpoint", "b3": "interaction"})
    found = rows.sparkSession.createDataFrame(merged[["grp", "breakpoint", "loss", "interaction"]].astype({"grp": str}),
                                              "grp string, breakpoint double, loss double, interaction double")
    # one row per configured fold or domain
    share = rows.join(F.broadcast(found), "grp").groupBy("grp", "breakpoint", "loss", "interaction").agg(
        F.avg((F.col("z") <= F.col("breakpoint")).cast("double")).alias("_below"), F.min("z").alias("z_low"), F.max("z").alias("z_high"),
        F.count(F.lit(1)).alias("row_count"),
    )
    return share.select(
        "grp", "row_count", "breakpoint", "loss", "interaction", F.least(F.col("_below"), 1 - F.col("_below")).alias("side_fraction"), "z_low", "z_high"
    )


def common_support(ranges: DataFrame) -> DataFrame:
    """Share of the smallest domain range that all domains cover; zero below two domains."""
    box = ranges.agg(F.max("z_low").alias("_l"), F.min("z_high").alias("_h"), F.count(F.lit(1)).alias("_n"))
    share = F.greatest(F.lit(0.0), F.col("_h") - F.col("_l")) / F.greatest(F.col("z_high") - F.col("z_low"), F.lit(1e-12))
    rows = attach(ranges, box, [])
    return rows.agg(
        F.max("_n").alias("domain_count"), F.coalesce(F.min(F.when(F.col("_n") >= 2, share)), F.lit(0.0)).alias("common_support")
    )


def shape_bootstrap(
    rows: DataFrame, quantile_range: tuple[float, float], points: int, inverse_regularization: float, replications: int, alpha: float, seed: str
) -> DataFrame:
    """Intervals of the interaction and the breakpoint of every group, from its entities resampled.

    A row carries how often each replicate draws it. Every (group, replicate, position) is a cell of the
    shared fits, weighted by that number, and the positions are quantiles of the replicate by the same
    numbers, so no row is copied. One-class replicates drop out; a group without any has an open interval.
    """
    times = multiplicity_arrays(rows, ["grp"], replications, seed)
    table = attach(rows, times, ["grp", "entity_id"]).filter("times IS NOT NULL").select("grp", "z", "monitor", "label", "weight", "times")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() * replications // DRAWS)
    blocks = packed(table.repartitionByRange(tasks, "grp", "z").sortWithinPartitions("grp", "z"), "grp", "times")
    both = drawn_rows(blocks).filter("ones > 0 AND ones < n").toArrow().to_pandas()  # one row a group and replicate
    low, high = quantile_range
    wanted = [low + (high - low) * i / (points - 1) for i in range(points)]
    spots = block_quantiles(blocks, replications, wanted).toArrow().to_pandas().rename(columns={"feature": "grp", "set": "rep", "quantile": "point"})
    spots = spots.drop_duplicates(["grp", "rep", "point"]).merge(both[["grp", "rep"]], on=["grp", "rep"])
    every = pd.concat([spots[["grp", "rep", "point"]], both[["grp", "rep"]].assign(point=NOWHERE)]).sort_values(["grp", "rep", "point"])
    candidates = {g: list(zip(part["rep"], part["point"], strict=True)) for g, part in every.groupby("grp")}
    fits = fit_many(table, "grp", candidates, hinge_design, 6, 1 / inverse_regularization, times="times", blocks=blocks)
    hinge, plain = fits[fits["point"] < NOWHERE], fits[fits["point"] == NOWHERE]
    best = hinge.sort_values(["grp", "rep", "loss", "point"]).groupby(["grp", "rep"], as_index=False).first()[["grp", "rep", "point"]]
    merged = best.merge(plain[["grp", "rep", "b3"]], on=["grp", "rep"]).drop(columns="rep")
    frame = rows.sparkSession.createDataFrame(merged.astype({"grp": str, "point": float, "b3": float}), "grp string, breakpoint double, interaction double")
    q = [alpha / 2, 1 - alpha / 2]

    def end(value: str, i: int) -> Column:
        empty = float("-inf") if i == 0 else float("inf")
        return F.coalesce(F.percentile(value, F.lit(q[i])), F.lit(empty))

    every = rows.select("grp").distinct().join(frame, "grp", "left")
    return every.groupBy("grp").agg(
        F.count("breakpoint").alias("valid_replications"),
        end("interaction", 0).alias("interaction_lower"), end("interaction", 1).alias("interaction_upper"),
        end("breakpoint", 0).alias("breakpoint_lower"), end("breakpoint", 1).alias("breakpoint_upper"),
    )


def standardized_claims(df: DataFrame, claims: Sequence[str], monitor: str, outcome: str, group: str) -> DataFrame:
    """Rows of the shape fits for several claims, each feature by its own scale; grp is claim|group."""
    whole = None
    for claim in claims:
        part = standardized(df, claim, monitor, outcome, group).withColumn("grp", F.concat(F.lit(f"{claim}|"), F.col("grp")))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def threshold_claims(folds: DataFrame, domains: DataFrame, intervals: DataFrame, cfg: Mapping[str, float]) -> DataFrame:
    """Verdict of every threshold claim: stable over folds, alike and supported across domains, both sides
    filled, and an interval for every fold's breakpoint.

    folds and domains are scans whose grp is claim|fold or claim|level; intervals are those of the folds.
    """
    claim = F.split("grp", r"\|")[0].alias("claim")
    known = intervals.filter(F.abs("breakpoint_lower") < float("inf")).select("grp", F.lit(1).alias("_i"))
    spread = attach(folds, known, ["grp"]).groupBy(claim).agg(
        F.count(F.lit(1)).alias("fold_count"), F.stddev_pop("breakpoint").alias("breakpoint_sd"), F.min("side_fraction").alias("min_side_fraction"),
        F.count("_i").alias("interval_count"),
    )
    ranges = domains.select(claim, "breakpoint", "z_low", "z_high")
    box = ranges.groupBy("claim").agg(F.max("z_low").alias("_l"), F.min("z_high").alias("_h"), F.count(F.lit(1)).alias("_n"))
    share = F.greatest(F.lit(0.0), F.col("_h") - F.col("_l")) / F.greatest(F.col("z_high") - F.col("z_low"), F.lit(1e-12))
    across = attach(ranges, box, ["claim"]).groupBy("claim").agg(
        F.count(F.lit(1)).alias("domain_count"), F.when(F.count(F.lit(1)) >= 2, F.max("breakpoint") - F.min("breakpoint")).alias("domain_difference"),
        F.coalesce(F.min(F.when(F.col("_n") >= 2, share)), F.lit(0.0)).alias("common_support"),
    )
    passed = (
        (F.col("breakpoint_sd") <= cfg["breakpoint_tolerance"])
        & (F.col("domain_difference") <= cfg["domain_difference_max"])
        & (F.col("common_support") >= cfg["common_support_min"])
        & (F.col("min_side_fraction") >= cfg["min_side_fraction"])
        & (F.col("domain_count") >= cfg["min_domains"])
        & (F.col("interval_count") == F.col("fold_count"))
    )
    joined = spread.join(across, "claim", "full").na.fill(0, ["fold_count", "interval_count", "domain_count"])
    return joined.withColumn("method_pass", F.coalesce(passed, F.lit(False)))


def gate3(directions: DataFrame, claims: DataFrame, stability: DataFrame, parent: DataFrame, cfg: Mapping[str, float]) -> DataFrame:
    """Shape verdict: every registered claim holds, the interaction has one direction in enough folds, and
    no fold's simultaneous interval of it holds zero.

    ``directions`` has a row per fold with interaction, interaction_lower and interaction_upper; ``claims``
    are those of ``threshold_claims``; ``parent`` has one row with the parent gate's verdict. A parent that
    did not pass, an unstable measurement, or no evidence skips the gate with its reason.
    """
    away = (F.col("interaction_lower") > 0) | (F.col("interaction_upper") < 0)
    shape = directions.agg(
        F.count("interaction").alias("direction_folds"),
        F.greatest(F.count_if(F.col("interaction") > 0), F.count_if(F.col("interaction") < 0)).alias("same_direction_folds"),
        (F.coalesce(F.bool_and(F.coalesce(away, F.lit(False))), F.lit(False))).alias("intervals_exclude_zero"),
    )
    held = claims.agg(F.count(F.lit(1)).alias("claim_count"), F.count_if("method_pass").alias("claims_passed"))
    stable = stability.select(F.col("passed").alias("_stable"))
    rows = attach(attach(attach(shape, held, []), stable, []), parent.select("verdict"), [])
    ok = (
        (F.col("claim_count") == cfg["claims"])
        & (F.col("claims_passed") == cfg["claims"])
        & (F.col("same_direction_folds") >= cfg["same_direction_min"])
        & F.col("intervals_exclude_zero")
    )
    reason = (
        F.when(F.coalesce("verdict", F.lit("")) != "PASS", "PARENT_GATE_NOT_PASS")
        .when(~F.coalesce("_stable", F.lit(False)), "MEASUREMENT_NOT_STABLE")
        .when(F.col("direction_folds") == 0, "NO_FOLD_DIRECTIONS")
        .when(F.col("claim_count") != cfg["claims"], "THRESHOLD_CLAIMS_MISSING")
    )
    return rows.select(
        "direction_folds", "same_direction_folds", "intervals_exclude_zero", "claim_count", "claims_passed",
        F.when(reason.isNotNull(), "SKIPPED").when(ok, "PASS").otherwise("FAIL").alias("shape_verdict"), reason.alias("reason"),
    )


# ------------------------------------------------------------- known cases


def known_case_ranks(predictions: DataFrame, cases: DataFrame) -> DataFrame:
    """Percentile of each known case inside its (period, model), and the exact lower-tail p.

    Counts come from running sums over distinct scores, so the reference set is never gathered.
    """
    by = ["period", "model_id"]
    counts = value_counts(predictions, by, "prediction", totals=True).select(
        *by, "prediction", "rows_upto", F.col("rows_upto_total").alias("reference_size")
    )
    found = predictions.join(cases.select("case_id", *KEY), KEY)
    joined = found.join(counts, [*by, "prediction"])
    return joined.select(
        "case_id", *KEY, "model_id", "prediction", "reference_size", (F.col("rows_upto") / F.col("reference_size")).alias("percentile"),
        ((F.col("rows_upto") + 1) / (F.col("reference_size") + 1)).alias("lower_tail_p"),
    )


def known_case_summary(ranks: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    """Soft veto and strong falsification over models, from distinct cases below the two percentiles."""
    per_model = ranks.groupBy("model_id").agg(
        F.count_distinct(F.when(F.col("percentile") < cfg["weak_percentile"], F.col("case_id"))).alias("weak_cases"),
        F.count_distinct(F.when(F.col("percentile") < cfg["strong_percentile"], F.col("case_id"))).alias("strong_cases"),
    )
    shares = per_model.agg(
        F.count(F.lit(1)).alias("model_count"),
        F.avg((F.col("weak_cases") >= cfg["below_median_cases"]).cast("double")).alias("below_fraction"),
        F.avg((F.col("strong_cases") >= cfg["minimum_cases"]).cast("double")).alias("strong_fraction"),
    )
    cases = ranks.agg(F.count_distinct("case_id").alias("case_count"))
    rows = attach(shares, cases, [])
    enough = F.col("case_count") >= cfg["minimum_cases"]
    return rows.select(
        "model_count", "case_count", "below_fraction", "strong_fraction", enough.alias("minimum_cases_met"),
        F.coalesce(enough & (F.col("below_fraction") >= cfg["model_fraction"]), F.lit(False)).alias("soft_veto"),
        F.coalesce(F.col("strong_fraction") >= cfg["model_fraction"], F.lit(False)).alias("strong_falsification"),
    )
