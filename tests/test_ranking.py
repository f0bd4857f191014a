"""Distributed ranks and quantiles against brute force, with a hot group and heavy ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.operators import metrics, ranking, transport


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [("hot" if i % 3 else f"g{i % 5}", float(rng.integers(0, 40)), i) for i in range(3000)]
    return data, spark.createDataFrame(data, "g string, v double, k long").repartition(7).cache()


def test_positions_are_dense(rows):
    data, df = rows
    got = ranking.positions(df, ["g"], [("v", False), ("k", True)]).collect()
    for g in {d[0] for d in data}:
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.v, r.k) for r in mine] == sorted(((d[1], d[2]) for d in data if d[0] == g), key=lambda x: (-x[0], x[1]))


def test_quantiles_match_numpy(rows):
    data, df = rows
    got = {r.g: r for r in ranking.quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.95, "e": 1.0}).collect()}
    for g in {d[0] for d in data}:
        want = np.quantile([d[1] for d in data if d[0] == g], [0, 0.37, 0.5, 0.95, 1])
        assert np.allclose([got[g][c] for c in "abcde"], want)


def test_average_ranks(rows):
    data, df = rows
    got = {(r.g, r.k): r.r for r in ranking.average_ranks(df, ["g"], "v", "r").collect()}
    for g, v, k in data[:200]:
        mine = [d[1] for d in data if d[0] == g]
        assert got[(g, k)] == sum(x < v for x in mine) + (sum(x == v for x in mine) + 1) / 2


def test_auc_and_concordance_match_pairs(spark):
    rng = np.random.default_rng(9)
    t, s = rng.integers(0, 8, 150) / 8, rng.integers(0, 30, 150) / 30
    df = spark.createDataFrame([(float(a), float(b), bool(a > 0.5)) for a, b in zip(t, s)], "t double, prediction double, outcome boolean")
    pairs = [(a, b) for a in range(150) for b in range(150) if t[a] < t[b]]
    want = np.mean([1.0 if s[a] < s[b] else 0.5 if s[a] == s[b] else 0.0 for a, b in pairs])
    got = metrics.concordance(df, "t", "prediction").first()
    assert got.comparable_pairs == len(pairs) and got.concordance == pytest.approx(want)
    pos, neg = s[t > 0.5], s[t <= 0.5]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert metrics.roc_auc(df).first().roc_auc == pytest.approx(auc)


def test_average_precision_edge_cases(spark):
    df = spark.createDataFrame(
        [("a", "1", 1, 0.9, True), ("a", "2", 1, 0.8, False), ("a", "3", 1, 0.7, True), ("b", "1", 1, 0.5, False)],
        "m string, entity_id string, period int, prediction double, outcome boolean",
    )
    got = {r.m: r.average_precision for r in metrics.average_precision(df, ["m"]).collect()}
    assert got["a"] == pytest.approx((1 + 2 / 3) / 2) and got["b"] is None


def test_bootstrap_draws_n_of_n(spark):
    df = spark.createDataFrame([(str(i), 1) for i in range(57)], "entity_id string, period int")
    units = metrics.bootstrap_units(df)
    times = metrics.multiplicities(units.select("unit", "n"), 6, "s")
    totals = {r.rep: r.t for r in times.groupBy("rep").agg(F.sum("times").alias("t")).collect()}
    assert totals == {i: 57 for i in range(6)}
    shuffled = metrics.multiplicities(units.repartition(5).select("unit", "n"), 6, "s")
    assert sorted(map(tuple, times.collect())) == sorted(map(tuple, shuffled.collect()))


def test_bootstrap_draws_entities_with_all_their_periods(spark):
    from paneloom.operators import metrics

    rows = spark.createDataFrame(
        [(str(i), p, m, float(i % 7), i % 3 == 0) for i in range(30) for p in (2019, 2020) for m in ("a", "b")],
        "entity_id string, period int, model_id string, prediction double, outcome boolean",
    )
    drawn = metrics.bootstrap_rows(rows, 5, "s").collect()
    times = {}
    for r in drawn:
        times.setdefault((r.rep, r.entity_id), []).append(r.times)
    assert all(len(t) == 4 and len(set(t)) == 1 for t in times.values())
    assert all(sum(t[0] for (rep, _), t in times.items() if rep == k) == 30 for k in range(5))


def test_attach_without_keys_refuses_a_second_row(spark):
    import pytest

    from paneloom.operators.ranking import attach

    rows = spark.range(3)
    assert attach(rows, spark.range(1).withColumnRenamed("id", "x"), []).count() == 3
    assert attach(rows, spark.range(0).withColumnRenamed("id", "x"), []).filter("x IS NULL").count() == 3
    with pytest.raises(Exception, match="single row"):
        attach(rows, spark.range(2).withColumnRenamed("id", "x"), []).collect()


def test_pair_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from paneloom.operators import metrics, reports

    assert metrics.PAIRS and metrics.COUNT
    a, b = (spark.createDataFrame([r], "x string, y string") for r in (("a|b", "c"), ("a", "b|c")))
    assert reports.table_digest(a).first() != reports.table_digest(b).first()
    whole = spark.range(1).select((F.lit(6_000_000_000).cast(metrics.PAIRS) * F.lit(6_000_000_000).cast(metrics.PAIRS)).cast(metrics.COUNT).alias("n"))
    assert int(whole.first().n) == 36 * 10**18


def test_ranges_are_written_without_values(spark, monkeypatch):
    df = spark.range(40).selectExpr("id % 2 AS g", "id AS k", "id * 3 AS x")
    seen = []
    monkeypatch.setattr(ranking, "cut", lambda d: seen.append(d) or d.checkpoint())
    ranking.checkpoint_folder(spark)
    rows = ranking.running(df, ["g"], [("k", True)], {"upto": F.col("x") + 1}, ranges=5).collect()
    assert {(r["g"], r["k"]): r["upto"] for r in rows} == {(k % 2, k): sum(3 * i + 1 for i in range(k % 2, k + 1, 2)) for k in range(40)}
    below = seen[0]._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression", 1)[1]
    assert "_v_" not in below  # the shuffle's writer sees the bare rows


def test_scoring_tasks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(transport, "SCORED_ROWS", 500)
    rows = spark.range(1000).selectExpr("CAST(id AS STRING) AS entity_id", "1 AS period").coalesce(1)
    sizes = transport.spread(rows, 10).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 1000 and max(r["count"] for r in sizes) < 150
