"""Quantiles and ranks of overlapping sets against one set at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.operators import models, nested
from paneloom.operators.ranking import quantile_rows


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = [(int(i), int(rng.integers(0, 6)), float(rng.integers(0, 40)) if i % 9 else None, float(rng.normal()) if i % 3 else 2.0) for i in range(900)]
    return spark.createDataFrame(data, "id long, period int, a double, b double").repartition(7).cache()


def test_quantiles_of_nested_sets(spark, rows):
    before = [0, 1, 3, 6]
    marked = rows.withColumn("sets", nested.members(F.col("period"), before))
    got = nested.nested_medians(marked, ["a", "b"], len(before))
    assert got[0] == {}
    for i, p in list(enumerate(before))[1:]:
        part = rows.filter(F.col("period") < p).toPandas()
        assert got[i] == pytest.approx({"a": part.a.median(), "b": part.b.median()})
    long = marked.select("sets", F.lit("x").alias("feature"), F.col("b").alias("value"))
    table = {(r["set"], r["p"]): r["quantile"] for r in nested.nested_quantiles(long, 4, [0.0, 0.1, 0.77, 1.0]).collect()}
    for i, p in list(enumerate(before))[1:]:
        for q in (0.0, 0.1, 0.77, 1.0):
            assert table[i, q] == pytest.approx(np.quantile(rows.filter(F.col("period") < p).toPandas().b, q))


def test_sets_need_not_be_nested(spark, rows):
    marked = rows.withColumn("sets", F.array_compact(F.array(*[F.when(F.col("id") % (k + 2) == 0, F.lit(k)) for k in range(5)])))
    got = nested.nested_medians(marked, ["a", "b"], 6)
    for k in range(5):
        part = rows.filter(F.col("id") % (k + 2) == 0).toPandas()
        assert got[k] == pytest.approx({"a": part.a.median(), "b": part.b.median()})
    assert got[5] == {}


def test_what_is_shuffled_does_not_grow_with_the_sets(spark, rows):
    few, many = (nested.counts(rows.select(F.lit("a").alias("feature"), F.col("a").alias("value"), nested.members(F.col("period"), range(1, n)).alias("sets"))) for n in (3, 7))
    assert many.count() <= rows.select("a", "period").distinct().count()
    assert few.count() <= many.count()


def test_ranks_see_earlier_periods_only(spark, rows):
    before = [1, 2, 4, 6]
    data = rows.toPandas()
    got = nested.nested_ecdf(rows, "a", "period", before).toPandas()
    assert len(got) == len(data)
    for r in got.itertuples():
        if np.isnan(r.a):
            assert r.ecdf is None
            continue
        for i, p in enumerate(before):
            part = data[(data.period < p) & data.a.notna()].a
            want = None if r.period > p or not len(part) else min(1 - 1e-6, max(1e-6, ((part <= r.a).sum() - 0.5) / len(part)))
            assert (r.ecdf[i] is None or np.isnan(r.ecdf[i])) if want is None else r.ecdf[i] == pytest.approx(want)
    later = rows.withColumn("a", F.when(F.col("period") >= 4, 1000 - F.col("a")).otherwise(F.col("a")))
    after = {r.id: r.ecdf for r in nested.nested_ecdf(later, "a", "period", before).toPandas().itertuples()}
    for r in got[got.period < 4].itertuples():
        if not np.isnan(r.a):
            assert list(after[r.id][:3]) == pytest.approx(list(r.ecdf[:3]), nan_ok=True)


def test_no_rows(spark, rows):
    none = rows.limit(0)
    assert nested.nested_ecdf(none, "a", "period", [1, 2]).count() == 0
    assert nested.nested_medians(none.withColumn("sets", nested.members(F.col("period"), [1])), ["a"], 1) == [{}]


def test_same_medians_as_one_set_at_a_time(spark, rows):
    got = models.medians_before(rows, ["a", "b"], [1, 5])
    for p in (1, 5):
        part = rows.filter(F.col("period") < p).select(F.lit("b").alias("f"), "b")
        assert got[p]["b"] == pytest.approx(quantile_rows(part, ["f"], "b", [0.5]).first()["quantile"])
