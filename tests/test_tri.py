"""Truth tables of the three-valued aggregates over all inputs of up to three values."""

from itertools import product

from pyspark.sql import functions as F

from paneloom.functions import tri

VALUES = (True, False, None)


def groups(width):
    return list(product(VALUES, repeat=width))


def expected_any(values):
    if any(v is True for v in values):
        return True
    return False if all(v is False for v in values) else None


def test_any_true(spark):
    rows = [(n, i, v) for n in (1, 2, 3) for i, g in enumerate(groups(n)) for v in g]
    df = spark.createDataFrame(rows, "n int, i int, v boolean")
    got = {(r.n, r.i): r.x for r in df.groupBy("n", "i").agg(tri.any_true(F.col("v")).alias("x")).collect()}
    assert got == {(n, i): expected_any(g) for n in (1, 2, 3) for i, g in enumerate(groups(n))}


def test_union_label(spark):
    cases = [(o, p) for o in groups(2) for p in groups(2)]
    rows = [(i, o[j], p[j]) for i, (o, p) in enumerate(cases) for j in range(2)]
    df = spark.createDataFrame(rows, "i int, o boolean, p boolean")
    got = {r.i: r.x for r in df.groupBy("i").agg(tri.union_label(F.col("o"), F.col("p")).alias("x")).collect()}
    for i, (o, p) in enumerate(cases):
        if True in o:
            want = True
        else:
            want = False if all(v is False for v in o) and all(v is True for v in p) else None
        assert got[i] is want, (o, p)


def test_union_label_needs_every_expected_source(spark):
    df = spark.createDataFrame([(1, False, True), (1, False, True)], "i int, o boolean, p boolean")
    got = df.groupBy("i").agg(tri.union_label(F.col("o"), F.col("p"), F.lit(3)).alias("x")).first().x
    assert got is None


def test_effective_opportunity(spark):
    df = spark.createDataFrame(list(product(VALUES, VALUES)), "a boolean, b boolean")
    for r in df.withColumn("x", tri.effective_opportunity(F.col("a"), F.col("b"))).collect():
        want = False if False in (r.a, r.b) else True if (r.a and r.b) else None
        assert r.x is want
