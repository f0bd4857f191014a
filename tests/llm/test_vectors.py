"""Exact and approximate searches against all products."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm.exact_topk import exact_topk, feasible, products, search
from paneloom.llm.graph_index import approximate_topk

VECTOR = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("dim", T.StringType())])
BAD = [(500, None, "x"), (520, [1.0, None], "x"), (540, [float("nan"), 1.0], "x"), (560, [float("inf"), 1.0], "x"), (None, [1.0, 2.0], "x")]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], d) for i, v, d in rows], VECTOR)


def brute(rows, k, score):
    rows = list({(i, tuple(v)): (i, v) for i, v, _ in rows}.values())
    out = set()
    for i, v in rows:
        if i % 20 == 0:
            found = sorted((-score(v, w), j) for j, w in rows if j != i and len(w) == len(v))[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(found, 1)}
    return out


def test_exact_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist(), "x") for i in range(70)]
    rows += [(100 + i, [0.5, 0.25, 0.125], "x") for i in range(30)] + [(100, [0.5, 0.25, 0.125], "x"), (200, [0.0, 0.0, 0.0], "x"), (300, [1.0], "x"), (301, [2.0], "x"), (320, [1.0] * 5, "x")]
    got = {tuple(r) for r in exact_topk(frame(spark, rows + BAD), F.col("id") % 20 == 0, k=7).collect()}
    whole = lambda v: [int(np.floor(64 * x)) for x in v]
    assert got == brute(rows, 7, lambda v, w: sum(a * b for a, b in zip(whole(v), whole(w), strict=True)))
    assert exact_topk(frame(spark, []), F.col("id") % 20 == 0).count() == 0
    assert exact_topk(frame(spark, BAD), F.col("id") % 20 == 0).count() == 0


def test_both_prunings_lose_nothing():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    vectors = np.floor(64 * np.repeat(base, 100, 0) * rng.uniform(0.2, 3, (4000, 1)) + rng.normal(size=(4000, 16))).astype(np.int64)
    ids = np.arange(4000)
    q = vectors[::200]
    exact = q @ vectors.T
    exact[np.arange(len(q)), ids[::200]] = -(2**62)
    bound = np.sort(exact, 1)[:, -25]
    for beat in (np.full(len(q), -(2**63)), bound):
        row, found, score = search(ids, vectors, ids[::200], q, beat, 10)
        for k in range(len(q)):
            best = sorted(zip(-score[row == k], found[row == k], strict=True))[:10]
            assert best == sorted(zip(-exact[k], ids, strict=True))[:10]
    unit = vectors / np.sqrt((vectors**2).sum(1))[:, None]
    near = np.flatnonzero(unit @ unit[0] >= 0.95)
    assert set(near) <= set(feasible(unit[0], unit, 0.95)) and len(feasible(unit[0], unit, 0.95)) < 2000


def test_coordinates_past_the_threshold_lose_nothing(spark):
    assert 0 in feasible(np.array([0.95, np.sqrt(1 - 0.95**2)]), np.array([[1.0, 0.0]]), 0.6)
    assert 0 in feasible(np.array([-0.95, np.sqrt(1 - 0.95**2)]), np.array([[-1.0, 0.0]]), 0.6)
    rng = np.random.default_rng(8)
    for dim in (1, 2, 3, 12):
        units = rng.normal(size=(1500, dim)) * np.where(rng.random((1500, dim)) < 0.5, 0.05, 1)
        units /= np.sqrt((units**2).sum(1))[:, None]
        for cosine in (0.6, 0.8, 0.95, 0.999):
            for unit in units[:60]:
                assert set(np.flatnonzero(units @ unit >= cosine)) <= set(feasible(unit, units, cosine))
    one_hot = rng.normal(size=(3000, 6)) * 0.1
    one_hot[np.arange(3000), rng.integers(0, 6, 3000)] += rng.choice([-1, 1], 3000)
    shapes = (one_hot, rng.normal(size=(2500, 2)), rng.normal(size=(2500, 3)))
    rows = [(10_000 * n + i, v.tolist(), "x") for n, part in enumerate(shapes) for i, v in enumerate(64 * part / np.sqrt((part**2).sum(1))[:, None])]
    got = {tuple(r) for r in exact_topk(frame(spark, rows), F.col("id") % 100 == 0, k=20, scale=64.0).collect()}
    want = set()
    for n in range(len(shapes)):
        ids = np.array([i for i, _, _ in rows if i // 10_000 == n])
        whole = np.floor(64 * np.array([v for i, v, _ in rows if i // 10_000 == n])).astype(np.int64)
        for at in np.flatnonzero(ids % 100 == 0):
            score = whole @ whole[at]
            order = [j for j in np.lexsort((ids, -score)) if j != at][:20]
            want |= {(int(ids[at]), r, int(ids[j]), int(score[j])) for r, j in enumerate(order, 1)}
    assert got == want


def test_ranges_and_blocks_lose_nothing(spark, monkeypatch):
    from paneloom.llm import exact_topk as module

    for name, value in (("RANGE_ROWS", 40), ("QUERY_ROWS", 3), ("SEED_ROWS", 10), ("BUCKET_ROWS", 16)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(12)
    rows = [(i, (rng.normal(size=4) * rng.choice([0.1, 1, 30])).tolist(), "x") for i in range(400)]
    whole = lambda v: [int(np.floor(64 * x)) for x in v]
    got = {tuple(r) for r in exact_topk(frame(spark, rows), F.col("id") % 20 == 0, k=5).collect()}
    assert got == brute(rows, 5, lambda v, w: sum(a * b for a, b in zip(whole(v), whole(w), strict=True)))


def test_products_stay_exact():
    for size in (10, 2**20, 2**29, 2**40):
        a = np.array([[size, -size + 1, 3]])
        assert products(a, a)[0, 0] == min(size**2 + (size - 1) ** 2 + 9, 2**63 - 1)


def test_graph_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist(), "x") for i in range(1500)]
    rows += [(2000 + i, [3.0] * 8, "x") for i in range(40)] + [(0, rows[0][1], "x"), (3000, [0.0] * 8, "x"), (3020, [1.0, 2.0], "x"), (3021, [2.0, 1.0], "x")]
    got = {tuple(r)[:3] for r in approximate_topk(frame(spark, rows + BAD), F.col("id") % 20 == 0, k=10).collect()}
    want = {r[:3] for r in brute([r for r in rows if any(r[1])], 10, lambda v, w: float(np.dot(v, w)))}
    assert {r[0] for r in got} == {r[0] for r in want}
    assert len({(q, v) for q, _, v in got} & {(q, v) for q, _, v in want}) >= 0.9 * len(want)
    assert (3020, 1, 3021) in got
    assert approximate_topk(frame(spark, []), F.col("id") % 20 == 0).count() == 0
