"""Hard negatives and centroid clusters against plain loops."""

import hashlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm.centroids import cluster, moved, nearest, with_inertia
from paneloom.llm.hard_negatives import LEAST, TOP, Heaps, hard_negatives, scores, shares, strassen

ROW = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
     T.StructField("key", T.StringType()), T.StructField("dim", T.StringType()), T.StructField("cluster", T.StringType())]
)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "k", "d", "c") for i, v, lab in rows], ROW)


def test_strassen_equals_plain_products():
    rng = np.random.default_rng(1)
    for shape in ((1, 1, 1), (33, 64, 70), (130, 65, 97), (257, 129, 64), (3, 200, 5), (40, 0, 40)):
        a, b = (rng.integers(-(2**20), 2**20, s) for s in (shape[:2], shape[1:]))
        assert (strassen(a, b) == a @ b).all()
        wide = rng.integers(-(2**30), 2**30, shape[:2])  # sums on the way pass 64 bits only where products do
        assert (strassen(wide, b) == wide @ b).all()
    huge = np.full((40, 40), 2**40)
    assert (scores(huge, huge) == TOP).all() and (scores(huge, -huge) == LEAST).all()
    assert scores(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0, 0, 0]] * 2


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    tile, ids = rng.integers(0, 9, (6, 300)), rng.permutation(300)
    wanted = rng.random((6, 300)) < 0.7
    for step in (300, 7):
        heap = Heaps(6, 4)
        for at in rng.permutation(range(0, 300, step)).tolist():
            heap.offer(tile[:, at : at + step], wanted[:, at : at + step], ids[at : at + step])
        for row in range(6):
            want = sorted((-int(s), int(i)) for s, i, w in zip(tile[row], ids, wanted[row], strict=True) if w)[:4]
            assert [(-int(s), int(i)) for s, i in zip(heap.score[heap.row == row], heap.id[heap.row == row], strict=True)] == want


def mined(rows):
    rows = list({(i, lab, tuple(v)): (i, v, lab) for i, v, lab in rows}.values())
    whole = [(i, tuple(int(np.floor(256 * x)) for x in v), lab) for i, v, lab in rows]
    out = []
    for a in whole:
        if a[0] % 50:
            continue
        near = [(-sum(x * y for x, y in zip(a[1], c[1], strict=True)), c[0], c) for c in whole if len(c[1]) == len(a[1])]
        for s, p, _ in sorted((n for n in near if n[2][2] == a[2] and n[2] != a), key=lambda n: n[:2])[:5]:
            inside = sorted((n for n in near if n[2][2] != a[2] and -50 * s <= -100 * n[0] <= -95 * s), key=lambda n: n[:2])[:3]
            out += [(a[0], p, r, n[1], -s, -n[0]) for r, n in enumerate(inside, 1)]
    return sorted(out)


def test_hard_negatives(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist(), int(i % 3)) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.25, 0.5, 0.5, 0.1], i % 2) for i in range(60)]  # ties
    rows += [rows[0], (0, [1.0] * 5, 0), (0, [1.0] * 5, 1), (2000, [1.0], 1), (2001, [2.0], 1), (2002, [1.6], 0), (2050, [], 1), (3000, [-1.0] * 5, 9)]
    bad = [(4000, None, 1), (4050, [1.0, None], 1), (4100, [float("nan")] * 5, 1), (4150, [float("inf")] * 5, 1), (None, [1.0] * 5, 1), (4200, [1.0] * 5, None)]
    got = sorted(tuple(r) for r in hard_negatives(frame(spark, rows + bad), F.col("id") % 50 == 0).collect())
    assert got == mined(rows) and len(got) > 50
    for some in ([], bad, rows[:1], [(50, [1.0], 1), (51, [1.0], 2)]):
        assert hard_negatives(frame(spark, some), F.col("id") % 50 == 0).count() == 0


def test_window_edges_are_whole_numbers():
    for p in (*range(-50, 60), 2**62 + 1, TOP, LEAST):
        inside = [n for n in range(-60, 70) if 50 * p <= 100 * n <= 95 * p]
        low, high = shares(p, (1, 2), True), shares(p, (19, 20), False)
        assert [n for n in range(-60, 70) if low <= n <= high] == inside


def test_orchard_finds_the_nearest():
    rng = np.random.default_rng(4)
    for k, dim, spread in ((1, 3, 9), (2, 3, 9), (8, 2, 3), (8, 64, 50), (40, 4, 2000), (20, 3, 2**40)):
        vectors, centroids = rng.integers(-spread, spread + 1, (500, dim)), rng.integers(-spread, spread + 1, (k, dim))
        centroids[-1] = centroids[0]  # equal centroids: the smaller number
        far = ((vectors[:, None].astype(object) - centroids[None].astype(object)) ** 2).sum(2)
        held, distance, measured = nearest(vectors, centroids)
        want = [min(range(k), key=lambda c: (row[c], c)) for row in far]
        assert held.tolist() == want and [int(d) for d in distance] == [row[c] for row, c in zip(far, want, strict=True)]
        assert measured <= 500 * k
    tight = np.repeat(rng.integers(-5000, 5000, (30, 8)), 20, 0) + rng.integers(-5, 5, (600, 8))
    assert nearest(tight, tight[::20])[2] < 600 * 30 / 2


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == n]
            if mine:
                centroids[n] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    final = assign()
    inertia = {n: sum(d for d, c in final if c == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i is None, i or 0, n, d, inertia[n], sum(inertia.values()), digest[n]) for (i, _), (d, n) in zip(kept, final, strict=True)))


def test_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) + 3 * (i % 5)).tolist(), None) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6, 1) for i in range(200)] + [rows[7], (7, [9.0] * 6, 1), (None, [2.0] * 6, 1), (2000, [0.0] * 6, 1)]
    bad = [(3000, None, 1), (3001, [1.0] * 5, 1), (3002, [1.0] * 5 + [None], 1), (3003, [1.0] * 5 + [float("nan")], 1), (3004, [float("-inf")] * 6, 1), (3005, [], 1)]
    for some, k, rounds in ((rows + bad, 8, 10), (rows + bad, 8, 1), (rows[:3], 8, 10), (bad, 8, 10), ([], 8, 10), (rows, 1, 2), (rows, 30, 3)):
        assigned, centroids = cluster(frame(spark, some), k, rounds, dim=6)
        got = with_inertia(assigned, centroids).select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
        assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == plain_clusters(some, k, rounds, 6)


def test_sums_beyond_64_bits_stay_exact(spark):
    rows = spark.createDataFrame([([2**62 + i, -(2**62) - i],) for i in range(9)], "vector array<long>")
    assert moved(rows, np.array([[2**62, -(2**62)]])).tolist() == [[2**62 + 4, -(2**62) - 4]]
