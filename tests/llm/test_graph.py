"""Recall of the graph index where lengths differ, and its parts."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm import graph_index
from paneloom.llm.graph_index import DEGREE, approximate_topk, build_graph, lifted, robust_prune

VECTOR = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("dim", T.StringType())])


def cases():
    """Vectors of one dimension a case, which never meet."""
    rng, n = np.random.default_rng(11), 1500

    def unit(dim):
        v = rng.normal(size=(n, dim))
        return v / np.linalg.norm(v, axis=1)[:, None]

    def some_longer(dim, factor):
        v = unit(dim)
        v[3:8] *= factor
        return v

    yield "equal", unit(16)
    for k, factor in enumerate((1e2, 1e3, 1e4, 1e6, 1e12)):
        yield f"five {factor} times longer", some_longer(17 + k, factor)
    yield "log-normal", unit(24) * np.exp(2 * rng.normal(size=n))[:, None]
    yield "uniform", unit(32) * rng.uniform(0.01, 1, n)[:, None]
    yield "far from one", some_longer(33, 1e3) * 1e-90


def test_recall_with_unequal_lengths(spark, monkeypatch):
    monkeypatch.setattr(graph_index, "SHARD_NODES", 700)  # more shards than one a case
    rows, want = [], {}
    for c, (name, vectors) in enumerate(cases()):
        ids = 10_000 * c + np.arange(len(vectors))
        rows += [(int(i), v.tolist(), "x") for i, v in zip(ids, vectors, strict=True)]
        for at in np.flatnonzero(ids % 20 == 0):
            score = vectors @ vectors[at]
            score[at] = -np.inf
            want[int(ids[at])] = (name, {int(ids[j]) for j in np.lexsort((ids, -score))[:20]})
    found = {}
    for r in approximate_topk(spark.createDataFrame(rows, VECTOR), F.col("id") % 20 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = {}
    for q, (name, best) in want.items():
        recall.setdefault(name, []).append(len(best & found[q]) / 20)
    assert len(recall) == 9 and all(np.mean(r) >= 0.9 for r in recall.values()), {n: np.mean(r) for n, r in recall.items()}


def test_no_reverse_edge_is_dropped_unseen():
    rng = np.random.default_rng(3)
    hub = np.concatenate([np.zeros((1, 4)), rng.normal(size=(600, 4))])
    graph, _ = build_graph(hub)
    assert (graph >= 0).any(1).all() and graph.shape == (601, DEGREE)
    points = lifted(hub)
    candidates = np.tile(np.arange(1, 601), (2, 1))
    whole = robust_prune(points, np.array([0, 0]), candidates)
    near = ((points[1:] - points[0]) ** 2).sum(1)
    assert whole[0, 0] == 1 + near.argmin() and (whole[0] == whole[1]).all()
    # no kept edge leads closer to a later one by the factor
    kept = whole[0][whole[0] >= 0]
    for i, a in enumerate(kept):
        for b in kept[i + 1 :]:
            assert graph_index.ALPHA**2 * ((points[a] - points[b]) ** 2).sum() > near[b - 1] - 1e-12


def test_blocks_of_queries_see_the_same_shards(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist(), "x") for i in range(900)], VECTOR)
    one = sorted(map(tuple, approximate_topk(df, F.col("id") % 20 == 0).collect()))
    monkeypatch.setattr(graph_index, "QUERY_ROWS", 7)
    assert sorted(map(tuple, approximate_topk(df, F.col("id") % 20 == 0).collect())) == one
