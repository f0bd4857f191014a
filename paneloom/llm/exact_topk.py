"""Exact top-k inner products of integer vectors by norm buckets.

``exact_topk`` sorts the vectors by length into ranges of bounded size and meets each range with
blocks of queries. Inside, a range is cut into buckets. For every query and bucket the local cosine
threshold is the score to beat over the product of both lengths: above 1 the bucket is skipped; where
it is high, vectors are pruned by the interval that each of the query's largest coordinates allows;
else by length alone. Products of the survivors are then computed exactly.

The score to beat starts from a bounded seed: the products with ``SEED_ROWS`` vectors of smallest
hash. It only prunes; every vector is met or provably below it. Queries reach only ranges whose
longest vector could beat it, and ranges only those blocks of queries that have one for them.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null
id, take no part; an empty vector is one of dimension 0; vectors of different dimension don't meet;
rows equal in id and vector count once; rows of one id with different vectors each take part, and
none meets its own id; a query without candidates gives no rows; scores beyond 64 bits are held at
the bound; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.llm.shared import query, stored, table

RANGE_ROWS, QUERY_ROWS, SEED_ROWS, BUCKET_ROWS = 8192, 2048, 2048, 1024
#: Local cosine threshold from which coordinates prune better than length, and coordinates used.
COORDINATE_COSINE, FOCUS = 0.6, 5
TOP = 2**63 - 1
#: Ranges up to which their list is broadcast.
SMALL_LIST = 100_000


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: floats while every sum is exact in them, else whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -TOP - 1, TOP).astype(np.int64)


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or the least number where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -TOP - 1)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def feasible(query_unit: np.ndarray, units: np.ndarray, cosine: float) -> np.ndarray:
    """Rows whose coordinates allow a cosine of at least this with the query.

    A vector within the angle acos(cosine) of the query is between the query's angle to an axis minus and
    plus that angle. An interval that passes the axis itself ends at 1, one that passes its opposite at -1.
    """
    focus = np.argsort(-np.abs(query_unit))[:FOCUS]
    q = query_unit[focus]
    # the root of a rounded difference near 0 is right to some 1e-8
    slack = np.sqrt(np.maximum(0, (1 - q * q) * (1 - cosine * cosine))) + 1e-7
    low = np.where(q <= -cosine, -1.0, q * cosine - slack) - 1e-7
    high = np.where(q >= cosine, 1.0, q * cosine + slack) + 1e-7
    near = units[:, focus]
    return np.flatnonzero(((near >= low) & (near <= high)).all(1))


def search(ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, q_vectors: np.ndarray, beat: np.ndarray, k: int):
    """(query row, candidate id, score) of all that may be among the k best of this range."""
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-length, kind="stable")
    ids, vectors, length = ids[order], vectors[order], length[order]
    units = vectors / np.maximum(length, 1e-300)[:, None]
    q_length = np.sqrt((q_vectors.astype(np.float64) ** 2).sum(1))
    q_units = q_vectors / np.maximum(q_length, 1e-300)[:, None]
    beat = beat.copy()
    best_ids = [np.zeros(0, np.int64)] * len(q_ids)
    best = [np.zeros(0, np.int64)] * len(q_ids)

    def keep(q: int, rows: np.ndarray, scores: np.ndarray) -> None:
        wanted = (scores >= beat[q]) & (ids[rows] != q_ids[q])
        some_ids, some = np.concatenate([best_ids[q], ids[rows[wanted]]]), np.concatenate([best[q], scores[wanted]])
        first = np.lexsort((some_ids, ~some))[:k]  # ~ turns the order round without overflow
        best_ids[q], best[q] = some_ids[first], some[first]
        if len(first) == k:
            beat[q] = max(beat[q], int(best[q].min()))

    for at in range(0, len(ids), BUCKET_ROWS):
        part = slice(at, at + BUCKET_ROWS)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            cosine = beat / (q_length * length[at])  # 0 / 0 where nothing can be said
        alive = ~(cosine > 1 + 1e-9)
        by_coordinate = alive & (cosine >= COORDINATE_COSINE)
        for q in np.flatnonzero(by_coordinate).tolist():
            rows = at + feasible(q_units[q], units[part], min(1.0, float(cosine[q])))
            if len(rows):
                keep(q, rows, products(q_vectors[q : q + 1], vectors[rows])[0])
        by_length = np.flatnonzero(alive & ~by_coordinate)
        if len(by_length):
            scores = products(q_vectors[by_length], vectors[part])
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                short = beat[by_length, None] / q_length[by_length, None] > length[None, part] * (1 + 1e-9)
            hit = (scores >= beat[by_length, None]) & ~short
            for row in np.flatnonzero(hit.any(1)).tolist():
                found = np.flatnonzero(hit[row])
                keep(int(by_length[row]), at + found, scores[row, found])
    sizes = [len(b) for b in best]
    return np.repeat(np.arange(len(q_ids)), sizes), np.concatenate([*best_ids, ids[:0]]), np.concatenate([*best, ids[:0]])


def usable(vectors: DataFrame, id_col: str, vector_col: str, value=lambda x: x) -> DataFrame:
    """(id, vector) of rows that take part, once each."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & sound)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, value).alias("vector")).distinct()


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal dimension as one array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def exact_topk(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, score) of each query's k largest products of floor(scale * x), ties to the smaller id.

    ``is_query`` is a condition on the column ``id``.
    """
    whole = usable(vectors, id_col, vector_col, lambda x: F.floor(x.cast("double") * scale))
    sized = whole.withColumn("dim", F.size("vector")).withColumn(
        "squared", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )
    rows = stored(sized, "vectors")
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    ranges, blocks = max(1, -(-counted["n"] // RANGE_ROWS)), max(1, -(-counted["q"] // QUERY_ROWS))
    by_length = rows.repartitionByRange(ranges, "dim", F.col("squared").desc(), F.xxhash64("id"))
    placed = stored(by_length.withColumn("range", F.spark_partition_id()), "ranges")
    queries = placed.filter(is_query).withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)))

    seed_rows = placed.orderBy(F.xxhash64("id", F.lit("seed")), "id").limit(SEED_ROWS).select("id", "dim", "vector").collect()
    seed: dict[int, tuple] = {}
    for dim in {r["dim"] for r in seed_rows}:
        same = [r for r in seed_rows if r["dim"] == dim]
        seed[dim] = (np.array([r["id"] for r in same]), np.array([r["vector"] for r in same], np.int64).reshape(len(same), dim))
    shared = rows.sparkSession.sparkContext.broadcast(seed)  # at most SEED_ROWS vectors

    def first_scores(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            ids = batch.column("id").to_numpy()
            beat = np.full(len(dims), -TOP - 1)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in shared.value:
                    continue
                seed_ids, seed_vectors = shared.value[dim]
                scores = products(matrix(batch.column("vector").take(pa.array(at))).reshape(len(at), dim), seed_vectors)
                scores[ids[at][:, None] == seed_ids[None]] = -TOP - 1
                beat[at] = kth_best(scores, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(beat)], [*batch.schema.names, "beat"])

    scored = queries.drop("range").mapInArrow(first_scores, "id long, vector array<long>, dim int, squared double, block long, beat long")
    asked = stored(scored, "asked")
    tops = placed.groupBy("range", "dim").agg(F.max("squared").alias("top"))
    if ranges <= SMALL_LIST:  # a few dozen bytes each
        tops = F.broadcast(tops)
    # a query meets the ranges that hold its dimension and could beat its score
    routed = (
        asked.join(tops, "dim")
        .filter((F.col("beat") <= 0) | (F.col("beat").cast("double") <= F.sqrt(F.col("squared") * F.col("top")) * (1 + 1e-9)))
        .select("range", "dim", "block", "id", "vector", "beat")
    )
    # a range goes to the blocks that have a query for it, and to no other
    wanted = routed.select("range", "dim", "block").distinct()
    met = placed.join(wanted, ["range", "dim"]).select("range", "dim", "block", "id", "vector")
    both = routed.unionByName(met, allowMissingColumns=True)

    def meet(group: pa.Table) -> pa.Table:
        asks = group.column("beat").is_valid()
        q, c = group.filter(asks), group.filter(pc.invert(asks))
        dim = group.column("dim")[0].as_py()
        if q.num_rows and c.num_rows:
            parts = search(
                c.column("id").to_numpy(), matrix(c.column("vector")).reshape(c.num_rows, dim), q.column("id").to_numpy(),
                matrix(q.column("vector")).reshape(q.num_rows, dim), q.column("beat").to_numpy(), k,
            )
        else:
            parts = (np.zeros(0, np.int64),) * 3
        row, ids, scores = parts
        q_ids, vectors = q.column("id").take(pa.array(row)), q.column("vector").take(pa.array(row))
        return pa.table({"query_id": q_ids, "query": vectors, "vec_id": pa.array(ids), "score": pa.array(scores)})

    found = both.groupBy("range", "dim", "block").applyInArrow(meet, "query_id long, query array<long>, vec_id long, score long")
    key = found.withColumn("query", F.xxhash64("query"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id"))
    return key.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


TOPK_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op4_exact_topk", TOPK_SQL)
def exact_topk_query(spark, folder):
    return exact_topk(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)
