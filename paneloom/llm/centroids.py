"""Centroid clustering of integer vectors by Orchard's search.

Every round walks, for each vector, the list of the other centroids sorted by their distance from the
centroid held. A closer centroid is jumped to at once and its own list is walked instead; centroids met
are marked and not measured again; the walk stops at the first neighbour strictly beyond twice the
vector's distance, since no later one can be nearer, nor as near. All numbers are integers, so bounds,
ties and means are exact.

A round is one Arrow pass over the stored vectors. A task emits one sum per centroid and component, Spark
adds them, and centroids times components numbers reach the driver. No centroid gathers its vectors, so
one may own any share of the rows. Rounds that change nothing are not repeated.

Defined results: vectors of another dimension, null ones and those with null or non-finite components
take no part; every other row counts, repeated rows as often as they occur; a row with a null id is
clustered too, but starts a centroid only when there are too few others; rows of equal id start
centroids in order of their vectors; with fewer vectors than centroids there are fewer centroids; an
empty table gives no rows; components, distances and inertias beyond 64 bits are held at the bound;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.exact_topk import TOP, matrix
from paneloom.llm.shared import query, stored, table


def exact_kind(*parts: np.ndarray) -> type:
    """Numbers in which squared distances of such components are exact."""
    most = max((max(-float(p.min()), float(p.max())) for p in parts if p.size), default=0.0)
    return np.int64 if 16 * most * most * max(1, parts[0].shape[-1]) < 2**62 else object


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between centroids, and the others of each, nearest first."""
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    lists = [sorted((j for j in range(len(centroids)) if j != i), key=lambda j: (between[i, j], j)) for i in range(len(centroids))]
    return between, np.array(lists, np.int64).reshape(len(centroids), -1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), its squared distance, and how many
    distances were measured."""
    kind = exact_kind(vectors, centroids)
    vectors, centroids = vectors.astype(kind), centroids.astype(kind)
    between, lists = neighbour_lists(centroids)
    rows = np.arange(len(vectors))
    held, place = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    met = np.zeros((len(rows), len(centroids)), bool)
    met[:, 0] = True
    distance = ((vectors - centroids[0]) ** 2).sum(1)
    measured = len(rows)
    while len(rows := rows[place[rows] < lists.shape[1]]):
        other = lists[held[rows], place[rows]]
        within = (between[held[rows], other] <= 4 * distance[rows]).astype(bool)
        rows, other = rows[within], other[within]
        place[rows] += 1
        fresh = ~met[rows, other]
        at, other = rows[fresh], other[fresh]
        met[at, other] = True
        measured += len(at)
        found = ((vectors[at] - centroids[other]) ** 2).sum(1)
        closer = ((found < distance[at]) | ((found == distance[at]) & (other < held[at]))).astype(bool)
        at, other = at[closer], other[closer]
        held[at], distance[at], place[at] = other, found[closer], 0
    return held, distance, measured


def start(rows: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The k vectors with the smallest sha-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "vector").limit(k).select("vector").collect()  # k vectors
    return np.array([r["vector"] for r in first], np.int64).reshape(len(first), dim)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floored means of their vectors; those without any stay."""
    width = centroids.shape[1]

    def sums(batches):
        total, count = np.zeros(centroids.shape, object), [0] * len(centroids)
        for batch in batches:
            vectors = matrix(batch.column("vector")).reshape(batch.num_rows, width)
            held, _, _ = nearest(vectors, centroids)
            for c in np.unique(held).tolist():
                mine = vectors[held == c]
                small = float(np.abs(mine.astype(np.float64)).max()) * len(mine) < 2**62
                total[c] += mine.sum(0).astype(object) if small else mine.astype(object).sum(0)
                count[c] += len(mine)
        some = [c for c, n in enumerate(count) if n]
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array(np.repeat(some, width), pa.int32()),
                "place": pa.array(np.tile(np.arange(width), len(some)), pa.int32()),
                "total": pa.array([t for c in some for t in total[c]], pa.decimal128(38, 0)),
                "n": pa.array(np.repeat([count[c] for c in some], width), pa.int64()),
            }
        )

    parts = rows.select("vector").mapInArrow(sums, "cluster int, place int, total decimal(38,0), n long")
    after = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k times width
        after[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return after


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024.0, seed: int = 3, id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every kept vector, stored, and the final centroids.

    ``k`` centroids are held by the driver and every task; their lists hold k times k numbers.
    """
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    kept = vectors.filter(v.isNotNull() & (F.size(v) == dim) & sound).select(F.col(id_col).alias("id"), whole.alias("vector"))
    rows = stored(kept, "cluster-vectors")
    centroids = start(rows, k, seed, dim)
    for _ in range(rounds if len(centroids) else 0):
        after = moved(rows, centroids)
        if (after == centroids).all():
            break
        centroids = after

    def assign(batches):
        for batch in batches:
            held, distance, _ = nearest(matrix(batch.column("vector")).reshape(batch.num_rows, dim), centroids)
            distance = np.minimum(distance, TOP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    return stored(rows.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "clusters"), centroids


def summed(column: Column) -> Column:
    return F.sum(column.cast("decimal(38,0)"))


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Assigned rows with the distance summed over their cluster and over all, and their centroid's digest."""
    spark = assigned.sparkSession
    found = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(summed(F.col("distance")).alias("s")).collect()}  # k rows
    total = min(TOP, sum(found.values()))
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    facts = [(c, min(TOP, s), total, digests[c]) for c, s in found.items()]
    of = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster")  # one row a centroid


_SOUND = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _rounds_sql(rounds: int) -> str:
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
              FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND {_SOUND})""",
        """e AS MATERIALIZED (SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM v)""",
        """c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1)::INT AS cluster, v AS c
              FROM v ORDER BY cluster LIMIT 8)""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT row, min(struct_pack(d := d, cluster := cluster)) AS b FROM (
                  SELECT row, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN c{r}) q
                GROUP BY 1)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
                      SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS m FROM (
                        SELECT b.cluster AS cluster, place, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN e USING (row) GROUP BY 1, 2) t GROUP BY 1) u
                    USING (cluster))"""
            )
    return "WITH " + ",\n".join(steps)


CLUSTER_SQL = f"""
{_rounds_sql(10)}
SELECT vec_id, b.cluster AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.cluster)::BIGINT AS cluster_inertia,
       sum(b.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a10 JOIN v USING (row) JOIN c10 ON c10.cluster = b.cluster
"""


@query("op13_orchard_clusters", CLUSTER_SQL)
def orchard_clusters(spark, folder):
    assigned, centroids = cluster(table(spark, folder, "embeddings"))
    rows = with_inertia(assigned, centroids).withColumnRenamed("id", "vec_id")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
