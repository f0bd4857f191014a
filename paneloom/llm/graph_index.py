"""Approximate nearest neighbours by largest inner product on robust-pruned directed graphs.

``build_index`` deals the distinct vectors into shards of like lengths and bounded expected size and
builds a graph in each: vectors are inserted in batches; a greedy beam search on the graph so far proposes
neighbours, and relaxed distance pruning keeps an edge only if no edge kept before leads closer by the
factor ``ALPHA``, so that directions stay diverse; all reverse edges of a batch are pruned alike. Vectors
get one more coordinate that makes all lengths equal, so the largest inner product is the shortest
distance. Lengths of a shard differ by less than a factor of four, so that coordinate never drowns the
others, and distances are taken in double precision.

``search_index`` sends every query to every shard, where queries stream past the shard's graph in order
of arrival: a task holds one shard and one batch of queries. Beam search finds candidates, and the best of
all shards are kept. Scores are exact products of the original vectors.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a
null id, take no part; rows equal in id and vector count once; equal vectors are one node, and a
query finds the smallest ids of it; vectors of different dimension don't meet; a query never finds
its own id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.llm.exact_topk import matrix, usable
from paneloom.llm.shared import query, stored, table

#: Nodes of a shard, and queries that one task sends past it; more queries get copies of the shard.
SHARD_NODES, QUERY_ROWS = 16384, 2**20
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, BATCH, STEP = 32, 64, 192, 1.2, 256, 4
#: Distances between candidates that are held while pruning.
CELLS = 8_000_000


def beam_search(points: np.ndarray, squares: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, width: int):
    """Nearest nodes found for each query, nearest first: (ids, distances less the query's square)."""
    n, rows = len(points), np.arange(len(queries))
    ids = np.full((len(queries), width), -1, np.int64)
    near = np.full((len(queries), width), np.inf)
    done = np.zeros((len(queries), width), bool)
    seen = np.zeros((len(queries), n), bool)
    ids[:, 0], seen[:, entry] = entry, True
    near[:, 0] = squares[entry] - 2 * (queries @ points[entry])
    active = rows
    step = min(STEP, width)
    while len(active):
        waiting = np.where(done[active], np.inf, near[active])
        pick = np.argpartition(waiting, step - 1, axis=1)[:, :step] if step < width else np.argsort(waiting, axis=1)
        good = np.isfinite(np.take_along_axis(waiting, pick, 1))
        some = good.any(1)
        active, pick, good = active[some], pick[some], good[some]
        if not len(active):
            break
        done[active[:, None], pick] = done[active[:, None], pick] | good
        around = np.where(good[:, :, None], graph[ids[active[:, None], pick]], -1).reshape(len(active), -1)
        around.sort(axis=1)
        fresh = around >= 0
        fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
        fresh &= ~seen[active[:, None], around]
        at, column = np.nonzero(fresh)
        found = around[at, column]
        seen[active[at], found] = True
        most = int(fresh.sum(1).max(initial=0))
        if not most:
            continue
        distance = squares[found] - 2 * np.einsum("ij,ij->i", points[found], queries[active[at]])
        place = np.arange(len(at)) - np.searchsorted(at, at)
        more_ids = np.full((len(active), most), -1, np.int64)
        more = np.full((len(active), most), np.inf)
        more_ids[at, place], more[at, place] = found, distance
        all_ids = np.concatenate([ids[active], more_ids], 1)
        all_near = np.concatenate([near[active], more], 1)
        all_done = np.concatenate([done[active], np.zeros(more.shape, bool)], 1)
        best = np.argpartition(all_near, width - 1, axis=1)[:, :width]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        near[active] = np.take_along_axis(all_near, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
    order = np.argsort(near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def robust_prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Up to DEGREE diverse neighbours of each owner among its candidates (-1: none)."""
    step = max(1, CELLS // max(1, candidates.shape[1] * max(candidates.shape[1], points.shape[1])))
    parts = [prune_some(points, owners[at : at + step], candidates[at : at + step]) for at in range(0, len(owners), step)]
    return np.concatenate([np.zeros((0, DEGREE), np.int32), *parts])


def prune_some(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    ids = np.sort(candidates, axis=1)
    valid = (ids >= 0) & (ids != owners[:, None])
    valid[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    at = points[ids]
    far = ((at - points[owners][:, None]) ** 2).sum(2)
    far[~valid] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    ids, far, at = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(at, order[:, :, None], 1)
    squares = (at * at).sum(2)
    between = squares[:, :, None] + squares[:, None] - 2 * np.matmul(at, at.transpose(0, 2, 1))
    alive, rows = np.isfinite(far), np.arange(len(owners))
    out = np.full((len(owners), DEGREE), -1, np.int32)
    for k in range(DEGREE):
        some = alive.any(1)
        if not some.any():
            break
        first = alive.argmax(1)
        out[some, k] = ids[rows, first][some]
        alive[rows, first] = False
        alive &= ALPHA * ALPHA * between[rows, first] > far
    return out


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate that makes all lengths equal; scaled to length 1."""
    vectors = vectors / max(float(np.abs(vectors).max(initial=0)), 1e-300)
    squares = (vectors * vectors).sum(1)
    top = max(float(squares.max(initial=0)), 1e-300)
    return np.concatenate([vectors, np.sqrt(np.maximum(0, top - squares))[:, None]], 1).astype(np.float64) / np.sqrt(top)


def build_graph(vectors: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """Neighbours of every vector, and the node where searches start."""
    points = lifted(vectors)
    squares = (points * points).sum(1)
    n = len(points)
    graph = np.full((n, DEGREE), -1, np.int32)
    entry = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != entry]
    at, size = 0, 1
    while at < len(order):
        new = order[at : at + size]
        at, size = at + size, min(BATCH, size * 2)
        found, _ = beam_search(points, squares, graph, entry, points[new], BUILD_BEAM)
        graph[new] = robust_prune(points, new, found)
        source = np.repeat(new, DEGREE)
        target = graph[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        owners, start = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(start, np.diff(np.append(start, len(target))))
        back = np.full((len(owners), int(place.max(initial=0)) + 1), -1, np.int64)  # one edge a new vector at most
        back[np.searchsorted(owners, target), place] = source
        both = -np.sort(-np.concatenate([graph[owners], back], 1), axis=1)
        many = (both >= 0).sum(1)
        graph[owners[many <= DEGREE]] = both[many <= DEGREE, :DEGREE]
        for low, high in ((DEGREE, 2 * DEGREE), (2 * DEGREE, both.shape[1])):  # few rows are wide
            some = np.flatnonzero((many > low) & (many <= high))
            if len(some):
                graph[owners[some]] = robust_prune(points, owners[some], both[some, :high])
    return graph, entry


def build_index(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per distinct vector: (shard, dim, node, entry, vector, ids, near); stored.

    ``ids`` are its k + 1 smallest ids, the most that any query can be given.
    """
    rows = usable(vectors, id_col, vector_col, lambda x: x.cast("double")).filter(F.exists("vector", lambda x: x != 0))
    key = rows.select("id", "vector", F.size("vector").alias("dim"), F.xxhash64("vector").alias("h"))
    first = F.row_number().over(Window.partitionBy("h", "vector").orderBy("id"))
    same = key.withColumn("n", first).filter(F.col("n") <= k + 1)
    nodes = stored(same.groupBy("dim", "h", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
    # lengths within a power of four
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(x / length, F.lit(2)))
    sized = nodes.withColumn("scale", F.floor((F.log2(length) + F.log2(square) / 2) / 2).cast("long"))
    counts = sized.groupBy("dim", "scale").agg(F.count(F.lit(1)).alias("n"))  # at most some 1,100 for a dimension
    cuts = counts.select("dim", "scale", F.ceil(F.col("n") / SHARD_NODES).alias("parts"))
    spread = sized.join(cuts, ["dim", "scale"])
    placed = spread.select((F.col("scale") * 2**40 + F.pmod("h", F.col("parts"))).alias("shard"), "dim", "vector", "ids")

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("vector_key", "ascending")])
        dim = group.column("dim")[0].as_py()
        points = matrix(group.column("vector")).reshape(group.num_rows, dim)
        graph, entry = build_graph(points)
        near = pa.ListArray.from_arrays(pa.array(np.arange(0, graph.size + 1, DEGREE), pa.int32()), pa.array(graph.ravel()))
        return pa.table(
            {"shard": group.column("shard"), "dim": group.column("dim"), "node": pa.array(np.arange(group.num_rows)),
             "entry": pa.array(np.full(group.num_rows, entry)), "vector": group.column("vector"), "ids": group.column("ids"), "near": near}
        )

    keyed = placed.withColumn("vector_key", F.xxhash64("vector"))
    schema = "shard long, dim int, node long, entry long, vector array<double>, ids array<long>, near array<int>"
    return stored(keyed.groupBy("shard", "dim").applyInArrow(build, schema), "graph-index")


def search_index(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best found for each (id, vector) query."""
    asked = stored(queries.withColumn("dim", F.size("vector")), "queries")
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)))
    shards = index.filter("node = 0").select("shard", "dim")
    routed = asked.join(F.broadcast(shards) if index.count() <= SHARD_NODES * 10_000 else shards, "dim")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    both = routed.unionByName(index.select("*", every).withColumnRenamed("vector", "point"), allowMissingColumns=True)
    keyed = both.withColumn("key", F.xxhash64("vector"))
    group = ["dim", "shard", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, graph = None, [], None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            columns = [part.column(c).to_numpy() for c in group]
            columns.append(part.column("node").is_null().to_numpy())
            changed = np.zeros(max(0, part.num_rows - 1), bool)
            for c in columns:
                changed |= c[1:] != c[:-1]
            edges = [0, *(np.flatnonzero(changed) + 1).tolist(), part.num_rows]
            for start, stop in zip(edges, edges[1:], strict=False):
                if start == stop:
                    continue
                name, some = tuple(int(c[start]) for c in columns[:3]), part.slice(start, stop - start)
                if name != now:
                    now, waiting, graph = name, [], None
                if not columns[3][start]:
                    waiting.append(some)
                    continue
                if graph is None:
                    graph, waiting = Shard(pa.concat_tables(waiting), name[0]), []
                for at in range(0, some.num_rows, BATCH):
                    yield graph.search(some.slice(at, BATCH), k)

    order = [F.col("node").asc_nulls_last()]
    placed = keyed.repartition(*group).sortWithinPartitions(*group, *order)
    found = placed.mapInArrow(run, "query_id long, query long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Shard:
    """Graph of one shard, ready to be searched."""

    def __init__(self, nodes: pa.Table, dim: int) -> None:
        self.points = matrix(nodes.column("point")).reshape(nodes.num_rows, dim)
        self.graph = matrix(nodes.column("near")).reshape(nodes.num_rows, DEGREE)
        self.entry, self.up = nodes.column("entry")[0].as_py(), lifted(self.points)
        self.squares, self.members = (self.up * self.up).sum(1), nodes.column("ids")

    def search(self, asked: pa.Table, k: int) -> pa.RecordBatch:
        vectors = matrix(asked.column("vector")).reshape(asked.num_rows, -1)
        unit = vectors / np.abs(vectors).max(1)[:, None]
        unit = unit / np.sqrt((unit * unit).sum(1))[:, None]
        unit = np.concatenate([unit, np.zeros((len(unit), 1))], 1)
        found, _ = beam_search(self.up, self.squares, self.graph, self.entry, unit, max(SEARCH_BEAM, 2 * k))
        q_ids, keys = asked.column("id").to_pylist(), asked.column("key").to_pylist()
        out: dict[str, list] = {"query_id": [], "query": [], "vec_id": [], "score": []}
        for i, row in enumerate(found):
            row = row[row >= 0]
            scores = self.points[row] @ vectors[i]
            first = np.argsort(-scores, kind="stable")
            # equal scores stay together: a node's smaller ids may come before those of the one at the border
            kept = first[scores[first] >= scores[first[min(k, len(first) - 1)]]]
            lists = self.members.take(pa.array(row[kept])).to_pylist()
            hits = [(-s, m) for ids, s in zip(lists, scores[kept].tolist(), strict=True) for m in ids if m != q_ids[i]]
            for s, m in sorted(hits)[:k]:
                for name, value in zip(out, (q_ids[i], keys[i], m, -s), strict=True):
                    out[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def approximate_topk(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Build the index over all vectors and search it for those whose ``id`` meets the condition."""
    index = build_index(vectors, k, id_col, vector_col)
    rows = usable(vectors, id_col, vector_col, lambda x: x.cast("double")).filter(F.exists("vector", lambda x: x != 0))
    return search_index(index, rows.filter(is_query), k)


@query("op9_graph_neighbours")
def graph_neighbours(spark, folder):
    return approximate_topk(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)
