"""Hard negatives by Strassen products of integer tiles and mergeable heaps.

Scores are inner products of an anchor with every row of its dimension, made tile by tile: blocks of
anchors meet chunks of candidates, and inside, a tile of int64 rows is multiplied by Strassen's seven
products, recursively, with odd sides padded by zeros. Additions of int64 are exact modulo 2^64, so a
product that fits 64 bits is right whatever happens on the way.

The first pass keeps, for each anchor, a heap of its best rows of the same label; heaps of chunks merge
into the anchor's positives. The second pass makes the products again and keeps, for each positive, a heap
of the best rows of another label inside the positive's score window.

Candidates stream through a task in Arrow batches, so a chunk may be any size: a task holds one block of
anchors, one tile and the heaps. Chunks grow with the square root of the rows, and with them the number
of heaps that an anchor has to merge. Blocks and chunks are drawn from a hash of the whole row.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no
part; rows equal in id, label and vector count once; of rows with one id and different vectors or labels
each is a row of its own, and as an anchor gives rows of its own; vectors of different dimension don't
meet; ties go to the smaller id; an anchor without positives, and a positive without negatives in its
window, give no rows; components and scores beyond 64 bits are held at the bound; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.llm.exact_topk import TOP, matrix
from paneloom.llm.shared import query, stored, table

#: Sides down to which tiles are split, rows of a tile, and components of a block of anchors.
LEAF, TILE_ROWS, BLOCK_CELLS = 32, 1024, 2**20
LEAST = -TOP - 1


def leaf_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two small tiles, through floats where every sum is exact in them."""
    if a.dtype != object and a.size and b.size:
        most = max(-float(a.min()), float(a.max())) * max(-float(b.min()), float(b.max())) * a.shape[1]
        if most < 2**53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def padded(a: np.ndarray) -> np.ndarray:
    """Even sides by zeros."""
    return np.pad(a, [(0, n % 2) for n in a.shape])


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product by seven products of half the side."""
    if min(*a.shape, b.shape[1]) <= LEAF:
        return leaf_product(a, b)
    rows, columns = a.shape[0], b.shape[1]
    a, b = padded(a), padded(b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11), strassen(a11, b12 - b22)
    p4, p5 = strassen(a22, b21 - b11), strassen(a11 + a12, b22)
    p6, p7 = strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * m, 2 * n), a.dtype)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer products of all rows of one tile with all of the other, held at the bounds of 64 bits."""
    if not anchors.size or not candidates.size:
        return np.zeros((len(anchors), len(candidates)), np.int64)
    most = [max(-int(x.min()), int(x.max())) for x in (anchors, candidates)]
    if most[0] * most[1] * anchors.shape[1] < 2**63:
        return strassen(anchors, candidates.T)
    return np.clip(strassen(anchors.astype(object), candidates.T.astype(object)), LEAST, TOP).astype(np.int64)


class Heaps:
    """The best few (score, id) of each row: larger scores first, then smaller ids."""

    def __init__(self, rows: int, size: int) -> None:
        self.size = size
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.beat = np.full(rows, LEAST)

    def offer(self, tile: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> None:
        """Merge the wanted entries of a tile of scores, whose columns are ids."""
        wanted = wanted & (tile >= self.beat[:, None])
        if tile.shape[1] > self.size and np.count_nonzero(wanted) > 4 * self.size * len(tile):
            at = tile.shape[1] - self.size
            wanted &= tile >= np.partition(np.where(wanted, tile, LEAST), at, axis=1)[:, at, None]
        row, column = np.nonzero(wanted)
        if not len(row):
            return
        row, score = np.concatenate([self.row, row]), np.concatenate([self.score, tile[row, column]])
        some = np.concatenate([self.id, ids[column]])
        order = np.lexsort((some, ~score, row))  # ~ turns the order round without overflow
        row, score, some = row[order], score[order], some[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.size
        self.row, self.score, self.id = row[kept], score[kept], some[kept]
        full = place[kept] == self.size - 1
        self.beat[self.row[full]] = self.score[full]


def shares(value: int, share: tuple[int, int], up: bool) -> int:
    """Ceiling or floor of value times a fraction."""
    whole = value * share[0]
    return max(LEAST, min(TOP, -(-whole // share[1]) if up else whole // share[1]))


class Block:
    """One block of anchors with its heaps, through which candidates stream."""

    def __init__(self, rows: pa.Table, dim: int, sizes: tuple[int, int], window: tuple | None) -> None:
        self.id, self.key = rows.column("id").to_numpy(), rows.column("key").to_numpy()
        self.label, self.vectors = rows.column("label").to_numpy(), matrix(rows.column("vector")).reshape(rows.num_rows, dim)
        self.second = window is not None
        if self.second:
            listed = rows.column("positives").to_pylist()
            self.positive = [[(p["id"], p["score"]) for p in ps] for ps in listed]
            self.slots = max((len(p) for p in self.positive), default=0)
            edges = np.tile(np.array([TOP, LEAST]), (self.slots, len(listed), 1))  # an empty window where there is no positive
            for row, ps in enumerate(self.positive):
                for slot, (_, score) in enumerate(ps):
                    edges[slot, row] = shares(score, window[0], True), shares(score, window[1], False)
            self.edges = edges
        count, self.starts = (self.slots if self.second else 1), range(0, len(self.id), TILE_ROWS)
        self.heaps = [[Heaps(len(self.id[s : s + TILE_ROWS]), sizes[self.second]) for _ in range(count)] for s in self.starts]

    def meet(self, rows: pa.Table) -> None:
        dim = self.vectors.shape[1]
        for at in range(0, rows.num_rows, TILE_ROWS):
            some = rows.slice(at, TILE_ROWS)
            ids, keys = some.column("id").to_numpy(), some.column("key").to_numpy()
            labels, vectors = some.column("label").to_numpy(), matrix(some.column("vector")).reshape(some.num_rows, dim)
            for s, heaps in zip(self.starts, self.heaps, strict=True):
                mine = slice(s, s + TILE_ROWS)
                tile = scores(self.vectors[mine], vectors)
                same = self.label[mine, None] == labels[None]
                if not self.second:
                    own = (self.id[mine, None] == ids[None]) & (self.key[mine, None] == keys[None])
                    heaps[0].offer(tile, same & ~own, ids)
                    continue
                for slot, heap in enumerate(heaps):
                    low, high = self.edges[slot, mine, 0], self.edges[slot, mine, 1]
                    heap.offer(tile, ~same & (tile >= low[:, None]) & (tile <= high[:, None]), ids)

    def found(self):
        for s, heaps in zip(self.starts, self.heaps, strict=True):
            for slot, heap in enumerate(heaps):
                row = s + heap.row
                columns = {"anchor_id": self.id[row], "anchor_key": self.key[row]}
                if self.second:
                    positive = [self.positive[r][slot] for r in row.tolist()]
                    columns |= {
                        "slot": np.full(len(row), slot, np.int32), "positive_id": np.array([p for p, _ in positive], np.int64),
                        "positive_score": np.array([p for _, p in positive], np.int64),
                    }
                yield pa.RecordBatch.from_pydict(columns | {"id": heap.id, "score": heap.score})


def meeting(anchors: DataFrame, rows: DataFrame, blocks: int, chunks: int, sizes: tuple[int, int], window: tuple | None) -> DataFrame:
    """Heaps of every (block of anchors, chunk of candidates)."""

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    block, chunk = F.pmod("key", F.lit(blocks)), F.pmod(F.xxhash64("key"), F.lit(chunks))
    asks = anchors.select("*", block.alias("block"), every(chunks).alias("chunk"), F.lit(0).alias("kind"))
    both = asks.unionByName(rows.select("*", every(blocks).alias("block"), chunk.alias("chunk"), F.lit(1).alias("kind")), allowMissingColumns=True)
    group = ["dim", "block", "chunk"]

    def run(batches):
        # rows come in order of group and kind: a group's anchors, then its candidates
        now, waiting, held = None, [], None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            columns = [part.column(c).to_numpy() for c in [*group, "kind"]]
            changed = np.zeros(max(0, part.num_rows - 1), bool)
            for c in columns:
                changed |= c[1:] != c[:-1]
            edges = [0, *(np.flatnonzero(changed) + 1).tolist(), part.num_rows]
            for start, stop in zip(edges, edges[1:], strict=False):
                if start == stop:
                    continue
                key, some = tuple(int(c[start]) for c in columns[:3]), part.slice(start, stop - start)
                if key != now:
                    if held is not None:
                        yield from held.found()
                    now, waiting, held = key, [], None
                if columns[3][start] == 0:
                    waiting.append(some)
                elif waiting or held is not None:
                    if held is None:
                        held, waiting = Block(pa.concat_tables(waiting), key[0], sizes, window), []
                    held.meet(some)
        if held is not None:
            yield from held.found()

    more = "slot int, positive_id long, positive_score long, " if window else ""
    placed = both.repartition(*group).sortWithinPartitions(*group, "kind")
    return placed.mapInArrow(run, f"anchor_id long, anchor_key long, {more}id long, score long")


def first(found: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """The n best of the merged heaps."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))
    return found.withColumn(name, rank).filter(F.col(name) <= n)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, window: tuple = ((1, 2), (19, 20)), scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each positive's hard negatives.

    ``is_anchor`` is a condition on the column ``id``; ``window`` holds the least and the largest share of
    the positive's score, as fractions.
    """
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & sound)
    whole = usable.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
    ).distinct()
    rows = stored(whole.select("*", F.size("vector").alias("dim"), F.xxhash64("id", "label", "vector").alias("key")), "mining")
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("a"), F.max("dim").alias("d")).first()
    blocks = max(1, -(-counted["a"] // max(1, BLOCK_CELLS // max(1, counted["d"] or 1))))
    chunks = max(1, math.isqrt(counted["n"]) // 32)
    sizes = (positives, negatives)
    best = first(meeting(rows.filter(is_anchor), rows, blocks, chunks, sizes, None), ["anchor_id", "anchor_key"], positives, "slot")
    listed = best.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("slot", "id", "score"))).alias("positives"))
    known = rows.filter(is_anchor).join(listed, (F.col("id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key")))
    anchors = stored(known.drop("anchor_id", "anchor_key"), "anchors")
    found = first(meeting(anchors, rows, blocks, chunks, sizes, window), ["anchor_id", "anchor_key", "slot"], negatives, "rank")
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.v AS av, a.label AS al, c.vec_id, c.label = a.label AS same, c.vec_id = a.vec_id AND c.v = a.v AS itself,
         list_inner_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND len(a.v) = len(c.v)),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, av, al ORDER BY score DESC, vec_id) AS slot FROM s WHERE same AND NOT itself) q
  WHERE slot <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.av, p.al, p.slot ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.av = p.av AND s.al = p.al AND NOT s.same
                AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def hard_negatives_query(spark, folder):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings").withColumn("label", moved), F.col("id") % 50 == 0)
