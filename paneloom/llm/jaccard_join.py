"""Near-duplicate join on word n-grams: MinHash bands propose, full n-gram sets decide.

``near_duplicates`` links documents whose sets of word n-grams have a Jaccard similarity of at least
``threshold``. Documents with equal sets are one node. Band and row counts follow from the recall
wanted at the threshold. Nodes are shuffled on band hashes; a pair belongs to the first band in which
it agrees, so it is looked at once. Before any n-gram set travels, signatures alone settle which
nodes have such a pair in which band; only those nodes' texts are read again and only there the sets meet.

A band bucket of many nodes is dealt into blocks, and every two blocks meet in a task of bounded
size. Tasks return per node its links and the smallest node it hangs together with, never pairs.

Words are runs of other than ASCII white space in the lowered text; a text of fewer words than n has
one gram, all its words.

Defined results: null and empty texts and texts without words have no grams, no links and classes of
their own; documents with a null id take part, and a class's name is its smallest non-null id;
repeated rows are documents of their own with equal sets; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm.chunks import held
from paneloom.llm.components import components
from paneloom.llm.shared import by_bytes, query, stored, table, whole_runs

GRAM, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.999999, 128
#: Nodes of a bucket that meet in one block of a task.
BLOCK_NODES = 512
GRAMS_AT_ONCE = 4096
#: Text whose words are hashed at once; words as objects take several times its size.
BYTES_AT_ONCE = 4_000_000
VOCABULARY_AT_ONCE = 4096

def choose_bands(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have when ``recall`` at the threshold takes at most so many hashes."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-min(threshold**rows, 1 - 1e-12)))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("more hashes are needed for this recall")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of each text's words."""
    import xxhash

    held(("word hashes",), dict)  # a hash costs no more than a cache of it; what other operators kept goes
    lists = [t.lower().encode("utf-8", "surrogatepass").split() for t in texts]
    wanted = list(dict.fromkeys(chain.from_iterable(lists)))
    get = dict(zip(wanted, map(xxhash.xxh3_64_intdigest, wanted), strict=True)).__getitem__
    return [np.fromiter(map(get, words), np.uint64, len(words)) for words in lists]


def grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams."""
    if not len(words):
        return words
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k]
    return np.unique(mixed(total))


def signature(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of a set of gram hashes; the band's number is mixed in."""
    rng = np.random.default_rng(20_240_229)
    factor = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), GRAMS_AT_ONCE):
        least = np.minimum(least, (short[at : at + GRAMS_AT_ONCE, None] * factor + shift).min(0))
    joined = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        joined = mixed(joined * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return joined.view(np.int64)


def digest(found: np.ndarray) -> tuple[int, int]:
    import xxhash

    both = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
    return int(both[0]), int(both[1])


def sketches(documents: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, text_hash, grams, d1, d2, bands) of (id, text) rows."""
    schema = T.StructType(
        [documents.schema["id"], T.StructField("text_hash", T.LongType()), *T._parse_datatype_string("grams long, d1 long, d2 long, bands array<long>").fields]
    )

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", BYTES_AT_ONCE):
                sets = [grams(w, n) for w in word_hashes([t or "" for t in part.column("text").to_pylist()])]
                digests = [digest(s) for s in sets]
                marks = [signature(s, bands, rows) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                     pa.array(marks, pa.list_(pa.int64()))],
                    ["id", "text_hash", "grams", "d1", "d2", "bands"],
                )

    return documents.select("id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def _fresh(marks: np.ndarray, key: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of rows whose first common band is the one they meet in and whose set sizes allow the threshold."""
    same = marks[a] == marks[b]
    first = same.argmax(1)
    here = marks[a, first] == key[a]
    return here & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9)


def _pairs(starts: np.ndarray, ends: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Index pairs of each cell, in groups of bounded size: two-row cells together, others one by one."""
    small = starts[ends - starts == 2]
    small = small[(low[small] == high[small]) | (block[small] != block[small + 1])]
    if len(small):
        yield small, small + 1
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - s > 2:
            at = np.arange(s, e)
            if low[s] == high[s]:
                i, j = np.triu_indices(e - s, 1)
                a, b = at[i], at[j]
            else:
                left, right = at[block[s:e] == low[s]], at[block[s:e] == high[s]]
                a, b = np.repeat(left, len(right)), np.tile(right, len(left))
            step = 200_000
            for k in range(0, len(a), step):
                yield a[k : k + step], b[k : k + step]


def _cells(rows: pa.Table):
    key, low, high, block, node, size = (rows.column(c).to_numpy() for c in ("key", "low", "high", "block", "node", "grams"))
    marks = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(key), -1)
    return key, low, high, block, node, size, marks


def _needed(threshold: float):
    """Nodes with a fresh pair in a cell."""

    def run(batches):
        for rows, starts in whole_runs(batches, ["key", "low", "high"]):
            key, low, high, block, node, size, marks = _cells(rows)
            wanted = np.zeros(len(key), bool)
            for a, b in _pairs(starts, np.append(starts[1:], len(key)), block, low, high):
                good = _fresh(marks, key, size, a, b, threshold)
                wanted[a[good]] = wanted[b[good]] = True
            yield from rows.select(["key", "low", "high", "block", "node"]).filter(pa.array(wanted)).to_batches()

    return run


def _shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common elements of each pair of sets."""
    if len(a) <= 8 * len(sets):
        out = np.empty(len(a), np.int64)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            at = np.searchsorted(y, x)
            out[k] = np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)
        return out
    found, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    many = often[at] > 1  # an element of one set is common to none
    column, owner = (np.cumsum(often > 1) - 1)[at[many]], owner[many]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    counts = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, VOCABULARY_AT_ONCE):
        s, e = np.searchsorted(column, [start, start + VOCABULARY_AT_ONCE])
        held = np.zeros((len(sets), VOCABULARY_AT_ONCE), np.float32)
        held[owner[s:e], column[s:e] - start] = 1
        counts += held @ held.T
    return counts[a, b].astype(np.int64)


def _verified(threshold: float):
    """Links of each node in a cell, and the smallest node it hangs together with there."""

    def run(batches):
        for rows, starts in whole_runs(batches, ["key", "low", "high"]):
            key, low, high, block, node, size, marks = _cells(rows)
            copies = rows.column("copies").to_numpy()
            raw = rows.column("set").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in raw]
            links = np.zeros(len(key), np.int64)
            root = node.copy()
            ends = np.append(starts[1:], len(key))
            for a, b in _pairs(starts, ends, block, low, high):
                good = _fresh(marks, key, size, a, b, threshold)
                a, b = a[good], b[good]
                if not len(a):
                    continue
                used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                common = _shared_counts([sets[i] for i in used.tolist()], at[: len(a)], at[len(a) :])
                linked = common / (size[a] + size[b] - common) >= threshold
                a, b = a[linked], b[linked]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                while True:  # smallest node first, until nothing changes
                    least = np.minimum(root[a], root[b])
                    if (root[a] == least).all() and (root[b] == least).all():
                        break
                    np.minimum.at(root, a, least)
                    np.minimum.at(root, b, least)
            kept = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(root[kept]), pa.array(links[kept])], ["node", "root", "links"])

    return run


def texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, d1, d2, text) of the rows equal in id and text hash to a wanted node; no text meets another node of its id."""
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return documents.join(wanted.withColumnsRenamed({"id": "_id", "text_hash": "_hash"}), same).select("node", "d1", "d2", "text")


def near_duplicates(
    documents: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its id and text hash, its class's name, its links to other documents, and
    whether it is the one document of its class to keep."""
    bands, rows = choose_bands(threshold, recall)
    named = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = stored(sketches(named, n, bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
    with_grams = known.filter("grams > 0")
    nodes = with_grams.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
    members = with_grams.select("row", "d1", "d2").join(nodes, ["d1", "d2"]).select("row", "node", "copies")
    members = stored(members, "members")
    firsts = members.filter("row = node").select("node", "copies")
    node_rows = stored(known.withColumnRenamed("row", "node").join(firsts, "node"), "nodes")

    in_bands = node_rows.select("node", F.explode("bands").alias("key"))
    shared_bands = in_bands.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    placed = in_bands.join(shared_bands, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK_NODES))
    own: Column = F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high")),
    )
    cells = placed.withColumn("block", own).select("key", "block", "node", F.explode(others).alias("c")).select("key", "c.*", "block", "node")
    about = node_rows.select("node", "grams", "bands", "copies")
    cell_key = ["key", "low", "high"]
    met = cells.join(about.drop("copies"), "node").repartition(*cell_key).sortWithinPartitions(*cell_key)
    needed = stored(met.mapInArrow(_needed(threshold), "key long, low long, high long, block long, node long"), "needed")

    wanted = needed.select("node").distinct().join(node_rows.select("node", "id", "text_hash", "d1", "d2"), "node")
    texts = texts_of(named, wanted)

    def sets(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", BYTES_AT_ONCE):
                found = [grams(w, n) for w in word_hashes([t or "" for t in part.column("text").to_pylist()])]
                right = [digest(s) == d for s, d in zip(found, zip(part.column("d1").to_pylist(), part.column("d2").to_pylist(), strict=True), strict=True)]
                out = pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "set"])
                yield out.filter(pa.array(right, pa.bool_()))

    full = texts.mapInArrow(sets, "node long, set binary").dropDuplicates(["node"])
    checked = needed.join(about, "node").join(full, "node").repartition(*cell_key).sortWithinPartitions(*cell_key)
    found = stored(checked.mapInArrow(_verified(threshold), "node long, root long, links long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    hung = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classed = firsts.join(links, "node", "left").join(hung, "node", "left").select(
        "node", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")
    )
    placed_rows = known.select("id", "text_hash", "row").join(members, "row", "left").join(classed, "node", "left")
    rows_out = stored(
        placed_rows.select(
            "id", "text_hash", "row", F.coalesce("root", "row").alias("root"),
            F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("links"),
        ),
        "classes",
    )
    names = rows_out.groupBy("root").agg(F.min("id").alias("class_id"), F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("kept"))
    return rows_out.join(names, "root").select(
        F.col("id").alias(id_col), "text_hash", "class_id", "links", (F.col("row") == F.col("kept")).alias("keep")
    )


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents``, with all their columns, without the near copies of a kept one.

    Of rows equal in id and text one stays.
    """
    found = near_duplicates(documents, id_col=id_col, text_col=text_col, **options)
    kept = stored(found.filter("keep").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "kept")
    repeated = stored(found.groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "repeated")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & F.xxhash64(text_col).eqNullSafe(F.col("_hash"))
    if repeated.isEmpty():
        return documents.join(kept, same, "left_semi")
    once = documents.join(repeated, same, "left_anti").join(kept, same, "left_semi")
    often = documents.join(repeated, same, "left_semi").join(kept, same, "left_semi")
    return once.unionByName(often.dropDuplicates([id_col, text_col]))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c / (a.n + b.n - c)::DOUBLE >= 0.8),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT y, root FROM r JOIN l ON x = node),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT doc_id, min(root) AS class_id, coalesce(any_value(k.n), 0)::BIGINT AS n_links
FROM documents JOIN r ON node = doc_id LEFT JOIN k ON x = doc_id GROUP BY doc_id
"""


@query("op8_jaccard_join", JACCARD_SQL)
def jaccard_join(spark, folder):
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id", F.col("links").alias("n_links"))
