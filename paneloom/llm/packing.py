"""Cost-balanced packing of token sequences.

``pack`` cuts documents into pieces and lays them into sequences of a fixed token capacity. Each
task packs the documents it reads in windows: it opens as many sequences as the window's tokens
need, estimates a piece's cost as linear plus quadratic in its length, and gives the pieces, the
dearest first, to the sequence of lowest cost that still has room. A piece that fits nowhere whole
is cut to the largest room. A window leaves less than one sequence of padding and nothing is
shuffled; the placement follows from the rows a task reads, so a repeated task gives it again.

Defined results: a null or empty text is its end id alone; a document over the capacity fills whole
sequences first; repeated rows are packed each for itself; a null id stays null; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm.chunks import Encoder, concatenated, held, library
from paneloom.llm.shared import by_bytes, query, table

#: Tokens and documents that one window packs together.
WINDOW_TOKENS, WINDOW_ROWS = 4_000_000, 8_000
#: Linear cost of a token against the quadratic cost of a pair of tokens: six times the model width.
LINEAR_COST = 6 * 1024.0


def cost(length, linear: float = LINEAR_COST):
    return linear * length + length * length


def assign(lengths: np.ndarray, capacity: int, linear: float = LINEAR_COST) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths."""
    whole = lengths // capacity
    out = [(d, k * capacity, capacity, -1, 0) for d in np.flatnonzero(whole).tolist() for k in range(int(whole[d]))]
    out = [(d, s, n, i, 0) for i, (d, s, n, _, _) in enumerate(out)]
    first = len(out)
    rest = lengths - whole * capacity
    open_ = -(-int(rest.sum()) // capacity)
    room, spent = np.full(open_, capacity, np.int64), np.zeros(open_)
    order = np.argsort(-rest, kind="stable")
    for d in order[: np.count_nonzero(rest)].tolist():
        start, left = int(whole[d]) * capacity, int(rest[d])
        while left:
            fits = np.where(room >= left, spent, np.inf)
            i = int(fits.argmin())
            if fits[i] == np.inf:
                i = int(room.argmax())
            n = min(left, int(room[i]))
            out.append((d, start, n, first + i, capacity - int(room[i])))
            room[i] -= n
            spent[i] += cost(n, linear)
            start, left = start + n, left - n
    return out


def encoder(path: str) -> Encoder:
    return held(("packing", path), lambda: Encoder(*library(path), concatenated))


PIECE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def pack(
    documents: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    linear: float = LINEAR_COST, with_ids: bool = False,
) -> DataFrame:
    """One row per piece. ``ids`` holds its ids as little-endian 32-bit integers if asked for.

    The sequence number's upper bits are the task's number, so tasks need not agree on one.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["id", *[f.name for f in PIECE if with_ids or f.name != "ids"]]
    out_schema = T.StructType([rows.schema["id"], *[f for f in PIECE if f.name in names]])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        used = 0
        id_arrays: list[pa.Array] = []
        ids: list[bytes] = []
        tokens = 0

        def window() -> pa.RecordBatch:
            nonlocal used, tokens
            lengths = np.array([len(b) // 4 for b in ids], np.int64)
            pieces = np.array(assign(lengths, capacity, linear), np.int64).reshape(-1, 5)
            doc, start, length, seq, offset = pieces.T
            cut = [ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            columns = {
                "id": pa.chunked_array(id_arrays).combine_chunks().take(pa.array(doc)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array([crc32(b) for b in cut], pa.int64()),
                "doc_tokens": pa.array(lengths[doc]),
                "sequence_id": pa.array(base + used + seq),
                "offset": pa.array(offset),
            }
            if with_ids:
                columns["ids"] = pa.array(cut, pa.binary())
            used += int(seq.max()) + 1
            id_arrays.clear()
            ids.clear()
            tokens = 0
            return pa.RecordBatch.from_arrays([columns[n] for n in names], names)

        for batch in batches:
            for part in by_bytes(batch, "text"):
                new = [b + end for b in encoder(path).batch(part.column("text").to_pylist())]
                id_arrays.append(part.column("id"))
                ids.extend(new)
                tokens += sum(map(len, new)) // 4
                if tokens >= WINDOW_TOKENS or len(ids) >= WINDOW_ROWS:
                    yield window()
        if ids:
            yield window()

    return rows.mapInArrow(run, out_schema).withColumnRenamed("id", id_col)


@query("op2_packing")
def packing(spark, folder):
    import public_tokenizers as vocabularies

    return pack(table(spark, folder, "documents"), vocabularies.path("byte_bpe_50k.json"))
