"""Token ids in binary files: frequency-ranked, byte-aligned, with control bytes apart.

``write_token_files`` orders documents by id, encodes their whole texts and writes files of bounded
size; ``read_token_files`` gives the ids of every document back. Each file stands for itself. It
ranks its ids by how often they occur in it, so that the commonest 256 take one byte and the next
65,280 two, and holds:

    b"RVB1", documents, tokens, ranks   (three unsigned 64-bit integers)
    the id of each rank                 (unsigned 32-bit)
    document ids, a null flag each, token counts   (signed 64-bit, byte, signed 64-bit)
    control bytes                       (two bits a token: its bytes less one; four tokens a byte)
    data bytes                          (ranks, least significant byte first)

all little-endian. Reading looks each control byte up in a table of four lengths and gathers the
data bytes with numpy. A task writes under names of its own and reports them; files of lost
attempts are in no report and are never read.

Defined results: a null or empty text is its end id alone; null document ids come first; equal ids
stay side by side in order of a hash of their text, then the text; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.chunks import Encoder, concatenated, held, library
from paneloom.llm.shared import by_bytes, query, scratch, stored, table
from paneloom.operators.ranking import running

MAGIC = b"RVB1"
#: Tokens after which a task starts its next file.
FILE_TOKENS = 4_000_000
FILES = "part long, seq long, file string, n_docs long, n_tokens long"

#: For each control byte the lengths of its four values.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    size = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    kept = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.tobytes(), values.astype("<u4").view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    size = LENGTHS[control].reshape(-1)[:count]
    start = np.cumsum(size, dtype=np.int64) - size
    values = data[start].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        values[longer] |= data[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def file_bytes(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    often = np.bincount(ids)  # as long as the vocabulary
    order = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
    rank = np.zeros(len(often), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    control, data = encode_values(rank[ids])
    head = np.array([len(doc_ids), len(ids), len(order)], "<u8").tobytes()
    documents = (doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), counts.astype("<i8").tobytes())
    return [MAGIC, head, order.astype("<u4").tobytes(), *documents, control, data]


def parse_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, null flags, token counts and all ids of one file."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_tokens, n_ranks = (int(x) for x in np.frombuffer(content, "<u8", 3, 4))
    at = 28

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, count, at)
        at += out.nbytes
        return out

    ranked = take("<u4", n_ranks)
    doc_ids, nulls, counts = take("<i8", n_docs), take("u1", n_docs), take("<i8", n_docs)
    control = take("u1", -(-n_tokens // 4))
    return doc_ids, nulls, counts, ranked[decode_values(control, np.frombuffer(content, "u1", -1, at), n_tokens)]


def encoder(path: str, lowered: bool) -> Encoder:
    return held(("token files", path), lambda: Encoder(*library(path), concatenated, lowered))


def write_token_files(
    documents: DataFrame, path: str, folder: str, end_id: int = 1, lowered: bool = True, id_col: str = "doc_id",
    text_col: str = "text", file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Write the files below ``folder``, which all executors share; returns the list of files.

    ``lowered`` as in :class:`~paneloom.llm.chunks.Encoder`. The list is stored, so that reading it
    does not write again.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # rows of one id lie in order of a hash, so that a third of all rows with one id is spread and no rerun differs;
    # texts stay out of the ranges, whose sample of keys goes to the driver
    keyed = rows.withColumn("_order", F.xxhash64("text"))
    placed = keyed.repartitionByRange(parts, "id", "_order").sortWithinPartitions(F.col("id").asc_nulls_first(), "_order", "text").drop("_order")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[pa.Array] = []
        texts: list[bytes] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, tokens
            ids = np.frombuffer(b"".join(texts), "<u4")
            doc_ids = pa.chunked_array(docs)
            nulls = doc_ids.is_null().to_numpy().astype(np.uint8)
            numbers = doc_ids.fill_null(0).to_numpy()
            counts = np.array([len(b) // 4 for b in texts], np.int64)
            name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
            with system.open_output_stream(f"{root}/{name}") as file:
                for block in file_bytes(numbers, nulls, counts, ids):
                    file.write(block)
            row = [[part], [seq], [name], [len(texts)], [len(ids)]]
            docs.clear()
            texts.clear()
            seq, tokens = seq + 1, 0
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["part", "seq", "file", "n_docs", "n_tokens"])

        for batch in batches:
            for some in by_bytes(batch, "text"):
                new = [b + end for b in encoder(path, lowered).batch(some.column("text").to_pylist())]
                docs.append(some.column("id"))
                texts.extend(new)
                tokens += sum(map(len, new)) // 4
                if tokens >= file_tokens:
                    yield flush()
        if texts:
            yield flush()

    return stored(placed.mapInArrow(run, FILES), "token-file-list")


def read_token_files(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    ``start`` counts the ids of all documents before; ``ids`` adds the ids themselves.
    """
    starts = running(files, [], [("part", True), ("seq", True)], {"upto": F.col("n_tokens")})
    # the list is short and each of its rows a whole file, so the number of tasks is not left to the list's size
    tasks = max(1, min(files.count(), 4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    spread = starts.select("file", (F.col("upto") - F.col("n_tokens")).alias("first")).repartition(tasks, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{name}") as file:
                    doc_ids, nulls, counts, ids = parse_file(file.read())
                upto = np.cumsum(counts)
                raw = [ids[a:b].tobytes() for a, b in zip((upto - counts).tolist(), upto.tolist(), strict=True)]
                columns = [
                    pa.array(doc_ids, mask=nulls.astype(bool)),
                    pa.array(first + upto - counts),
                    pa.array(counts),
                    pa.array([crc32(b) for b in raw], pa.int64()),
                    *([pa.array(raw, pa.binary())] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


@query("op1_token_files")
def token_files(spark, folder):
    import public_tokenizers as vocabularies

    target = scratch(spark, "token-files")
    files = write_token_files(table(spark, folder, "documents"), vocabularies.path("word_bpe_49k.json"), target)
    return read_token_files(files, target)
