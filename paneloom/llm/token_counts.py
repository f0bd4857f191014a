"""Token counts by byte-pair merging with a heap over a linked list.

``count_tokens`` counts what a byte-level vocabulary file gives for whole texts. A word's bytes form
a linked list; a heap yields the adjacent pair of lowest rank again and again, and the count is the
number of bytes minus the merges done. No identifiers are made. Counts of words are cached in a
bounded table. Rows stay where they are: no shuffle.

Defined results: a null or empty text has no bytes and no tokens; a special string inside a text is
one token; repeated rows each give a row; a null id stays null; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm.chunks import BYTE_SYMBOLS, Encoder, held, special_strings, summed
from paneloom.llm.shared import by_bytes, query, table


class PairMerger:
    """Counts of single texts: split by the published pattern, then merge each part."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {pair: rank for rank, pair in enumerate(pairs)}
        self.symbol = BYTE_SYMBOLS
        self.pattern = regex.compile(pattern)
        self.specials = special_strings(path)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")

    def merged(self, part: str) -> int:
        symbols = [self.symbol[b] for b in part.encode()]
        n = len(symbols)
        rank, after, before = self.rank, [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank[pair], i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = left + right, ""
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (pair := (symbols[i], symbols[k])) in rank:
                    heapq.heappush(heap, (rank[pair], i, *pair))
            h = before[i]
            if h >= 0 and (pair := (symbols[h], symbols[i])) in rank:
                heapq.heappush(heap, (rank[pair], h, *pair))
        return n - merges

    def count(self, text: str) -> int:
        total, at = 0, 0
        for found in self.special.finditer(text):
            total += 1 + sum(map(self.merged, self.pattern.findall(text, at, found.start())))
            at = found.end()
        return total + sum(map(self.merged, self.pattern.findall(text[at:] if at else text)))

    def counts(self, texts: list[str]) -> list[int]:
        return list(map(self.count, texts))


def counter(path: str, pattern: str) -> Encoder:
    def make() -> Encoder:
        merger = PairMerger(path, pattern)
        return Encoder(merger.counts, merger.specials, summed)

    return held(("token counts", path, pattern), make)


def count_tokens(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row's whole text."""
    rows = documents.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                counts = counter(path, pattern).batch(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"]
                )

    out = T.StructType([rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


@query("op3_token_counts")
def token_counts(spark, folder):
    import public_tokenizers as vocabularies

    counted = count_tokens(table(spark, folder, "documents"), vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
