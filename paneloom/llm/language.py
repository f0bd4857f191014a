"""Language of texts from hyperdimensional profiles.

Every letter has a random vector of ``SIZE`` signs. A run of three letters of a word, with its borders,
is bound into one vector: the product of the letters' vectors, shifted by two, one and no places, so that
order counts. A text is the sum (bundle) of the vectors of its runs, a language's prototype the sum over
the texts that are known to be in it. A text gets the language whose prototype has the largest cosine.

Runs are counted first and each distinct run of a block of texts is bound once, so the work for a letter
is a table lookup. All sums are integers, whatever the order of blocks. Texts are read whole: long ones in
pieces that add to one bundle. Prototypes are summed in tasks, then by Spark;
a language has ``SIZE`` numbers, and the table of languages, whose size is checked, goes to every task.

Defined results: letters are those of Unicode, lowered, with marks counted in words; texts that are null
or have no letter are ``und`` with score 0; with equal cosines the first language in order wins; rows
without a language or without letters teach nothing; repeated rows teach as often as they occur; with
nothing learnt every text is ``und``; ids may be null or repeated; other columns are not read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm.chunks import held
from paneloom.llm.shared import by_bytes, query, table

SIZE, SEED = 1024, 12
#: Texts of a block, its letters, letters of a piece of a long text, and runs that are bound at a time.
TEXTS, LETTERS, PIECE, RUNS = 512, 2_000_000, 500_000, 4096
#: Languages that a model may hold: SIZE numbers each, some 80 MB in all.
LANGUAGES = 10_000
SPACE, TOP = 32, 0x110000
#: Alphabets up to which runs are numbered by a table instead of a sort.
DENSE = 160


def kinds() -> np.ndarray:
    """0 for no part of a word, 1 for a mark, 2 for a letter."""

    def build() -> np.ndarray:
        of = {"L": 2, "M": 1}
        return np.array([of.get(unicodedata.category(chr(c))[0], 0) for c in range(TOP)], np.int8)

    return held("letters", build)


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """Random signs of each code point, from a mixing of its number; the border of a word has them too."""
    words = letters.astype(np.uint64)[:, None] * np.uint64(SIZE // 64) + np.arange(SIZE // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        z = words * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    bits = np.unpackbits(z.astype("<u8").view(np.uint8).reshape(len(letters), -1), axis=1)
    return bits.astype(np.int8) * 2 - 1


def bound(runs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Vectors of runs of three numbered letters."""
    a, b, c = vectors[runs[:, 0]], vectors[runs[:, 1]], vectors[runs[:, 2]]
    return np.roll(a, 2, 1) * np.roll(b, 1, 1) * c


def run_counts(pieces: list[tuple[int, str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces of texts: the row and the number of the run around every letter, the distinct runs as
    numbers of letters, and the letters.

    A piece is (row, text, 1 if its first letter is only there for the next one, 1 if its last is for the one before).
    """
    whole = "\n".join(["", *[p[1] for p in pieces], ""]).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(whole, np.uint32)
    symbols = np.where(kinds()[points] > 0, points, SPACE).astype(np.int64)
    lengths = np.array([len(p[1]) for p in pieces])
    start = 1 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    of = np.concatenate([[-1], np.repeat([p[0] for p in pieces], lengths + 1)])
    of[start[[p[2] == 1 for p in pieces]]] = -1
    of[(start + lengths - 1)[[p[3] == 1 for p in pieces]]] = -1
    present = np.zeros(TOP, bool)
    present[symbols] = True
    letters = np.flatnonzero(present)
    number = np.zeros(TOP, np.int64)
    number[letters] = np.arange(len(letters))
    at, n = number[symbols], len(letters)
    middle = 1 + np.flatnonzero((symbols[1:-1] != SPACE) & (of[1:-1] >= 0))
    codes = (at[middle - 1] * n + at[middle]) * n + at[middle + 1]
    if n <= DENSE:
        seen = np.zeros(n**3, bool)
        seen[codes] = True
        runs = np.flatnonzero(seen)
        place = np.zeros(n**3, np.int64)
        place[runs] = np.arange(len(runs))
        which = place[codes]
    else:
        runs, which = np.unique(codes, return_inverse=True)
    return of[middle], which, np.stack([runs // (n * n), runs // n % n, runs % n], 1), letters


def bundles(pieces: list, size: int) -> np.ndarray:
    """Sums of the vectors of the runs of each row's pieces; whole numbers."""
    of, which, runs, letters = run_counts(pieces)
    vectors, out = letter_vectors(letters), np.zeros((size, SIZE))
    for at in range(0, len(runs), RUNS):
        some = runs[at : at + RUNS]
        mine = slice(None) if len(runs) <= RUNS else (which >= at) & (which < at + RUNS)
        counts = np.bincount(of[mine] * len(some) + which[mine] - at, minlength=size * len(some)).reshape(size, -1)
        # a block has fewer letters than a float counts exactly
        out += counts.astype(np.float32) @ bound(some, vectors).astype(np.float32)
    return out


def cut_up(row: int, text: str) -> list[tuple[int, str, int, int]]:
    """Pieces of a text, with one letter on either side of a cut."""
    ends = range(0, max(1, len(text)), PIECE)
    return [(row, text[max(0, s - 1) : s + PIECE + 1], int(s > 0), int(s + PIECE < len(text))) for s in ends]


def summed(texts: list[str], rows: list[int], size: int) -> np.ndarray:
    """Bundles of the texts of each of ``size`` rows."""
    total, waiting, letters = np.zeros((size, SIZE)), [], 0
    for row, text in zip(rows, texts, strict=True):
        for piece in cut_up(row, text.lower()):
            waiting.append(piece)
            letters += len(piece[1])
            if letters >= LETTERS:
                total += bundles(waiting, size)
                waiting, letters = [], 0
    return total + bundles(waiting, size) if waiting else total


def blocks(batch: pa.RecordBatch):
    """Parts of a batch with few texts and bounded bytes."""
    for part in by_bytes(batch, "text", LETTERS):
        for at in range(0, part.num_rows, TEXTS):
            yield part.slice(at, TEXTS)


def fit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The learnt languages in order, and their prototypes."""
    rows = documents.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in blocks(batch):
                names = part.column("lang").dictionary_encode()
                known = names.dictionary.to_pylist()
                total = summed(part.column("text").to_pylist(), names.indices.to_pylist(), len(known))
                for name, vector in zip(known, total, strict=True):
                    found[name] = found.get(name, 0) + vector
        for name, vector in found.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([name] * SIZE), "place": pa.array(np.arange(SIZE), pa.int32()), "total": pa.array(vector.astype(np.int64))}
            )

    parts = rows.mapInArrow(run, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))
    listed = parts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "total"))).alias("v"))  # SIZE numbers each
    listed = listed.filter(F.exists("v", lambda x: x["total"] != 0)).select("lang", F.col("v.total").alias("v"))
    found = sorted(listed.limit(LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: the column holds something else")
    return [r["lang"] for r in found], np.array([r["v"] for r in found], np.float64).reshape(len(found), SIZE)


def cosines(vectors: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    """Cosine of every vector with every prototype; 0 for an empty one."""
    lengths = [np.sqrt((x * x).sum(1)) for x in (vectors, prototypes)]
    return vectors @ prototypes.T / np.maximum(1e-300, lengths[0][:, None] * lengths[1])


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score, the largest cosine or 0 if it is negative."""
    rows = documents.select(*keep, F.col(text_col).alias("_text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most LANGUAGES prototypes

    def run(batches):
        names, prototypes = shared.value
        for batch in batches:
            batch = batch.rename_columns([*keep, "text"])
            for part in blocks(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                best, score = np.full(len(texts), -1), np.zeros(len(texts))
                if names:
                    near = cosines(summed(texts, list(range(len(texts))), len(texts)), prototypes)
                    best, score = near.argmax(1), np.clip(near.max(1), 0, 1)
                lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
                score = np.where(lettered, score, 0.0)
                lang = [names[b] if ok and b >= 0 else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"]
                )

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in keep], *more]))


def fold(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 4


@query("op12_language")
def language(spark, folder):
    documents = table(spark, folder, "documents")
    model = fit(documents.filter(fold(F.col("doc_id")) != 2))
    found = predict(documents, model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
