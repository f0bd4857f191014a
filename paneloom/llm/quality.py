"""Quality scores from compressed sizes.

``fit`` builds two zstandard dictionaries, one from text labelled good and one from text labelled
bad, and ``score`` compresses every text with both. Text like the good sample gets smaller with its
dictionary, so the difference of the two sizes over the text's own size is a score; a logistic curve
fitted on labelled texts that are in neither dictionary turns it into a probability.

What is learnt is bounded by parameters: at most ``LABELLED`` labelled documents of each class, the
smallest by a seeded hash, two thirds for the dictionaries of at most ``DICTIONARY_BYTES`` each, one
third for the curve, which is weighted back to the class shares of all labels. Scoring reads whole
texts where they lie. Texts are compressed in blocks, so that a long text can't explain itself.

Defined results: null and empty texts have difference 0; a null id counts as the empty string where
its fold is drawn; labels that are null, or whose document is missing, teach nothing; of several
documents with a labelled id the text first in order teaches; without labels of both classes every
score is the share of label 1 (one half without any); other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm.chunks import held
from paneloom.llm.shared import by_bytes, query, table

LABELLED, DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 4500, 2_000_000, 4000, 6


@dataclass
class Model:
    good: bytes
    bad: bytes
    intercept: float = 0.0
    slope: float = 0.0


def compressors(model: Model) -> tuple:
    """The compressors with the good and the bad dictionary."""
    import zstandard

    def one(content: bytes):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(content) >= 8:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            options["dict_data"] = words
        return zstandard.ZstdCompressor(**options)

    return held(("compressors", hash((model.good, model.bad))), lambda: (one(model.good), one(model.bad)))


def difference(text: str, pair) -> float:
    """Bytes that the good dictionary saves over the bad one, per byte of text."""
    content = text.encode("utf-8", "surrogatepass")
    saved = 0
    for at in range(0, len(content), BLOCK_BYTES):
        block = content[at : at + BLOCK_BYTES]
        saved += len(pair[1].compress(block)) - len(pair[0].compress(block))
    return saved / max(1, len(content))


def differences(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rows`` with the column difference in place of their text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size
    kept = [c for c in rows.columns if c != text]

    def run(batches):
        pair = compressors(shared.value)
        for batch in batches:
            for some in by_bytes(batch, text):
                values = [difference(t or "", pair) for t in some.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], pa.array(values, pa.float64())], [*kept, "difference"])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], T.StructField("difference", T.DoubleType())]))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps on standardised values with a small ridge."""
    mean, spread = np.average(x, weights=weight), max(float(x.std()), 1e-9)
    z = np.stack([np.ones(len(x)), (x - mean) / spread], 1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + 1e-3 * beta
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), gradient)
        beta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] - beta[1] * mean / spread), float(beta[1] / spread)


def seeded(column: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit("quality/"), column.cast("string"))), 1, 15), 16, 10).cast("long")


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Model from (id, label) rows and the texts of their documents."""
    spark = documents.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2) if not totals else float(1 in totals)
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(b"", b"", float(np.log(share / (1 - share))))
    chosen = []
    for label in (0, 1):  # bounded: the LABELLED smallest by hash
        rows = known.filter(F.col("label") == label).distinct().orderBy(seeded(F.col("id")), "id").limit(LABELLED).collect()
        chosen += [(r["id"], label, "curve" if k % 3 == 2 else "dictionary") for k, r in enumerate(rows)]
    schema = T.StructType([T.StructField("id", known.schema["id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("part", T.StringType())])
    wanted = F.broadcast(spark.createDataFrame(chosen, schema))  # at most 2 * LABELLED rows
    found = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id")
    # a repeated id counts once; what is gathered is bounded by the sample
    texts = found.filter("text <> ''").groupBy("id", "label", "part").agg(F.min("text").alias("text"))
    docs_of = {label: sum(1 for c in chosen if c[1] == label and c[2] == "dictionary") for label in (0, 1)}
    most = F.when(F.col("label") == 1, DICTIONARY_BYTES // max(1, docs_of[1])).otherwise(DICTIONARY_BYTES // max(1, docs_of[0])) - 1  # and a line end
    content = F.encode("text", "utf-8")
    spare = F.greatest(F.lit(1), F.octet_length("text") - most + 1)
    piece = F.substring(content, (F.pmod(seeded(F.col("id")), spare) + 1).cast("int"), most.cast("int"))
    pieces = texts.filter("part = 'dictionary'").select("id", "label", piece.alias("piece")).collect()
    pieces.sort(key=lambda r: str(r["id"]))
    good, bad = (b"\n".join(bytes(r["piece"]) for r in pieces if r["label"] == label) for label in (1, 0))
    model = Model(good, bad)
    curve = differences(texts.filter("part = 'curve'").select("id", "label", "text"), model).collect()
    curve.sort(key=lambda r: str(r["id"]))
    x, y = np.array([r["difference"] for r in curve]), np.array([r["label"] for r in curve], float)
    counts = {label: max(1, int((y == label).sum())) for label in (0, 1)}
    if not len(x):
        model.intercept = float(np.log(totals[1] / totals[0]))
        return model
    weight = np.where(y == 1, totals[1] / counts[1], totals[0] / counts[0])
    model.intercept, model.slope = logistic(x, y, weight / weight.mean())
    return model


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of label 1."""
    rows = differences(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    probability = 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * F.col("difference"))))
    return rows.select(F.col("id").alias(id_col), probability.alias("score"))


def accepted(documents: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """Rows of ``documents``, with all their columns, whose score reaches the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    least = float(np.log(threshold / (1 - threshold)))

    def run(batches):
        pair = compressors(shared.value)
        for batch in batches:
            for some in by_bytes(batch, text_col):
                values = np.array([difference(t or "", pair) for t in some.column(text_col).to_pylist()])
                yield some.filter(pa.array(shared.value.intercept + shared.value.slope * values >= least, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def fold(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 5


@query("op7_quality_scores")
def quality_scores(spark, folder, threshold: float = 0.3):
    documents = table(spark, folder, "documents")
    model = fit(documents, table(spark, folder, "labels").filter(fold(F.col("doc_id")) != 0))
    scored = score(documents, model)
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
