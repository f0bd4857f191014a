"""Training-corpus pipeline over ``documents``: quality, near duplicates, mixing, packing.

Each stage reads what the one before it kept. The first three return the columns of ``documents``;
the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.llm import jaccard_join, mixing, packing, quality
from paneloom.llm.shared import stored, table

#: Probability of good quality below which a document goes.
LEAST_QUALITY = 0.3


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    labels = table(spark, sf_dir, "labels").filter(quality.fold(F.col("doc_id")) != 0)
    return quality.accepted(docs, quality.fit(docs, labels), LEAST_QUALITY)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, and the parts of documents, that the source mix takes, as often as it takes them."""
    return mixing.mixed_documents(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 tokens."""
    import public_tokenizers as vocabularies

    return packing.pack(docs, vocabularies.path("byte_bpe_50k.json"))


STAGES = [("quality", _quality), ("near_duplicates", _near_duplicates), ("mixing", _mix), ("packing", _pack)]
#: A compression classifier and a tokenizer are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
