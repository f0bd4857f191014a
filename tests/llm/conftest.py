import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
     T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()), T.StructField("size", T.StringType()),
     T.StructField("row", T.StringType()), T.StructField("node", T.StringType())]
)


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text, source) with further columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, s, len(t or ""), "x", "y", "z", "w") for i, t, s in rows], DOCUMENT)

    return make
