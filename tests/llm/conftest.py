import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

TEXTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])


@pytest.fixture
def table(spark):
    """Makes a (doc_id, text) table."""

    def make(rows, extra=False):
        df = spark.createDataFrame(rows, TEXTS)
        if extra:  # columns with names that the operators use themselves
            from pyspark.sql import functions as F

            for name in ("key", "score", "class", "kept", "h", "n", "marks", "owner", "lang", "size", "part"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


ODD = [
    (None, "a row without id and some words to read here"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three"),
    (5, "one two three"),
    (5, "one two three"),
    (6, "very long " * 5000),
    (7, "x" * 20000),
    (8, "é ü 漢字 😀 ▁ \x00 end"),
]


@pytest.fixture
def odd():
    return list(ODD)
