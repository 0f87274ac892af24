import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("key", T.StringType())])


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "a", "k"),
        (2, None, None, None),
        (3, "", "", ""),
        (None, "It's a null id. Don't lose it! ÀÉÎ × ÷ ß 日本語 12३", "x", None),
        (4, "the quick brown fox jumps over the lazy dog near the old river bank today", None, "k"),
        (4, "the quick brown fox jumps over the lazy dog near the old river bank today", None, "k"),
        (5, "word " * 5000 + "<|endoftext|> end", "y", "k"),
        (6, " \n\t \n", "y", "k"),
        (7, "one\n\ntwo lines é́ and İstanbul ΑΣ", "y", "k"),
        (7, "another text of the same id", "y", "k"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
