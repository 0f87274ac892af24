"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of documents.

1. quality: documents that the classifier scores below 0.7 go; it learns from ``labels``.
2. near_duplicates: of each class of texts with a 5-gram Jaccard of 0.8 or more, linked
   directly or through others, the document of the smallest id stays.
3. decontamination: documents with ten consecutive words of a ``benchmark`` item go.
4. packing: what is left, as pieces in sequences of at most 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import decontamination, near_duplicates, packing, quality
from claimloom.session import scratch, ship, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_duplicates.keep_one(docs, n=5, threshold=0.8)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, seq_len=2048, end_id=0)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_clean),
    ("packing", pack),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
