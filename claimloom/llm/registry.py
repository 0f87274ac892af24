"""The registered queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..session import table
from . import decontamination, licenses, near_duplicates, packing, quality, sharding, token_counts, token_files, topk, warc


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return topk.search(topk.build(vectors, factor=1024), vectors.where(F.col("id") % 100 == 0), k=10, factor=1024)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    directory = warc.build_index(warc.write(pages, least=1000))
    found = warc.read(warc.look_up(directory, pages.select("url")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), seq_len=2048, end_id=0)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontamination.build_index(table(spark, sf_dir, "documents"))
    return decontamination.report(index, table(spark, sf_dir, "benchmark"), window=10)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(spark, token_files.write(table(spark, sf_dir, "documents"), end_id=1))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), rule="start", lead_chars=200)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("id"), F.expr(licenses.path_sql("div")).alias("path"), "text")
    return licenses.licenses(files, threshold=0.7).withColumnRenamed("id", "doc_id")


def op9_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.jaccard_join(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_classifier, op2_exact_topk, op3_warc, op4_best_fit_packing, op5_benchmark_decontamination, op6_token_files, op7_token_counts, op8_license_scan, op9_best_fit_sharding, op10_ngram_jaccard_join]
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": licenses.oracle_sql(threshold=0.7)}
