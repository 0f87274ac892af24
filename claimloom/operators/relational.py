"""Listing, filtering and joining of claims, edges and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_claims(claims: DataFrame, *, truth: tuple[float, float] | None = None, contains: str | None = None, where: Sequence[Column] = (), order: Sequence[Column] = (), offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of the claims that pass every given filter; no cap on what is searched."""
    out = claims
    if truth is not None:
        out = out.where(F.col("truth_value").between(*truth))
    if contains is not None:
        out = out.where(F.lower("content").contains(contains.lower()))
    for w in where:
        out = out.where(w)
    return out.orderBy(*(order or [F.desc_nulls_last("truth_value"), F.col("claim_id")])).offset(offset).limit(min(limit, 100))


def labels_all(labels: Column, wanted: Sequence[str], excluded: Sequence[str] = ()) -> Column:
    """All wanted labels and none of the excluded."""
    has = F.size(F.array_except(F.array(*map(F.lit, wanted)), labels)) == 0
    return has & ~F.arrays_overlap(labels, F.array(*map(F.lit, excluded))) if excluded else has


def current_edges(edges: DataFrame, relationship: str) -> DataFrame:
    """Edges of a relationship that still hold, newest first."""
    return edges.where((F.col("relationship") == relationship) & F.col("valid_to").isNull()).orderBy(F.desc_nulls_last("valid_from"))


def without_edges(claims: DataFrame, edges: DataFrame, relationship: str) -> DataFrame:
    """Claims at neither end of an edge of the relationship."""
    e = edges.where(F.col("relationship") == relationship)
    return claims.join(e.select(F.col("source_id").alias("claim_id")), "claim_id", "left_anti").join(e.select(F.col("target_id").alias("claim_id")), "claim_id", "left_anti")


def undirected(edges: DataFrame, *more: str) -> DataFrame:
    """Both orientations as (node, other), so that either end is an equality join."""
    return edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), *more).unionAll(edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), *more))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key: the first in the order. Also the upsert of a batch into a table: union first."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def top_in_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, total: str | None = None) -> DataFrame:
    """The first k rows of each group with their rank, and the group's size."""
    w = Window.partitionBy(*keys)
    out = rows.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    if total:
        out = out.withColumn(total, F.count("*").over(w))
    return out.where(F.col("rank") <= k)


def longest_rise(rows: DataFrame, key: str, order: Sequence[Column], value: str) -> DataFrame:
    """Length of the longest run of strictly rising values of each key, in steps."""
    w = Window.partitionBy(key).orderBy(*order)
    up = (F.col(value) > F.lag(value).over(w)).cast("int")
    run = F.sum(F.when(up == 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("_run", run).groupBy(key, "_run").agg((F.count("*") - 1).alias("steps"))
    return runs.groupBy(key).agg(F.max("steps").alias("longest"))


def redacted(label: Column, allowed: Column) -> Column:
    return F.when(allowed, label).otherwise(F.lit("[REDACTED]"))


def snapshot(log: DataFrame, version: int) -> DataFrame:
    """All events up to a version."""
    return log.where(F.col("graph_version") <= version)


def short_label(text: Column, most: int = 60) -> Column:
    """Texts over ``most`` characters cut with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of the padded words of a text."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    pieces = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members; 0 where both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def similar_pairs(rows: DataFrame, text: str, keys: list[str], least: float) -> DataFrame:
    """(left_id, right_id, similarity) of ``rows`` (claim_id) that share the keys, with left_id < right_id and a trigram overlap of ``least`` or more.

    Two texts are compared once, however many groups and claims have them; pairs of claims are made only for what is similar.
    """
    c = rows.dropna(subset=[text, *keys]).select(*keys, "claim_id", F.col(text).alias("t"))
    d = c.select(*keys, "t").distinct()
    met = d.withColumnRenamed("t", "t_a").join(d.withColumnRenamed("t", "t_b"), keys).where("t_a <= t_b").select("t_a", "t_b").distinct()
    met = met.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "t_a", "t_b")  # few bytes, but much work a row
    near = met.withColumn("similarity", jaccard(trigrams(F.col("t_a")), trigrams(F.col("t_b")))).where(F.col("similarity") >= least)
    a, b = c.withColumnsRenamed({"claim_id": "a", "t": "t_a"}), c.withColumnsRenamed({"claim_id": "b", "t": "t_b"})
    got = near.join(a, "t_a").join(b, [*keys, "t_b"]).where("t_a < t_b OR a < b")
    return got.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "similarity")
