"""Joins and row numbers that no single key can make into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A key with more than this part of all rows is hot; there can be no more hot keys than that.
HOT_PARTS = 256
#: Fewer rows than this are not worth splitting.
HOT_ROWS = 1_000
#: A table of at most so many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Rows of a chunk that is numbered in one piece.
CHUNK_ROWS = 5_000


def hot_limit(total: int) -> int:
    return max(HOT_ROWS, total // HOT_PARTS)


def join_split(rows: DataFrame, lookup: DataFrame, on: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` (one row a key; ``count`` says how many of ``rows`` have it).

    Keys with over total / HOT_PARTS rows, at most HOT_PARTS of them, are broadcast, so their rows
    stay where they are; all others are shuffled. ``count`` is dropped, null keys match nothing.
    """
    limit = hot_limit(total)
    hot = F.broadcast(lookup.where(F.col(count) > limit).drop(count))
    cold = lookup.where(F.col(count) <= limit).drop(count)
    rest = rows.join(hot.select(on), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(cold, on))


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with a number from 0, without a gap, within each value of ``by``.

    ``rows`` comes from ``placed``: numbers follow the place of a row in the
    written table, in chunks of CHUNK_ROWS rows and sums of the chunks before.
    """
    per_chunk = rows.groupBy(by, "part", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = per_chunk.select(by, "part", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(by, "part", "chunk").orderBy("at")
    nth = rows.withColumn("nth", F.row_number().over(within) - 1)
    return nth.join(base, [by, "part", "chunk"]).withColumn(name, F.col("base") + F.col("nth")).drop("part", "chunk", "at", "nth", "base")


def placed(written: DataFrame) -> DataFrame:
    """A written table with the place of each row: part (of the file), chunk, at."""
    at = F.col("_metadata.row_index")
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)-", 1).cast("long")
    return written.select("*", part.alias("part"), F.floor(at / CHUNK_ROWS).alias("chunk"), at.alias("at"))
