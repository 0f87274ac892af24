"""Event streams: deduplicated events, versions, replay, and refresh of what they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..session import is_folder


def read_events(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 16, lateness: str | None = None) -> DataFrame:
    """A file stream of events; each appears once for its id.

    Without ``lateness`` no event is late, whatever the order of the files, and the state has
    every id. With it the state is bounded, and events behind the watermark are dropped.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if not is_folder(spark, path):  # one file: the stream watches its folder for that name
        folder, _, name = path.rpartition("/")
        reader, path = reader.option("pathGlobFilter", name), folder
    raw = reader.parquet(path)
    timed = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    if lateness is None:
        return timed.dropDuplicates(["event_id"])
    return timed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def refresh(events: DataFrame, recompute: Callable[[DataFrame, int], None], checkpoint: str, *, key: str = "user_id") -> StreamingQuery:
    """Call ``recompute(keys, batch)`` with the keys that each micro-batch touches; all that is there, then stop."""

    def one(batch: DataFrame, epoch: int) -> None:
        recompute(batch.select(key).where(F.col(key).isNotNull()).distinct(), epoch)

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows (an extension; closed by the watermark)."""
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def replay(log: DataFrame, after, kinds: list[str] | None = None) -> DataFrame:
    """Events strictly after a time, of some types, in order."""
    out = log.where(F.col("ts") > F.lit(after).cast("timestamp_ntz"))
    return (out if kinds is None else out.where(F.col("event_type").isin(*kinds))).orderBy("ts", "event_id")


def versioned(events: DataFrame, start: int = 0) -> DataFrame:
    """Events with consecutive versions by time, without one task seeing them all.

    Days are numbered apart and shifted by what came before.
    """
    day = events.withColumn("_day", F.to_date("ts"))
    before = day.groupBy("_day").agg(F.count("*").alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_day").orderBy("ts", "event_id"))
    return day.withColumn("_n", nth).join(before.select("_day", "_base"), "_day").withColumn("graph_version", F.col("_base") + F.col("_n") + start).drop("_day", "_n", "_base")


def merged(stored_events: DataFrame, live: DataFrame) -> DataFrame:
    """Stored and live events, once for each id (the stored one), by time."""
    both = stored_events.withColumn("_p", F.lit(0)).unionByName(live.withColumn("_p", F.lit(1)))
    w = Window.partitionBy("event_id").orderBy("_p")
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_p").orderBy("ts", "event_id")
