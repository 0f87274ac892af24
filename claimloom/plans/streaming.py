"""Queries over the event log and its stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch
from ..streaming import refresh as S
from .registry import plan

R6 = lambda c: F.round(c, 6)


@plan("SELECT graph_version, event_id FROM eventlog")
def event_versions(t):
    return S.versioned(t.events).select("graph_version", "event_id")


@plan("SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20' AND event_type IN ('error', 'purchase')")
def event_replay(t):
    return S.replay(t.events, "2024-01-20", ["error", "purchase"]).select("event_id", "event_type")


@plan("SELECT event_id, event_type FROM events")
def merged_events(t):
    return S.merged(t.events.where("event_id % 3 <> 0"), t.events.where("event_id % 2 = 0").unionByName(t.events.where("event_id % 3 = 0"))).select("event_id", "event_type")


@plan("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def stream_refresh(t):
    """The stream's micro-batches recompute the users that they touch, into a table of versions."""
    out, path = scratch(t.spark, "refreshed"), f"{t.sf_dir}/events.parquet"
    whole = t.events

    def recompute(keys, epoch):
        got = whole.join(keys, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"), R6(F.avg("value")).alias("mean_value"))
        got.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    S.refresh(S.read_events(t.spark, path, whole.schema), recompute, scratch(t.spark, "stream")).awaitTermination()
    got = t.spark.read.parquet(out)
    return got.groupBy("user_id").agg(F.max_by("n", "epoch").alias("n"), F.max_by("mean_value", "epoch").alias("mean_value"))


@plan("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(t):
    """The stream's windows, over all events at once."""
    return S.windowed_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
