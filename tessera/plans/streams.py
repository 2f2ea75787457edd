"""Queries whose state is kept by Structured Streaming, in their batch form, which the streaming form agrees with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.sources.tables import table


@query("SELECT event_id, ts FROM (SELECT * FROM events UNION SELECT * FROM events)")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return events.unionByName(events).dropDuplicates(["event_id"])


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS first, count(*) AS n, bool_or(event_type = 'error') AS deleted FROM s GROUP BY user_id, session""")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a user's events, apart by half an hour of quiet."""
    bursts = table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w"))
    return bursts.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("event_type") == "error").alias("deleted")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("first"), "n", "deleted")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour."""
    by = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
