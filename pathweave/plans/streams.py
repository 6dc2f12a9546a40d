"""Queries of windows over events, as the batch form of the streaming plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..runtime import table
from ..streaming import logs


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events and values per day and type."""
    x = logs.tumbling(_events(spark, d), "ts", "1 day", "1 day", "event_type")
    return x.select(F.col("start").cast("long").alias("start_s"), "event_type", "n", "value")


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of every user with less than six hours between events."""
    x = logs.sessions(_events(spark, d), "ts", "6 hours", "1 day", "user_id")
    return x.select("user_id", F.col("start").cast("long").alias("start_s"), "n")
