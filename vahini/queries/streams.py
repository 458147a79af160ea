"""Streaming pipelines run over all that has landed, beside the SQL that gives the same rows in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vahini.streaming import pipelines as P


def events(spark: SparkSession, d: str) -> DataFrame:
    return P.read_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def u02_process_once(spark: SparkSession, d: str) -> DataFrame:
    return P.drain(P.once(events(spark, d).select("event_id", "user_id", "event_type", "ts"), ["event_id"], "ts", "7 days"), "once").select("event_id", "user_id", "event_type")


def u03_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = P.drain(P.windowed_counts(events(spark, d), "ts", ["event_type"]), "daily", "complete")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def u04_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """The latest status of every tender, kept by a keyed upsert per micro-batch."""
    stream = P.read_stream(spark, f"{d}/tenders.parquet").select("id", "status", F.col("last_seen_at").alias("first_seen"), F.col("last_seen_at"), "row_id")
    path = P.shared_path(spark, "latest")
    q = P.upsert_sink(stream, path, ["id"], ["first_seen"], ["last_seen_at", "row_id"]).option("checkpointLocation", P.shared_path(spark, "latest-state"))
    q.trigger(availableNow=True).start().awaitTermination()
    return P.latest(spark, path).select("id", "status", "last_seen_at")


def u05_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a user's event type in the order of arrival."""
    rows = events(spark, d).select(F.col("user_id").cast("string").alias("user_id"), "event_type", F.struct("ts", "event_id").alias("at"))
    rows = rows.withColumn("at", F.concat_ws(" ", F.date_format("at.ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("at.event_id").cast("string"), 20, "0")))
    return P.drain(P.transitions(rows, "user_id", "event_type", "at"), "transitions").groupBy("current").agg(F.count("*").alias("n"))


def u07_follow_ups(spark: SparkSession, d: str) -> DataFrame:
    """Purchases up to a day after a signup of the same user, by a stream-stream interval join."""
    side = lambda t: events(spark, d).filter(F.col("event_type") == t).select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return P.drain(P.later_counterparts(side("signup"), side("purchase"), "user_id", 1), "followups").select("id", "later_id")


QUERIES = {"u02_process_once": u02_process_once, "u03_daily_counts": u03_daily_counts, "u04_latest_state": u04_latest_state, "u05_transitions": u05_transitions, "u07_follow_ups": u07_follow_ups}
ORACLE_SQL = {
    "u02_process_once": "SELECT DISTINCT ON (event_id) event_id, user_id, event_type FROM events",
    "u03_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "u04_latest_state": "SELECT id, status, last_seen_at FROM (SELECT DISTINCT ON (row_id) * FROM tenders) QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_seen_at DESC NULLS LAST, row_id DESC) = 1",
    "u05_transitions": "SELECT current, count(*) AS n FROM (SELECT event_type AS current, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL) WHERE before IS DISTINCT FROM current GROUP BY 1",
    "u07_follow_ups": "SELECT a.event_id AS id, b.event_id AS later_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 DAY",
}
