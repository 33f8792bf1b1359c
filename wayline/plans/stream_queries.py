"""Event-time windows as batch plans; tests hold the streaming runs against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.plans import views
from wayline.plans.registry import query
from wayline.plans.views import table
from wayline.streaming import jobs

_CENTS = "CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query(f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, {_CENTS} FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.tumbling(_events(spark, sf))


@query(f"SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - k * INTERVAL 6 HOUR AS start, event_type, count(*) AS n, {_CENTS} FROM events, range(4) r(k) GROUP BY 1, 2")
def events_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.tumbling(_events(spark, sf), "1 day", "6 hours")


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.sessions(_events(spark, sf))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS var FROM events GROUP BY event_type")
def running_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Of the events as a stream, whose batches are merged into a table."""
    t = jobs.merged_moments(jobs.events_stream(spark, sf), views.shared_path(spark, "moments"))
    return t.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round(F.col("m2") / F.col("n"), 4).alias("var"))


@query("SELECT i, j, count(*) AS n FROM (SELECT event_type AS i, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j FROM events WHERE date_trunc('milliseconds', ts) <= date_trunc('milliseconds', (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)) WHERE j IS NOT NULL GROUP BY i, j")
def stream_transition_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Transitions of the events as a stream with keyed state, written by the stream and then counted: those that the watermark, an hour behind the latest event, has passed."""
    jobs.rocksdb(spark)
    t = jobs.stream_transitions(jobs.events_stream(spark, sf))
    return jobs.written(t, views.shared_path(spark, "stream")).where("late = 0 AND j IS NOT NULL").groupBy("i", "j").agg(F.count("*").alias("n"))


@query(f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, {_CENTS} FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of the events as a stream that are final: those that end before the watermark, an hour behind the latest event."""
    return jobs.written(jobs.tumbling(jobs.events_stream(spark, sf), late="1 hour"), views.shared_path(spark, "stream"))


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the events as a stream that are final: those that end before the watermark, an hour behind the latest event."""
    return jobs.written(jobs.sessions(jobs.events_stream(spark, sf), late="1 hour"), views.shared_path(spark, "stream"))
