"""Windows over the event stream, with their batch counterparts as the rows they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.registry import query
from visitlens.sources.views import table
from visitlens.streaming.events import event_stream, first_seen, run_to_table, running_totals, sessions, sliding, tumbling


@query("strm_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows of a stream; update mode leaves each window's last state."""
    out = run_to_table(tumbling(event_stream(spark, d), "1 day"), "update", "tumbling")
    last = out.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "epoch").alias("x"))
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "x.n", F.round("x.total", 4).alias("total"))


@query("strm_tumbling_batch", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-06') AS window_start, COUNT(*) AS n FROM events GROUP BY 1")
def batch_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Weeks that begin on Tuesday, as windows with an offset."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "7 days", startTime="5 days")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")


@query("strm_sliding_batch", "SELECT s AS window_start, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM (SELECT user_id, UNNEST(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS s FROM events) GROUP BY s")
def batch_sliding(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "7 days", "1 day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n", "users")


@query("strm_sliding", "SELECT s AS window_start, COUNT(*) AS n FROM (SELECT UNNEST(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS s FROM events) GROUP BY s")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = run_to_table(sliding(event_stream(spark, d), "7 days", "1 day"), "update", "sliding")
    return out.groupBy("window").agg(F.max_by("n", "epoch").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")


@query("strm_session_batch", """WITH x AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', LAG(ts) OVER w, ts) >= 12 * 3.6e9 OR LAG(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM x) SELECT user_id, MIN(ts) AS session_start, COUNT(*) AS n FROM s GROUP BY user_id, i""")
def batch_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that end after twelve hours without an event."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "12 hours").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n")


@query("strm_running_totals", "SELECT user_id, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY user_id")
def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    """Custom state per user across micro-batches."""
    out = run_to_table(running_totals(event_stream(spark, d)), "update", "totals")
    return out.groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "n").alias("x")).select("user_id", "x.n", F.round("x.total", 4).alias("total"))


@query("strm_first_seen", "SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Every event once, from a stream that has each of them twice."""
    twice = event_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    seen = run_to_table(first_seen(twice), "append", "first-seen")
    return seen.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")


@query("strm_append_closed_windows", "SELECT s AS window_start, n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS s, COUNT(*) AS n FROM events GROUP BY 1) WHERE s + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """Append mode: only windows that the watermark has passed, each once."""
    daily = event_stream(spark, d).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return run_to_table(daily, "append", "closed").select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")
