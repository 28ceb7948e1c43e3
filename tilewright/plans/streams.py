"""Queries that run the supplied events through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.streaming import queues


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type in windows of six hours that are closed when the stream ends."""
    events = queues.table_stream(spark, f"{sf_dir}/events.parquet")
    out = queues.drain(queues.windowed_counts(events, "ts", ["event_type"], "6 hours", "10 minutes"), "windows")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items of each user that got done or were given up after three failures."""
    events = queues.table_stream(spark, f"{sf_dir}/events.parquet")
    attempts = events.select("user_id", "event_id", "ts", (F.col("value") < 30).alias("ok"))
    out = queues.drain(queues.bounded_retries(attempts, "user_id", "event_id", "ok", ts="ts", remember="90 days"), "retries")
    return out.groupBy("outcome", "attempts").agg(F.count("*").alias("n"))


def distinct_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by how many kinds of requests they made, each kind counted once."""
    events = queues.table_stream(spark, f"{sf_dir}/events.parquet")
    out = queues.drain(queues.first_requests(events.select("ts", "user_id", "event_type"), "ts", ["user_id", "event_type"], "90 days"), "requests")
    return out.groupBy("user_id").agg(F.count("*").alias("kinds"))


def staged_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are built, fetched and converted in a chain of streams that run at once: done and pending items of each stage."""
    events = queues.table_stream(spark, f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    _, seen = queues.chained(events, [
        ("built", lambda df: df.where(F.col("event_type").isin("click", "view"))),
        ("fetched", lambda df: df.where("value >= 10")),
        ("converted", lambda df: df.where("value < 90")),
    ])
    return queues.progress(spark, seen)


QUERIES = {"staged_queues": staged_queues, "event_windows": event_windows, "retry_outcomes": retry_outcomes, "distinct_requests": distinct_requests}
SQL = {
    "staged_queues": """
WITH n AS (SELECT count(*) AS a, count(*) FILTER (event_type IN ('click', 'view')) AS b, count(*) FILTER (event_type IN ('click', 'view') AND value >= 10) AS c,
  count(*) FILTER (event_type IN ('click', 'view') AND value >= 10 AND value < 90) AS d FROM events)
SELECT 0 AS stage, 'built' AS name, b AS done, a - b AS pending FROM n UNION ALL SELECT 1, 'fetched', c, b - c FROM n UNION ALL SELECT 2, 'converted', d, c - d FROM n""",
    "event_windows": """
WITH w AS (SELECT time_bucket(INTERVAL 6 hours, ts) AS s, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, n FROM w
WHERE s + INTERVAL 6 hours <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 minutes FROM events)""",
    "retry_outcomes": """
WITH RECURSIVE a AS (SELECT user_id, event_id, value < 30 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
, r AS (SELECT user_id, i, ok, CASE WHEN ok THEN 0 ELSE 1 END AS failed, CASE WHEN ok THEN 'done' END AS outcome, 1 AS attempts FROM a WHERE i = 1
  UNION ALL SELECT a.user_id, a.i, a.ok, CASE WHEN a.ok OR r.failed = 2 THEN 0 ELSE r.failed + 1 END, CASE WHEN a.ok THEN 'done' WHEN r.failed = 2 THEN 'dead' END, r.failed + 1
  FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i + 1)
SELECT outcome, attempts, count(*) AS n FROM r WHERE outcome IS NOT NULL GROUP BY outcome, attempts""",
    "distinct_requests": "SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id",
}
