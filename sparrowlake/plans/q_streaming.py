"""Streaming queries; each oracle is the batch equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowlake.plans.catalog import REGISTRY
from sparrowlake.streaming import jobs

query = REGISTRY.query


def _events(spark, sf_dir):
    return jobs.source(spark, f"{sf_dir}/events.parquet")


@query("stream_tumbling_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark, sf_dir):
    x = jobs.tumbling_counts(_events(spark, sf_dir), "ts", "event_type")
    return x.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("stream_sliding_counts", "WITH d AS (SELECT date_trunc('day', ts) AS d FROM events), w AS (SELECT unnest([d, d - INTERVAL 1 DAY]) AS s FROM d) SELECT strftime(s, '%Y-%m-%d') AS day, count(*)::BIGINT AS n FROM w GROUP BY 1")
def stream_sliding_counts(spark, sf_dir):
    x = jobs.sliding_counts(_events(spark, sf_dir), "ts", "2 days", "1 day")
    return x.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


@query(
    "stream_sessions",
    """WITH x AS (SELECT user_id, epoch_us(ts) AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 21600000000 THEN 0 ELSE 1 END AS new FROM x),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM f), g AS (SELECT user_id, sid, min(t) AS a, max(t) + 21600000000 AS b, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, a::BIGINT AS start_us, b::BIGINT AS end_us, n::BIGINT AS n FROM g WHERE b <= (SELECT max(t) // 1000 * 1000 FROM x)""",
)
def stream_sessions(spark, sf_dir):
    x = jobs.sessions(_events(spark, sf_dir), "ts", "user_id", "6 hours")
    return x.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@query("stream_incremental_encoder", "SELECT user_id, count(*)::BIGINT AS n, sum((event_type = 'purchase')::INTEGER)::BIGINT AS total, round((sum((event_type = 'purchase')::INTEGER) + 1)::DOUBLE / (count(*) + 10), 6) AS encoded FROM events GROUP BY 1")
def stream_incremental_encoder(spark, sf_dir):
    x = jobs.incremental_counts(_events(spark, sf_dir), "user_id", (F.col("event_type") == "purchase").cast("bigint"))
    return x.select("user_id", "n", "total", F.round((F.col("total") + 1).cast("double") / (F.col("n") + 10), 6).alias("encoded"))


@query("stream_chunk_callback", "SELECT event_id, user_id, round(value * 2, 6) AS doubled FROM events WHERE event_type = 'purchase'")
def stream_chunk_callback(spark, sf_dir):
    each = lambda x: x.where("event_type = 'purchase'").select("event_id", "user_id", F.round(F.col("value") * 2, 6).alias("doubled"))
    return jobs.transformed(_events(spark, sf_dir), each)
