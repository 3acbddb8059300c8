"""Bindings: streams over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.streaming import events as op

from .registry import query


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
 SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2 HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)) GROUP BY 1, 2""")
def stream_sessions(spark, sf):
    # Sessions that the watermark has closed; the last ones are still open.
    out = op.run_once(op.sessions(op.file_stream(spark, sf, "events.parquet"), "user_id", "ts", "12 hours", "1 hour"))
    return out.groupBy("user_id", "n").agg(F.count("*").alias("sessions"))


@query("stream_windows", """WITH h AS (SELECT event_type, epoch_us(ts) // 43200000000 AS b FROM events), w AS (SELECT event_type, unnest([b, b - 1]) AS b FROM h) SELECT event_type, b AS bin, count(*) AS n FROM w
 WHERE (b + 2) * 43200000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM events) GROUP BY 1, 2""")
def stream_windows(spark, sf):
    out = op.run_once(op.windows(op.file_stream(spark, sf, "events.parquet"), "event_type", "ts", "24 hours", "12 hours", "1 hour"))
    start = F.unix_micros(F.col("w.start")) + F.lit(_offset(spark))
    return out.select("event_type", F.floor(start / 43_200_000_000).alias("bin"), "n")


def _offset(spark) -> int:
    """Windows are aligned to UTC; times without zone were read in the session's zone."""
    return spark.sql("select timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(timestamp_micros(0) as timestamp_ntz)) as o").first()["o"]


@query("stream_mates", """SELECT a.event_id AS l_id, b.event_id AS r_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""")
def stream_mates(spark, sf):
    left = op.file_stream(spark, sf, "events.parquet").where("event_type = 'view'")
    right = op.file_stream(spark, sf, "events.parquet").where("event_type = 'click'")
    return op.run_once(op.mates(left, right, "user_id", "ts", "1 hour", "1 hour")).select("l_id", "r_id")
