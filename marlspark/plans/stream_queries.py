"""Streams over the events table, with the batch results that they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import corpus as C
from ..streaming import streams as S
from .registry import query


def events(spark, d):
    return S.source(spark, f"{d}/events.parquet")


@query("x6_tumbling_hours", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, d):
    out = S.drained(S.windowed_counts(events(spark, d), "ts", "1 hour", "event_type"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("x7_daily_buckets", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily(spark, d):
    out = S.drained(S.windowed_counts(events(spark, d), "ts", "1 day", "event_type"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("x8_sliding_windows", "SELECT (date_trunc('hour', ts) - to_hours(CAST(6 * k + hour(ts) % 6 AS INTEGER)))::TIMESTAMP AS start, event_type, count(*) AS n FROM events, (SELECT unnest(range(4)) AS k) GROUP BY ALL")
def sliding(spark, d):
    out = S.drained(S.windowed_counts(events(spark, d), "ts", "24 hours", "event_type", "6 hours"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("x10_late_duplicates", "SELECT count(*) AS n FROM (SELECT DISTINCT event_id FROM events)")
def duplicates(spark, d):
    e = events(spark, d).select("event_id", "ts")
    return S.drained(e.dropDuplicatesWithinWatermark(["event_id"]), "append").agg(F.count("*").alias("n"))


@query("x13_streaks_in_state", """WITH i AS (SELECT user_id, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events), r AS (SELECT user_id, g, count(*) FILTER (event_type = 'error') AS n FROM i GROUP BY ALL)
SELECT user_id, max_by(n, g) AS streak FROM r GROUP BY user_id""")
def streaks(spark, d):
    e = events(spark, d).select("user_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return S.drained(S.failure_streaks(e, "user_id", "ts", "failed"), "update", "user_id")


@query("x3_since_mark", "SELECT event_id FROM events WHERE event_id > 500")
def since(spark, d):
    return S.since_mark(C.table(spark, d, "events").select("event_id"), "event_id", 500)


@query("x4_up_to_unexamined", "SELECT event_id FROM events WHERE event_id > 100 AND event_id < (SELECT min(event_id) FROM events WHERE event_id > 100 AND event_id % 400 = 0)")
def unexamined(spark, d):
    e = C.table(spark, d, "events").select("event_id", (F.col("event_id") % 400 == 0).alias("todo"))
    return S.since_mark(e, "event_id", 100, "todo").select("event_id")


@query("x15_leases")
def leases(spark, d):
    """Users are jobs, and their events polls of two schedulers and settled runs; what is past the watermark is told."""
    from ..streaming import leases as L

    e = events(spark, d)
    settles = F.col("event_type").isin("purchase", "error")
    who = F.concat(F.lit("s"), (F.hour("ts") % 2).cast("string"))
    told = L.leased(e.select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("seq"), F.when(settles, "settle").otherwise("poll").alias("kind"), who.alias("who"), (F.col("event_type") != "error").alias("ok")), 600)
    with L.with_rocks(spark):
        return S.drained(told, "append")
