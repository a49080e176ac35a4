"""Queries of the streaming operators over the events table, run to the end of the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.plans.registry import study
from tidemark.plans.sqlviews import r
from tidemark.session import fresh_path
from tidemark.sources import tables as T
from tidemark.streaming import bars as B

FILES = 6


def arriving(spark, folder, repeats: bool = False):
    """The stored events read as a stream; optionally every row is delivered twice."""
    schema = T.events(spark, folder).schema
    path = f"{folder.rstrip('/')}/events.parquet*"
    ticks = B.tick_source(spark, path, schema, 1000).withColumn("ts", F.col("ts").cast("timestamp"))
    return ticks.unionByName(ticks) if repeats else ticks


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@study("t1_stream_with_backfill", "SELECT event_type, count(*) AS ticks FROM events GROUP BY 1")
def t1(spark, folder):
    """History up to the middle of the month from the table, the rest from the stream."""
    rows = T.events(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    edge = "2024-01-15"
    path = fresh_path(spark, "ticks")
    rows.where(F.col("ts") >= edge).repartitionByRange(FILES, "ts").write.parquet(path)
    live = B.drain(B.tick_source(spark, path, rows.schema, 2), "t1")
    both = B.with_history(rows.where(F.col("ts") < edge), live, F.lit("2024-01-01").cast("timestamp"))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("ticks"))


@study("t2_newest_only", "SELECT event_type, count(DISTINCT (user_id, ts)) AS ticks FROM events GROUP BY 1")
def t2(spark, folder):
    kept = B.drain(B.newest_only(arriving(spark, folder, repeats=True), ["user_id", "event_type"]), "t2")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("ticks"))


@study("t3_strictly_increasing", """SELECT user_id, count(*) AS kept FROM (SELECT user_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM events) WHERE earlier IS NULL OR ts > earlier GROUP BY 1""")
def t3(spark, folder):
    return B.drain(B.increasing_only(arriving(spark, folder)), "t3").groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@study("t4_resampled_bars", f"""SELECT event_type, strftime(time_bucket(INTERVAL 60 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks, {r('sum(value)', 4)} AS volume
FROM events GROUP BY event_type, time_bucket(INTERVAL 60 MINUTE, ts)""")
def t4(spark, folder):
    out = B.drain_to_end(arriving(spark, folder), lambda ticks: B.resampled(ticks, "60 minutes", ["event_type"]), "t4")
    return out.select("event_type", stamp("start").alias("start"), "open", "high", "low", "close", "ticks", rounded("volume", 4).alias("volume"))


@study("t5_sliding_means", f"""WITH b AS (SELECT event_type, ts, value, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL (k * 2) HOUR AS start FROM events CROSS JOIN generate_series(0, 2) g(k)),
m AS (SELECT event_type, start, avg(value) AS mean, avg(value) FILTER (WHERE ts >= start + INTERVAL 4 HOUR) AS fast, count(*) AS ticks FROM b GROUP BY event_type, b.start),
s AS (SELECT *, nullif(sign(round(fast - mean, 6)), 0) AS side FROM m),
h AS (SELECT *, last_value(side IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY start ROWS UNBOUNDED PRECEDING) AS held, last_value(side IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT event_type, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, {r('mean')} AS mean, {r('fast')} AS fast, ticks, CAST(CASE WHEN held <> before THEN held ELSE 0 END AS INTEGER) AS crossing FROM h""")
def t5(spark, folder):
    """Two stateful steps, the second one reading the first one's closed windows as they come."""
    sink = fresh_path(spark, "t5-means")
    means = B.drain_to_end(arriving(spark, folder), lambda ticks: B.sliding_means(ticks, "6 hours", "2 hours", ["event_type"]), "t5", sink)
    out = B.drain(B.crossings(spark.readStream.schema(means.schema).parquet(sink), ["event_type"]), "t5-crossings")
    return out.select("event_type", stamp("start").alias("start"), rounded("mean").alias("mean"), rounded("fast").alias("fast"), "ticks", "crossing")


@study("t6_gap_sessions", f"""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 4 HOUR THEN 1 ELSE 0 END AS cut FROM events), g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS ticks, {r('sum(value)', 4)} AS volume FROM g GROUP BY user_id, k""")
def t6(spark, folder):
    out = B.drain_to_end(arriving(spark, folder), lambda ticks: B.gap_sessions(ticks, "4 hours", ["user_id"]), "t6")
    return out.select("user_id", stamp("start").alias("start"), "ticks", rounded("volume", 4).alias("volume"))


@study("t7_ordered_pairs", """SELECT y.event_id FROM events y WHERE y.event_type = 'purchase' AND EXISTS (SELECT 1 FROM events x WHERE x.user_id = y.user_id AND x.event_type = 'click' AND x.ts < y.ts AND y.ts - x.ts <= INTERVAL 24 HOUR)""")
def t7(spark, folder):
    return B.drain(B.ordered_pairs(arriving(spark, folder), "click", "purchase", 24 * 3600 * 1000000), "t7").select("event_id")


@study("t8_stream_session_join", """WITH d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS session FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup')) SELECT event_id, CAST(session AS INTEGER) AS session FROM events LEFT JOIN d ON d.day = CAST(ts AS DATE)""")
def t8(spark, folder):
    from pyspark.sql import Window as W
    days = T.events(spark, folder).where("event_type = 'signup'").select(F.to_date("ts").alias("day")).distinct()
    calendar = days.select("day", (F.row_number().over(W.orderBy("day")) - 1).alias("session"))
    return B.drain(B.attach_session(arriving(spark, folder), calendar), "t8").select("event_id", "session")


@study("t9_late_rows")
def t9(spark, folder):
    """Files in hash order arrive out of time: rows older than the bound go to their own sink."""
    path = fresh_path(spark, "ticks")
    rows = T.events(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(FILES, "event_id").write.parquet(path)
    kept, late = B.split_late(B.tick_source(spark, path, rows.schema, 2), "t9", 24 * 3600 * 1000000)
    return kept.select(F.lit("in_time").alias("sink"), "event_id").unionByName(late.select(F.lit("late").alias("sink"), "event_id")).groupBy("sink").agg(F.count(F.lit(1)).alias("ticks"))
