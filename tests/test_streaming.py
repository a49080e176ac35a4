"""Streams delivered in several batches give the batch result."""

import time

import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidemark.session import fresh_path
from tidemark.streaming import bars as B

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def ticks(spark, n=60):
    rows = [(i, i * 600, i % 3, ["click", "purchase", "view"][(i // 3) % 3], float(i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id bigint, s bigint, user_id bigint, event_type string, value double").select(
        "event_id", F.timestamp_seconds(F.col("s") + 1704067200).alias("ts"), "user_id", "event_type", "value")


def arriving(spark, rows, parts=3):
    path = fresh_path(spark, "test-ticks")
    for k in range(parts):
        rows.where((F.col("event_id") >= k * 20) & (F.col("event_id") < (k + 1) * 20)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return B.tick_source(spark, path, rows.schema, 1)


def test_state_survives_batches(spark):
    rows = ticks(spark)
    kept = B.drain(B.increasing_only(arriving(spark, rows)), "inc").count()
    assert kept == 60
    limit = 3 * 3600 * 1000000
    got = {r["event_id"] for r in B.drain(B.ordered_pairs(arriving(spark, rows), "click", "purchase", limit), "pairs").collect()}
    data = [(r["event_id"], r["ts"].timestamp(), r["user_id"], r["event_type"]) for r in rows.collect()]
    want = {b[0] for b in data if b[3] == "purchase" and any(a[3] == "click" and a[2] == b[2] and 0 < b[1] - a[1] <= 3 * 3600 for a in data)}
    assert got == want


def test_resample_over_batches(spark):
    rows = ticks(spark)
    out = B.drain(B.resampled(arriving(spark, rows), "1 hour", ["user_id"]), "bars")
    batch = rows.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
    matched = out.join(batch, ["user_id", "start"])
    assert out.count() == matched.where("ticks = n").count() >= 24


def test_late_rows_go_to_their_own_sink(spark):
    rows = ticks(spark)
    shuffled = rows.withColumn("event_id", (F.col("event_id") + 20) % 60)
    kept, late = B.split_late(arriving(spark, shuffled), "late", 3600 * 1000000)
    assert kept.count() + late.count() == 60 and late.count() > 0


@pytest.mark.parametrize("size", [7, 10_000])
def test_stateful_results_do_not_depend_on_arrow_batches(spark, tmp_path, size):
    rows = [(i, 1, "click" if i % 3 == 0 else "purchase", 86_400 + (i * 37 % 200) * 60) for i in range(150)]
    pdf = pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "s"])
    out = str(tmp_path / "ticks")
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("s")).withColumn("value", F.lit(1.0)).drop("s")
    df.coalesce(1).sortWithinPartitions(F.col("event_id").desc()).write.parquet(out)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        kept = {r.event_id for r in B.drain(B.increasing_only(B.tick_source(spark, out, df.schema)), "test").collect()}
        pairs = {r.event_id for r in B.drain(B.ordered_pairs(B.tick_source(spark, out, df.schema), "click", "purchase", 600 * 1_000_000), "test").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    high, want = -1, set()
    for i, _, _, s in rows:
        if s > high:
            want.add(i)
            high = s
    assert kept == want
    clicks = [s for _, _, kind, s in rows if kind == "click"]
    assert pairs == {i for i, _, kind, s in rows if kind == "purchase" and any(0 < s - c <= 600 for c in clicks)}


def test_late_bound_survives_a_repeated_batch(spark, tmp_path):
    out = str(tmp_path / "ticks")
    for i, s in enumerate([1000, 9000, 2000, 9500]):
        spark.createDataFrame([(i, s)], "event_id long, s long").select("event_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(out)
    schema = "event_id long, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(out)
    kept, late = B.split_late(stream, "test", 3600 * 1_000_000)
    assert sorted(r.event_id for r in kept.collect()) == [0, 1, 3] and [r.event_id for r in late.collect()] == [2]


def test_an_ended_stream_closes_its_own_bins(spark):
    rows = ticks(spark)
    bars = B.drain_to_end(arriving(spark, rows), lambda t: B.resampled(t, "1 hour", ["user_id"]), "bars")
    want = rows.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
    assert {(r.user_id, r.start, r.ticks) for r in bars.collect()} == {tuple(r) for r in want.collect()}
    gaps = B.drain_to_end(arriving(spark, rows.where("event_id % 30 < 12")), lambda t: B.gap_sessions(t, "2 hours", ["user_id"]), "gaps")
    assert sorted((r.user_id, r.ticks) for r in gaps.collect()) == [(u, 4) for u in (0, 0, 1, 1, 2, 2)]


def test_crossings_carry_their_side_over_batches(spark):
    values = [1.0, 2.0, 3.0, 2.0, 1.0, 0.0, 0.0, 5.0, 6.0, 1.0, 1.0, 1.0]
    rows = spark.createDataFrame([(i, i * 3600, 1, "a", v) for i, v in enumerate(values)], "event_id bigint, s bigint, user_id bigint, event_type string, value double").select(
        "event_id", F.timestamp_seconds(F.col("s") + 1704067200).alias("ts"), "user_id", "event_type", "value")
    sink = fresh_path(spark, "means")
    means = B.drain_to_end(arriving(spark, rows.withColumn("event_id", F.col("event_id") * 5)), lambda t: B.sliding_means(t, "3 hours", "1 hour", ["event_type"]), "means", sink)
    again = fresh_path(spark, "means")  # one file a trigger, in the order of the windows
    ordered = [r.start for r in means.orderBy("start").collect()]
    for low in range(0, len(ordered), 5):
        means.where(F.col("start").isin(ordered[low:low + 5])).coalesce(1).write.mode("append").parquet(again)
        time.sleep(0.05)
    stream = spark.readStream.schema(means.schema).option("maxFilesPerTrigger", 1).parquet(again)
    got = [r.crossing for r in B.drain(B.crossings(stream, ["event_type"]), "crossings").orderBy("start").collect()]
    want, last = [], 0
    for end in range(1, len(values) + 3):
        window = values[max(0, end - 3):min(end, len(values))]
        fast = values[end - 1] if end <= len(values) else None
        apart = 0 if fast is None else round(fast - sum(window) / len(window), 6)
        side = (apart > 0) - (apart < 0) or last
        want.append(side if side != last and last else 0)
        last = side
    assert got == want and 1 in want and -1 in want
