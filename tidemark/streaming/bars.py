"""Structured Streaming forms of the bar feed: de-duplication, resampling, sequences, late rows.

Every query takes a streaming (or batch) DataFrame of ticks and returns a
DataFrame; `drain` runs a stream to the end of its input and returns the sink.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import fresh_path

LATENESS = "1 hour"
NEVER = -(1 << 61)  # microseconds before any tick
LAST_TICK = "ts timestamp, user_id bigint, kept boolean"


def tick_source(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Ticks from arriving files, a bounded number per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run over all available input into a file sink with its own checkpoint, then read the sink."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", fresh_path(spark, f"{name}-state")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


END = dt.datetime(2200, 1, 1)  # later than any tick


def drain_to_end(ticks: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, sink: str | None = None) -> DataFrame:
    """`build` over a stream of ticks whose source ends: every bin is closed by the stream itself.

    A second source carries marks. When the ticks are drained, one mark with a late time and no key arrives; it moves the watermark past all open
    bins, which the query, going on from its own checkpoint, then emits. The mark's own bin stays open, so it is in no result.
    """
    spark = ticks.sparkSession
    marks, out, state = fresh_path(spark, f"{name}-marks"), sink or fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    spark.createDataFrame([], ticks.schema).write.parquet(marks)
    stream = build(ticks.unionByName(spark.readStream.schema(ticks.schema).parquet(marks)))

    def run() -> None:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state)
        query.trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame([tuple(END if c == "ts" else None for c in ticks.columns)], ticks.schema).write.mode("append").parquet(marks)
    run()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, name: str, handle: Callable[[DataFrame, int], None]) -> None:
    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", fresh_path(stream.sparkSession, f"{name}-state"))
             .trigger(availableNow=True).start())
    query.awaitTermination()


def with_history(history: DataFrame, fresh: DataFrame, since) -> DataFrame:
    """Bounded backfill from a static table followed by what the stream delivered."""
    return history.where(F.col("ts") >= since).unionByName(fresh)


def newest_only(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and timestamp, repeated deliveries dropped."""
    return ticks.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark([*keys, "ts"])


def resampled(ticks: DataFrame, width: str, keys: list[str]) -> DataFrame:
    """Open, high, low, close and volume per key and time bin; (ts, event_id) orders equal stamps."""
    order = F.struct("ts", "event_id")
    bins = ticks.withWatermark("ts", LATENESS).groupBy(*keys, F.window("ts", width).alias("bin"))
    return bins.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
                    F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("ticks"), F.sum("value").alias("volume")).select(
        *keys, F.col("bin.start").alias("start"), "open", "high", "low", "close", "ticks", "volume")


def sliding_means(ticks: DataFrame, width: str, slide: str, keys: list[str]) -> DataFrame:
    """Sliding windows with the mean of the whole window and of its last slide (fast, null without a tick there)."""
    late = F.col("ts") >= F.col("bin.end") - F.expr(f"INTERVAL {slide}")
    bins = ticks.withWatermark("ts", LATENESS).select(*keys, "ts", "value", F.window("ts", width, slide).alias("bin"))
    return bins.groupBy(*keys, "bin").agg(F.avg("value").alias("mean"), F.avg(F.when(late, F.col("value"))).alias("fast"), F.count(F.lit(1)).alias("ticks")).select(
        *keys, F.col("bin.start").alias("start"), "mean", "fast", "ticks")


def crossings(means: DataFrame, keys: list[str]) -> DataFrame:
    """A stream of closed sliding windows plus `crossing`: 1 where fast crosses the mean upwards, -1 downwards, else 0.

    Triggers must bring windows in their order, as one that takes all closed windows does; within a trigger they are put in order. The state keeps each key's last side. A window without a side (equal means,
    or no tick in its last slide) keeps the side before it.
    """
    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(chunks), ignore_index=True).sort_values("start", kind="stable")
        apart = (rows["fast"] - rows["mean"]).round(6)
        side = apart.gt(0).astype(int) - apart.lt(0).astype(int)
        held = side.where(side != 0).ffill().fillna(last).astype(int)
        before = held.shift(1, fill_value=last)
        rows["crossing"] = held.where((held != before) & (before != 0), 0).astype(int)
        state.update((int(held.iloc[-1]),))
        yield rows

    schema = T.StructType([*means.schema.fields, T.StructField("crossing", T.IntegerType())])
    return means.groupBy(*keys).applyInPandasWithState(step, schema, "side int", "append", GroupStateTimeout.NoTimeout)


def gap_sessions(ticks: DataFrame, gap: str, keys: list[str]) -> DataFrame:
    return ticks.withWatermark("ts", LATENESS).groupBy(*keys, F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("ticks"), F.sum("value").alias("volume")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "ticks", "volume")


def increasing_only(ticks: DataFrame) -> DataFrame:
    """Per user, keep a tick only when it is strictly later than everything kept before it.

    State is one timestamp per key. A key's rows of a trigger, which the source's file limit bounds, are ordered together, so
    the size of Arrow batches has no say in the result.
    """
    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(chunks), ignore_index=True).sort_values("event_id", kind="stable")
        stamps = rows["us"].astype("int64")
        before = stamps.cummax().shift(1, fill_value=last).clip(lower=last)
        state.update((max(last, int(stamps.max())),))
        yield rows.loc[stamps > before, ["event_id", "user_id", "us"]]

    rows = ticks.select("event_id", "user_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "event_id bigint, user_id bigint, us bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def ordered_pairs(ticks: DataFrame, first: str, second: str, within_us: int) -> DataFrame:
    """Second events that follow a first event of the same user within the limit, from per-user state.

    The state holds the time of the latest first event and is dropped when the watermark passes its limit. A key's rows of a
    trigger, which the source's file limit bounds, are ordered together, whatever the size of Arrow batches.
    """
    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(chunks)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        us, kind = rows["us"].to_numpy(), rows["event_type"].to_numpy()
        firsts = np.sort(us[kind == first])
        # Rows of one instant see the first events of earlier instants only, and the one of the state.
        seen = np.concatenate([[state.get[0] if state.exists else NEVER], firsts]).astype(np.int64)
        seen = np.maximum.accumulate(seen)
        gap = us - seen[np.searchsorted(firsts, us, side="left")]
        hits = (kind == second) & (gap > 0) & (gap <= within_us)
        if hits.any():
            yield rows.loc[hits, ["event_id", "user_id", "us"]]
        if seen[-1] != NEVER:
            state.update((int(seen[-1]),))
            state.setTimeoutTimestamp(max((int(seen[-1]) + within_us) // 1000, state.getCurrentWatermarkMs() + 1))

    rows = ticks.withWatermark("ts", LATENESS).where(F.col("ts").isNotNull() & F.col("event_type").isin(first, second))
    rows = rows.select("event_id", "user_id", "event_type", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "event_id bigint, user_id bigint, us bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def attach_session(ticks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Stream-static join with the calendar by day."""
    return ticks.withColumn("day", F.to_date("ts")).join(F.broadcast(sessions), "day", "left")


def split_late(stream: DataFrame, name: str, lateness_us: int) -> tuple[DataFrame, DataFrame]:
    """Rows in time and rows later than the bound, each in its own sink; nothing is dropped silently.

    The bound follows the largest timestamp of all earlier batches. Each batch and its largest time are written once, to places of their own that a
    repeated batch overwrites, so a restart goes on with the same bound.
    """
    spark = stream.sparkSession
    sink = fresh_path(spark, name)
    schema = T.StructType([*stream.schema.fields, T.StructField("late", T.BooleanType()), T.StructField("batch", T.LongType())])
    spark.createDataFrame([], schema.fromJson({**schema.jsonValue(), "fields": schema.jsonValue()["fields"][:-1]})).write.mode("append").parquet(f"{sink}/batch=-1")

    highs = f"{sink}-highs"
    high_schema = "high bigint, batch bigint"
    spark.createDataFrame([], "high bigint").write.mode("append").parquet(f"{highs}/batch=-1")

    def handle(batch: DataFrame, number: int) -> None:
        # One small row a batch holds its largest time, so a batch does not read the rows of all earlier ones.
        high = spark.read.schema(high_schema).parquet(highs).where(F.col("batch") < number).agg(F.max("high").alias("m")).first()["m"]
        late = F.lit(False) if high is None else F.coalesce(F.unix_micros("ts") < high - lateness_us, F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        own = spark.read.schema(schema).parquet(f"{sink}/batch={number}")
        own.agg(F.max(F.unix_micros("ts")).alias("high")).coalesce(1).write.mode("overwrite").parquet(f"{highs}/batch={number}")

    drain_batches(stream, name, handle)
    rows = spark.read.schema(schema).parquet(sink)
    return rows.where("not late").select(*stream.columns), rows.where("late").select(*stream.columns)
