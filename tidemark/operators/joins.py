"""As-of, range and exclusion joins written as equality joins or bounded windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import first_reason
from tidemark.operators.panel import by_session


def aged_mark(value: str, max_age: int, keys: Sequence[str] = ("ticker",)) -> tuple[Column, Column]:
    """Latest mark at most `max_age` sessions old on a dense grid, and its age."""
    frame = by_session(*keys).rowsBetween(-max_age, 0)
    seen = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("session").alias("s"))), ignorenulls=True).over(frame)
    return seen["v"], F.col("session") - seen["s"]


def latest_quote(cutoffs: DataFrame, quotes: DataFrame, keys: Sequence[str], max_age_ns: int) -> DataFrame:
    """Latest quote in [cutoff - max_age, cutoff] per cutoff row; ties by sequence.

    Cutoffs are calendar-sized and broadcast. A quote can only be the latest of the first cutoff at or after it, or of later ones that
    have none of their own, so every task keeps one quote a cutoff time: what is shuffled grows with the cutoffs and tasks, not with the quotes.
    Time is cut in buckets of max_age, so a quote meets the few cutoffs of its own and the next bucket.
    """
    names = [c for c in quotes.columns if c not in keys]
    times = cutoffs.select(*keys, F.col("cutoff_ns").alias("_at")).where(F.col("_at").isNotNull()).distinct()
    bucket = F.floor(F.col("_at") / max_age_ns)
    near = times.select("*", F.explode(F.array(bucket - 1, bucket)).alias("_bucket")).groupBy(*keys, "_bucket").agg(F.array_sort(F.collect_list("_at")).alias("_cuts"))
    placed = quotes.withColumn("_bucket", F.floor(F.col("ts_ns") / max_age_ns)).join(F.broadcast(near), [*keys, "_bucket"])
    first = F.get(F.filter("_cuts", lambda c: c >= F.col("ts_ns")), F.lit(0))
    placed = placed.select(*keys, first.alias("_at"), *names).where(F.col("_at").isNotNull() & (F.col("_at") - F.col("ts_ns") <= max_age_ns))
    own = placed.groupBy(*keys, "_at").agg(F.max(F.struct("ts_ns", "sequence", F.struct(*names).alias("quote"))).alias("_own"))
    # A cutoff without a quote of its own looks back over the cutoffs of its key, at most a calendar of them.
    back = W.partitionBy(*keys).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    best = times.join(own, [*keys, "_at"], "left").select(*keys, F.col("_at").alias("cutoff_ns"), F.last("_own.quote", ignorenulls=True).over(back).alias("best"))
    fresh = F.col("cutoff_ns") - F.col("best.ts_ns") <= max_age_ns
    found = cutoffs.join(best, [*keys, "cutoff_ns"], "left")
    return found.select(*cutoffs.columns, *[F.when(fresh, F.col(f"best.{n}")).alias(n) for n in names])


def shifted(rows: DataFrame, value: str, k: int, name: str, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Value exactly k sessions earlier; a missing session gives NULL, never the next older one."""
    earlier = rows.select(*keys, (F.col("session") + k).alias("session"), F.col(value).alias(name))
    return rows.join(earlier, [*keys, "session"], "left")


def outside_zones(candidates: DataFrame, events: DataFrame, keys: Sequence[str], radius: int) -> DataFrame:
    """Candidates with no event within `radius` sessions: the zone becomes rows, the test an equality anti join."""
    zone = events.select(*keys, F.explode(F.sequence(F.col("session") - radius, F.col("session") + radius)).alias("session")).distinct()
    return candidates.join(zone, [*keys, "session"], "left_anti")


def running_total(days: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Running sum at (key, session) grain, the lookup table of interval sums."""
    return days.withColumn(name, F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(
        by_session(*keys).rowsBetween(W.unboundedPreceding, 0)))


def interval_sum(positions: DataFrame, totals: DataFrame, keys: Sequence[str], total: str, name: str) -> DataFrame:
    """Sum over (entry, exit] as the difference of two running totals: two equality joins."""
    at_entry = totals.select(*keys, F.col("session").alias("entry_session"), F.col(total).alias("_a"))
    at_exit = totals.select(*keys, F.col("session").alias("exit_session"), F.col(total).alias("_b"))
    return positions.join(at_entry, [*keys, "entry_session"], "left").join(at_exit, [*keys, "exit_session"], "left").withColumn(
        name, F.col("_b") - F.col("_a")).drop("_a", "_b")


def call_put_pairs(contracts: DataFrame) -> DataFrame:
    """Call and put of the same ticker, expiry and strike; listings are reduced to one contract per side."""
    sides = contracts.groupBy("ticker", "expiry", "strike").pivot("contract_type", ["call", "put"]).agg(F.min("contract"))
    return sides.where("call is not null and put is not null")


def reconcile(expected: DataFrame, delivered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every expected item once, with what was delivered for it."""
    got = delivered.groupBy(*keys).agg(F.count(F.lit(1)).alias("deliveries"), F.count_if(F.col("failed")).alias("failures"))
    status = first_reason((F.col("deliveries").isNull(), "missing"), (F.col("failures") == F.col("deliveries"), "failed"))
    return expected.join(got, list(keys), "left").select(
        *keys, F.coalesce("deliveries", F.lit(0)).alias("deliveries"), F.coalesce(status, F.lit("complete")).alias("status"))


def earlier_in_window(grid: DataFrame, first: str, second: str, window: int, keys: Sequence[str]) -> DataFrame:
    """Rows with a `second` event: how many `first` events lie 1..window sessions before, and the latest of them.

    `grid` holds counts per key and session, so no pairs of events are emitted.
    """
    frame = by_session(*keys).rowsBetween(-window, -1)
    latest = F.max(F.when(F.col(first) > 0, F.col("session"))).over(frame)
    return grid.select("*", F.coalesce(F.sum(first).over(frame), F.lit(0)).alias("earlier"), latest.alias("latest_session")).where(F.col(second) > 0)


def nearest_listed(goals: DataFrame, listed: DataFrame, keys: Sequence[str], goal: str, value: str, distance) -> DataFrame:
    """goals plus `near`, the listed row of equal keys whose value is nearest to the goal; of equal distances the lower one, null without any.

    listed has one row per (keys, value). distance(row, near) is the distance of a goal's row to a listed row's value; it must grow
    with the difference on either side. Goals and listed values pass in one order, so no goal meets every value.
    """
    one = goals.select(*keys, F.col(goal).alias("_x"), F.lit(1).alias("_kind"), F.struct(*goals.columns).alias("_row"), F.lit(None).alias("_listed"))
    two = listed.select(*keys, F.col(value).alias("_x"), F.lit(0).alias("_kind"), F.lit(None).alias("_row"), F.struct(*listed.columns).alias("_listed"))
    both = one.unionByName(two)
    up = W.partitionBy(*keys).orderBy("_x", "_kind").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys).orderBy(F.col("_x").desc(), F.col("_kind").desc()).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_low", F.last("_listed", ignorenulls=True).over(up)).withColumn("_high", F.last("_listed", ignorenulls=True).over(down)).where("_kind = 1")
    low, high = F.col("_low"), F.col("_high")
    better = F.when(low.isNull(), high).when(high.isNull(), low).when(distance(F.col("_row"), high) < distance(F.col("_row"), low), high).otherwise(low)
    return found.select("_row.*", better.alias("near"))
