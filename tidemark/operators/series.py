"""Ordered per-ticker series: history counts, recency, signals, trades, regimes.

All windows run at (ticker or issuer, session) grain, which the calendar bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators.panel import by_session


def prior_count(events: str, window: int, keys: Sequence[str]) -> Column:
    """Events in the last `window` sessions before today; NULL until that history exists."""
    total = F.coalesce(F.sum(events).over(by_session(*keys).rowsBetween(-window, -1)), F.lit(0))
    return F.when(F.col("session") >= window, total)


def prior_flag(events: str, window: int, keys: Sequence[str], censored: bool = True) -> Column:
    found = F.coalesce(F.max((F.col(events) > 0).cast("int")).over(by_session(*keys).rowsBetween(-window, -1)), F.lit(0))
    return F.when(F.col("session") >= window, found) if censored else found


def recency(events: str, cap: int, keys: Sequence[str]) -> Column:
    """Sessions since the last strictly earlier event, at most cap + 1; NULL while session < cap."""
    last = F.max(F.when(F.col(events) > 0, F.col("session"))).over(by_session(*keys).rowsBetween(W.unboundedPreceding, -1))
    return F.when(F.col("session") >= cap, F.least(F.coalesce(F.col("session") - last, F.lit(cap + 1)), F.lit(cap + 1)))


def demeaned(value: str, keys: Sequence[str]) -> Column:
    return F.col(value) - F.avg(value).over(W.partitionBy(*keys))


def crossover(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """Two moving averages per ticker and a +1 / -1 signal on the bar where their order flips."""
    w = W.partitionBy("ticker").orderBy("date")

    def average(k: int) -> Column:
        f = w.rowsBetween(1 - k, 0)
        return F.when(F.count("close").over(f) == k, F.avg("close").over(f))

    lines = bars.withColumns({"fast": average(fast), "slow": average(slow)})
    above = lines.withColumn("above", F.signum(F.col("fast") - F.col("slow")))
    before = F.lag("above").over(w)
    return above.withColumn("signal", F.when((F.col("above") > 0) & (before <= 0), 1).when((F.col("above") < 0) & (before >= 0), -1)
                            .otherwise(0)).withColumn("bar", F.row_number().over(w)).drop("above")


def paired_trades(signals: DataFrame) -> DataFrame:
    """Long trades: an entry on +1 while flat, closed by the next -1; the last may stay open.

    Repeated signals of the same side are one run, so only changes of side count.
    """
    w = W.partitionBy("ticker").orderBy("date")
    marks = signals.where(F.col("signal") != 0)
    changes = marks.withColumn("previous", F.lag("signal").over(w)).where(
        F.col("previous").isNull() | (F.col("previous") != F.col("signal")))
    follow = changes.select("ticker", "signal", F.col("date").alias("entry_date"), F.col("close").alias("entry_price"),
                            F.col("bar").alias("entry_bar"), F.lead("date").over(w).alias("exit_date"),
                            F.lead("close").over(w).alias("exit_price"), F.lead("bar").over(w).alias("exit_bar"))
    return follow.where(F.col("signal") == 1).select(
        "ticker", "entry_date", "exit_date", "entry_price", "exit_price", (F.col("exit_price") - F.col("entry_price")).alias("pnl"),
        (F.col("exit_bar") - F.col("entry_bar")).alias("bars_held"))


def trade_summary(trades: DataFrame) -> DataFrame:
    """Closed trades per ticker: won, lost, win rate, net, and the drawdown of the running total."""
    closed = trades.where(F.col("exit_date").isNotNull())
    w = W.partitionBy("ticker").orderBy("exit_date", "entry_date").rowsBetween(W.unboundedPreceding, 0)
    running = closed.withColumn("total", F.sum("pnl").over(w))
    running = running.withColumn("drop", F.greatest(F.max("total").over(w), F.lit(0.0)) - F.col("total"))
    return running.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("won"), F.count_if(F.col("pnl") <= 0).alias("lost"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.sum("pnl").alias("net_pnl"), F.max("drop").alias("max_drawdown"))


def momentum_weights(dense: DataFrame, lookback: int, top: int, cap: float, every: int) -> DataFrame:
    """Equal weights of the strongest positive movers on every n-th session, each at most `cap`."""
    moved = dense.withColumn("momentum", ratio("close", F.lag("close", lookback).over(by_session())) - 1)
    chosen = moved.where((F.col("session") % every == 0) & (F.col("momentum") > 0))
    rank = F.row_number().over(W.partitionBy("session").orderBy(F.desc("momentum"), "ticker"))
    picked = chosen.withColumn("place", rank).where(F.col("place") <= top)
    count = F.count(F.lit(1)).over(W.partitionBy("session"))
    return picked.select("session", "ticker", "place", "momentum", F.least(1 / count, F.lit(cap)).alias("weight"))


def drawdown(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Running peak and drop below it."""
    w = by_session(*keys).rowsBetween(W.unboundedPreceding, 0)
    return values.withColumn("peak", F.max(value).over(w)).withColumn("drawdown", ratio(value, "peak") - 1)


def spaced(sessions: Column, gap: int) -> Column:
    """Greedy selection from a sorted session array: keep what lies more than `gap` after the last kept."""
    return F.aggregate(sessions, F.array().cast("array<int>"), lambda kept, s: F.when(
        (F.size(kept) == 0) | (s - F.element_at(kept, -1) > gap), F.array_append(kept, s)).otherwise(kept))


def suppress_repeats(rows: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Mark rows that come at most `gap` sessions after the last kept row of the same key.

    The key's distinct sessions form a calendar-bounded array; a row number or a
    lag would compare with dropped rows and is not equivalent.
    """
    days = rows.select(*keys, "session").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("session")).alias("days"))
    kept = days.select(*keys, F.explode(spaced(F.col("days"), gap)).alias("session"), F.lit(True).alias("kept"))
    return rows.join(kept, [*keys, "session"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def prior_year_cuts(series: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Cut points per year from all strictly earlier years of a calendar-sized series."""
    years = series.select(F.year("date").alias("year")).distinct()
    last = years.agg(F.max("year")).scalar()
    spread = series.where(F.col(value).isNotNull() & (F.year("date") < last)).select(
        value, F.explode(F.sequence(F.year("date") + 1, last)).alias("year"))
    cuts = spread.groupBy("year").agg(*[F.percentile(value, p).alias(n) for n, p in probs.items()])
    return years.join(cuts, "year", "left")
