"""Dense ticker x session panels: past-only controls and forward outcomes.

A ticker has at most one row per trading session, so every window partition is
bounded by the calendar, whatever the size of the source. Frames count the rows
they need and stay NULL when a session is missing; nothing is shortened.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import no_nulls, ratio


def by_session(*keys: str):
    return W.partitionBy(*(keys or ("ticker",))).orderBy("session")


def calendar(sessions: DataFrame) -> DataFrame:
    """Sessions are calendar-sized (a few hundred rows a year): safe to broadcast."""
    return F.broadcast(sessions)


def densify(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row for every ticker and session; the bar's columns are NULL where no bar exists."""
    last = sessions.agg(F.max("session").alias("last")).scalar()
    grid = bars.select("ticker").distinct().select(
        "ticker", F.explode(F.sequence(F.lit(0), last)).alias("session"))
    numbered = bars.join(calendar(sessions), "date").drop("date")
    return grid.join(numbered, ["ticker", "session"], "left").join(calendar(sessions), "session")


def moves(dense: DataFrame) -> DataFrame:
    """Add ret, the one-session return; NULL on either missing close."""
    return dense.withColumn("ret", past_return(1))


def past_return(k: int) -> Column:
    return ratio("close", F.lag("close", k).over(by_session())) - 1


def full_frame(value: Column | str, aggregate, low: int, high: int, keys: Sequence[str] = ("ticker",)) -> Column:
    """Aggregate over rows [low, high], NULL unless all of them hold a value."""
    v = F.col(value) if isinstance(value, str) else value
    frame = by_session(*keys).rowsBetween(low, high)
    return F.when(F.count(v).over(frame) == high - low + 1, aggregate(v).over(frame))


def rolling_std(k: int) -> Column:
    return full_frame("ret", F.stddev_samp, 1 - k, 0)


def rolling_rms(k: int, value: str = "ret") -> Column:
    return F.sqrt(full_frame(F.col(value) * F.col(value), F.avg, 1 - k, 0))


def average_dollar_volume(k: int) -> Column:
    return full_frame(F.col("close") * F.col("volume"), F.avg, 1 - k, 0)


def volume_state(k: int) -> Column:
    return ratio("volume", full_frame("volume", F.avg, 1 - k, 0))


def forward_complete(h: int) -> Column:
    return F.count("ret").over(by_session().rowsBetween(1, h)) == h


def forward_return(h: int) -> Column:
    return F.when(forward_complete(h), ratio(F.lead("close", h).over(by_session()), "close") - 1)


def forward_volatility(h: int) -> Column:
    return F.sqrt(full_frame(F.col("ret") * F.col("ret"), F.avg, 1, h))


def forward_downside(h: int) -> Column:
    low = F.min("close").over(by_session().rowsBetween(1, h))
    return F.when(forward_complete(h), F.greatest(F.lit(0.0), 1 - ratio(low, "close")))


def target_end(h: int) -> Column:
    return F.lead("date", h).over(by_session())


def next_session(sessions: DataFrame) -> DataFrame:
    """(day, session, session_date): the first session on or after every calendar day."""
    before = sessions.withColumn("before", F.lag("date").over(W.orderBy("session")))
    start = F.coalesce(F.date_add("before", 1), F.col("date"))
    return before.select(F.explode(F.sequence(start, F.col("date"))).alias("day"), "session",
                         F.col("date").alias("session_date"))


def align_forward(rows: DataFrame, sessions: DataFrame, available: str) -> DataFrame:
    """Attach the first session at or after the available date (NULL beyond the grid).

    The calendar map turns the as-of search into an equality join on the day.
    """
    first = sessions.agg(F.min("date").alias("first")).scalar()
    days = F.broadcast(next_session(sessions))
    return rows.withColumn("day", F.greatest(F.col(available), first)).join(days, "day", "left").drop("day")


def event_days(aligned: DataFrame, keys: Sequence[str] = ("ticker", "category")) -> DataFrame:
    """(keys, session, filings): filings per aligned session; hot keys shrink to the calendar here."""
    return aligned.where(F.col("session").isNotNull()).groupBy(*keys, "session").agg(
        F.count(F.lit(1)).alias("filings"))


def attach_benchmark(panel: DataFrame, benchmark: DataFrame, names: Sequence[str]) -> DataFrame:
    """Join the benchmark's columns by session (one row per session, so broadcast is bounded)."""
    market = benchmark.select("session", *[F.col(n).alias(f"market_{n}") for n in names])
    return panel.join(F.broadcast(market), "session", "left")


def study_panel(dense: DataFrame, aligned: DataFrame, categories: Sequence[str],
                horizons: Sequence[int], benchmark: str, first: str, second: str, gap: int) -> DataFrame:
    """Controls, forward outcomes, one-day event flags, and the ordered-sequence flag."""
    wide = moves(dense).select(
        "ticker", "session", "date", "close", past_return(5).alias("past_return_5"),
        past_return(20).alias("past_return_20"), rolling_std(20).alias("past_vol_20"),
        F.log1p("volume").alias("past_log_volume"),
        *[forward_return(h).alias(f"return_{h}") for h in horizons],
        *[forward_volatility(h).alias(f"volatility_{h}") for h in horizons],
        *[target_end(h).alias(f"target_end_{h}") for h in horizons])
    market = dense.where(F.col("ticker") == benchmark).select("session", past_return(5).alias("market_past_return_5"))
    wide = wide.where(F.col("ticker") != benchmark).join(F.broadcast(market), "session", "left")
    flags = event_days(aligned.where(F.col("category").isin(list(categories)))).groupBy("ticker", "session").pivot(
        "category", list(categories)).agg(F.max(F.lit(1)))
    flags = flags.select("ticker", "session", *[F.col(f"`{c}`").alias(f"event__{c}") for c in categories])
    wide = wide.join(flags, ["ticker", "session"], "left").na.fill(0, [f"event__{c}" for c in categories])
    recent = F.coalesce(F.max(F.col(f"event__{first}")).over(by_session().rowsBetween(-gap, -1)), F.lit(0))
    return (wide.withColumn("recent_a", recent)
            .withColumn("sequence_a_before_b", F.col("recent_a") * F.col(f"event__{second}"))
            .where(no_nulls("past_return_5", "past_return_20", "past_vol_20", "past_log_volume",
                            "market_past_return_5")))


def extended_panel(dense: DataFrame, issuer: Column, horizons: Sequence[int], benchmark: str) -> DataFrame:
    """Eleven controls, four outcome kinds and the share-class weight."""
    wide = moves(dense).select(
        "ticker", issuer.alias("issuer"), "session", "date", "close", "volume",
        *[past_return(h).alias(f"return{h}") for h in (1, 5, 20, 60)],
        *[rolling_rms(h).alias(f"vol{h}") for h in (20, 60)],
        F.log1p(average_dollar_volume(20)).alias("log_adv20"), volume_state(20).alias("volume_state"),
        *[forward_return(h).alias(f"return_{h}") for h in horizons],
        *[forward_volatility(h).alias(f"volatility_{h}") for h in horizons],
        *[forward_downside(h).alias(f"downside_{h}") for h in horizons],
        *[target_end(h).alias(f"target_end_{h}") for h in horizons])
    for h in horizons:
        wide = wide.withColumn(f"absolute_{h}", F.abs(F.col(f"return_{h}")))
    alone = moves(dense.where(F.col("ticker") == benchmark)).select(
        "session", past_return(5).alias("return5"), past_return(20).alias("return20"), rolling_rms(20).alias("vol20"))
    market = alone.select(
        "session", F.col("return5").alias("market_return5"), F.col("return20").alias("market_return20"),
        F.col("vol20").alias("market_vol20"))
    share = 1 / F.count(F.lit(1)).over(W.partitionBy("issuer", "session"))
    return (wide.where(F.col("ticker") != benchmark).join(F.broadcast(market), "session", "left")
            .withColumn("weight", share))
