"""Matching of event sessions to earlier ordinary sessions of the same issuer.

Candidates are always restricted to a session range, and both sides are at
(ticker, session) grain, so a ticker gives at most sessions x range pairs. The
range becomes a bucket, which makes the join an equality join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import no_nulls
from tidemark.operators.panel import by_session

# Fixed values of the matching rules.
NEAREST = {"back_far": 252, "back_near": 84, "warmup": 21, "quiet": 4, "caliper": 2.0, "floor": 1e-8}


def expanding_scales(features: DataFrame, names: Sequence[str], minimum: int) -> DataFrame:
    """Population deviation of all earlier complete rows of the ticker, NULL below `minimum` rows."""
    complete = features.where(no_nulls(*names))
    frame = by_session().rowsBetween(W.unboundedPreceding, -1)
    enough = F.count(F.lit(1)).over(frame) >= minimum
    return complete.select("*", *[F.when(enough, F.greatest(F.stddev_pop(n).over(frame), F.lit(NEAREST["floor"]))).alias(f"scale_{n}") for n in names])


def prior_pairs(events: DataFrame, candidates: DataFrame, near: int, far: int) -> DataFrame:
    """(event row e, candidate row c) with c.session in [e.session - far, e.session - near]."""
    width = far - near + 1
    low, high = F.col("session") - far, F.col("session") - near
    left = events.select("ticker", F.struct(*events.columns).alias("e"),
                         F.explode(F.array_distinct(F.array(F.floor(low / width), F.floor(high / width)))).alias("bucket"))
    right = candidates.select("ticker", F.struct(*candidates.columns).alias("c"), F.floor(F.col("session") / width).alias("bucket"))
    gap = F.col("e.session") - F.col("c.session")
    return left.join(right, ["ticker", "bucket"]).where(gap.between(near, far)).select("ticker", "e", "c")


def mean_square(names: Sequence[str], scale=lambda n: F.col(f"e.scale_{n}")) -> tuple[Column, Column]:
    """Mean squared scaled difference and the largest absolute one."""
    z = [(F.col(f"e.{n}") - F.col(f"c.{n}")) / scale(n) for n in names]
    worst = F.greatest(*[F.abs(v) for v in z]) if len(z) > 1 else F.abs(z[0])
    return sum((v * v for v in z[1:]), z[0] * z[0]) / len(z), worst


def nearest_prior(events: DataFrame, candidates: DataFrame, names: Sequence[str], near: int, far: int) -> DataFrame:
    """Best candidate per event session: smallest mean squared z, then the latest session."""
    pairs = prior_pairs(events, candidates, near, far)
    distance, worst = mean_square(names)
    good = pairs.withColumn("distance", distance).where(worst <= NEAREST["caliper"])
    return good.groupBy("ticker", F.col("e.session").alias("session")).agg(
        F.min(F.struct("distance", (-F.col("c.session")).alias("later"))).alias("best")).select(
        "ticker", "session", (-F.col("best.later")).alias("control_session"), F.col("best.distance").alias("distance"))


def quiet_sessions(features: DataFrame, events: DataFrame, quiet: int) -> DataFrame:
    """Feature rows with no event on them or in the `quiet` sessions before."""
    zone = events.select("ticker", F.explode(F.sequence(F.col("session"), F.col("session") + quiet)).alias("session")).distinct()
    return features.join(zone, ["ticker", "session"], "left_anti")


def spaced_prior(events: DataFrame, candidates: DataFrame, names: Sequence[str], far: int, gap: int, count: int) -> DataFrame:
    """Up to `count` nearest earlier sessions, each more than `gap` sessions from those already kept.

    The candidates of one event are at most `far` rows, so they fit one array.
    """
    pairs = prior_pairs(events, candidates, 1, far).where(F.col("c.target_end") < F.col("e.date"))
    distance, _ = mean_square(names, lambda n: F.lit(1.0))
    ranked = pairs.groupBy("ticker", F.col("e.session").alias("session")).agg(
        F.array_sort(F.collect_list(F.struct((distance * len(names)).alias("d"), F.col("c.session").alias("s")))).alias("pool"))
    start = F.array().cast("array<int>")
    kept = F.aggregate("pool", start, lambda k, x: F.when(
        (F.size(k) < count) & F.forall(k, lambda s: F.abs(s - x["s"]) > gap), F.array_append(k, x["s"])).otherwise(k))
    return ranked.select("ticker", "session", kept.alias("controls"))


def unique_nearest(events: DataFrame, candidates: DataFrame, names: Sequence[str], days: int) -> DataFrame:
    """Nearest earlier session within `days`, each used once, events taken in date order.

    Taking turns is order-dependent, so each ticker's candidate pairs (calendar
    times window, never the raw filings) are walked in one grouped call.
    """
    pairs = prior_pairs(events, candidates, 1, days).where(
        (F.datediff("e.date", "c.date") <= days) & (F.col("c.target_end") < F.col("e.date")))
    distance, _ = mean_square(names)
    flat = pairs.select("ticker", F.col("e.session").alias("session"), F.col("c.session").alias("control_session"),
                        F.sqrt(distance).alias("distance")).where(F.col("distance") <= NEAREST["caliper"])
    return flat.groupBy("ticker").applyInPandas(_take_turns, "ticker string, session int, control_session int, distance double")


def _take_turns(pairs: pd.DataFrame) -> pd.DataFrame:
    ordered = pairs.sort_values(["session", "distance", "control_session"], kind="stable")
    used: set[int] = set()
    kept = []
    for _, group in ordered.groupby("session", sort=True):
        free = group[~group["control_session"].isin(used)]
        if len(free):
            kept.append(free.iloc[0])
            used.add(int(free.iloc[0]["control_session"]))
    return pd.DataFrame(kept, columns=pairs.columns) if kept else pairs.iloc[:0]


def balance(pairs: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Standardized mean difference of every feature over matched pairs."""
    parts = []
    for n in names:
        diff = F.avg(f"e_{n}") - F.avg(f"c_{n}")
        pooled = F.sqrt((F.var_samp(f"e_{n}") + F.var_samp(f"c_{n}")) / 2)
        parts.append(F.try_divide(diff, pooled).alias(f"smd_{n}"))
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), *parts)
