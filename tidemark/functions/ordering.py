"""Exact ranks, order statistics and quantiles that never put a group in one task.

A plain rank window sends a whole group to one task. Here the values of a group
are first counted, then cut into ranges at approximate split points; every
range is numbered on its own and shifted by the rows in the ranges before it.
The split points only balance the work, so the numbers are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLITS = 64


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _count): hot ties collapse before any ordering."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))


def positioned(counts: DataFrame, keys: list[str], value: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """Add _before (rows with a smaller value), _sum_before (their sum) and _total (rows of the group); `carried` columns stay."""
    grid = F.array(*[F.lit((i + 1) / SPLITS) for i in range(SPLITS - 1)])
    splits = counts.groupBy(*keys).agg(
        F.percentile_approx(value, grid, 1000).alias("_splits"), F.sum("_count").alias("_total"))
    on = _same_keys(keys)
    tagged = counts.alias("l").join(splits.alias("r"), on, "inner").select(
        *[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{value}").alias(value), "_count", "_total", *carried,
        F.size(F.filter("_splits", lambda s: s < F.col(f"l.{value}"))).alias("_range"))
    weighted = F.col("_count") * F.col(value)
    sizes = tagged.groupBy(*keys, "_range").agg(F.sum("_count").alias("_rows"), F.sum(weighted).alias("_mass"))
    prior = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_rows").over(prior), F.lit(0)).alias("_offset"),
                           F.coalesce(F.sum("_mass").over(prior), F.lit(0)).alias("_mass_offset"))
    inside = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    local = tagged.withColumns({"_local": F.coalesce(F.sum("_count").over(inside), F.lit(0)),
                                "_mass_local": F.coalesce(F.sum(weighted).over(inside), F.lit(0))})
    joined = local.alias("l").join(offsets.alias("r"), on & (F.col("l._range") == F.col("r._range")), "inner")
    return joined.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{value}").alias(value), "_count", *carried,
                         "_total", (F.col("_offset") + F.col("_local")).alias("_before"),
                         (F.col("_mass_offset") + F.col("_mass_local")).alias("_sum_before"))


def _same_keys(keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return condition


def with_totals(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with the sums of its group on every row: added per group and joined back, so no group has to fit one task."""
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    joined = df.alias("l").join(totals.alias("r"), _same_keys(keys), "inner")
    return joined.select("l.*", *[F.col(f"r.{n}").alias(n) for n in sums])


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, value, name) with average ranks for ties, one row per distinct value."""
    return positioned(value_counts(df, keys, value), keys, value).select(
        *keys, value, (F.col("_before") + (F.col("_count") + 1) / 2.0).alias(name))


def lowest_share_mean(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """Mean of the ceil(share * n) smallest values of every group."""
    ordered = positioned(value_counts(df, keys, value), keys, value)
    size = F.ceil(F.col("_total") * F.lit(share))
    taken = F.greatest(F.lit(0), F.least(F.col("_count"), size - F.col("_before")))
    return ordered.groupBy(*keys).agg((F.sum(taken * F.col(value)) / F.sum(taken)).alias(name))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles, one column per named probability."""
    ordered = positioned(value_counts(df, keys, value), keys, value)
    columns = []
    for name, p in probs.items():
        spot = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)

        def at(k: Column) -> Column:
            return F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_count")), F.col(value)))

        share = F.max(spot - low)
        columns.append((at(low) + (at(high) - at(low)) * share).alias(name))
    return ordered.groupBy(*keys).agg(*columns)
