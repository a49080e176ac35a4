"""Resampling weights, weighted re-estimates and family adjustments.

Draws come from counters, so a weight depends only on (seed, draw, slot) and not
on partitioning. Losses are summed to (comparison, date) before they meet the
weights, and the product is summed straight to (comparison, draw).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import counter_draw
from tidemark.operators.estimators import MOMENTS, correlation


def _draws(rows: DataFrame, draws: int, first: int = 0) -> DataFrame:
    """One copy of a small dimension per draw, spread over the cluster by draw."""
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(first), F.lit(first + draws - 1)))).repartition("draw")


def moving_block_weights(sessions: DataFrame, draws: int, block: int, seed: int, first: int = 0) -> DataFrame:
    """(draw, session, weight): blocks of consecutive sessions, starts uniform on [0, n - block], cut to n."""
    size = sessions.agg(F.count(F.lit(1)).alias("n"))
    starts = _draws(size, draws, first).withColumn("slot", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    start = counter_draw(seed, F.lit("block"), "draw", "slot") % F.greatest(F.lit(1), F.col("n") - block + 1)
    steps = starts.withColumn("start", start).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    inside = steps.where((F.col("slot") * block + F.col("step") < F.col("n")) & (F.col("start") + F.col("step") < F.col("n")))
    return inside.groupBy("draw", (F.col("start") + F.col("step")).cast("int").alias("session")).agg(F.count(F.lit(1)).alias("weight"))


def year_block_weights(sessions: DataFrame, draws: int, block: int, seed: int, first: int = 0) -> DataFrame:
    """(draw, session, weight): circular blocks inside each calendar year, cut to the year's length."""
    years = sessions.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min("session").alias("base"))
    starts = _draws(years, draws, first).withColumn("slot", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    start = counter_draw(seed, F.lit("year"), "draw", "year", "slot") % F.col("n")
    steps = starts.withColumn("start", start).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    inside = steps.where(F.col("slot") * block + F.col("step") < F.col("n"))
    place = (F.col("base") + (F.col("start") + F.col("step")) % F.col("n")).cast("int")
    return inside.groupBy("draw", place.alias("session")).agg(F.count(F.lit(1)).alias("weight"))


def cluster_weights(clusters: DataFrame, key: str, draws: int, seed: int, first: int = 0) -> DataFrame:
    """(draw, key, weight): clusters drawn with replacement, as many as there are."""
    numbered = clusters.select(key).distinct().withColumn("place", F.row_number().over(W.orderBy(key)) - 1)
    size = numbered.agg(F.count(F.lit(1)).alias("n"))
    picks = _draws(size, draws, first).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    place = (counter_draw(seed, F.lit("cluster"), "draw", "slot") % F.col("n")).cast("int")
    counts = picks.groupBy("draw", place.alias("place")).agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(numbered, "place").select("draw", key, "weight")


def joint_weights(cells: DataFrame, clusters: DataFrame, calendar: DataFrame, key: str) -> DataFrame:
    """Product weights for the (cluster, session) cells that exist; both factors carry shared shocks."""
    c = clusters.withColumnRenamed("weight", "cluster_weight")
    d = calendar.withColumnRenamed("weight", "session_weight")
    return cells.join(c, key).join(d, ["draw", "session"]).withColumn("weight", F.col("cluster_weight") * F.col("session_weight"))


def weighted_correlations(date_moments: DataFrame, weights: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Correlation of every cell under every draw, from moments by session."""
    joined = date_moments.join(weights, "session")
    sums = joined.groupBy(*cell, "draw").agg(*[F.sum(F.col("weight") * F.col(m)).alias(m) for m in MOMENTS])
    return sums.select(*cell, "draw", correlation().alias("estimate"))


def block_correlations(date_moments: DataFrame, sessions: DataFrame, cell: Sequence[str], draws: int, block: int, seed: int, first: int = 0) -> DataFrame:
    """What `weighted_correlations` gives under `moving_block_weights`, for thousands of draws.

    A draw is a list of block starts, and a block's moments are the same in every draw, so they are summed once for every start. Draws then meet one row a
    block instead of one a session: `block` times fewer, and nothing is expanded to sessions. The last block is cut, so its sums are kept as well.
    """
    n = sessions.agg(F.count(F.lit(1)).cast("int")).scalar()
    slots = F.ceil(n / block).cast("int")
    grid = date_moments.select(*cell).distinct().withColumn("session", F.explode(F.sequence(F.lit(0), n - 1)))
    dense = grid.join(date_moments, [*cell, "session"], "left").withColumns({m: F.coalesce(m, F.lit(0)) for m in MOMENTS})
    within = W.partitionBy(*cell).orderBy("session")
    # A cell's sessions are the calendar. The cut block is added up from the days of its start.
    sums = dense.withColumns({f"{m}_block": F.sum(m).over(within.rowsBetween(0, block - 1)) for m in MOMENTS}).withColumns({f"{m}_days": F.collect_list(m).over(within.rowsBetween(0, block - 1)) for m in MOMENTS})
    last = (n - (slots - 1) * block).cast("int")
    sums = sums.withColumn("_last", last)
    cut = {f"{m}_cut": F.aggregate(F.slice(f"{m}_days", F.lit(1), F.col("_last")), F.lit(0.0), lambda a, x: a + x) for m in MOMENTS}
    sums = sums.withColumns(cut).select(*cell, F.col("session").alias("start"), *[f"{m}_{k}" for m in MOMENTS for k in ("block", "cut")])
    size = sessions.agg(F.count(F.lit(1)).alias("n"))
    starts = _draws(size, draws, first).withColumn("slot", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    start = (counter_draw(seed, F.lit("block"), "draw", "slot") % F.greatest(F.lit(1), F.col("n") - block + 1)).cast("int")
    starts = starts.select("draw", start.alias("start"), (F.col("slot") == F.ceil(F.col("n") / block) - 1).alias("is_last"))
    met = starts.join(sums, "start")
    total = met.groupBy(*cell, "draw").agg(*[F.sum(F.when(F.col("is_last"), F.col(f"{m}_cut")).otherwise(F.col(f"{m}_block"))).alias(m) for m in MOMENTS])
    return total.select(*cell, "draw", correlation().alias("estimate"))


def weighted_means(sums: DataFrame, weights: DataFrame, cell: Sequence[str], on: Sequence[str], total: str, count: str) -> DataFrame:
    """Weighted mean of every cell under every draw, from (total, count) by the resampled unit."""
    joined = sums.join(weights, list(on))
    w = F.col("weight")
    return joined.groupBy(*cell, "draw").agg(F.try_divide(F.sum(w * F.col(total)), F.sum(w * F.col(count))).alias("estimate"))


def influence(legs: DataFrame, effect: str, role: str) -> DataFrame:
    """(effect, issuer, session, coef): centred by role, divided by the number of pairs."""
    by_role = legs.groupBy(effect, role).agg(F.avg("value").alias("centre"), F.count(F.lit(1)).alias("pairs"))
    centred = legs.join(by_role, [effect, role])
    return centred.groupBy(effect, "issuer", "session").agg(F.sum(F.col("sign") * (F.col("value") - F.col("centre")) / F.col("pairs")).alias("coef"))


def influence_draws(coefs: DataFrame, clusters: DataFrame, calendar: DataFrame, effect: str) -> DataFrame:
    """Centred draw of every effect: sum of (w_issuer * w_session - 1) * coef.

    Cells missing from a draw have weight zero, so the draw is the weighted sum
    of the present cells minus the plain sum of all of them.
    """
    plain = coefs.groupBy(effect).agg(F.sum("coef").alias("plain"))
    present = joint_weights(coefs, clusters, calendar, "issuer").groupBy(effect, "draw").agg(F.sum(F.col("weight") * F.col("coef")).alias("taken"))
    span = clusters.agg(F.sequence(F.min("draw"), F.max("draw"))).scalar()
    full = plain.withColumn("draw", F.explode(span))
    return full.join(present, [effect, "draw"], "left").select(effect, "draw", (F.coalesce("taken", F.lit(0.0)) - F.col("plain")).alias("estimate"))


def percentile_interval(draws: DataFrame, cell: Sequence[str], floor: int, alpha: float = 0.05) -> DataFrame:
    """Percentile interval per cell when enough draws are defined."""
    counted = draws.groupBy(*cell).agg(F.count(F.lit(1)).alias("draws"), F.count("estimate").alias("valid"),
                                       F.percentile("estimate", alpha / 2).alias("lo"), F.percentile("estimate", 1 - alpha / 2).alias("hi"))
    good = F.col("valid") >= floor
    return counted.select(*cell, "draws", "valid", F.when(good, F.col("lo")).alias("lower"), F.when(good, F.col("hi")).alias("upper"),
                          F.when(good, "measured").otherwise("inconclusive").alias("status"))


def family_interval(draws: DataFrame, cell: Sequence[str], family: int, tail_draws: int = 20, alpha: float = 0.05) -> DataFrame:
    """Bonferroni interval, given only when the tail holds enough draws to resolve it."""
    half = alpha / family / 2
    counted = draws.groupBy(*cell).agg(F.count("estimate").alias("valid"), F.percentile("estimate", half).alias("lo"),
                                       F.percentile("estimate", 1 - half).alias("hi"))
    good = F.col("valid") * F.lit(half) >= tail_draws
    return counted.select(*cell, "valid", F.when(good, F.col("lo")).alias("lower"), F.when(good, F.col("hi")).alias("upper"),
                          F.when(good, "resolved").otherwise("unresolved_tail").alias("status"))


def studentized(observed: DataFrame, draws: DataFrame, effect: str) -> tuple[DataFrame, DataFrame]:
    """Absolute t of the estimate and of every centred draw, for effects with a usable error."""
    errors = draws.groupBy(effect).agg(F.stddev_samp("estimate").alias("se"), F.count("estimate").alias("valid"), F.count(F.lit(1)).alias("all"))
    good = observed.join(errors, effect).where((F.col("se") > 1e-12) & (F.col("valid") == F.col("all")))
    t_obs = good.select(effect, F.col("estimate").alias("point"), "se", F.abs(F.col("estimate") / F.col("se")).alias("t"))
    t_draw = draws.join(t_obs, effect).select(effect, "draw", F.abs(F.col("estimate") / F.col("se")).alias("td"), "t")
    return t_obs, t_draw


def step_down(t_obs: DataFrame, t_draw: DataFrame, effect: str, by: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p: each effect against the maximum over itself and all weaker ones.

    One window per draw gives the running maxima; a draw holds one value per
    effect of its family, never the whole matrix.
    """
    within = W.partitionBy(*by, "draw").orderBy("t", effect).rowsBetween(W.unboundedPreceding, 0)
    beaten = t_draw.withColumn("peak", F.max("td").over(within)).groupBy(*by, effect).agg(
        ((1 + F.count_if(F.col("peak") >= F.col("t"))) / (1 + F.count(F.lit(1)))).alias("raw_p"))
    ranked = t_obs.join(beaten, [*by, effect])
    order = W.partitionBy(*by).orderBy(F.desc("t"), F.desc(effect)).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("p_adjusted", F.max("raw_p").over(order))


def simultaneous_bounds(t_obs: DataFrame, t_draw: DataFrame, effect: str, alpha: float = 0.05) -> DataFrame:
    """Bounds from the upper quantile of the largest |t| per draw, taken at an actual order statistic."""
    peaks = t_draw.groupBy("draw").agg(F.max("td").alias("peak"))
    placed = peaks.withColumns({"place": F.row_number().over(W.orderBy("peak")) - 1, "n": F.count(F.lit(1)).over(W.partitionBy())})
    critical = placed.where(F.col("place") == F.ceil((F.col("n") - 1) * F.lit(1 - alpha))).agg(F.max("peak")).scalar()
    return t_obs.withColumn("critical", critical).withColumns({
        "lower": F.col("point") - F.col("critical") * F.col("se"), "upper": F.col("point") + F.col("critical") * F.col("se")})


def permuted_labels(rows: DataFrame, groups: Sequence[str], label: str, key: str, replicas: int, seed: int) -> DataFrame:
    """Labels shuffled inside each group, once per replica: the same multiset, in hash order."""
    copies = rows.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    w = W.partitionBy("replica", *groups)
    fixed = copies.withColumn("_slot", F.row_number().over(w.orderBy(key)))
    mixed = copies.select("replica", *groups, F.col(label).alias("permuted"), F.row_number().over(
        w.orderBy(counter_draw(seed, F.lit("permute"), "replica", key), key)).alias("_slot"))
    return fixed.join(mixed, ["replica", *groups, "_slot"]).drop("_slot")
