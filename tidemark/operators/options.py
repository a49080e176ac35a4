"""Contract selection, option-implied measures, quote pairs and fixed-rule outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import first_reason, ratio
from tidemark.operators.joins import nearest_listed

# Maturity buckets (days: lowest, highest, target), rate, shapes and their signed legs, costs.
BUCKETS = {"short": (21, 45, 30), "middle": (46, 80, 60), "long": (90, 180, 120)}
RATE = 0.04
YEAR = 365.25
SHAPES = {"synthetic_long": {"atm_call": 1, "atm_put": -1}, "covered_call": {"atm_call": 1, "atm_put": -1, "upper_call": -1},
          "protective_put": {"atm_call": 1, "atm_put": -1, "lower_put": 1}, "cash_secured_put": {"lower_put": -1}}
STOCK_FRICTION, OPTION_FRICTION, OPTION_FEE = 0.0006, 0.05, 0.65
QUOTE_STOCK_FEE, QUOTE_STOCK_IMPACT, QUOTE_OPTION_IMPACT = 0.0001, 0.0001, 0.01
RETRIES = 5


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def in_term(anchors: DataFrame, listings: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Anchor x listing rows with shortest..longest days to expiry, joined on (ticker, expiry month)."""
    months = F.sequence(month_index(F.date_add("date", shortest)), month_index(F.date_add("date", longest)))
    left = anchors.withColumn("expiry_month", F.explode(months))
    right = listings.withColumn("expiry_month", month_index(F.col("expiry")))
    joined = left.join(right, ["ticker", "expiry_month"]).drop("expiry_month").withColumn("dte", F.datediff("expiry", "date"))
    return joined.where(F.col("dte").between(shortest, longest))


def pair_by_bucket(anchors: DataFrame, pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """One call/put pair per anchor and maturity bucket; an empty bucket keeps its row and reason.

    The expiry is chosen among a ticker's distinct ones, then the strike by order within that expiry.
    """
    expiries = pairs.select("ticker", "expiry").distinct()
    found = in_term(anchors, expiries, min(b[0] for b in BUCKETS.values()), max(b[1] for b in BUCKETS.values()))
    bucket, target = None, None
    for name, (low, high, goal) in BUCKETS.items():
        inside = F.col("dte").between(low, high)
        bucket = F.when(inside, name) if bucket is None else bucket.when(inside, name)
        target = F.when(inside, goal) if target is None else target.when(inside, goal)
    rows = found.withColumn("bucket", bucket).withColumn("target", target).where("bucket is not null")
    chosen = rows.groupBy(*key, "bucket").agg(F.first("spot").alias("spot"), F.min_by(F.struct("expiry", "dte"), F.struct(F.abs(F.col("dte") - F.col("target")).alias("a"), F.col("expiry"))).alias("e"))
    placed = nearest_listed(chosen.select(*key, "bucket", "spot", "e.*"), pairs, ["ticker", "expiry"], "spot", "strike", lambda row, near: F.abs(near["strike"] / row["spot"] - 1))
    best = placed.select(*key, "bucket", F.struct("expiry", "near.strike", "dte", "near.call", "near.put").alias("p"))
    planned = anchors.withColumn("bucket", F.explode(F.array(*[F.lit(b) for b in BUCKETS])))
    return planned.join(best, [*key, "bucket"], "left").select(*anchors.columns, "bucket", "p.*", F.when(F.col("p").isNull(), "no_pair_in_maturity_bucket").alias("reason"))


def nearest_leg(anchors: DataFrame, contracts: DataFrame, key: Sequence[str], side: str, moneyness: float, days: int, tolerance: float) -> DataFrame:
    """Expiry nearest to `days` first, then the strike nearest to spot * moneyness; rejected beyond the tolerance."""
    listed = contracts.where(F.col("contract_type") == side).groupBy("ticker", "expiry", "strike").agg(F.min(F.struct("contract", "style")).alias("c")).select("ticker", "expiry", "strike", "c.*")
    found = in_term(anchors, listed.select("ticker", "expiry").distinct(), 7, 90)
    chosen = found.groupBy(*key).agg(F.first("spot").alias("spot"), F.min_by(F.struct("expiry", "dte"), F.struct(F.abs(F.col("dte") - days).alias("a"), F.col("expiry"))).alias("e"))
    goals = chosen.select(*key, (F.col("spot") * moneyness).alias("goal"), "e.*")
    placed = nearest_listed(goals, listed, ["ticker", "expiry"], "goal", "strike", lambda row, near: F.abs(near["strike"] - row["goal"]))
    best = placed.select(*key, F.struct("near.contract", "expiry", "near.strike", "dte", "near.style").alias("p"))
    off = F.abs(F.col("p.strike") / (F.col("spot") * moneyness) - 1)
    reason = first_reason((F.col("p").isNull(), "no_contract_in_term"), (off > tolerance, "strike_outside_tolerance"))
    return anchors.join(best, list(key), "left").select(*anchors.columns, F.lit(side).alias("contract_type"), "p.*", reason.alias("reason"))


def parity_spot(strike: Column, dte: Column, call: Column, put: Column) -> Column:
    """Spot implied by put-call parity, NULL unless positive."""
    value = strike * F.exp(-RATE * dte / YEAR) + call - put
    return F.when(value > 0, value)


def implied_measures(spot: Column, strike: Column, dte: Column, call: Column, put: Column) -> list[Column]:
    premium = call + put
    return [ratio(premium, spot).alias("implied_move"), ratio(ratio(premium, spot), F.sqrt(dte / YEAR)).alias("uncertainty"),
            ratio(call - put, premium).alias("asymmetry"), (ratio(strike, spot) - 1).alias("moneyness")]


def net_value(positions: DataFrame, marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily value of a fixed position table: running cash plus quantity times mark; a held but unmarked day is NULL."""
    w = W.partitionBy(*keys).orderBy("session").rowsBetween(W.unboundedPreceding, 0)
    days = marks.join(positions, [*keys, "session"], "left")
    run = days.withColumns({"cash": F.sum(F.coalesce("cash_delta", F.lit(0.0))).over(w), "quantity": F.sum(F.coalesce("quantity_delta", F.lit(0))).over(w)})
    return run.withColumn("nav", F.when(F.col("quantity") == 0, F.col("cash")).otherwise(F.col("cash") + F.col("quantity") * F.col("mark")))


def performance(nav: DataFrame, keys: Sequence[str], initial: float | str, rate: float) -> DataFrame:
    """Annualized return, volatility, Sharpe and drawdown; one missing value blocks the metrics of its key.

    `initial` is a number, or the name of a column that holds the key's starting value; a missing starting value blocks its key.
    """
    w = W.partitionBy(*keys).orderBy("session")
    nav = nav.withColumn("start", F.col(initial) if isinstance(initial, str) else F.lit(initial))
    before = F.lag("nav").over(w)
    rows = nav.withColumn("previous", F.when(F.row_number().over(w) == 1, F.col("start")).otherwise(before))
    days = F.coalesce(F.datediff("date", F.lag("date").over(w)), F.lit(0))
    rows = rows.withColumns({"ret": ratio("nav", "previous") - 1, "rf": F.exp(rate * days / YEAR) - 1,
                             "peak": F.greatest("start", F.max("nav").over(w.rowsBetween(W.unboundedPreceding, 0)))})
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("nav").isNull() | F.col("start").isNull()).alias("gaps"), F.max_by("nav", "session").alias("last"), F.max("start").alias("start"),
                                F.stddev_samp("ret").alias("sd"), F.avg(F.col("ret") - F.col("rf")).alias("excess"), F.stddev_samp(F.col("ret") - F.col("rf")).alias("xsd"),
                                F.min(F.col("nav") / F.col("peak") - 1).alias("dd"))
    good = F.col("gaps") == 0
    return g.select(*keys, "observations", F.when(good, "measured").otherwise("inconclusive").alias("status"),
                    F.when(good, F.pow(F.col("last") / F.col("start"), F.lit(252.0) / F.col("observations")) - 1).alias("annualized_return"),
                    F.when(good, F.col("sd") * F.sqrt(F.lit(252.0))).alias("annualized_volatility"),
                    F.when(good & (F.col("xsd") > 1e-15), F.col("excess") / F.col("xsd") * F.sqrt(F.lit(252.0))).alias("sharpe"),
                    F.when(good, F.least(F.lit(0.0), F.col("dd"))).alias("max_drawdown"))
