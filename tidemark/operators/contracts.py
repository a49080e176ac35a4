"""Legs of contracts with marks and quotes of their own.

A leg is a contract, and its mark is that contract's last one within an age, not its ticker's. Requests and marks meet by (contract, block of
sessions), a block as long as the age: a mark stands in its own block and the next one, so a request finds all that may count in its block alone, and a
contract however busy is split over time. Strikes near a goal are found by order, listed strikes and goals in one sorted pass, never by
holding every anchor against every contract.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.options import OPTION_FEE


def latest(requests: DataFrame, marks: DataFrame, age: int, fields: Sequence[str]) -> DataFrame:
    """requests (.., contract, session) plus `mark`, the contract's last row in [session - age, session] as (session, fields), or null."""
    size = age + 1
    asked = requests.select("contract", "session").distinct().withColumn("block", F.floor(F.col("session") / size))
    kept = marks.select("contract", F.struct(F.col("session").alias("session"), *fields).alias("m"))
    kept = kept.withColumn("block", F.explode(F.array(F.floor(F.col("m.session") / size), F.floor(F.col("m.session") / size) + 1)))
    met = asked.join(kept, ["contract", "block"]).where(F.col("m.session").between(F.col("session") - age, F.col("session")))
    best = met.groupBy("contract", "session").agg(F.max("m").alias("mark"))
    return requests.join(best, ["contract", "session"], "left")


def expand(selections: DataFrame, shapes: dict[str, dict[str, int]]) -> DataFrame:
    """Rows of every shape and leg: selections hold `legs`, a map of leg name to (contract, strike)."""
    grid = F.array(*[F.struct(F.lit(s).alias("shape"), F.lit(n).alias("leg"), F.lit(q).alias("sign")) for s, legs in shapes.items() for n, q in legs.items()])
    rows = selections.withColumn("g", F.explode(grid)).select("*", "g.*").drop("g")
    return rows.withColumn("l", F.element_at("legs", F.col("leg"))).select(*[c for c in rows.columns if c != "legs"], "l.contract", F.col("l.strike").alias("leg_strike"))


def leg_cash(sign: Column, bid: Column, ask: Column, costs: Column, opening: bool = True) -> Column:
    """Cash of one leg of a transaction: friction counted once, on the side that is traded."""
    quantity = sign if opening else -sign
    mid, half = (bid + ask) / 2, (ask - bid) / 2
    return -quantity * 100 * (mid + F.signum(quantity) * half * costs) - F.abs(sign) * OPTION_FEE * costs
