"""Settlement of held positions: one ordered fold over the sessions of every record.

A record meets at most horizon + retries + 1 sessions, so its days are one short sorted array, and one pass over it carries what a holder carries:
shares, cash received, the last marks, the lowest return on the way. A day's corporate actions come in one row per (ticker, session). Its
dividends are tried one by one in their order, the first one worth more than the option's time value calls the position away. Only a dividend that is larger than all
before it can be the first for any time value, so the row keeps those and what had been paid before each: a short list, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.options import OPTION_FEE, OPTION_FRICTION, RETRIES, STOCK_FRICTION

SHARES = 100.0

# Why a record ends.
SPLIT_UNKNOWN, SPLIT_DELIVERABLE, SPLIT_FRACTION = "unknown_share_split_ratio", "adjusted_option_deliverable_unknown", "fractional_share_cash_in_lieu_unknown"
DIVIDEND_UNSUPPORTED, ASSIGNED, EXPIRY_MISSING = "unsupported_dividend_cashflow", "modelled_early_assignment", "missing_expiry_stock"
EXERCISED, WORTHLESS, SCHEDULED, UNFILLED = "modelled_physical_expiry", "expiry_worthless", "scheduled_exit", "unfilled_exit_after_retries"


def action_days(dividends: DataFrame, splits: DataFrame) -> DataFrame:
    """One row per (ticker, session): cash, steps, unsupported, factor, ratio_known.

    dividends: (ticker, session, accession, declared, previous_date, cash, currency), splits: (ticker, session, split_to, split_from). A step is a
    dividend that was announced before the session and is larger than every announced one before it: (cash, what was paid before).
    """
    usd = F.when(F.col("currency") == "USD", F.col("cash"))
    before = W.partitionBy("ticker", "session").orderBy("accession").rowsBetween(W.unboundedPreceding, -1)
    announced = F.when(F.col("declared") <= F.col("previous_date"), usd)
    rows = dividends.withColumns({"paid": F.coalesce(F.sum(usd).over(before), F.lit(0.0)), "largest": F.coalesce(F.max(announced).over(before), F.lit(0.0)), "own": announced})
    step = F.when(F.col("own") > F.col("largest"), F.struct(F.col("accession"), F.col("own").alias("cash"), F.col("paid").alias("before")))
    cash = rows.groupBy("ticker", "session").agg(F.sum(usd).alias("cash"), F.bool_or(F.col("currency") != "USD").alias("unsupported"), F.array_sort(F.collect_list(step)).alias("steps"))
    good = (F.col("split_to") > 0) & (F.col("split_from") > 0)
    factors = splits.groupBy("ticker", "session").agg(F.product(F.when(good, F.col("split_to") / F.col("split_from")).otherwise(F.lit(1.0))).alias("factor"), F.bool_and(good).alias("ratio_known"))
    return cash.join(factors, ["ticker", "session"], "full")


def costs(shares: Column, stock: Column, option: Column, multiplier: Column, has_option: Column) -> Column:
    return multiplier * (shares * stock * STOCK_FRICTION + F.when(has_option, 100 * option * OPTION_FRICTION + OPTION_FEE).otherwise(0.0))


def paths(records: DataFrame, marks: DataFrame, actions: DataFrame, retries: int = RETRIES) -> DataFrame:
    """One row per record and session from entry to the last retry, with that session's marks and actions."""
    last = F.col("entry_session") + F.col("horizon") + retries
    rows = records.withColumn("session", F.explode(F.sequence(F.col("entry_session"), last)))
    return rows.join(marks, ["ticker", "session"]).join(actions, ["ticker", "session"], "left")


def settle(walked: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every record's end: exit_session, exit_reason, stock_exit, option_exit, shares_exit, dividends, lowest, mark_gaps, opening, closing.

    Order within a session: split, unsupported dividend, early assignment or receipt, expiry, scheduled exit, mark. A record whose end is not known has no
    prices. walked holds the record's columns, session, stock, option and the action columns.
    """
    fixed = ["entry_session", "horizon", "sign", "style", "strike", "expiry_session", "stock_only", "stock_entry", "option_entry", "cost_multiplier"]
    day = F.struct("session", "stock", "option", F.coalesce("cash", F.lit(0.0)).alias("cash"), F.coalesce("unsupported", F.lit(False)).alias("unsupported"),
                   F.coalesce("steps", F.array().cast("array<struct<accession:bigint,cash:double,before:double>>")).alias("steps"), "factor", "ratio_known")
    held = walked.groupBy(*key).agg(*[F.first(c).alias(c) for c in fixed if c not in key], F.array_sort(F.collect_list(day)).alias("days"))
    option_held = ~F.col("stock_only")
    target = F.col("entry_session") + F.col("horizon")
    opening = costs(F.lit(SHARES), F.col("stock_entry"), F.col("option_entry"), F.col("cost_multiplier"), option_held)
    nothing = F.lit(None).cast("double")

    def end(why: Column | str, stock: Column, option: Column) -> Column:
        return F.struct((F.lit(why) if isinstance(why, str) else why).alias("why"), stock.alias("s"), option.alias("o"))

    def step(state: Column, d: Column) -> Column:
        live = state["why"].isNull() & (d["session"] > F.col("entry_session"))
        split = d["factor"].isNotNull()
        shares = F.when(live & split & d["ratio_known"], state["shares"] * d["factor"]).otherwise(state["shares"])
        broken = F.abs(shares - F.round(shares)) > 1e-9
        split_why = F.when(split, F.when(~d["ratio_known"], SPLIT_UNKNOWN).when(option_held, SPLIT_DELIVERABLE).when(broken, SPLIT_FRACTION))
        callable_ = option_held & (F.col("sign") == -1) & (F.col("style") == "american") & (state["stock"] > F.col("strike"))
        value = state["option"] - (state["stock"] - F.col("strike"))
        call = F.when(callable_ & value.isNotNull(), F.get(F.filter(d["steps"], lambda x: x["cash"] > value), F.lit(0)))
        received = state["received"] + F.when(live & split_why.isNull() & ~d["unsupported"], shares * F.when(call.isNotNull(), call["before"]).otherwise(d["cash"])).otherwise(0.0)
        at_expiry = option_held & (d["session"] >= F.col("expiry_session"))
        in_money = F.when(F.col("sign") == -1, d["stock"] > F.col("strike")).otherwise(d["stock"] < F.col("strike"))
        traded = d["stock"].isNotNull() & (F.col("stock_only") | d["option"].isNotNull())
        found = (F.when(split_why.isNotNull(), end(split_why, nothing, nothing))
                 .when(d["unsupported"], end(DIVIDEND_UNSUPPORTED, nothing, nothing))
                 .when(call.isNotNull(), end(ASSIGNED, F.col("strike"), F.lit(0.0)))
                 .when(at_expiry & d["stock"].isNull(), end(EXPIRY_MISSING, nothing, nothing))
                 .when(at_expiry, end(F.when(in_money, EXERCISED).otherwise(WORTHLESS), F.when(in_money, F.col("strike")).otherwise(d["stock"]), F.lit(0.0)))
                 .when((d["session"] >= target) & traded, end(SCHEDULED, d["stock"], F.when(F.col("stock_only"), 0.0).otherwise(d["option"]))))
        ended = F.when(live, found)
        stock = F.coalesce(d["stock"], state["stock"])
        option = F.when(F.col("stock_only"), 0.0).otherwise(F.coalesce(d["option"], state["option"]))
        marked = state["why"].isNull() & ended["why"].isNull()
        net = (shares * stock - SHARES * F.col("stock_entry") + F.when(F.col("stock_only"), 0.0).otherwise(F.col("sign") * 100 * (option - F.col("option_entry"))) + received
               - opening - costs(shares, stock, option, F.col("cost_multiplier"), option_held)) / (SHARES * F.col("stock_entry"))
        return F.struct(
            d["stock"].alias("stock"), d["option"].alias("option"), shares.alias("shares"), received.alias("received"),
            F.when(marked, F.least(state["lowest"], net)).otherwise(state["lowest"]).alias("lowest"),
            (state["gaps"] + (marked & net.isNull()).cast("long")).alias("gaps"),
            F.coalesce(state["exit"], F.when(ended["why"].isNotNull(), d["session"])).alias("exit"),
            F.coalesce(state["why"], ended["why"]).alias("why"), F.coalesce(state["s"], ended["s"]).alias("s"), F.coalesce(state["o"], ended["o"]).alias("o"))

    first = F.struct(nothing.alias("stock"), nothing.alias("option"), F.lit(SHARES).alias("shares"), F.lit(0.0).alias("received"), nothing.alias("lowest"),
                     F.lit(0).cast("long").alias("gaps"), F.lit(None).cast("int").alias("exit"), F.lit(None).cast("string").alias("why"), nothing.alias("s"), nothing.alias("o"))
    done = held.withColumn("x", F.aggregate("days", first, step))
    closing = costs(F.col("x.shares"), F.col("x.s"), F.col("x.o"), F.col("cost_multiplier"), option_held)
    return done.select(*key, F.col("x.exit").alias("exit_session"), F.coalesce("x.why", F.lit(UNFILLED)).alias("exit_reason"), F.col("x.s").alias("stock_exit"), F.col("x.o").alias("option_exit"),
                       F.col("x.shares").alias("shares_exit"), F.col("x.received").alias("dividends"), F.col("x.lowest").alias("lowest"), F.col("x.gaps").alias("mark_gaps"),
                       opening.alias("opening"), closing.alias("closing"))


def outcomes(records: DataFrame, settled: DataFrame, key: Sequence[str]) -> DataFrame:
    """Status, profit parts, net return and downside of every record, also of those that never began."""
    out = records.join(settled, list(key), "left")
    status = F.when(F.col("ineligible").isNotNull(), F.col("ineligible")).when(F.col("stock_exit").isNotNull(), "completed").otherwise("initiated_unresolved")
    done = F.col("status") == "completed"
    stock_pnl = F.col("shares_exit") * F.col("stock_exit") - SHARES * F.col("stock_entry")
    option_pnl = F.when(F.col("stock_only"), 0.0).otherwise(F.col("sign") * 100 * (F.col("option_exit") - F.col("option_entry")))
    net = stock_pnl + option_pnl + F.col("dividends") - F.col("opening") - F.col("closing")
    target = F.col("entry_session") + F.col("horizon")
    early = (F.col("exit_session") < target) & (F.col("exit_reason") == ASSIGNED)
    out = out.withColumn("status", status).withColumns({"stock_pnl": F.when(done, stock_pnl), "option_pnl": F.when(done, option_pnl), "net_pnl": F.when(done, net)})
    out = out.withColumn("net_return", F.col("net_pnl") / (SHARES * F.col("stock_entry")))
    whole = F.coalesce(done & (F.col("mark_gaps") == 0), F.lit(False))
    aligned = F.coalesce(done & ((F.col("exit_session") == target) | early), F.lit(False))
    return out.withColumns({"path_complete": whole, "evaluation_aligned": aligned}).withColumn(
        "downside_loss", F.when(F.col("path_complete"), F.greatest(F.lit(0.0), -F.least("lowest", "net_return"))))
