"""Input contracts, support gates and eligibility reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite, first_reason, no_nulls, status_of

# Support floors of the studies.
MIN_ROWS, MIN_POSITIVE, MIN_ISSUERS = 60, 8, 3
THIN_ROWS = "Too few rows or no feature/target variation"
THIN_SUPPORT = "Insufficient event/issuer support"


def contract_violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) for every rule, zero counts included, from one aggregate."""
    grouped = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), *[F.count_if(c).alias(n) for n, c in rules.items()])
    total = grouped.agg(F.sum(F.col("copies") - 1).alias("duplicate_key"),
                        *[F.sum(n).alias(n) for n in rules])
    pairs = ", ".join(f"'{n}', {n}" for n in ["duplicate_key", *rules])
    return total.selectExpr(f"stack({len(rules) + 1}, {pairs}) as (rule, violations)")


def complete_cases(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where every named column is known; NaN counts as unknown."""
    doubles = {n for n, t in rows.dtypes if t in ("double", "float")}
    return rows.withColumns({c: finite(c) for c in columns if c in doubles}).where(no_nulls(*columns))


def support_columns(x: str, y: str, date: str = "date", issuer: str = "issuer") -> list[Column]:
    """Aggregates behind the support gate. Minimum and maximum tell whether a column varies."""
    event = F.col(x) != 0
    return [F.count(F.lit(1)).alias("rows"), F.count_distinct(date).alias("dates"),
            F.count_distinct(issuer).alias("issuers"), F.count_if(event).alias("positive_rows"),
            F.count_distinct(F.when(event, F.col(issuer))).alias("positive_issuers"),
            F.count_distinct(F.when(event, F.col(date))).alias("positive_dates"),
            (F.min(x) < F.max(x)).alias("x_varies"), (F.min(y) < F.max(y)).alias("y_varies")]


def support_gate(cells: DataFrame, min_rows: int = MIN_ROWS, min_positive: int = MIN_POSITIVE,
                 min_issuers: int = MIN_ISSUERS) -> DataFrame:
    """Status and reason of every cell; thin cells stay in the result."""
    flat = ~(F.col("x_varies") & F.col("y_varies"))
    reason = first_reason(
        ((F.col("rows") < min_rows) | F.coalesce(flat, F.lit(True)), THIN_ROWS),
        ((F.col("positive_rows") < min_positive) | (F.col("positive_issuers") < min_issuers), THIN_SUPPORT))
    return cells.withColumn("reason", reason).withColumn("status", status_of(F.col("reason"))).drop("x_varies", "y_varies")


def standard_contract(day: str) -> Column:
    """Reason a contract is not a standard one; NULL for an accepted contract."""
    return first_reason(
        (F.col("shares") != 100, "nonstandard_share_count"), (F.col("extra"), "additional_deliverable"),
        (~F.col("style").isin("american", "european"), "unknown_exercise_style"),
        (~F.col("contract_type").isin("call", "put"), "unknown_contract_type"),
        (F.col("expiry") <= F.col(day), "expired"))


def quote_reason(max_spread: float, min_size: float) -> Column:
    """Reason a quote is not usable; NULL for an accepted quote."""
    mid = (F.col("bid") + F.col("ask")) / 2
    return first_reason(
        ((F.col("bid") <= 0) | (F.col("ask") < F.col("bid")), "nonpositive_or_crossed_quote"),
        ((F.col("ask") - F.col("bid")) > max_spread * mid, "relative_spread_above_cap"),
        ((F.col("bid_size") < min_size) | (F.col("ask_size") < min_size), "insufficient_displayed_size"))


def liquidity_reason(option_volume: str, stock_volume: str, min_option: float, min_stock: float, last: int = -1,
                     keys: tuple[str, ...] = ("ticker",)) -> Column:
    """Eligibility from the five sessions ending `last` rows away; the row itself never enters."""
    frame = W.partitionBy(*keys).orderBy("session").rowsBetween(last - 4, last)
    known = F.count(F.when(no_nulls(option_volume, stock_volume), 1)).over(frame)
    return first_reason((known != 5, "incomplete_prior_liquidity"),
                        (F.sum(option_volume).over(frame) < min_option, "thin_prior_option_volume"),
                        (F.avg(stock_volume).over(frame) < min_stock, "thin_prior_stock_volume"))


def taxonomy_check(rows: DataFrame, taxonomy: DataFrame, label: str, parent: str) -> DataFrame:
    """Count unknown labels and labels whose stated parent differs from the taxonomy."""
    known = taxonomy.select(F.col(label), F.col(parent).alias("expected"))
    counted = rows.groupBy(label, parent).agg(F.count(F.lit(1)).alias("rows"))
    joined = counted.join(known, label, "left")
    problem = first_reason((F.col("expected").isNull(), "unknown_label"),
                           (F.col("expected") != F.col(parent), "parent_mismatch"))
    return joined.select(label, parent, "rows", F.coalesce(problem, F.lit("valid")).alias("result"))


def earlier_maximum(rows: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Largest earlier value per key in arrival order, cut in buckets so that a hot key splits.

    Inside a bucket a window does it; the maxima of earlier buckets are carried over.
    """
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    peaks = rows.groupBy(*keys, bucket).agg(F.max(value).alias("_peak"))
    carried = peaks.select(*keys, bucket, F.max("_peak").over(
        W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    local = rows.withColumn("_local", F.max(value).over(inside))
    return local.join(carried, [*keys, bucket]).withColumn(name, F.greatest("_local", "_carried")).drop("_local", "_carried")


def criteria_flags(lower: str, lowest: str, highest: str, tail: str, estimate: str) -> list[Column]:
    """Registered pass criteria; an unknown input leaves the flag false."""
    def known(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")
    return [known(F.col(lower) > 0).alias("interval_above_zero"),
            known(F.signum(lowest) == F.signum(highest)).alias("leave_one_sign_stable"),
            known(F.col(tail) >= 0).alias("tail_not_worse"),
            known((F.col(estimate) > 0) & (F.col(lower) > 0) & (F.col(tail) >= 0)).alias("passes")]
