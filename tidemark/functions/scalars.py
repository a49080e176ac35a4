"""Column helpers shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Division that is NULL, never an error, on a zero base."""
    return F.try_divide(col(top).cast("double"), col(bottom).cast("double"))


def rounded(value: Column | str, digits: int = 6) -> Column:
    return F.round(col(value).cast("double"), digits)


def big(value: Column | str) -> Column:
    return col(value).cast("bigint")


def flag(condition: Column) -> Column:
    """0/1 flag; an unknown condition counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def finite(value: Column | str) -> Column:
    """NaN and infinities become NULL (unknown), so they never reach a sum."""
    v = col(value)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Reason of the first rule that holds, NULL when none does."""
    chain = None
    for condition, text in rules:
        chain = F.when(condition, text) if chain is None else chain.when(condition, text)
    return chain


def status_of(reason: Column, good: str = "measured", bad: str = "inconclusive") -> Column:
    return F.when(reason.isNull(), good).otherwise(bad)


def counter_draw(*parts: Column | str | int) -> Column:
    """Counter-based random integer in [0, 2**32): depends only on its key."""
    keys = [F.lit(str(p)) if isinstance(p, int) else col(p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("bigint")


def uniform_draw(*parts: Column | str | int) -> Column:
    """Uniform double in (0, 1) from the same counter."""
    return (counter_draw(*parts) + 0.5) / F.lit(4294967296.0)


def row_identity(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the named columns, in name order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def clip(value: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(value)))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def no_nulls(*names: str) -> Column:
    return all_of([F.col(n).isNotNull() for n in names])
