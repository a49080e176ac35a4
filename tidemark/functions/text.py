"""Text helpers built from native string and array functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Clause rules and term lists.
CLAUSE_BREAK = r"(?<=[.!?;])\s+"
DEBT_WORDS = r"(?i)\b(notes?|bonds?|debentures?|debt|senior secured|senior unsecured)\b"
COMPLETION_WORDS = r"(?i)\b(completed|closed|consummated|issued|sold)\b"
RECEIPT_WORDS = r"(?i)\b(received|receipt|raised|funded)\b"
FUNDS_WORDS = r"(?i)\b(proceeds|funding|financing)\b"
CONDITIONAL_WORDS = r"(?i)\b(will|expects?|intends?|plans?|proposed|if|not|no|never)\b|subject to|upon completion"
PAY_WORDS = r"(?i)salary|compensation|equity award|incentive"


def identifier(value: Column) -> Column:
    """Digits left-padded to ten characters, NULL for anything else."""
    trimmed = F.trim(value)
    return F.when(trimmed.rlike("^[0-9]+$"), F.lpad(trimmed, 10, "0"))


def squeezed(value: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def normalized(value: Column) -> Column:
    return F.lower(squeezed(value))


def _percent(value: float | None) -> str | None:
    if value is None:
        return None
    if not math.isfinite(value):
        return f"{value}%"
    return f"{math.copysign(math.floor(abs(value) * 1e6 + 0.5) / 1e6, value):.2f}%"


def percent(value: Column) -> Column:
    """A double, rounded to six decimals, as a percentage with two: by its exact binary value, a half to the even digit, and with the sign of a negative zero.

    Spark's own format rounds the shortest decimal form half up, and its round drops the sign.
    """
    return F.udf(_percent, StringType())(value)


def clauses(value: Column) -> Column:
    return F.split(value, CLAUSE_BREAK)


def combinations(items: Column, length: int, joiner: str = "&") -> Column:
    """Sorted k-combinations of a sorted array, joined to strings; no shuffle needed."""
    state = F.transform(items, lambda x, i: F.struct(x.alias("text"), i.alias("last")))
    for _ in range(length - 1):
        state = F.flatten(F.transform(state, lambda s: F.transform(
            F.filter(F.transform(items, lambda x, i: F.struct(x.alias("text"), i.alias("last"))), lambda n: n["last"] > s["last"]),
            lambda n: F.struct(F.concat(s["text"], F.lit(joiner), n["text"]).alias("text"), n["last"].alias("last")))))
    return F.transform(state, lambda s: s["text"])


def financing_status(rows: DataFrame, excerpt: str) -> DataFrame:
    """Add status and evidence: completed only with an explicit receipt in the same or a neighbouring clause.

    Every step is its own column, so a clause meets each pattern once.
    """
    clean = squeezed(F.col(excerpt))
    marked = rows.withColumn("_clean", clean).withColumn("_parts", clauses(F.col("_clean"))).withColumn("_marks", F.transform("_parts", lambda c: F.struct(
        (~c.rlike(CONDITIONAL_WORDS)).alias("plain"), (c.rlike(DEBT_WORDS) & c.rlike(COMPLETION_WORDS)).alias("deal"),
        (c.rlike(RECEIPT_WORDS) & c.rlike(FUNDS_WORDS)).alias("receipt"))))
    roles = marked.withColumn("_deals", F.array_compact(F.transform("_marks", lambda m, i: F.when(m["plain"] & m["deal"], i)))).withColumn(
        "_receipts", F.array_compact(F.transform("_marks", lambda m, i: F.when(m["plain"] & m["receipt"], i))))

    def has(i: Column) -> Column:
        return F.array_contains(F.col("_receipts"), i)

    near = F.transform("_deals", lambda d: F.when(has(d), F.struct(d.alias("a"), d.alias("b"))).when(has(d - 1), F.struct(d.alias("a"), (d - 1).alias("b")))
                       .when(has(d + 1), F.struct(d.alias("a"), (d + 1).alias("b"))))
    found = roles.withColumn("_proof", F.get(F.array_compact(near), F.lit(0)))
    here, there = F.get("_parts", F.col("_proof.a")), F.get("_parts", F.col("_proof.b"))
    missing = F.col(excerpt).isNull() | (F.col("_clean") == "")
    planned = F.col("_clean").rlike(CONDITIONAL_WORDS) & F.col("_clean").rlike(DEBT_WORDS)
    proven = F.col("_proof").isNotNull()
    status = F.when(missing, "unknown").when(proven, "completed").when(F.size("_deals") > 0, "unknown").when(planned, "planned").otherwise("unknown")
    evidence = (F.when(missing, "missing_excerpt").when(proven & (F.col("_proof.a") == F.col("_proof.b")), here).when(proven, F.concat_ws(" ", here, there))
                .when(F.size("_deals") > 0, "completion_without_explicit_receipt_wording").when(planned, "no_unqualified_completion_and_receipt")
                .otherwise("insufficient_affirmative_completion_and_receipt"))
    return found.withColumns({"status": status, "evidence": evidence}).drop("_clean", "_parts", "_marks", "_deals", "_receipts", "_proof")
