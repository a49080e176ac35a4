"""Chronological folds, ridge forecasts and paired losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import linear as L

# Fold cuts as shares of the ordered dates, inner validation share, penalties.
CUTS = [0.4, 0.6, 0.8]
INNER_SHARE = 0.8
ALPHAS = [0.1, 1.0, 10.0]


def numbered_dates(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct dates with their place and count; a calendar-sized table."""
    days = rows.select(*keys, "date").distinct()
    w = W.partitionBy(*keys)
    return days.select(*keys, "date", (F.row_number().over(w.orderBy("date")) - 1).alias("place"), F.count(F.lit(1)).over(w).alias("dates"))


def fold_bounds(rows: DataFrame) -> DataFrame:
    """(fold, start, stop): expanding folds at fixed shares of the ordered dates."""
    days = numbered_dates(rows)
    cuts = [F.max(F.when(F.col("place") == F.floor(F.col("dates") * F.lit(c)), F.col("date"))) for c in CUTS]
    ends = [*cuts[1:], F.lit("9999-12-31").cast("date")]
    folds = F.array(*[F.struct(F.lit(i).alias("fold"), a.alias("start"), b.alias("stop")) for i, (a, b) in enumerate(zip(cuts, ends))])
    return days.agg(folds.alias("folds")).select(F.explode("folds").alias("f")).select("f.*")


def assign_folds(rows: DataFrame, bounds: DataFrame, target_end: str) -> DataFrame:
    """One row per panel row and fold it takes part in; training outcomes end before the fold starts."""
    folds = bounds.agg(F.collect_list(F.struct("fold", "start", "stop"))).scalar()
    spread = rows.withColumn("f", F.explode(folds)).select("*", "f.*").drop("f")
    part = F.when((F.col("date") < F.col("start")) & (F.col(target_end) < F.col("start")), "train").when(
        (F.col("date") >= F.col("start")) & (F.col("date") < F.col("stop")), "valid")
    return spread.withColumn("part", part).where(F.col("part").isNotNull())


def assign_years(rows: DataFrame, years: Sequence[int], target_end: str) -> DataFrame:
    """Calendar-year outer folds: train before the year with matured outcomes, test inside it."""
    spread = rows.withColumn("fold_year", F.explode(F.array(*[F.lit(y) for y in years])))
    start, stop = F.make_date("fold_year", F.lit(1), F.lit(1)), F.make_date(F.col("fold_year") + 1, F.lit(1), F.lit(1))
    part = F.when((F.col("date") < start) & (F.col(target_end) < start), "train").when((F.col("date") >= start) & (F.col("date") < stop), "test")
    return spread.withColumn("part", part).where(F.col("part").isNotNull())


def inner_parts(train: DataFrame, keys: Sequence[str], target_end: str, minimum: int = 60) -> DataFrame:
    """Inner split of the training rows at 80 % of their dates, purged like the outer one."""
    days = numbered_dates(train, keys)
    edge = days.where((F.col("place") == F.floor(F.col("dates") * F.lit(INNER_SHARE))) & (F.col("dates") >= minimum)).select(*keys, F.col("date").alias("boundary"))
    rows = train.join(F.broadcast(edge), list(keys))
    inner = F.when((F.col("date") < F.col("boundary")) & (F.col(target_end) < F.col("boundary")), "inner_train").when(F.col("date") >= F.col("boundary"), "inner_test")
    return rows.withColumn("inner", inner).where(F.col("inner").isNotNull())


def ridge_losses(rows: DataFrame, keys: Sequence[str], regressors: Sequence[str], outcome: str, alphas: Sequence[float], train: str, test: str, part: str = "part",
                 carry: Sequence[str] = ()) -> DataFrame:
    """Squared errors of the test rows per penalty; fitted on the training rows of the same key."""
    fitted = L.ridge(L.products(rows.where(F.col(part) == train), list(keys), [*regressors, outcome]), list(keys), regressors, alphas)
    scored = rows.where(F.col(part) == test).join(F.broadcast(fitted), list(keys)).withColumn("prediction", L.predicted(regressors))
    error = F.col(outcome) - F.col("prediction")
    return scored.select(*keys, "alpha", *carry, "prediction", (error * error).alias("loss"))
