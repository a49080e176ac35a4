"""Linear estimators from sums of products.

Rows are reduced to one small product matrix per (cell, issuer); fixed effects,
leave-one-out ranges, resampled weights and ridge penalties all follow from
those matrices. Only the final solve, a few dozen numbers per cell, runs in
NumPy, inside tasks, one matrix per row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import ordering


def _name(i: int, j: int) -> str:
    return f"g_{min(i, j)}_{max(i, j)}"


def products(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """n, column sums s_i and product sums g_i_j per key."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    aggs = [F.sum(w).alias("n")] + [F.sum(w * v).alias(f"s_{i}") for i, v in enumerate(values)]
    aggs += [F.sum(w * values[i] * values[j]).alias(_name(i, j)) for i in range(len(values)) for j in range(i, len(values))]
    return rows.groupBy(*keys).agg(*aggs)


def within(grams: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Products around the group's own means: what demeaning inside the group would give."""
    columns = [(F.col(_name(i, j)) - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n")).alias(_name(i, j)) for i in range(size) for j in range(i, size)]
    return grams.select(*keys, "n", *columns)


def pooled(grams: DataFrame, keys: Sequence[str], size: int, weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    names = ["n"] + [_name(i, j) for i in range(size) for j in range(i, size)]
    return grams.groupBy(*keys).agg(*[F.sum(w * F.col(c)).alias(c) for c in names])


def without_each(grams: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Pooled products with one group left out, per group: total minus part."""
    names = ["n"] + [_name(i, j) for i in range(size) for j in range(i, size)]
    whole = ordering.with_totals(grams, list(keys), {f"_all_{c}": F.col(c) for c in names})
    return whole.withColumns({c: F.col(f"_all_{c}") - F.col(c) for c in names}).drop(*[f"_all_{c}" for c in names])


PIVOT = 1e-10  # of a control's own product, under which the controls before it explain it


def swept(grams: DataFrame, size: int, controls: Sequence[int]) -> DataFrame:
    """Products that are left of all columns once the controls are taken out, one elimination step a control; any number of them, inside the JVM.

    A control that those before it explain adds nothing and is passed over.
    """
    out = grams.withColumns({f"_d_{k}": F.col(_name(k, k)) for k in controls})
    for k in controls:
        good = F.col(_name(k, k)) > PIVOT * F.col(f"_d_{k}")
        out = out.withColumns({_name(i, j): F.when(good, F.col(_name(i, j)) - F.col(_name(i, k)) * F.col(_name(j, k)) / F.col(_name(k, k))).otherwise(F.col(_name(i, j)))
                               for i in range(size) for j in range(i, size) if k not in (i, j)})
    return out.drop(*[f"_d_{k}" for k in controls])


def partial(i: int, j: int) -> Column:
    """Correlation of what is left of two columns."""
    return F.col(_name(i, j)) / F.sqrt(F.col(_name(i, i)) * F.col(_name(j, j)))


def solve(grams: DataFrame, keys: Sequence[str], regressors: Sequence[str], limit: float = 1e10) -> DataFrame:
    """(keys, name, coef, condition): one row per regressor; NULL coef on deficient rank or bad conditioning.

    The outcome is the last column of the product matrix.
    """
    p = len(regressors)
    kept = [f for f in grams.schema.fields if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", name string, coef double, condition double"
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                matrix = np.array([[row[_name(i, j)] for j in range(p)] for i in range(p)], dtype=float)
                target = np.array([row[_name(i, p)] for i in range(p)], dtype=float)
                scale = np.sqrt(np.clip(np.diag(matrix), 0, None))
                coef, condition = np.full(p, np.nan), np.nan
                if np.isfinite(matrix).all() and (scale > 0).all():
                    unit = matrix / np.outer(scale, scale)
                    condition = float(np.linalg.cond(unit))
                    if np.linalg.matrix_rank(unit) == p and condition < limit:
                        coef = np.linalg.solve(unit, target / scale) / scale
                out += [{**{k: row[k] for k in names}, "name": r, "coef": None if np.isnan(c) else float(c), "condition": condition} for r, c in zip(regressors, coef)]
            yield pd.DataFrame(out, columns=[*names, "name", "coef", "condition"])

    return grams.mapInPandas(run, schema).withColumn("coef", F.when(~F.isnan("coef"), F.col("coef")))


def fixed_effects(rows: DataFrame, keys: Sequence[str], issuer: str, regressors: Sequence[str], outcome: str, focus: str) -> DataFrame:
    """Issuer-demeaned coefficient of `focus` with rows, issuers and its leave-one-issuer range."""
    columns = [*regressors, outcome]
    size = len(columns)
    parts = within(products(rows, [*keys, issuer], columns), [*keys, issuer], size)
    point = solve(pooled(parts, keys, size), keys, regressors).where(F.col("name") == focus)
    ranges = solve(without_each(parts, keys, size), [*keys, issuer], regressors).where(F.col("name") == focus).groupBy(*keys).agg(
        F.min("coef").alias("leave_one_low"), F.max("coef").alias("leave_one_high"))
    counts = parts.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("rows"), F.count(F.lit(1)).alias("issuers"))
    return point.select(*keys, "coef", "condition").join(ranges, list(keys)).join(counts, list(keys))


def ridge(grams: DataFrame, keys: Sequence[str], regressors: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """(keys, alpha, intercept, coefs): ridge on columns scaled by their own population deviation.

    `grams` come from products() over the training rows, outcome last. Every
    penalty reuses the same matrix; coefficients are returned in raw units.
    """
    p = len(regressors)
    kept = [f for f in grams.schema.fields if f.name in keys]
    names = [f.name for f in kept]
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    schema = head + "alpha double, intercept double, coefs array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                n = row["n"]
                mean = np.array([row[f"s_{i}"] / n for i in range(p + 1)])
                cov = np.array([[row[_name(i, j)] / n - mean[i] * mean[j] for j in range(p + 1)] for i in range(p + 1)])
                scale = np.sqrt(np.clip(np.diag(cov)[:p], 0, None))
                scale[scale < 1e-12] = 1.0
                unit = cov[:p, :p] / np.outer(scale, scale) * n
                target = cov[:p, p] / scale * n
                for alpha in alphas:
                    raw = np.linalg.solve(unit + alpha * np.eye(p), target) / scale
                    out.append({**{k: row[k] for k in names}, "alpha": float(alpha), "intercept": float(mean[p] - raw @ mean[:p]), "coefs": raw.tolist()})
            yield pd.DataFrame(out, columns=[*names, "alpha", "intercept", "coefs"])

    return grams.mapInPandas(run, schema)


def predicted(regressors: Sequence[str], intercept: str = "intercept", coefs: str = "coefs") -> Column:
    """Intercept plus dot product, inside the JVM."""
    x = F.array(*[F.col(f"`{r}`").cast("double") for r in regressors])
    return F.col(intercept) + F.aggregate(F.zip_with(x, coefs, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def market_model(rows: DataFrame, key: str, y: str, x: str, lags: int) -> DataFrame:
    """Intercept and slope per key with autocorrelation-consistent errors.

    Scores are multiplied with their own lags in one window per key (a key has
    one row per session), and only sums reach the 2 x 2 sandwich.
    """
    sums = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    fit = sums.withColumn("det", det).withColumn("beta", (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.col("det")).withColumn(
        "alpha", (F.col("sy") - F.col("beta") * F.col("sx")) / F.col("n"))
    scored = rows.join(fit.select(key, "alpha", "beta"), key).withColumn("e", F.col(y) - F.col("alpha") - F.col("beta") * F.col(x))
    scored = scored.withColumns({"s0": F.col("e"), "s1": F.col("e") * F.col(x)})
    w = W.partitionBy(key).orderBy("session")
    terms = {"m00": F.col("s0") * F.col("s0"), "m01": F.col("s0") * F.col("s1"), "m11": F.col("s1") * F.col("s1")}
    for k in range(1, lags + 1):
        share = 1 - k / (lags + 1)
        a, b = F.lag("s0", k, 0.0).over(w), F.lag("s1", k, 0.0).over(w)
        terms["m00"] = terms["m00"] + 2 * share * F.col("s0") * a
        terms["m01"] = terms["m01"] + share * (F.col("s0") * b + F.col("s1") * a)
        terms["m11"] = terms["m11"] + 2 * share * F.col("s1") * b
    meat = scored.select(key, *[v.alias(n) for n, v in terms.items()]).groupBy(key).agg(*[F.sum(n).alias(n) for n in terms])
    j = fit.join(meat, key)
    i00, i01, i11 = F.col("sxx") / F.col("det"), -F.col("sx") / F.col("det"), F.col("n") / F.col("det")
    var_a = i00 * i00 * F.col("m00") + 2 * i00 * i01 * F.col("m01") + i01 * i01 * F.col("m11")
    var_b = i01 * i01 * F.col("m00") + 2 * i01 * i11 * F.col("m01") + i11 * i11 * F.col("m11")
    return j.select(key, F.col("n").alias("rows"), "alpha", "beta", F.sqrt(F.greatest(F.lit(0.0), var_a)).alias("alpha_error"), F.sqrt(F.greatest(F.lit(0.0), var_b)).alias("beta_error"))
