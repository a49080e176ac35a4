"""Association estimators written as mergeable sums over long tables.

Rows are exploded to cells, and every cell is first summed by date or by issuer.
Those partial sums are small, and give the estimate, the support counts, the
leave-one-out range and the resampling input without reading the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import ordering
from tidemark.functions.scalars import ratio
from tidemark.session import stage

MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def gap_lag(name: str, k: int, keys: Sequence[str] = ("ticker",)) -> Column:
    """Value k rows back, only when exactly k sessions passed."""
    if k == 0:
        return F.col(f"`{name}`").cast("double")
    w = W.partitionBy(*keys).orderBy("session")
    return F.when(F.col("session") - F.lag("session", k).over(w) == k, F.lag(F.col(f"`{name}`"), k).over(w)).cast("double")


def long_cells(panel: DataFrame, features: Sequence[str], lags: Sequence[int], targets: Sequence[tuple[str, int]]) -> DataFrame:
    """(ticker, date, session, feature, lag, kind, horizon, x, y): one row per panel row and cell."""
    names = {f"x{i}_{k}": (f, k) for i, f in enumerate(features) for k in lags}
    wide = panel.select("ticker", "date", "session", *[gap_lag(f, k).alias(n) for n, (f, k) in names.items()],
                        *[F.col(f"{kind}_{h}") for kind, h in targets])
    inputs = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("lag"), F.col(n).alias("x")) for n, (f, k) in names.items()])
    outputs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(h).alias("horizon"), F.col(f"{kind}_{h}").alias("y")) for kind, h in targets])
    rows = wide.select("ticker", "date", "session", F.explode(inputs).alias("i"), outputs.alias("o")).where("i.x is not null")
    rows = rows.select("ticker", "date", "session", "i.*", F.explode("o").alias("o"))
    return rows.select("ticker", "date", "session", "feature", "lag", "o.kind", "o.horizon", "x", "o.y").where("y is not null")


def moment_sums(x: str = "x", y: str = "y") -> list[Column]:
    a, b = F.col(x), F.col(y)
    return [F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"),
            F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")]


def merged_moments() -> list[Column]:
    return [F.sum(m).alias(m) for m in MOMENTS]


def correlation(n="n", sx="sx", sy="sy", sxx="sxx", syy="syy", sxy="sxy") -> Column:
    """Pearson from sums: NULL below three rows or when a column does not vary."""
    n, sx, sy, sxx, syy, sxy = [F.col(c) if isinstance(c, str) else c for c in (n, sx, sy, sxx, syy, sxy)]
    vx = F.greatest(F.lit(0.0), sxx - sx * sx / n)
    vy = F.greatest(F.lit(0.0), syy - sy * sy / n)
    return F.when(n >= 3, F.try_divide(sxy - sx * sy / n, F.sqrt(vx * vy)))


def partial_moments(long: DataFrame, cell: Sequence[str], part: str) -> DataFrame:
    """Moments and positive rows by (cell, part): the shared input of estimates, support and resampling."""
    return long.groupBy(*cell, part).agg(*moment_sums(), F.count_if(F.col("x") != 0).alias("positive"),
                                         F.min("x").alias("x_low"), F.max("x").alias("x_high"),
                                         F.min("y").alias("y_low"), F.max("y").alias("y_high"))


def cell_table(long: DataFrame, cell: Sequence[str], issuer: str = "ticker") -> DataFrame:
    """Estimate and support of every cell, plus the mean within-date correlation."""
    by_issuer = partial_moments(long, cell, issuer).groupBy(*cell).agg(
        *merged_moments(), F.count(F.lit(1)).alias("issuers"), F.sum("positive").alias("positive_rows"),
        F.count_if(F.col("positive") > 0).alias("positive_issuers"),
        (F.min("x_low") < F.max("x_high")).alias("x_varies"), (F.min("y_low") < F.max("y_high")).alias("y_varies"))
    by_date = partial_moments(long, cell, "date").withColumn("r", correlation()).groupBy(*cell).agg(
        F.count(F.lit(1)).alias("dates"), F.count_if(F.col("positive") > 0).alias("positive_dates"),
        F.avg("r").alias("within_date"), F.count("r").alias("supported_dates"))
    return (by_issuer.join(by_date, list(cell)).withColumn("pearson", correlation()).withColumnRenamed("n", "rows"))


FEW_VALUES = 100_000  # ranks of x that may be sent to every task


def spearman(long: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Rank correlation per cell with average ranks for ties.

    Rows are counted by (cell, x, y) once. The ranks of y meet, per value of y, the sum of the ranks of x there, so y is ranked without a join of ranks
    to rows. The ranks of x are joined to the counts; where x has few values, as flags have, they are few enough to be sent along.
    """
    keys = list(cell)
    pairs = stage(long.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("c")), "rank-pairs")
    values = stage(pairs.groupBy(*keys, "x").agg(F.sum("c").alias("_count")), "rank-values")
    ranks_x = stage(ordering.positioned(values, keys, "x").select(*keys, "x", (F.col("_before") + (F.col("_count") + 1) / 2.0).alias("rx")), "ranks-x")
    if ranks_x.count() <= FEW_VALUES:
        ranks_x = F.broadcast(ranks_x)
    c, a, b = F.col("c"), F.col("rx"), F.col("_before") + (F.col("_count") + 1) / 2.0
    met = pairs.join(ranks_x, [*keys, "x"]).groupBy(*keys, "y").agg(F.sum(c).alias("_count"), F.sum(c * a).alias("_x"), F.sum(c * a * a).alias("_xx"))
    placed = ordering.positioned(met, keys, "y", ("_x", "_xx"))
    n = F.col("_count")
    sums = placed.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum("_x").alias("sx"), F.sum(n * b).alias("sy"), F.sum("_xx").alias("sxx"),
                                     F.sum(n * b * b).alias("syy"), F.sum(F.col("_x") * b).alias("sxy"))
    return sums.select(*keys, correlation().alias("spearman"))


def leave_one_range(sums: DataFrame, keys: Sequence[str], total: str, count: str) -> DataFrame:
    """Range of the mean when each part is left out: total minus part, no recomputation."""
    whole = ordering.with_totals(sums, list(keys), {"_total": F.col(total), "_size": F.col(count)})
    rest = F.try_divide(F.col("_total") - F.col(total), F.col("_size") - F.col(count))
    return whole.withColumn("_rest", rest).groupBy(*keys).agg(
        (F.sum(total) / F.sum(count)).alias("mean"), F.min("_rest").alias("leave_one_low"),
        F.max("_rest").alias("leave_one_high"), F.count(F.lit(1)).alias("parts"))


def leave_one_correlation(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range of the correlation when each part is left out, from moment differences."""
    whole = ordering.with_totals(parts, list(keys), {f"_all_{m}": F.col(m) for m in MOMENTS})
    rest = correlation(*[F.col(f"_all_{m}") - F.col(m) for m in MOMENTS])
    return whole.withColumn("_rest", rest).groupBy(*keys).agg(F.min("_rest").alias("leave_one_low"), F.max("_rest").alias("leave_one_high"))


def distribution(rows: DataFrame, keys: Sequence[str], value: str, tail: float) -> DataFrame:
    """Mean, median, tenth and ninetieth percentile, and tail probability by group."""
    simple = rows.groupBy(*keys).agg(F.count(value).alias("rows"), F.avg(value).alias("mean"),
                                     F.avg((F.col(value) < tail).cast("double")).alias("tail_probability"))
    spread = ordering.quantiles(rows, list(keys), value, {"median": 0.5, "q10": 0.1, "q90": 0.9})
    return simple.join(spread, list(keys))


def mutual_information(rows: DataFrame, keys: Sequence[str], x: str, y: str, bins: int) -> DataFrame:
    """Information between a flag and an outcome cut at its own quantiles, in nats."""
    probs = {f"_q{i}": i / bins for i in range(1, bins)}
    cuts = ordering.quantiles(rows, list(keys), y, probs).select(*keys, F.array(*probs).alias("_cuts"))
    binned = rows.join(cuts, list(keys)).withColumn(
        "_bin", F.aggregate("_cuts", F.lit(0), lambda a, c: a + (F.col(y) > c).cast("int")))
    joint = binned.groupBy(*keys, x, "_bin").agg(F.count(F.lit(1)).alias("nxy"))
    w = list(keys)
    share = joint.select(*keys, "nxy", F.sum("nxy").over(W.partitionBy(*w, x)).alias("nx"),
                         F.sum("nxy").over(W.partitionBy(*w, "_bin")).alias("ny"), F.sum("nxy").over(W.partitionBy(*w)).alias("n"))
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return share.groupBy(*keys).agg(F.max("n").alias("rows"), F.sum(term).alias("mutual_information"))


def flag_distance_correlation(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Distance correlation of a 0/1 flag and an outcome over all rows, without forming pairs.

    With a flag on one side, every pair sum reduces to sums of absolute
    differences inside and across the two groups, and those follow from ranks
    and running sums of the ordered outcome.
    """
    keys = list(keys)
    counts = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_count"))
    counts = stage(counts, "flag-counts")
    whole = ordering.positioned(counts.groupBy(*keys, y).agg(F.sum("_count").alias("_count")), keys, y)
    sides = ordering.positioned(counts, [*keys, x], y)

    def spread(c: Column) -> Column:
        # sum over ordered pairs of |difference| = 2 * sum of value * (2 * position - n - 1)
        return 2 * F.sum(F.col(y) * c * (2 * F.col("_before") + c - F.col("_total")))

    size = F.col("_count")
    inside = sides.groupBy(*keys, x).agg(spread(size).alias("w"), F.sum(size).alias("m")).groupBy(*keys).agg(
        F.sum("w").alias("within"), F.sum(F.when(F.col(x) != 0, F.col("m")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col(x) == 0, F.col("m")).otherwise(0)).alias("n0"))
    whole = ordering.with_totals(whole, keys, {"_mass": size * F.col(y)})
    mass = F.col("_mass")
    after = F.col("_total") - F.col("_before") - size
    row_sum = F.col(y) * F.col("_before") - F.col("_sum_before") + (mass - F.col("_sum_before") - size * F.col(y)) - F.col(y) * after
    reach = stage(whole.select(*keys, y, F.col("_total").alias("n"), (row_sum / F.col("_total")).alias("_b"), size, "_before", "_total"), "reach")
    moments = reach.groupBy(*keys).agg(
        F.max("n").alias("n"), spread(size).alias("all_pairs"), F.sum(size * F.col("_b") * F.col("_b")).alias("bb"),
        F.sum(size * F.col(y)).alias("sy"), F.sum(size * F.col(y) * F.col(y)).alias("syy"))
    cross = counts.join(reach.select(*keys, y, "_b"), [*keys, y]).groupBy(*keys).agg(
        F.sum(F.when(F.col(x) != 0, F.col("_count") * F.col("_b"))).alias("b1"), F.sum(F.when(F.col(x) == 0, F.col("_count") * F.col("_b"))).alias("b0"))
    t = moments.join(inside, keys).join(cross, keys)
    n, n1, n0 = F.col("n").cast("double"), F.col("n1").cast("double"), F.col("n0").cast("double")
    mean_a, mean_b = 2 * n1 * n0 / (n * n), F.col("all_pairs") / (n * n)
    a_row_sq = (n1 * n0 * n0 + n0 * n1 * n1) / (n * n * n)
    cov = (F.col("all_pairs") - F.col("within")) / (n * n) - 2 * (n0 * F.col("b1") + n1 * F.col("b0")) / (n * n) + mean_a * mean_b
    var_a = 2 * n1 * n0 / (n * n) - 2 * a_row_sq + mean_a * mean_a
    var_b = (2 * n * F.col("syy") - 2 * F.col("sy") * F.col("sy")) / (n * n) - 2 * F.col("bb") / n + mean_b * mean_b
    value = F.sqrt(F.try_divide(F.greatest(F.lit(0.0), cov), F.sqrt(var_a * var_b)))
    supported = (F.col("n1") >= 4) & (F.col("n0") >= 4)
    return t.select(*keys, F.col("n").alias("rows"), F.when(supported, value).alias("distance_correlation"))


def split_feasibility(rows: DataFrame, keys: Sequence[str], value: str, minimum: int) -> DataFrame:
    """Whether any threshold leaves at least `minimum` rows on both sides."""
    ordered = ordering.positioned(ordering.value_counts(rows, list(keys), value), list(keys), value)
    left = F.col("_before") + F.col("_count")
    good = (left >= minimum) & (F.col("_total") - left >= minimum)
    return ordered.groupBy(*keys).agg(F.max("_total").alias("rows"), F.count(F.lit(1)).alias("levels"),
                                      F.count_if(good).alias("thresholds"), F.max(good.cast("int")).alias("feasible"))


def label_phi(filing_labels: DataFrame, filings: int | Column) -> DataFrame:
    """Co-occurrence and phi coefficient of all pairs of labels, also of those that never meet in a filing.

    Met pairs come from each filing's own label array, which the taxonomy bounds; the full list has a row per pair of taxonomy labels.
    """
    per_filing = filing_labels.groupBy("accession").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    pairs = F.flatten(F.transform("labels", lambda a, i: F.transform(
        F.filter(F.col("labels"), lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    together = per_filing.select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count(F.lit(1)).alias("together"))
    single = filing_labels.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    # The taxonomy as one array; a pair is a label with a later one.
    listed = single.agg(F.array_sort(F.collect_list(F.struct("label", "k"))).alias("all"))
    listed = listed.select("all", F.posexplode("all").alias("at", "x"))
    listed = listed.select("x", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("y"))
    t = listed.select(F.col("x.label").alias("first"), F.col("y.label").alias("second"), F.col("x.k").alias("ka"), F.col("y.k").alias("kb"))
    t = t.join(together, ["first", "second"], "left").withColumn("together", F.coalesce("together", F.lit(0)))
    n = (filings if isinstance(filings, Column) else F.lit(filings)).cast("double")
    a, b, c = F.col("ka").cast("double"), F.col("kb").cast("double"), F.col("together").cast("double")
    phi = F.try_divide(n * c - a * b, F.sqrt(a * b * (n - a) * (n - b)))
    return t.select("first", "second", "together", phi.alias("phi"))
