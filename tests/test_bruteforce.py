"""Operators without a SQL form, and the distributed ones, against plain loops on small data."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordering
from tidemark.functions import text as X
from tidemark.operators import estimators as E
from tidemark.operators import joins as J
from tidemark.operators import linear as L
from tidemark.operators import matching as M
from tidemark.operators import patterns as N
from tidemark.operators import resample as R
from tidemark.operators import series as Z

RNG = np.random.default_rng(3)


def test_quantiles_and_ranks_match_pandas(spark):
    df = pd.DataFrame({"k": RNG.choice(["a", "b"], 400, p=[0.9, 0.1]), "v": RNG.integers(0, 60, 400) / 4})
    s = spark.createDataFrame(df)
    got = ordering.quantiles(s, ["k"], "v", {"q1": 0.1, "q5": 0.5, "q9": 0.93}).toPandas().set_index("k")
    ranks = ordering.average_ranks(s, ["k"], "v", "r").toPandas()
    low = ordering.lowest_share_mean(s, ["k"], "v", 0.1, "m").toPandas().set_index("k")
    for k, g in df.groupby("k"):
        assert got.loc[k, ["q1", "q5", "q9"]].tolist() == pytest.approx(np.quantile(g.v, [0.1, 0.5, 0.93]).tolist())
        assert low.m[k] == pytest.approx(np.sort(g.v)[: math.ceil(0.1 * len(g))].mean())
        want = g.assign(r=g.v.rank()).drop_duplicates("v").set_index("v").r
        mine = ranks[ranks.k == k].set_index("v").r
        assert mine.sort_index().tolist() == want.sort_index().tolist()


def test_distance_correlation_matches_all_pairs(spark):
    x = RNG.integers(0, 2, 80).astype(float)
    y = np.round(RNG.normal(size=80) + x, 1)
    def centred(v):
        a = np.abs(v[:, None] - v[None, :])
        return a - a.mean(0) - a.mean(1)[:, None] + a.mean()
    a, b = centred(x), centred(y)
    want = math.sqrt(max(0, (a * b).mean()) / math.sqrt((a * a).mean() * (b * b).mean()))
    rows = spark.createDataFrame([("c", float(p), float(q)) for p, q in zip(x, y)], "cell string, x double, y double")
    got = E.flag_distance_correlation(rows, ["cell"], "x", "y").first()["distance_correlation"]
    assert got == pytest.approx(want, abs=1e-9)


def test_fixed_effects_recover_and_match_dummies(spark):
    rows = []
    for i in range(8):
        for j in range(10):
            x, z = RNG.normal(), RNG.normal()
            rows.append(("c", f"I{i}", x, z, 2 * x - 3 * z + i))
    s = spark.createDataFrame(rows, "cell string, issuer string, x double, z double, y double")
    out = L.fixed_effects(s, ["cell"], "issuer", ["x", "z"], "y", "x").first()
    assert out["coef"] == pytest.approx(2) and out["leave_one_low"] == pytest.approx(2) and out["issuers"] == 8
    flat = L.solve(L.within(L.products(s.withColumn("z", F.col("x") * 2), ["cell"], ["x", "z", "y"]), ["cell"], 3), ["cell"], ["x", "z"]).collect()
    assert all(r["coef"] is None for r in flat)


def test_ridge_matches_closed_form(spark):
    n = 60
    x = RNG.normal(size=(n, 2)) * [1, 50]
    y = x @ [1.5, -0.1] + RNG.normal(size=n) + 4
    s = spark.createDataFrame([("c", float(a), float(b), float(v)) for (a, b), v in zip(x, y)], "cell string, a double, b double, y double")
    got = L.ridge(L.products(s, ["cell"], ["a", "b", "y"]), ["cell"], ["a", "b"], [3.0]).first()
    z = (x - x.mean(0)) / x.std(0)
    raw = np.linalg.solve(z.T @ z + 3 * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert got["coefs"] == pytest.approx(raw.tolist())
    assert got["intercept"] == pytest.approx(y.mean() - raw @ x.mean(0))


def test_sequences_match_enumeration(spark):
    filings = [("I", int(s), c) for s, c in zip(RNG.integers(0, 40, 45), RNG.choice(list("abc"), 45))]
    s = spark.createDataFrame(filings, "issuer string, session int, label string")
    days = N.label_days(s, ["issuer"])
    rows = N.windowed(N.closed(N.sequences(days, N.last_before(days, ["issuer"]), ["issuer"], 3, 10), days, ["issuer"]), [3, 10])
    got = {(r["window"], r["pattern"], r["session"]) for r in rows.collect()}
    want = set()
    for w in (3, 10):
        for _, t, last in filings:
            prior = [(a, c) for _, a, c in filings if 0 < t - a <= w]
            for k in (1, 2):
                for combo in itertools.permutations(prior, k):
                    times = [a for a, _ in combo] + [t]
                    if all(p < q for p, q in zip(times, times[1:])):
                        want.add((w, ">".join([c for _, c in combo] + [last]), t))
    assert got == want
    prefixes = N.sequences(days, N.last_before(days, ["issuer"]), ["issuer"], 3, 10)
    support = {(r["window"], r["pattern"]): r["activations"] for r in N.windowed_support(prefixes, days, "issuer", [3, 10]).collect()}
    counts = {}
    for w, p, _ in want:
        counts[(w, f"seq{w}:{p}")] = counts.get((w, f"seq{w}:{p}"), 0) + 1
    assert support == counts


def test_latest_quote_matches_scan(spark):
    second = 1_000_000_000
    quotes = [("A", int(t) * second, i, 1.0 + i) for i, t in enumerate(RNG.integers(0, 3000, 60))] + [("A", 600 * second, 100, 5.0), ("A", 600 * second, 101, 6.0)]
    cuts = [("A", n, t * second) for n, t in enumerate([0, 59, 600, 601, 1500, 2999])]
    got = J.latest_quote(spark.createDataFrame(cuts, "k string, id int, cutoff_ns bigint"), spark.createDataFrame(quotes, "k string, ts_ns bigint, sequence bigint, bid double"), ["k"], 60 * second)
    found = {r["id"]: r["bid"] for r in got.collect()}
    for _, n, c in cuts:
        inside = [(q[1], q[2], q[3]) for q in quotes if c - 60 * second <= q[1] <= c]
        assert found[n] == (max(inside)[2] if inside else None)


def feature_table(spark, n=60):
    rows = [("A", i, pd.Timestamp("2024-01-01") + pd.Timedelta(days=i), pd.Timestamp("2024-01-01") + pd.Timedelta(days=i + 3), float(RNG.normal())) for i in range(n)]
    return spark.createDataFrame([(t, s, d.date(), e.date(), v) for t, s, d, e, v in rows], "ticker string, session int, date date, target_end date, f double"), rows


def test_unique_nearest_matches_loop(spark):
    table, rows = feature_table(spark)
    events = [20, 22, 25, 40, 41]
    marked = table.withColumn("scale_f", F.lit(1.0))
    got = M.unique_nearest(marked.where(F.col("session").isin(events)), table.where(~F.col("session").isin(events)), ["f"], 15)
    got = {r["session"]: r["control_session"] for r in got.collect()}
    used, want = set(), {}
    for e in events:
        pool = [(abs(rows[e][4] - rows[c][4]), c) for c in range(e) if e - c <= 15 and c not in events and rows[c][3] < rows[e][2] and c not in used]
        pool = [p for p in pool if p[0] <= 2]
        if pool:
            want[e] = min(pool)[1]
            used.add(want[e])
    assert got == want


def test_spaced_prior_matches_loop(spark):
    table, rows = feature_table(spark)
    got = M.spaced_prior(table.where("session in (30, 50)"), table.where("session < 45"), ["f"], 25, 4, 3)
    got = {r["session"]: r["controls"] for r in got.collect()}
    for e in (30, 50):
        pool = sorted(((rows[e][4] - rows[c][4]) ** 2, c) for c in range(min(e, 45)) if e - c <= 25 and rows[c][3] < rows[e][2])
        kept = []
        for _, c in pool:
            if len(kept) < 3 and all(abs(c - k) > 4 for k in kept):
                kept.append(c)
        assert got[e] == kept


def test_step_down_matches_loop(spark):
    effects, draws = 6, 99
    t = np.abs(RNG.normal(size=effects)) * 2
    d = np.abs(RNG.normal(size=(draws, effects)))
    obs = spark.createDataFrame([(f"e{i}", 0.0, 1.0, float(v)) for i, v in enumerate(t)], "effect string, point double, se double, t double")
    rows = spark.createDataFrame([(f"e{i}", b, float(d[b, i]), float(t[i])) for b in range(draws) for i in range(effects)], "effect string, draw int, td double, t double")
    got = {r["effect"]: r["p_adjusted"] for r in R.step_down(obs, rows, "effect").collect()}
    order, previous = sorted(range(effects), key=lambda i: -t[i]), 0.0
    for k, i in enumerate(order):
        p = (1 + (d[:, order[k:]].max(1) >= t[i]).sum()) / (1 + draws)
        previous = max(previous, p)
        assert got[f"e{i}"] == pytest.approx(previous)


def test_block_weights_keep_the_calendar_size(spark):
    days = spark.createDataFrame([(i, d) for i, d in enumerate(pd.bdate_range("2023-06-01", periods=300).date)], "session int, date date")
    year = R.year_block_weights(days, 5, 21, 1).join(days, "session").groupBy("draw", F.year("date").alias("y")).agg(F.sum("weight").alias("w")).toPandas()
    sizes = days.groupBy(F.year("date").alias("y")).count().toPandas().set_index("y")["count"]
    assert all(sizes[y] == w for y, w in zip(year.y, year.w))
    moving = R.moving_block_weights(days, 5, 21, 1).groupBy("draw").agg(F.sum("weight").alias("w")).collect()
    assert [r["w"] for r in moving] == [300] * 5
    cluster = R.cluster_weights(spark.createDataFrame([(c,) for c in "abcdef"], "k string"), "k", 4, 2).groupBy("draw").agg(F.sum("weight").alias("w")).collect()
    assert [r["w"] for r in cluster] == [6] * 4


def test_repeat_suppression_compares_with_kept_rows(spark):
    rows = spark.createDataFrame([("k", s) for s in (0, 40, 80, 100, 200)], "k string, session int")
    kept = {r["session"] for r in Z.suppress_repeats(rows, ["k"], 63).where("kept").collect()}
    assert kept == {0, 80, 200}


@pytest.mark.parametrize("text, status", [
    ("The company issued notes. It received the proceeds.", "completed"),
    ("It raised funding. The company sold bonds.", "completed"),
    ("The company sold bonds.", "unknown"),
    ("The company will issue notes.", "planned"),
    ("The company issued notes. It will use them. It received the proceeds.", "unknown"),
    ("Nothing else.", "unknown"), ("  ", "unknown"), (None, "unknown")])
def test_clause_rules(spark, text, status):
    df = spark.createDataFrame([(text,)], "t string")
    assert X.financing_status(df, "t").first()["status"] == status


def test_label_combinations(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],)], "labels array<string>")
    assert df.select(X.combinations(F.col("labels"), 3).alias("c")).first()["c"] == ["&".join(c) for c in itertools.combinations("abcd", 3)]
    sets = N.itemsets(df.selectExpr("'I' as issuer", "1 as accession", "0 as session", "labels"), 4)
    assert {r["pattern"] for r in sets.collect()} == {"&".join(c) for k in (2, 3, 4) for c in itertools.combinations("abcd", k)}


def test_block_sums_give_the_same_draws(spark):
    from tidemark.operators import resample as R
    from tidemark.operators.estimators import MOMENTS

    rng = np.random.default_rng(9)
    days = spark.createDataFrame([(i,) for i in range(97)], "session int")
    rows = [(f, i, *map(float, rng.normal(size=5))) for f in ("a", "b") for i in range(97) if rng.random() < 0.8]
    moments = spark.createDataFrame([(f, i, 3, sx, sy, 5 + sx * sx, 5 + sy * sy, sxy) for f, i, sx, sy, _, _, sxy in rows], "feature string, session int, n long, sx double, sy double, sxx double, syy double, sxy double")
    assert MOMENTS == moments.columns[2:]
    slow = R.weighted_correlations(moments, R.moving_block_weights(days, 60, 10, 3), ["feature"])
    fast = R.block_correlations(moments, days, ["feature"], 60, 10, 3)
    a, b = ({(r.feature, r.draw): r.estimate for r in d.collect()} for d in (slow, fast))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_sweep_equals_residual_correlation(spark):
    from tidemark.operators import linear as L

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[:, 4] = x[:, 2] + x[:, 3]  # a control that the others explain
    x[:, 0] += x[:, 2] - 2 * x[:, 5]
    x[:, 1] += 0.5 * x[:, 0] + x[:, 3]
    df = spark.createDataFrame([("k", *map(float, row)) for row in x], "k string, " + ", ".join(f"c{i} double" for i in range(6)))
    grams = L.within(L.products(df, ["k"], [f"c{i}" for i in range(6)]), ["k"], 6)
    got = L.swept(grams, 6, [2, 3, 4, 5]).select(L.partial(0, 1).alias("r")).first()["r"]
    design = np.column_stack([np.ones(300), x[:, 2:]])
    left = [v - design @ np.linalg.lstsq(design, v, rcond=None)[0] for v in (x[:, 0], x[:, 1])]
    assert abs(got - np.corrcoef(*left)[0, 1]) < 1e-9
