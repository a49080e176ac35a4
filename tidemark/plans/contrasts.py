"""Queries of conditional coefficients, matched responses and contrasts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import ordering
from tidemark.functions.scalars import big, finite, flag, ratio, rounded
from tidemark.operators import estimators as E
from tidemark.operators import linear as L
from tidemark.operators import matching as M
from tidemark.operators import panel as P
from tidemark.operators import resample as R
from tidemark.operators import series as Z
from tidemark.plans.association import corr_sql, flag_rows, long
from tidemark.plans.events import DATA_EXCLUSION, NAMES, complete, component_matched, features, label_grid, labelled, matched, paired, spaced_matches, unique_matches
from tidemark.plans.inference import DRAWS, SEED
from tidemark.plans.market import CATEGORIES, HORIZONS, moves, study_panel
from tidemark.plans.registry import study
from tidemark.plans.sqlviews import gram_name, gram_sql, r, swept_sql, view
from tidemark.session import snapshot
from tidemark.sources import tables as T

CONTROLS = ["past_return_5", "past_vol_20"]
EVENT = "event__1-URGENT"


@study("c2_nonlinear_dependence")
def c2(spark, folder):
    rows = flag_rows(spark, folder)
    info = E.mutual_information(rows, ["feature", "kind"], "x", "y", 8)
    distance = E.flag_distance_correlation(rows, ["feature", "kind"], "x", "y").drop("rows")
    return info.join(distance, ["feature", "kind"]).withColumns({c: rounded(c, 5) for c in ("mutual_information", "distance_correlation")})


PARTIAL_CONTROLS = ["past_return_5", "past_return_20", "past_vol_20", "past_log_volume", "market_past_return_5"]
_PARTIAL = [f'"{EVENT}"', "return_5", *PARTIAL_CONTROLS]
_SIZE = len(_PARTIAL)
_PAIRS = [(i, j) for i in range(_SIZE) for j in range(i, _SIZE)]


@study("c3_partial_correlation", f"""
WITH g AS ({gram_sql(_PARTIAL, "1", "(SELECT * FROM panel WHERE return_5 IS NOT NULL)", "ticker").replace("SELECT 1, ticker", "SELECT ticker").replace("GROUP BY 1, ticker", "GROUP BY ticker")}),
t AS (SELECT 'event__1-URGENT' AS feature, CAST(sum(n) AS BIGINT) AS n, {', '.join(f'sum({gram_name(i, j)}) AS {gram_name(i, j)}' for i, j in _PAIRS)} FROM g HAVING count(*) > 0)
SELECT feature, n AS rows, {r('g_0_1 / sqrt(g_0_0 * g_1_1)')} AS partial FROM {swept_sql('t', 'feature', _SIZE, list(range(2, _SIZE)))}""", "panel")
def c3(spark, folder):
    """Event and outcome within issuers, all controls taken out one after the other."""
    rows = study_panel(spark, folder).where("return_5 is not null").withColumn("feature", F.lit(EVENT))
    columns = [EVENT, "return_5", *PARTIAL_CONTROLS]
    grams = L.within(L.products(rows, ["feature", "ticker"], columns), ["feature", "ticker"], len(columns))
    left = L.swept(L.pooled(grams, ["feature"], len(columns)), len(columns), range(2, len(columns)))
    return left.select("feature", big("n").alias("rows"), rounded(L.partial(0, 1)).alias("partial"))


def _unpivot(panel, horizons=HORIZONS):
    """One row per panel row and horizon, outcome in y."""
    return panel.select("*", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"return_{h}").alias("y")) for h in horizons])).alias("o")).select("*", "o.*").where("y is not null")


_UNPIVOTED = " UNION ALL ".join(f"SELECT *, {h} AS horizon, return_{h} AS y FROM panel WHERE return_{h} IS NOT NULL" for h in HORIZONS)
def _effect_ctes(columns: list[str], source: str = "u") -> str:
    """g, t and w: products by horizon and issuer, of all issuers, and without each issuer (ticker '' stands for all)."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return f"""g AS ({gram_sql(columns, 'horizon', source, 'ticker')}),
t AS (SELECT horizon, sum(n) AS n, {', '.join(f'sum({gram_name(i, j)}) AS {gram_name(i, j)}' for i, j in pairs)} FROM g GROUP BY 1),
w AS (SELECT horizon, '' AS ticker, * EXCLUDE (horizon) FROM t UNION ALL SELECT g.horizon, g.ticker, t.n - g.n, {', '.join(f't.{gram_name(i, j)} - g.{gram_name(i, j)}' for i, j in pairs)} FROM g JOIN t USING (horizon))"""


def _effect_sql(size: int, focus: int) -> str:
    """Coefficient of one regressor once the others are taken out; the outcome is the last column."""
    coef = f"{gram_name(focus, size - 1)} / {gram_name(focus, focus)}"
    return f"""horizon, CAST(max(n) FILTER (WHERE ticker = '') AS BIGINT) AS rows, count(*) FILTER (WHERE ticker <> '') AS issuers, {r(f"max({coef}) FILTER (WHERE ticker = '')")} AS coef, {r(f"min({coef}) FILTER (WHERE ticker <> '')")} AS leave_one_low,
  {r(f"max({coef}) FILTER (WHERE ticker <> '')")} AS leave_one_high FROM {swept_sql('w', 'horizon, ticker', size, [k for k in range(size - 1) if k != focus])} GROUP BY horizon"""


_C4 = [f'"{EVENT}"', *CONTROLS, "y"]


@study("c4_fixed_effects", f"WITH u AS ({_UNPIVOTED}), {_effect_ctes(_C4)} SELECT {_effect_sql(len(_C4), 0)}", "panel")
def c4(spark, folder):
    rows = _unpivot(study_panel(spark, folder))
    out = L.fixed_effects(rows, ["horizon"], "ticker", [EVENT, *CONTROLS], "y", EVENT)
    return out.select("horizon", "rows", "issuers", *[rounded(c).alias(c) for c in ("coef", "leave_one_low", "leave_one_high")])


_C5 = ["recent_a", '"event__2-HIGH"', 'recent_a * "event__2-HIGH"', "y"]


@study("c5_sequence_interaction", f"""
WITH u AS ({_UNPIVOTED}), g AS ({gram_sql(_C5, 'horizon', 'u')})
""" + " UNION ALL ".join(f"SELECT horizon, '{name}' AS name, {r(f'{gram_name(k, 3)} / {gram_name(k, k)}')} AS coef FROM {swept_sql('g', 'horizon', 4, [x for x in range(3) if x != k])}" for k, name in enumerate(["recent_a", "b", "a_b"])), "panel")
def c5(spark, folder):
    second = F.col("`event__2-HIGH`")
    rows = _unpivot(study_panel(spark, folder)).withColumns({"b": second, "a_b": F.col("recent_a") * second})
    grams = L.within(L.products(rows, ["horizon"], ["recent_a", "b", "a_b", "y"]), ["horizon"], 4)
    return L.solve(grams, ["horizon"], ["recent_a", "b", "a_b"]).select("horizon", "name", rounded("coef").alias("coef"))


def early_standardized(panel, names):
    """Columns scaled by the mean and deviation of the first 40 % of sessions (a constant column by one)."""
    cut = panel.agg(F.max("session")).scalar() * 0.4
    early = panel.where(F.col("session") < cut)
    columns = {}
    for n in names:
        spread = F.coalesce(F.nullif(early.agg(F.stddev_samp(n)).scalar(), F.lit(0.0)), F.lit(1.0))
        columns[f"z_{n}"] = (F.col(n) - early.agg(F.avg(n)).scalar()) / spread
    return panel.withColumns(columns)


@study("f13_early_standardize", f"""
WITH e AS (SELECT avg(past_return_5) AS m1, stddev_samp(past_return_5) AS s1, avg(past_vol_20) AS m2, stddev_samp(past_vol_20) AS s2 FROM panel WHERE session < (SELECT max(session) FROM panel) * 0.4::DOUBLE)
SELECT ticker, session, {r('(past_return_5 - m1) / coalesce(nullif(s1, 0), 1)')} AS z_past_return_5, {r('(past_vol_20 - m2) / coalesce(nullif(s2, 0), 1)')} AS z_past_vol_20 FROM panel CROSS JOIN e""", "panel")
def f13(spark, folder):
    out = early_standardized(study_panel(spark, folder), CONTROLS)
    return out.select("ticker", "session", *[rounded(f"z_{n}").alias(f"z_{n}") for n in CONTROLS])


_C6 = ["event", "z1", "z2", "event_x_return", "event_x_vol", "y"]
_Z = "({0} - m{1}) / coalesce(nullif(s{1}, 0), 1)"


@study("c6_event_control_interactions", f"""WITH u0 AS ({_UNPIVOTED}),
e AS (SELECT avg(past_return_5) AS m1, stddev_samp(past_return_5) AS s1, avg(past_vol_20) AS m2, stddev_samp(past_vol_20) AS s2 FROM u0 WHERE session < (SELECT max(session) FROM u0) * 0.4::DOUBLE),
z AS (SELECT horizon, ticker, y, "{EVENT}" AS event, {_Z.format('past_return_5', 1)} AS z1, {_Z.format('past_vol_20', 2)} AS z2 FROM u0 CROSS JOIN e), u AS (SELECT *, event * z1 AS event_x_return, event * z2 AS event_x_vol FROM z),
{_effect_ctes(_C6)} SELECT 'event_x_return' AS focus, {_effect_sql(len(_C6), 3)} UNION ALL SELECT 'event_x_vol', {_effect_sql(len(_C6), 4)}""", "panel")
def c6(spark, folder):
    rows = early_standardized(_unpivot(study_panel(spark, folder)), CONTROLS)
    event = F.col(f"`{EVENT}`")
    rows = rows.withColumns({"event": event, "event_x_return": event * F.col("z_past_return_5"), "event_x_vol": event * F.col("z_past_vol_20")})
    regressors = ["event", "z_past_return_5", "z_past_vol_20", "event_x_return", "event_x_vol"]
    found = None
    for focus in ("event_x_return", "event_x_vol"):
        part = L.fixed_effects(rows, ["horizon"], "ticker", regressors, "y", focus).withColumn("focus", F.lit(focus))
        found = part if found is None else found.unionByName(part)
    return found.select("focus", "horizon", "rows", "issuers", *[rounded(c).alias(c) for c in ("coef", "leave_one_low", "leave_one_high")])


@study("c7_prior_context_grid")
def c7(spark, folder):
    context = label_grid(spark, folder).select(
        F.concat(F.lit("T"), F.substring("issuer", 2, 9)).alias("ticker"), "session", *[Z.prior_flag("b", w, ["issuer"]).alias(f"w{w}") for w in (5, 21)])
    rows = _unpivot(study_panel(spark, folder)).join(context, ["ticker", "session"])
    rows = rows.select("*", F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"w{w}").alias("context")) for w in (5, 21)])).alias("c")).select("*", "c.*").where("context is not null")
    rows = rows.withColumns({"event": F.col(f"`{EVENT}`"), "both": F.col(f"`{EVENT}`") * F.col("context")})
    keys = ["window", "horizon"]
    sides = rows.groupBy(*keys).agg(F.count_if(F.expr("event = 1 and context = 1")).alias("with_context"), F.count_if(F.expr("event = 1 and context = 0")).alias("without_context"))
    out = L.fixed_effects(rows, keys, "ticker", ["event", "context", "both", *CONTROLS], "y", "both").join(sides, keys)
    good = (F.col("with_context") >= 8) & (F.col("without_context") >= 8) & F.col("coef").isNotNull()
    return out.select(*keys, "rows", "issuers", "with_context", "without_context", F.when(good, "measured").otherwise("inconclusive").alias("status"), rounded(F.when(good, F.col("coef"))).alias("coef"))


PAIR_INPUTS = ["past_return_5", "past_return_20", "past_vol_20", "past_log_volume", "market_past_return_5"]


@study("c8_input_relationships", f"""
WITH v AS (SELECT ticker, session, unnest([{', '.join(f"{{'f': '{f}', 'v': {f}}}" for f in PAIR_INPUTS)}]) AS i FROM panel),
p AS (SELECT a.i.f AS feature_a, b.i.f AS feature_b, a.i.v AS x, b.i.v AS y FROM v a JOIN v b ON a.ticker = b.ticker AND a.session = b.session AND a.i.f < b.i.f)
SELECT feature_a, feature_b, n AS rows, {r(corr_sql(), 5)} AS pearson FROM (SELECT feature_a, feature_b, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM p GROUP BY 1, 2)""", "panel")
def c8(spark, folder):
    return input_pairs(study_panel(spark, folder), PAIR_INPUTS).groupBy("feature_a", "feature_b").agg(*E.moment_sums()).select(
        "feature_a", "feature_b", F.col("n").alias("rows"), rounded(E.correlation(), 5).alias("pearson"))


def input_pairs(panel, names):
    """Every ordered pair of inputs of a row, made inside the row."""
    ordered = sorted(names)
    pairs = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(ordered) for b in ordered[i + 1:]]
    return panel.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


@study("c9_matched_response")
def c9(spark, folder):
    rows = complete(spark, folder).select("ticker", "session", "return_5", *NAMES)
    e = rows.select("ticker", "session", F.col("return_5").alias("e_value"), *[F.col(n).alias(f"e_{n}") for n in NAMES])
    c = rows.select("ticker", F.col("session").alias("control_session"), F.col("return_5").alias("c_value"), *[F.col(n).alias(f"c_{n}") for n in NAMES])
    pairs = unique_matches(spark, folder).join(e, ["ticker", "session"]).join(c, ["ticker", "control_session"]).where("e_value is not null and c_value is not null")
    pairs = pairs.withColumn("difference", F.col("e_value") - F.col("c_value")).withColumn("all", F.substring("ticker", 1, 1))
    balance = M.balance(pairs, NAMES, ["all"])
    middle = ordering.quantiles(pairs, ["all"], "difference", {"median": 0.5})
    mean = pairs.groupBy("all").agg(F.avg("difference").alias("mean"))
    joined = balance.join(middle, "all").join(mean, "all")
    return joined.select("pairs", *[rounded(x).alias(x) for x in ("mean", "median", *[f"smd_{n}" for n in NAMES])])


@study("c10_response_modes")
def c10(spark, folder):
    value = features(spark, folder).where("return_5 is not null").select("ticker", "session", "return_5")
    control = value.withColumnsRenamed({"session": "at", "return_5": "c"})
    listed = spaced_matches(spark, folder, DATA_EXCLUSION).select("ticker", "session", F.explode("controls").alias("at")).withColumn("mode", F.lit("ordinary"))
    component = component_matched(spark, folder).select("ticker", "session", F.col("control_session").alias("at"), F.lit("component").alias("mode"))
    base = listed.unionByName(component).join(control, ["ticker", "at"]).groupBy("mode", "ticker", "session").agg(F.avg("c").alias("base"))
    against = base.join(value, ["ticker", "session"]).select("mode", "ticker", "session", (F.col("return_5") - F.col("base")).alias("v"))
    raw = matched(spark, folder).select("ticker", "session").join(value, ["ticker", "session"]).select(F.lit("raw").alias("mode"), "ticker", "session", F.col("return_5").alias("v"))
    rows = against.unionByName(raw)
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("ticker").alias("issuers"), rounded(F.avg("v")).alias("mean"))


@study("c11_regime_contrast", f"""
WITH c AS (SELECT quantile_cont(past_vol_20, 0.5) AS cut FROM panel WHERE session < (SELECT max(session) FROM panel) * 0.4::DOUBLE),
g AS (SELECT CASE WHEN past_vol_20 > cut THEN 'high' ELSE 'low' END AS regime, CAST("event__1-URGENT" AS INTEGER) AS event, return_5 AS y FROM panel CROSS JOIN c WHERE return_5 IS NOT NULL)
SELECT regime, event, count(*) AS rows, {r('avg(y)')} AS mean, {r('avg(CASE WHEN y < -0.02::DOUBLE THEN 1::DOUBLE ELSE 0 END)')} AS tail_probability, {r('quantile_cont(y, 0.5)')} AS median, {r('quantile_cont(y, 0.1)')} AS q10, {r('quantile_cont(y, 0.9)')} AS q90 FROM g GROUP BY 1, 2""", "panel")
def c11(spark, folder):
    panel = study_panel(spark, folder)
    early = panel.where(F.col("session") < panel.agg(F.max("session")).scalar() * 0.4).withColumn("all", F.substring("ticker", 1, 1))
    cut = ordering.quantiles(early, ["all"], "past_vol_20", {"cut": 0.5}).agg(F.max("cut")).scalar()
    rows = panel.where("return_5 is not null").select(F.when(F.col("past_vol_20") > cut, "high").otherwise("low").alias("regime"), F.col(f"`{EVENT}`").cast("int").alias("event"), "return_5")
    out = E.distribution(rows, ["regime", "event"], "return_5", -0.02)
    return out.select("regime", "event", "rows", *[rounded(c).alias(c) for c in ("mean", "tail_probability", "median", "q10", "q90")])


@study("c12_redundancy_components")
def c12(spark, folder):
    """Component loadings of the early window: covariance by Spark, small eigenproblem in the PCA transformer."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    panel = study_panel(spark, folder)
    early = panel.where(F.col("session") < panel.agg(F.max("session")).scalar() * 0.4).select(*PAIR_INPUTS)
    early = snapshot(spark, folder, "early-inputs", lambda s, f: early)
    wide = VectorAssembler(inputCols=PAIR_INPUTS, outputCol="raw").transform(early)
    scaled = StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True).fit(wide).transform(wide)
    model = PCA(k=3, inputCol="z", outputCol="pc").fit(scaled)
    scores = model.transform(scaled).select(vector_to_array("pc").alias("pc"))
    parts = scores.agg(*[F.var_samp(F.get("pc", F.lit(i))).alias(f"v{i}") for i in range(3)], F.count(F.lit(1)).alias("rows"))
    return parts.selectExpr("rows", "stack(3, 1, v0, 2, v1, 3, v2) as (component, variance)").withColumn("explained", rounded(F.col("variance") / len(PAIR_INPUTS))).drop("variance")


view("pairs5", "matched features", """SELECT m.ticker, m.session, e.return_5 - c.return_5 AS difference, year(e.date) AS year FROM matched m JOIN features e ON e.ticker = m.ticker AND e.session = m.session JOIN features c ON c.ticker = m.ticker AND c.session = m.control_session
    WHERE e.return_5 IS NOT NULL AND c.return_5 IS NOT NULL""")


@study("c13_paired_contrast", f"""
WITH s AS (SELECT ticker, sum(difference) AS s, count(*) AS n FROM pairs5 GROUP BY 1), l AS (SELECT (sum(s) OVER () - s) / (sum(n) OVER () - n) AS rest FROM s)
SELECT (SELECT count(*) FROM pairs5) AS pairs, {r('(SELECT avg(difference) FROM pairs5)')} AS mean, {r('(SELECT quantile_cont(difference, 0.5) FROM pairs5)')} AS median, {r('min(rest)')} AS leave_one_low, {r('max(rest)')} AS leave_one_high FROM l""", "pairs5")
def c13(spark, folder):
    """One row, also without a pair. Pairs of one ticker only have no mean without it: not a number, as in SQL."""
    rows = paired(spark, folder).withColumn("all", F.substring("ticker", 1, 1))
    sums = rows.groupBy("all", "ticker").agg(F.sum("difference").alias("s"), F.count(F.lit(1)).alias("n"))
    ends = {c: F.when(F.col("parts") == 1, float("nan")).otherwise(F.col(c)) for c in ("leave_one_low", "leave_one_high")}
    span = E.leave_one_range(sums, ["all"], "s", "n").withColumns(ends)
    middle = ordering.quantiles(rows, ["all"], "difference", {"median": 0.5})
    total = rows.agg(F.count(F.lit(1)).alias("pairs"), F.max("all").alias("all"))
    out = total.join(span, "all", "left").join(middle, "all", "left")
    return out.select("pairs", *[rounded(c).alias(c) for c in ("mean", "median", "leave_one_low", "leave_one_high")])


@study("c14_subgroup_contrast", f"""
WITH g AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM label_grid l WHERE 'T' || substr(l.issuer, 2) = p.ticker AND l.b > 0 AND p.session - l.session BETWEEN 1 AND 5) THEN 1 ELSE 0 END AS context FROM pairs5 p WHERE p.session >= 5)
SELECT count_if(context = 1) AS with_pairs, count_if(context = 0) AS without_pairs, {r('avg(difference) FILTER (WHERE context = 1)')} AS with_mean, {r('avg(difference) FILTER (WHERE context = 0)')} AS without_mean,
  {r('avg(difference) FILTER (WHERE context = 1) - avg(difference) FILTER (WHERE context = 0)')} AS contrast FROM g""", "pairs5 label_grid")
def c14(spark, folder):
    context = label_grid(spark, folder).select(F.concat(F.lit("T"), F.substring("issuer", 2, 9)).alias("ticker"), "session", Z.prior_flag("b", 5, ["issuer"]).alias("context"))
    rows = paired(spark, folder).join(context, ["ticker", "session"]).where("context is not null")
    on, off = F.avg(F.when(F.col("context") == 1, F.col("difference"))), F.avg(F.when(F.col("context") == 0, F.col("difference")))
    return rows.agg(F.count_if(F.expr("context = 1")).alias("with_pairs"), F.count_if(F.expr("context = 0")).alias("without_pairs"), rounded(on).alias("with_mean"), rounded(off).alias("without_mean"), rounded(on - off).alias("contrast"))


@study("c16_conditional_coefficient")
def c16(spark, folder):
    rows = _unpivot(study_panel(spark, folder)).withColumn("event", F.col(f"`{EVENT}`"))
    regressors = ["event", *CONTROLS]
    grams = L.within(L.products(rows, ["horizon"], [*regressors, "y"]), ["horizon"], 4)
    out = L.solve(grams, ["horizon"], regressors, limit=1e6).where("name = 'event'")
    return out.select("horizon", rounded("coef").alias("coef"), F.when(F.col("coef").isNull(), "unsupported_rank_or_conditioning").otherwise("measured").alias("status"), rounded("condition", 3).alias("condition"))


@study("c17_market_model", f"""
WITH d AS (SELECT m.ticker, m.session, m.ret AS y, b.ret AS x FROM moves m JOIN moves b ON b.ticker = 'T4' AND b.session = m.session WHERE m.ticker <> 'T4' AND m.ret IS NOT NULL AND b.ret IS NOT NULL),
s AS (SELECT ticker, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM d GROUP BY 1),
f AS (SELECT *, n * sxx - sx * sx AS det, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS beta FROM s), g AS (SELECT *, (sy - beta * sx) / n AS alpha FROM f),
e AS (SELECT d.ticker, session, y - alpha - beta * x AS s0, (y - alpha - beta * x) * x AS s1 FROM d JOIN g USING (ticker)),
l AS (SELECT ticker, s0 * s0 {' '.join(f'+ 2 * {1 - k / 6}::DOUBLE * s0 * lag(s0, {k}, 0) OVER w' for k in range(1, 6))} AS m00,
  s0 * s1 {' '.join(f'+ {1 - k / 6}::DOUBLE * (s0 * lag(s1, {k}, 0) OVER w + s1 * lag(s0, {k}, 0) OVER w)' for k in range(1, 6))} AS m01,
  s1 * s1 {' '.join(f'+ 2 * {1 - k / 6}::DOUBLE * s1 * lag(s1, {k}, 0) OVER w' for k in range(1, 6))} AS m11 FROM e WINDOW w AS (PARTITION BY ticker ORDER BY session)),
m AS (SELECT ticker, sum(m00) AS m00, sum(m01) AS m01, sum(m11) AS m11 FROM l GROUP BY 1)
SELECT ticker, n AS rows, {r('alpha', 5)} AS alpha, {r('beta', 5)} AS beta, {r('sqrt(greatest(0, (sxx / det) * (sxx / det) * m00 + 2 * (sxx / det) * (-sx / det) * m01 + (sx / det) * (sx / det) * m11))', 5)} AS alpha_error,
  {r('sqrt(greatest(0, (sx / det) * (sx / det) * m00 + 2 * (-sx / det) * (n / det) * m01 + (n / det) * (n / det) * m11))', 5)} AS beta_error FROM g JOIN m USING (ticker)""", "moves")
def c17(spark, folder):
    m = moves(spark, folder)
    joined = P.attach_benchmark(m.where(F.col("ticker") != T.BENCHMARK), m.where(F.col("ticker") == T.BENCHMARK), ["ret"]).where("ret is not null and market_ret is not null")
    out = L.market_model(joined, "ticker", "ret", "market_ret", 5)
    return out.select("ticker", "rows", *[rounded(c, 5).alias(c) for c in ("alpha", "beta", "alpha_error", "beta_error")])


@study("c20_prior_state_pairs", f"""
WITH v AS (SELECT session, date, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS vol FROM moves WHERE ticker = 'T4' WINDOW w AS (ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
c AS (SELECT y.year, quantile_cont(v.vol, 0.5) AS median FROM (SELECT DISTINCT year(date) AS year FROM v) y JOIN v ON year(v.date) < y.year AND v.vol IS NOT NULL GROUP BY 1)
SELECT CASE WHEN median IS NULL OR vol IS NULL THEN 'unknown_prior_year_volatility' WHEN vol > median THEN 'high_volatility' ELSE 'low_volatility' END AS state, count(*) AS pairs, {r('avg(difference)')} AS mean, count_if(difference > 0) AS positive
FROM pairs5 p JOIN v USING (session) LEFT JOIN c ON c.year = year(v.date) GROUP BY 1""", "pairs5 moves")
def c20(spark, folder):
    market = moves(spark, folder).where(F.col("ticker") == T.BENCHMARK).select("session", "date", P.rolling_std(20).alias("vol"))
    cuts = Z.prior_year_cuts(market, "vol", {"median": 0.5})
    states = market.withColumn("year", F.year("date")).join(F.broadcast(cuts), "year", "left").select("session", F.when(
        F.col("median").isNull() | F.col("vol").isNull(), "unknown_prior_year_volatility").when(F.col("vol") > F.col("median"), "high_volatility").otherwise("low_volatility").alias("state"))
    return paired(spark, folder).join(F.broadcast(states), "session").groupBy("state").agg(
        F.count(F.lit(1)).alias("pairs"), rounded(F.avg("difference")).alias("mean"), F.count_if(F.col("difference") > 0).alias("positive"))


@study("r4_coefficient_bootstrap")
def r4(spark, folder):
    """Issuer bootstrap of a fixed-effects coefficient: resampled product matrices, one solve per draw."""
    rows = study_panel(spark, folder).where("return_5 is not null").withColumn("event", F.col(f"`{EVENT}`"))
    columns = ["event", *CONTROLS, "return_5"]
    parts = L.within(L.products(rows, ["ticker"], columns), ["ticker"], len(columns))
    weights = R.cluster_weights(parts, "ticker", DRAWS, SEED)
    grams = L.pooled(parts.join(weights, "ticker"), ["draw"], len(columns), F.col("weight"))
    draws = L.solve(grams, ["draw"], columns[:-1]).where("name = 'event'").select(F.lit("event").alias("name"), F.col("coef").alias("estimate"))
    return R.percentile_interval(draws, ["name"], 40).withColumns({"lower": rounded("lower"), "upper": rounded("upper")})


@study("c22_two_group_contrast")
def c22(spark, folder):
    """Matched differences split by a same-filing label, with floors, tails and doubled costs per group."""
    group = labelled(spark, folder).where("session is not null").groupBy("ticker", "session").agg(F.max(F.array_contains("labels", "Brand#1").cast("int")).alias("group"))
    rows = paired(spark, folder).join(group, ["ticker", "session"])
    counts = rows.groupBy("group").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("ticker").alias("issuers"), F.avg("difference").alias("mean"), F.avg(F.col("difference") - 2 * 0.0006).alias("doubled_cost_mean"))
    tails = ordering.lowest_share_mean(rows, ["group"], "difference", 0.1, "tail_mean")
    good = (F.col("events") >= 8) & (F.col("issuers") >= 3)
    return counts.join(tails, "group").select("group", "events", "issuers", F.when(good, "measured").otherwise("inconclusive").alias("status"), *[rounded(F.when(good, F.col(c))).alias(c) for c in ("mean", "doubled_cost_mean", "tail_mean")])


@study("c23_event_minus_ordinary")
def c23(spark, folder):
    """Mechanism and outcome difference of one study: mean, conditional coefficient and worst decile side by side."""
    rows = complete(spark, folder).where("return_5 is not null").select("ticker", "session", F.col("return_5").alias("y"), "vol20", "return20")
    m = matched(spark, folder)
    both = m.select("ticker", "session", F.lit(1).alias("event")).unionByName(m.select("ticker", F.col("control_session").alias("session"), F.lit(0).alias("event"))).distinct().join(rows, ["ticker", "session"]).withColumn("study", F.substring("ticker", 1, 1))
    grams = L.within(L.products(both, ["study"], ["event", "vol20", "return20", "y"]), ["study"], 4)
    coef = L.solve(grams, ["study"], ["event", "vol20", "return20"], limit=1e8).where("name = 'event'").select("study", "coef")
    means = both.groupBy("study").agg(F.count(F.lit(1)).alias("rows"), (F.avg(F.when(F.col("event") == 1, F.col("y"))) - F.avg(F.when(F.col("event") == 0, F.col("y")))).alias("difference"))
    tails = ordering.lowest_share_mean(both, ["study", "event"], "y", 0.1, "t").groupBy("study").agg((F.max(F.when(F.col("event") == 1, F.col("t"))) - F.max(F.when(F.col("event") == 0, F.col("t")))).alias("tail_difference"))
    return means.join(coef, "study").join(tails, "study").select(F.lit("primary").alias("study"), "rows", *[rounded(c).alias(c) for c in ("difference", "coef", "tail_difference")])
