"""Queries of windows over events and signals, aggregations, and association estimators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import ordering
from tidemark.functions import text as X
from tidemark.functions.scalars import big, counter_draw, ratio, rounded
from tidemark.operators import estimators as E
from tidemark.operators import gates as G
from tidemark.operators import panel as P
from tidemark.operators import series as Z
from tidemark.plans.basics import option_dense
from tidemark.plans.market import CATEGORIES, HORIZONS, aligned, dense, extended_panel, moves, study_panel, sessions, nation_dense
from tidemark.plans.registry import study
from tidemark.plans.sqlviews import draw, r, view
from tidemark.session import snapshot
from tidemark.sources import tables as T

FEATURES = [f"event__{c}" for c in CATEGORIES] + ["sequence_a_before_b"]
LAGS = [0, 1, 5]
TARGETS = [(k, h) for h in HORIZONS for k in ("return", "volatility")]
CELL = ["feature", "lag", "kind", "horizon"]

# ---------------------------------------------------------------- event history windows

view("event_days", "aligned sessions", """SELECT g.ticker, g.category, s.session, coalesce(e.n, 0) AS filings
    FROM (SELECT DISTINCT ticker, category FROM aligned) g CROSS JOIN sessions s
    LEFT JOIN (SELECT ticker, category, session, count(*) AS n FROM aligned WHERE session IS NOT NULL GROUP BY 1, 2, 3) e
      ON e.ticker = g.ticker AND e.category = g.category AND e.session = s.session""")


def event_grid(spark, folder):
    return snapshot(spark, folder, "event-grid", _event_grid)


def _event_grid(spark, folder):
    """Filings per ticker, category and session, zeros included."""
    rows = aligned(spark, folder)
    last = sessions(spark, folder).agg(F.max("session")).scalar()
    grid = rows.select("ticker", "category").distinct().select("*", F.explode(F.sequence(F.lit(0), last)).alias("session"))
    return grid.join(P.event_days(rows), ["ticker", "category", "session"], "left").na.fill(0, ["filings"])


_W = "PARTITION BY ticker, category ORDER BY session"


@study("w9_prior_counts", "SELECT ticker, category, session, " + ", ".join(
    f"CAST(CASE WHEN session >= {w} THEN coalesce(sum(filings) OVER ({_W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 0) END AS BIGINT) AS prior_{w}"
    for w in (5, 21, 63)) + " FROM event_days", "event_days")
def w9(spark, folder):
    return event_grid(spark, folder).select("ticker", "category", "session", *[
        Z.prior_count("filings", w, ["ticker", "category"]).alias(f"prior_{w}") for w in (5, 21, 63)])


@study("w10_prior_flags", "SELECT ticker, category, session, " + ", ".join(
    f"CAST(CASE WHEN session >= {w} THEN coalesce(max(filings > 0) OVER ({_W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), false) END AS INTEGER) AS any_{w}"
    for w in (5, 21, 63)) + f", CAST(coalesce(max(filings > 0) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false) AS INTEGER) AS uncensored_5 FROM event_days", "event_days")
def w10(spark, folder):
    keys = ["ticker", "category"]
    return event_grid(spark, folder).select("ticker", "category", "session", *[
        Z.prior_flag("filings", w, keys).alias(f"any_{w}") for w in (5, 21, 63)], Z.prior_flag("filings", 5, keys, False).alias("uncensored_5"))


@study("w11_recency", f"""
SELECT ticker, category, session, CASE WHEN session >= 63 THEN least(coalesce(session - max(CASE WHEN filings > 0 THEN session END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 64), 64) END AS recency
FROM event_days""", "event_days")
def w11(spark, folder):
    return event_grid(spark, folder).select("ticker", "category", "session", Z.recency("filings", 63, ["ticker", "category"]).alias("recency"))


@study("w12_demeaned", f"SELECT ticker, session, {r('ret - avg(ret) OVER (PARTITION BY ticker)')} AS demeaned FROM moves WHERE ret IS NOT NULL", "moves")
def w12(spark, folder):
    return moves(spark, folder).where("ret is not null").select("ticker", "session", rounded(Z.demeaned("ret", ["ticker"])).alias("demeaned"))


# ---------------------------------------------------------------- signals and trades

view("crossover", "bars", """SELECT *, row_number() OVER w AS bar, CASE WHEN above > 0 AND lag(above) OVER w <= 0 THEN 1 WHEN above < 0 AND lag(above) OVER w >= 0 THEN -1 ELSE 0 END AS signal
    FROM (SELECT *, sign(fast - slow) AS above FROM (SELECT ticker, date, close,
      CASE WHEN count(close) OVER f = 10 THEN avg(close) OVER f END AS fast, CASE WHEN count(close) OVER s = 30 THEN avg(close) OVER s END AS slow
      FROM bars WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), s AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)))
    WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
view("trades", "crossover", """SELECT ticker, date AS entry_date, exit_date, close AS entry_price, exit_price, exit_price - close AS pnl, exit_bar - bar AS bars_held FROM (
    SELECT *, lead(date) OVER w AS exit_date, lead(close) OVER w AS exit_price, lead(bar) OVER w AS exit_bar FROM (
      SELECT *, lag(signal) OVER (PARTITION BY ticker ORDER BY date) AS previous FROM crossover WHERE signal <> 0) WHERE previous IS NULL OR previous <> signal
    WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE signal = 1""")


@study("w13_crossover", f"SELECT ticker, date, {r('fast', 4)} AS fast, {r('slow', 4)} AS slow, signal FROM crossover", "crossover")
def w13(spark, folder):
    return Z.crossover(T.bars(spark, folder), 10, 30).select("ticker", "date", rounded("fast", 4).alias("fast"), rounded("slow", 4).alias("slow"), "signal")


@study("w14_momentum_weights", f"""
WITH m AS (SELECT session, ticker, close / lag(close, 20) OVER (PARTITION BY ticker ORDER BY session) - 1 AS momentum FROM nation_dense),
p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY momentum DESC, ticker) AS place FROM m WHERE session % 21 = 0 AND momentum > 0)
SELECT session, ticker, CAST(place AS INTEGER) AS place, {r('momentum')} AS momentum, {r('least(1::DOUBLE / count(*) OVER (PARTITION BY session), 0.3::DOUBLE)')} AS weight FROM p WHERE place <= 3""", "nation_dense")
def w14(spark, folder):
    return Z.momentum_weights(nation_dense(spark, folder), 20, 3, 0.3, 21).withColumns({"momentum": rounded("momentum"), "weight": rounded("weight")})


@study("w15_drawdown", f"""SELECT ticker, session, {r('close / max(close) OVER (PARTITION BY ticker ORDER BY session) - 1')} AS drawdown, max(close) OVER (PARTITION BY ticker ORDER BY session) AS peak FROM dense""", "dense")
def w15(spark, folder):
    return Z.drawdown(dense(spark, folder), ["ticker"], "close").select("ticker", "session", rounded("drawdown").alias("drawdown"), "peak")


@study("w16_repeat_suppression", """
WITH texts AS (SELECT a.issuer, a.accession, a.session, coalesce(string_agg(l.label, ' ' ORDER BY l.label), '') AS body
  FROM aligned a LEFT JOIN filing_labels l USING (accession) WHERE a.session IS NOT NULL GROUP BY 1, 2, 3),
days AS (SELECT issuer, body, list_sort(list(DISTINCT session)) AS days FROM texts GROUP BY 1, 2),
kept AS (SELECT issuer, body, unnest(list_reduce(list_transform(days, lambda d: [d]), lambda a, b: CASE WHEN b[1] - a[-1] > 63 THEN list_append(a, b[1]) ELSE a END)) AS session FROM days)
SELECT t.accession, CAST(k.session IS NOT NULL AS INTEGER) AS kept FROM texts t LEFT JOIN kept k USING (issuer, body, session)""", "aligned filing_labels")
def w16(spark, folder):
    texts = T.labelled_filings(spark, folder).select("accession", F.array_join("labels", " ").alias("body"))
    rows = aligned(spark, folder).where("session is not null").join(texts, "accession")
    return Z.suppress_repeats(rows, ["issuer", "body"], 63).select("accession", F.col("kept").cast("int").alias("kept"))


@study("w17_paired_trades", f"SELECT ticker, entry_date, exit_date, {r('pnl', 4)} AS pnl, CAST(bars_held AS INTEGER) AS bars_held FROM trades", "trades")
def w17(spark, folder):
    return trades(spark, folder).select("ticker", "entry_date", "exit_date", rounded("pnl", 4).alias("pnl"), "bars_held")


def trades(spark, folder):
    return Z.paired_trades(Z.crossover(T.bars(spark, folder), 10, 30))


@study("a27_trade_summary", f"""
WITH c AS (SELECT *, sum(pnl) OVER w AS total FROM trades WHERE exit_date IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY exit_date, entry_date)),
d AS (SELECT *, greatest(max(total) OVER (PARTITION BY ticker ORDER BY exit_date, entry_date), 0::DOUBLE) - total AS drop FROM c)
SELECT ticker, count(*) AS trades, count_if(pnl > 0) AS won, count_if(pnl <= 0) AS lost, {r('avg(CASE WHEN pnl > 0 THEN 1::DOUBLE ELSE 0 END)')} AS win_rate, {r('sum(pnl)', 3)} AS net_pnl, {r('max(drop)', 3)} AS max_drawdown
FROM d GROUP BY 1""", "trades")
def a27(spark, folder):
    return Z.trade_summary(trades(spark, folder)).withColumns({"win_rate": rounded("win_rate"), "net_pnl": rounded("net_pnl", 3), "max_drawdown": rounded("max_drawdown", 3)})


@study("w18_prior_year_state", f"""
WITH v AS (SELECT session, date, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS vol FROM moves WHERE ticker = 'T4' WINDOW w AS (ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
c AS (SELECT y.year, quantile_cont(v.vol, 0.5) AS median, quantile_cont(v.vol, 1/3::DOUBLE) AS low, quantile_cont(v.vol, 2/3::DOUBLE) AS high
  FROM (SELECT DISTINCT year(date) AS year FROM v) y JOIN v ON year(v.date) < y.year AND v.vol IS NOT NULL GROUP BY 1)
SELECT session, {r('vol')} AS vol, CASE WHEN median IS NULL THEN 'unknown_prior_year_volatility' WHEN vol IS NULL THEN NULL WHEN vol > median THEN 'high_volatility' ELSE 'low_volatility' END AS state,
  CASE WHEN vol <= low THEN 1 WHEN vol <= high THEN 2 WHEN vol > high THEN 3 END AS tercile FROM v LEFT JOIN c ON c.year = year(v.date)""", "moves")
def w18(spark, folder):
    market = moves(spark, folder).where(F.col("ticker") == T.BENCHMARK).select("session", "date", P.rolling_std(20).alias("vol"))
    cuts = Z.prior_year_cuts(market, "vol", {"median": 0.5, "low": 1 / 3, "high": 2 / 3})
    rows = market.withColumn("year", F.year("date")).join(F.broadcast(cuts), "year", "left")
    state = F.when(F.col("median").isNull(), "unknown_prior_year_volatility").when(F.col("vol") > F.col("median"), "high_volatility").when(
        F.col("vol").isNotNull(), "low_volatility")
    tercile = F.when(F.col("vol") <= F.col("low"), 1).when(F.col("vol") <= F.col("high"), 2).when(F.col("vol") > F.col("high"), 3)
    return rows.select("session", rounded("vol").alias("vol"), state.alias("state"), tercile.alias("tercile"))


@study("w19_buffer_dates", """
SELECT a.accession, b.buffer, s.date AS observation_date FROM aligned a CROSS JOIN (VALUES (0), (1), (3), (5)) b(buffer) LEFT JOIN sessions s ON s.session = a.session + b.buffer WHERE a.session IS NOT NULL""", "aligned")
def w19(spark, folder):
    rows = aligned(spark, folder).where("session is not null").select("accession", "session", F.explode(F.array(*[F.lit(b) for b in (0, 1, 3, 5)])).alias("buffer"))
    days = sessions(spark, folder).select(F.col("session").alias("at"), F.col("date").alias("observation_date"))
    return rows.withColumn("at", F.col("session") + F.col("buffer")).join(P.calendar(days), "at", "left").select("accession", "buffer", "observation_date")


# ---------------------------------------------------------------- cells

def _cells_sql() -> str:
    w = "(PARTITION BY ticker ORDER BY session)"
    lagged = []
    for i, f in enumerate(FEATURES):
        for k in LAGS:
            expr = f'"{f}"' if k == 0 else f'CASE WHEN session - lag(session, {k}) OVER {w} = {k} THEN lag("{f}", {k}) OVER {w} END'
            lagged.append(f"CAST({expr} AS DOUBLE) AS x{i}_{k}")
    inputs = ", ".join(f"{{'feature': '{f}', 'lag': {k}, 'x': x{i}_{k}}}" for i, f in enumerate(FEATURES) for k in LAGS)
    outputs = ", ".join(f"{{'kind': '{k}', 'horizon': {h}, 'y': {k}_{h}}}" for k, h in TARGETS)
    return f"""SELECT ticker, date, session, i.feature, i.lag, o.kind, o.horizon, i.x, o.y FROM (
      SELECT ticker, date, session, i, unnest([{outputs}]) AS o FROM (SELECT *, unnest([{inputs}]) AS i FROM (SELECT *, {', '.join(lagged)} FROM panel)))
    WHERE i.x IS NOT NULL AND o.y IS NOT NULL"""


view("cells", "panel", _cells_sql())
_N = "count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy"


def corr_sql(n="n", sx="sx", sy="sy", sxx="sxx", syy="syy", sxy="sxy") -> str:
    vx, vy = f"({sxx} - {sx} * {sx} / {n})", f"({syy} - {sy} * {sy} / {n})"
    return f"CASE WHEN {n} >= 3 AND {vx} > 0 AND {vy} > 0 THEN ({sxy} - {sx} * {sy} / {n}) / sqrt({vx} * {vy}) END"


def long(spark, folder, features=FEATURES, lags=LAGS, targets=TARGETS):
    return E.long_cells(study_panel(spark, folder), features, lags, targets)


def flag_rows(spark, folder):
    """The zero-lag five-session return cells, written once for the rank-based estimators."""
    return snapshot(spark, folder, "flag-rows", lambda s, f: long(s, f, lags=[0], targets=[("return", 5), ("volatility", 5)]))


@study("a1_pair_moments", f"""
SELECT feature, lag, kind, horizon, ticker, n, {r('sx', 3)} AS sx, {r('sy', 3)} AS sy, {r('sxx', 3)} AS sxx, {r('syy', 3)} AS syy, {r('sxy', 3)} AS sxy
FROM (SELECT feature, lag, kind, horizon, ticker, {_N} FROM cells GROUP BY ALL)""", "cells")
def a1(spark, folder):
    sums = long(spark, folder).groupBy(*CELL, "ticker").agg(*E.moment_sums())
    return sums.select(*CELL, "ticker", "n", *[rounded(m, 3).alias(m) for m in E.MOMENTS[1:]])


@study("a2_pearson", f"SELECT feature, lag, kind, horizon, n AS rows, {r(corr_sql())} AS pearson FROM (SELECT feature, lag, kind, horizon, {_N} FROM cells GROUP BY ALL)", "cells")
def a2(spark, folder):
    sums = long(spark, folder).groupBy(*CELL).agg(*E.moment_sums())
    return sums.select(*CELL, F.col("n").alias("rows"), rounded(E.correlation()).alias("pearson"))


@study("a3_spearman", f"""
WITH k AS (SELECT feature, lag, kind, horizon, rank() OVER (PARTITION BY feature, lag, kind, horizon ORDER BY x) + (count(*) OVER (PARTITION BY feature, lag, kind, horizon, x) - 1) / 2 AS x,
  rank() OVER (PARTITION BY feature, lag, kind, horizon ORDER BY y) + (count(*) OVER (PARTITION BY feature, lag, kind, horizon, y) - 1) / 2 AS y FROM cells)
SELECT feature, lag, kind, horizon, {r(corr_sql())} AS spearman FROM (SELECT feature, lag, kind, horizon, {_N} FROM k GROUP BY ALL)""", "cells")
def a3(spark, folder):
    return E.spearman(long(spark, folder), CELL).withColumn("spearman", rounded("spearman"))


@study("a4_within_date", f"""
WITH d AS (SELECT feature, lag, kind, horizon, date, {_N} FROM cells GROUP BY ALL)
SELECT feature, lag, kind, horizon, {r(f'avg({corr_sql()})')} AS within_date, count({corr_sql()}) AS supported_dates FROM d GROUP BY ALL""", "cells")
def a4(spark, folder):
    days = long(spark, folder).groupBy(*CELL, "date").agg(*E.moment_sums()).withColumn("r", E.correlation())
    return days.groupBy(*CELL).agg(rounded(F.avg("r")).alias("within_date"), F.count("r").alias("supported_dates"))


GATED = f"""
WITH k AS (SELECT feature, lag, kind, horizon, rank() OVER (PARTITION BY feature, lag, kind, horizon ORDER BY x) + (count(*) OVER (PARTITION BY feature, lag, kind, horizon, x) - 1) / 2 AS x,
  rank() OVER (PARTITION BY feature, lag, kind, horizon ORDER BY y) + (count(*) OVER (PARTITION BY feature, lag, kind, horizon, y) - 1) / 2 AS y FROM cells),
q AS (SELECT feature, lag, kind, horizon, {corr_sql()} AS spearman FROM (SELECT feature, lag, kind, horizon, {_N} FROM k GROUP BY ALL)),
d AS (SELECT feature, lag, kind, horizon, date, {_N} FROM cells GROUP BY ALL),
w AS (SELECT feature, lag, kind, horizon, avg({corr_sql()}) AS within_date FROM d GROUP BY ALL),
c AS (SELECT feature, lag, kind, horizon, {_N}, count(DISTINCT date) AS dates, count(DISTINCT ticker) AS issuers, count_if(x <> 0) AS positive_rows,
  count(DISTINCT CASE WHEN x <> 0 THEN ticker END) AS positive_issuers, count(DISTINCT CASE WHEN x <> 0 THEN date END) AS positive_dates, min(x) < max(x) AND min(y) < max(y) AS varies FROM cells GROUP BY ALL),
g AS (SELECT f.feature, l.lag, k.kind, h.horizon FROM (VALUES {', '.join(f"('{f}')" for f in FEATURES)}) f(feature), (VALUES (0), (1), (5)) l(lag), (VALUES ('return'), ('volatility')) k(kind), (VALUES (1), (5), (21)) h(horizon)),
s AS (SELECT g.*, coalesce(c.n, 0) AS rows, coalesce(dates, 0) AS dates, coalesce(issuers, 0) AS issuers, coalesce(positive_rows, 0) AS positive_rows, coalesce(positive_issuers, 0) AS positive_issuers, coalesce(positive_dates, 0) AS positive_dates,
  CASE WHEN coalesce(c.n, 0) < 60 OR NOT coalesce(varies, false) THEN 'Too few rows or no feature/target variation' WHEN positive_rows < 8 OR positive_issuers < 3 THEN 'Insufficient event/issuer support' END AS reason, {corr_sql('c.n')} AS pearson, within_date
  FROM g LEFT JOIN c USING (feature, lag, kind, horizon) LEFT JOIN w USING (feature, lag, kind, horizon))
SELECT feature, lag, kind, horizon, rows, dates, issuers, positive_rows, positive_issuers, positive_dates, reason, {r('CASE WHEN reason IS NULL THEN spearman END')} AS spearman, CASE WHEN reason IS NULL THEN 'measured' ELSE 'inconclusive' END AS status,
  {r('CASE WHEN reason IS NULL THEN pearson END')} AS pearson, {r('CASE WHEN reason IS NULL THEN within_date END')} AS within_date FROM s LEFT JOIN q USING (feature, lag, kind, horizon)"""


def planned_cells(spark, features, lags, targets):
    """Every planned cell, so that thin ones are reported too."""
    def each(values, name):
        return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    grid = spark.range(1).select(each(features, "feature"))
    grid = grid.select("*", each(lags, "lag"))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(h).alias("horizon")) for k, h in targets]))
    return grid.select("*", pairs.alias("t")).select("feature", "lag", "t.kind", "t.horizon")


@study("c1_lag_horizon_map", GATED, "cells")
def c1(spark, folder):
    cells = E.cell_table(long(spark, folder), CELL)
    grid = planned_cells(spark, FEATURES, LAGS, TARGETS)
    full = grid.join(cells, CELL, "left").join(E.spearman(long(spark, folder), CELL), CELL, "left").na.fill(0, ["rows", "dates", "issuers", "positive_rows", "positive_issuers", "positive_dates"])
    gated = G.support_gate(full)
    shown = [rounded(F.when(F.col("status") == "measured", F.col(c))).alias(c) for c in ("pearson", "within_date", "spearman")]
    return gated.select(*CELL, "rows", "dates", "issuers", "positive_rows", "positive_issuers", "positive_dates", "reason", "status", *shown)


# ---------------------------------------------------------------- grouped statistics

@study("a5_event_regime_statistics", f"""
SELECT CAST("event__1-URGENT" AS INTEGER) AS event, CASE WHEN market_past_return_5 > 0 THEN 'rising' ELSE 'falling' END AS regime, count(*) AS rows, {r('avg(return_5)')} AS mean,
  {r('avg(CASE WHEN return_5 < -0.02::DOUBLE THEN 1::DOUBLE ELSE 0 END)')} AS tail_probability, {r('quantile_cont(return_5, 0.5)')} AS median, {r('quantile_cont(return_5, 0.1)')} AS q10, {r('quantile_cont(return_5, 0.9)')} AS q90
FROM panel WHERE return_5 IS NOT NULL GROUP BY 1, 2""", "panel")
def a5(spark, folder):
    rows = study_panel(spark, folder).where("return_5 is not null").select(
        F.col("`event__1-URGENT`").cast("int").alias("event"), F.when(F.col("market_past_return_5") > 0, "rising").otherwise("falling").alias("regime"), "return_5")
    out = E.distribution(rows, ["event", "regime"], "return_5", -0.02)
    return out.select("event", "regime", "rows", *[rounded(c).alias(c) for c in ("mean", "tail_probability", "median", "q10", "q90")])


@study("a6_tail_probability", f"""
SELECT feature, horizon, {r('avg(CASE WHEN y < -0.02::DOUBLE THEN 1::DOUBLE ELSE 0 END)')} AS tail_probability, count(*) AS rows FROM cells WHERE kind = 'return' AND lag = 0 AND x <> 0 GROUP BY 1, 2""", "cells")
def a6(spark, folder):
    rows = long(spark, folder, lags=[0], targets=[("return", h) for h in HORIZONS]).where("x <> 0")
    return rows.groupBy("feature", "horizon").agg(rounded(F.avg((F.col("y") < -0.02).cast("double"))).alias("tail_probability"), F.count(F.lit(1)).alias("rows"))


@study("a7_worst_decile", f"""
WITH k AS (SELECT ticker, return_5, row_number() OVER (PARTITION BY ticker ORDER BY return_5) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM panel WHERE return_5 IS NOT NULL)
SELECT ticker, {r('avg(return_5) FILTER (WHERE k <= ceil(0.1::DOUBLE * n))')} AS worst_decile_mean, {r('quantile_cont(return_5, 0.1)')} AS q10 FROM k GROUP BY 1""", "panel")
def a7(spark, folder):
    rows = study_panel(spark, folder).where("return_5 is not null").select("ticker", "return_5")
    low = ordering.lowest_share_mean(rows, ["ticker"], "return_5", 0.1, "worst_decile_mean")
    q = ordering.quantiles(rows, ["ticker"], "return_5", {"q10": 0.1})
    return low.join(q, "ticker").select("ticker", rounded("worst_decile_mean").alias("worst_decile_mean"), rounded("q10").alias("q10"))


@study("a8_filing_rollup", """
SELECT f.issuer, f.accession, array_to_string(list_sort(list_distinct(list(l.label) FILTER (WHERE l.label IS NOT NULL))), '|') AS labels, min(f.filing_date) AS first_date
FROM filings f LEFT JOIN filing_labels l USING (accession) GROUP BY 1, 2""", "filings filing_labels")
def a8(spark, folder):
    rows = T.filings(spark, folder).join(T.filing_labels(spark, folder), "accession", "left")
    rolled = rows.groupBy("issuer", "accession").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.min("filing_date").alias("first_date"))
    return rolled.select("issuer", "accession", F.when(F.size("labels") > 0, F.array_join("labels", "|")).alias("labels"), "first_date")


@study("a9_category_coverage", "SELECT t.label, " + ", ".join(f"count_if(year(f.filing_date) = {y}) AS y{y}" for y in range(1995, 2002)) + """, count(f.accession) AS filings
FROM (SELECT DISTINCT p_brand AS label FROM part UNION ALL SELECT 'Brand#none') t LEFT JOIN filing_labels l USING (label) LEFT JOIN filings f USING (accession) GROUP BY 1""", "filings filing_labels")
def a9(spark, folder):
    taxonomy = T.table(spark, folder, "part").select(F.col("p_brand").alias("label")).distinct().unionByName(
        spark.range(1).select(F.lit("Brand#none").alias("label")))
    counted = T.filing_labels(spark, folder).join(T.filings(spark, folder).select("accession", F.year("filing_date").alias("year")), "accession").groupBy("label", "year").agg(
        F.count(F.lit(1)).alias("n"))
    return taxonomy.join(counted, "label", "left").groupBy("label").agg(
        *[F.coalesce(F.sum(F.when(F.col("year") == y, F.col("n"))), F.lit(0)).alias(f"y{y}") for y in range(1995, 2002)], F.coalesce(F.sum("n"), F.lit(0)).alias("filings"))


@study("a10_quality_profile", """
SELECT strftime(date, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT ticker) AS tickers, count_if(close IS NULL) AS missing_bars, count_if(ret IS NULL) AS missing_returns FROM moves GROUP BY 1""", "moves")
def a10(spark, folder):
    return moves(spark, folder).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("tickers"), F.count_if(F.col("close").isNull()).alias("missing_bars"), F.count_if(F.col("ret").isNull()).alias("missing_returns"))


@study("a11_status_rollup", GATED.rsplit("SELECT", 1)[0] + """
SELECT kind AS study, CASE WHEN reason IS NULL THEN 'measured' ELSE 'inconclusive' END AS status, count(*) AS cells FROM s GROUP BY ROLLUP (kind, CASE WHEN reason IS NULL THEN 'measured' ELSE 'inconclusive' END)""", "cells")
def a11(spark, folder):
    return c1(spark, folder).withColumnRenamed("kind", "study").rollup("study", "status").agg(F.count(F.lit(1)).alias("cells"))


@study("a14_issuer_equal_mean", f"SELECT feature, horizon, {r('avg(m)')} AS issuer_equal_mean FROM (SELECT feature, horizon, ticker, avg(y) AS m FROM cells WHERE kind = 'return' AND lag = 0 AND x <> 0 GROUP BY 1, 2, 3) GROUP BY 1, 2", "cells")
def a14(spark, folder):
    rows = long(spark, folder, lags=[0], targets=[("return", h) for h in HORIZONS]).where("x <> 0")
    return rows.groupBy("feature", "horizon", "ticker").agg(F.avg("y").alias("m")).groupBy("feature", "horizon").agg(rounded(F.avg("m")).alias("issuer_equal_mean"))


@study("a15_leave_one_out", f"""
WITH s AS (SELECT feature, horizon, ticker, sum(y) AS s, count(*) AS n FROM cells WHERE kind = 'return' AND lag = 0 AND x <> 0 GROUP BY 1, 2, 3),
l AS (SELECT *, CASE WHEN sum(n) OVER c - n > 0 THEN (sum(s) OVER c - s) / (sum(n) OVER c - n) END AS rest FROM s WINDOW c AS (PARTITION BY feature, horizon))
SELECT feature, horizon, {r('sum(s) / sum(n)')} AS mean, {r('min(rest)')} AS leave_one_low, {r('max(rest)')} AS leave_one_high, count(*) AS parts FROM l GROUP BY 1, 2""", "cells")
def a15(spark, folder):
    rows = long(spark, folder, lags=[0], targets=[("return", h) for h in HORIZONS]).where("x <> 0")
    sums = rows.groupBy("feature", "horizon", "ticker").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    out = E.leave_one_range(sums, ["feature", "horizon"], "s", "n")
    return out.select("feature", "horizon", *[rounded(c).alias(c) for c in ("mean", "leave_one_low", "leave_one_high")], "parts")


@study("a16_weighted_mean", f"SELECT issuer, year(date) AS year, {r('sum(weight * return_1) / sum(weight)')} AS weighted_mean, count(*) AS rows FROM extended WHERE return_1 IS NOT NULL GROUP BY 1, 2", "extended")
def a16(spark, folder):
    rows = extended_panel(spark, folder).where("return_1 is not null")
    mean = F.sum(F.col("weight") * F.col("return_1")) / F.sum("weight")
    return rows.groupBy("issuer", F.year("date").cast("bigint").alias("year")).agg(rounded(mean).alias("weighted_mean"), F.count(F.lit(1)).alias("rows"))


@study("a17_distinct_support", "SELECT category, count(DISTINCT (issuer, session)) AS activations, count(DISTINCT issuer) AS issuers, count(DISTINCT session) AS dates FROM aligned WHERE session IS NOT NULL GROUP BY 1", "aligned")
def a17(spark, folder):
    days = P.event_days(aligned(spark, folder), ["issuer", "category"])
    return days.groupBy("category").agg(F.count(F.lit(1)).alias("activations"), F.count_distinct("issuer").alias("issuers"), F.count_distinct("session").alias("dates"))


@study("a18_label_phi", f"""
WITH m AS (SELECT label, count(*) AS k FROM filing_labels GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM filings),
p AS (SELECT a.label AS first, b.label AS second, count(*) AS together FROM filing_labels a JOIN filing_labels b ON a.accession = b.accession AND a.label < b.label GROUP BY 1, 2)
SELECT x.label AS first, y.label AS second, coalesce(together, 0) AS together, {r('(n * coalesce(together, 0) - x.k * y.k) / sqrt(CAST(x.k AS DOUBLE) * y.k * (n - x.k) * (n - y.k))')} AS phi FROM m x JOIN m y ON x.label < y.label LEFT JOIN p ON p.first = x.label AND p.second = y.label CROSS JOIN n""", "filings filing_labels")
def a18(spark, folder):
    total = T.filings(spark, folder).agg(F.count(F.lit(1))).scalar()
    return E.label_phi(T.filing_labels(spark, folder), total).withColumn("phi", rounded("phi"))


@study("a20_outcome_dedup", """
SELECT l_orderkey, l_linenumber, count(*) AS copies, CASE WHEN count(DISTINCT (l_partkey, l_extendedprice)) > 1 THEN 'conflict' ELSE 'unique' END AS result FROM lineitem GROUP BY 1, 2""")
def a20(spark, folder):
    body = F.sha2(F.to_json(F.struct("l_extendedprice", "l_partkey")), 256)
    return T.table(spark, folder, "lineitem").withColumn("h", body).groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("copies"), F.when(F.min("h") < F.max("h"), "conflict").otherwise("unique").alias("result"))


@study("a19_alias_patterns", """
WITH two AS (SELECT a.accession, a.label || '&' || b.label AS combo, b.label AS last FROM filing_labels a JOIN filing_labels b ON a.accession = b.accession AND a.label < b.label),
three AS (SELECT t.accession, combo || '&' || label AS combo, label AS last FROM two t JOIN filing_labels l ON l.accession = t.accession AND label > last),
four AS (SELECT t.accession, combo || '&' || label AS combo, label AS last FROM three t JOIN filing_labels l ON l.accession = t.accession AND label > last),
sets AS (SELECT * FROM two UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four),
p AS (SELECT combo || '@' || f.category || '@' || f.issuer AS pattern, string_agg(accession::VARCHAR, ',' ORDER BY accession) AS rows, count(*) AS support FROM sets JOIN filings f USING (accession) GROUP BY 1),
g AS (SELECT rows, support, count(*) AS patterns, min(pattern) AS first_pattern FROM p GROUP BY 1, 2)
SELECT first_pattern, patterns, support FROM g WHERE patterns > 1""", "filings filing_labels")
def a19(spark, folder):
    sets = F.concat(*[X.combinations(F.col("labels"), k) for k in (2, 3, 4)])
    rows = T.labelled_filings(spark, folder).where(F.size("labels") > 1).select("category", "issuer", sets.alias("sets"), *row_draws("accession"))
    return alias_groups(rows.select(F.explode("sets").alias("combo"), "category", "issuer", *DRAWS), ["combo", "category", "issuer"])


DRAWS = ["_a", "_b", "_c"]


def row_draws(row: str):
    """Independent 32-bit draws of a row, taken once for all of its patterns."""
    return [counter_draw(i, row).alias(n) for i, n in enumerate(DRAWS, 1)]


def alias_groups(activations, pattern: list[str]):
    """Patterns active on exactly the same rows, by an order-free fingerprint of the rows' draws.

    Two sums and an exclusive-or of independent 32-bit draws merge like any
    other partial aggregate, so no activation set is ever collected. A pattern's
    text is written once, after its rows are added.
    """
    marks = activations.groupBy(*pattern).agg(F.count(F.lit(1)).alias("support"), F.sum("_a").alias("a"), F.sum("_b").alias("b"), F.bit_xor("_c").alias("c"))
    groups = marks.groupBy("support", "a", "b", "c").agg(F.count(F.lit(1)).alias("patterns"), F.min(F.concat_ws("@", *pattern)).alias("first_pattern"))
    return groups.where("patterns > 1").select("first_pattern", "patterns", "support")


MI_CELLS = ["feature"]


@study("a21_mutual_information", f"""
WITH c AS (SELECT feature, x, y FROM cells WHERE lag = 0 AND kind = 'return' AND horizon = 5),
q AS (SELECT feature, {', '.join(f'quantile_cont(y, {i}/8::DOUBLE) AS q{i}' for i in range(1, 8))} FROM c GROUP BY 1),
b AS (SELECT feature, x, {' + '.join(f'CAST(y > q{i} AS INTEGER)' for i in range(1, 8))} AS bin FROM c JOIN q USING (feature)),
j AS (SELECT feature, x, bin, count(*) AS nxy FROM b GROUP BY ALL),
m AS (SELECT *, sum(nxy) OVER (PARTITION BY feature, x)::DOUBLE AS nx, sum(nxy) OVER (PARTITION BY feature, bin)::DOUBLE AS ny, sum(nxy) OVER (PARTITION BY feature)::DOUBLE AS n FROM j)
SELECT feature, CAST(max(n) AS BIGINT) AS rows, {r('sum(nxy / n * ln(nxy * n / (nx * ny)))')} AS mutual_information FROM m GROUP BY 1""", "cells")
def a21(spark, folder):
    rows = flag_rows(spark, folder).where("kind = 'return'")
    return E.mutual_information(rows, ["feature"], "x", "y", 8).withColumn("mutual_information", rounded("mutual_information"))


@study("a22_distance_correlation", f"""
WITH c AS (SELECT feature, x, y, row_number() OVER (PARTITION BY feature ORDER BY y) AS k, sum(y) OVER (PARTITION BY feature ORDER BY y ROWS UNBOUNDED PRECEDING) AS p, count(*) OVER (PARTITION BY feature) AS n,
  sum(y) OVER (PARTITION BY feature) AS t, row_number() OVER (PARTITION BY feature, x ORDER BY y) AS kx, count(*) OVER (PARTITION BY feature, x) AS nx FROM cells WHERE lag = 0 AND kind = 'return' AND horizon = 5),
b AS (SELECT *, (y * k - p + (t - p) - y * (n - k)) / n AS b FROM c),
s AS (SELECT feature, max(n)::DOUBLE AS n, count_if(x <> 0)::DOUBLE AS n1, count_if(x = 0)::DOUBLE AS n0, sum(2 * y * (2 * k - n - 1)) AS allp, sum(2 * y * (2 * kx - nx - 1)) AS within, sum(b * b) AS bb, sum(y) AS sy, sum(y * y) AS syy,
  sum(CASE WHEN x <> 0 THEN b END) AS b1, sum(CASE WHEN x = 0 THEN b END) AS b0 FROM b GROUP BY 1),
v AS (SELECT feature, n, n1, n0, 2 * n1 * n0 / (n * n) AS ma, allp / (n * n) AS mb, (allp - within) / (n * n) - 2 * (n0 * b1 + n1 * b0) / (n * n) AS cross_part,
  2 * n1 * n0 / (n * n) - 2 * (n1 * n0 * n0 + n0 * n1 * n1) / (n * n * n) AS va, (2 * n * syy - 2 * sy * sy) / (n * n) - 2 * bb / n AS vb FROM s)
SELECT feature, CAST(n AS BIGINT) AS rows, {r('CASE WHEN n1 >= 4 AND n0 >= 4 THEN sqrt(greatest(0::DOUBLE, cross_part + ma * mb) / sqrt((va + ma * ma) * (vb + mb * mb))) END', 5)} AS distance_correlation FROM v""", "cells")
def a22(spark, folder):
    rows = flag_rows(spark, folder).where("kind = 'return'")
    return E.flag_distance_correlation(rows, ["feature"], "x", "y").select("feature", big("rows").alias("rows"), rounded("distance_correlation", 5).alias("distance_correlation"))


@study("a23_split_feasibility", """
WITH v AS (SELECT category, filings AS value FROM event_days), c AS (SELECT category, value, count(*) AS c FROM v GROUP BY 1, 2),
k AS (SELECT *, sum(c) OVER (PARTITION BY category ORDER BY value) AS l, sum(c) OVER (PARTITION BY category) AS n FROM c)
SELECT category, CAST(max(n) AS BIGINT) AS rows, count(*) AS levels, count_if(l >= 300 AND n - l >= 300) AS thresholds, CAST(max(CASE WHEN l >= 300 AND n - l >= 300 THEN 1 ELSE 0 END) AS INTEGER) AS feasible FROM k GROUP BY 1""", "event_days")
def a23(spark, folder):
    return E.split_feasibility(event_grid(spark, folder).withColumnRenamed("filings", "value"), ["category"], "value", 300)


@study("a24_constant_features", """
SELECT ticker, feature, count(DISTINCT x) AS levels, CAST(count(DISTINCT x) <= 1 AS INTEGER) AS constant FROM cells WHERE lag = 0 AND kind = 'return' AND horizon = 1 GROUP BY 1, 2""", "cells")
def a24(spark, folder):
    rows = long(spark, folder, lags=[0], targets=[("return", 1)])
    return rows.groupBy("ticker", "feature").agg(F.count_distinct("x").alias("levels"), (F.count_distinct("x") <= 1).cast("int").alias("constant"))


@study("a25_coverage_cube", """
SELECT ticker, leg, CASE WHEN bid_size >= 25 THEN 'large' ELSE 'small' END AS size_class, count(*) AS quotes FROM quotes GROUP BY CUBE (ticker, leg, CASE WHEN bid_size >= 25 THEN 'large' ELSE 'small' END)""", "quotes")
def a25(spark, folder):
    rows = T.quotes(spark, folder).withColumn("size_class", F.when(F.col("bid_size") >= 25, "large").otherwise("small"))
    return rows.cube("ticker", "leg", "size_class").agg(F.count(F.lit(1)).alias("quotes"))


@study("a26_quote_audit", f"""
WITH s AS (SELECT ticker, leg, (ask - bid) / ((ask + bid) / 2) AS spread FROM quotes)
SELECT ticker, leg, {r('quantile_cont(spread, 0.5)')} AS median, {r('quantile_cont(spread, 0.9)')} AS p90, {r('max(spread)')} AS max_spread FROM s GROUP BY 1, 2""", "quotes")
def a26(spark, folder):
    rows = T.quotes(spark, folder).select("ticker", "leg", ratio(F.col("ask") - F.col("bid"), (F.col("ask") + F.col("bid")) / 2).alias("spread"))
    out = ordering.quantiles(rows, ["ticker", "leg"], "spread", {"median": 0.5, "p90": 0.9, "max_spread": 1.0})
    return out.select("ticker", "leg", *[rounded(c).alias(c) for c in ("median", "p90", "max_spread")])


@study("a28_capacity_grid", f"""
WITH v AS (SELECT ticker, session, avg(call_volume) OVER w AS adv, count(call_volume) OVER w AS n, call_volume FROM option_dense WINDOW w AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT ticker, session, p AS participation, {r('CASE WHEN n = 5 THEN floor(adv * p) END')} AS volume_units, {r('CASE WHEN n = 5 THEN least(floor(adv * p), call_volume) END')} AS displayed_units, {r('sqrt(p)')} AS impact_proxy
FROM v CROSS JOIN (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS p) WHERE session >= 4""", "option_dense")
def a28(spark, folder):
    rows = option_dense(spark, folder).select("ticker", "session", "call_volume", P.full_frame("call_volume", F.avg, -4, 0).alias("adv")).where("session >= 4")
    grid = rows.select("*", F.explode(F.array(F.lit(0.01), F.lit(0.05), F.lit(0.1))).alias("participation"))
    units = F.floor(F.col("adv") * F.col("participation")).cast("double")
    return grid.select("ticker", "session", "participation", units.alias("volume_units"), F.when(F.col("adv").isNotNull(), F.least(units, "call_volume")).alias("displayed_units"),
                       rounded(F.sqrt("participation")).alias("impact_proxy"))
