"""Queries of the panel group: grid, alignment, rolling state and forward outcomes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import big, flag, ratio, rounded
from tidemark.operators import panel as P
from tidemark.plans.registry import study
from tidemark.plans.sqlviews import r, view
from tidemark.session import snapshot
from tidemark.sources import tables as T

HORIZONS = [1, 5, 21]
CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def sessions(spark, folder):
    """The numbered trading days, read once from the source."""
    return snapshot(spark, folder, "sessions", T.sessions)


def market_grid(spark, folder):
    """Stock, call and put series on the dense grid; every study starts from this one table."""
    return snapshot(spark, folder, "market-grid", lambda s, f: P.densify(T.market_days(s, f), sessions(s, f)))


def dense(spark, folder):
    return market_grid(spark, folder).select("ticker", "session", "date", "close", "volume")


def nation_dense(spark, folder):
    return snapshot(spark, folder, "nation-grid", lambda s, f: P.densify(T.bars(s, f, "nation"), sessions(s, f)))


def moves(spark, folder):
    return P.moves(dense(spark, folder))


def aligned(spark, folder):
    return snapshot(spark, folder, "aligned", _aligned)


def _aligned(spark, folder):
    return P.align_forward(T.filings(spark, folder), sessions(spark, folder), "available_date")


@study("j1_densify_grid", "SELECT ticker, session, date, close, volume FROM dense", "dense")
def j1(spark, folder):
    return P.densify(T.bars(spark, folder), T.sessions(spark, folder)).select("ticker", "session", "date", "close", "volume")


@study("j2_benchmark_attach", f"""
SELECT m.ticker, m.session, {r('m.ret')} AS ret, {r('b.ret')} AS market_ret, {r('m.ret - b.ret')} AS excess
FROM moves m LEFT JOIN (SELECT session, ret FROM moves WHERE ticker = 'T4') b USING (session) WHERE m.ticker <> 'T4'
""", "moves")
def j2(spark, folder):
    m = moves(spark, folder)
    joined = P.attach_benchmark(m.where(F.col("ticker") != T.BENCHMARK), m.where(F.col("ticker") == T.BENCHMARK), ["ret"])
    return joined.select("ticker", "session", rounded("ret").alias("ret"), rounded("market_ret").alias("market_ret"),
                         rounded(F.col("ret") - F.col("market_ret")).alias("excess"))


@study("j3_forward_session", "SELECT issuer, accession, available_date, session, session_date FROM aligned", "aligned")
def j3(spark, folder):
    return _aligned(spark, folder).select("issuer", "accession", "available_date", "session", "session_date")


@study("w1_past_returns", f"""
SELECT ticker, session, {r('close / lag(close, 1) OVER w - 1')} AS return_1, {r('close / lag(close, 5) OVER w - 1')} AS return_5,
  {r('close / lag(close, 20) OVER w - 1')} AS return_20
FROM dense WINDOW w AS (PARTITION BY ticker ORDER BY session)""", "dense")
def w1(spark, folder):
    return dense(spark, folder).select("ticker", "session", *[rounded(P.past_return(k)).alias(f"return_{k}") for k in (1, 5, 20)])


@study("w2_rolling_std", f"""
SELECT ticker, session, {r('CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END')} AS past_vol_20
FROM moves WINDOW w AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "moves")
def w2(spark, folder):
    return moves(spark, folder).select("ticker", "session", rounded(P.rolling_std(20)).alias("past_vol_20"))


def _rms(k: int, name: str) -> str:
    frame = f"(PARTITION BY ticker ORDER BY session ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"{r(f'CASE WHEN count(ret) OVER {frame} = {k} THEN sqrt(avg(ret * ret) OVER {frame}) END')} AS {name}"


@study("w3_rolling_rms", f"""
WITH v AS (SELECT ticker, session, {_rms(20, 'vol20')}, {_rms(60, 'vol60')}, {_rms(21, 'vol21')} FROM moves)
SELECT v.*, b.vol20 AS market_vol20 FROM v LEFT JOIN (SELECT session, vol20 FROM v WHERE ticker = 'T4') b USING (session)
""", "moves")
def w3(spark, folder):
    v = moves(spark, folder).select("ticker", "session", *[rounded(P.rolling_rms(k)).alias(f"vol{k}") for k in (20, 60, 21)])
    return P.attach_benchmark(v, v.where(F.col("ticker") == T.BENCHMARK), ["vol20"])


@study("w4_adv_volume_state", f"""
SELECT ticker, session, {r('CASE WHEN count(close * volume) OVER w = 20 THEN ln(1 + avg(close * volume) OVER w) END')} AS log_adv20,
  {r('CASE WHEN count(volume) OVER w = 20 THEN volume / avg(volume) OVER w END')} AS volume_state
FROM dense WINDOW w AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "dense")
def w4(spark, folder):
    return dense(spark, folder).select(
        "ticker", "session", rounded(F.log1p(P.average_dollar_volume(20))).alias("log_adv20"),
        rounded(P.volume_state(20)).alias("volume_state"))


def forward_sql(kind: str, h: int) -> str:
    w = "(PARTITION BY ticker ORDER BY session)"
    f = f"(PARTITION BY ticker ORDER BY session ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    value = {"return": f"lead(close, {h}) OVER {w} / close - 1", "volatility": f"sqrt(avg(ret * ret) OVER {f})",
             "downside": f"greatest(CAST(0 AS DOUBLE), 1 - min(close) OVER {f} / close)"}[kind]
    return f"CASE WHEN count(ret) OVER {f} = {h} THEN {value} END"


def _forward(kind: str) -> str:
    return ", ".join(f"{r(forward_sql(kind, h))} AS {kind}_{h}" for h in HORIZONS)


@study("w5_forward_return", f"SELECT ticker, session, {_forward('return')} FROM moves", "moves")
def w5(spark, folder):
    return moves(spark, folder).select("ticker", "session", *[rounded(P.forward_return(h)).alias(f"return_{h}") for h in HORIZONS])


@study("w6_forward_volatility", f"SELECT ticker, session, {_forward('volatility')} FROM moves", "moves")
def w6(spark, folder):
    return moves(spark, folder).select("ticker", "session", *[rounded(P.forward_volatility(h)).alias(f"volatility_{h}") for h in HORIZONS])


@study("w7_forward_downside", f"SELECT ticker, session, {_forward('downside')} FROM moves", "moves")
def w7(spark, folder):
    return moves(spark, folder).select("ticker", "session", *[rounded(P.forward_downside(h)).alias(f"downside_{h}") for h in HORIZONS])


@study("w8_target_end", "SELECT ticker, session, " + ", ".join(
    f"lead(date, {h}) OVER (PARTITION BY ticker ORDER BY session) AS target_end_{h}" for h in HORIZONS) + " FROM dense", "dense")
def w8(spark, folder):
    return dense(spark, folder).select("ticker", "session", *[P.target_end(h).alias(f"target_end_{h}") for h in HORIZONS])


def _panel_sql(horizons) -> str:
    w20 = "(PARTITION BY ticker ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    w = "(PARTITION BY ticker ORDER BY session)"
    forward = ", ".join(f"{forward_sql('return', h)} AS return_{h}, {forward_sql('volatility', h)} AS volatility_{h}, "
                        f"lead(date, {h}) OVER {w} AS target_end_{h}" for h in horizons)
    flags = ", ".join(f"max(CASE WHEN category = '{c}' THEN 1 END) AS \"event__{c}\"" for c in CATEGORIES)
    filled = ", ".join(f"coalesce(\"event__{c}\", 0) AS \"event__{c}\"" for c in CATEGORIES)
    return f"""SELECT *, coalesce(max("event__1-URGENT") OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS recent_a
    FROM (SELECT p.*, m.past_return_5 AS market_past_return_5, {filled} FROM (
      SELECT ticker, session, date, close, close / lag(close, 5) OVER {w} - 1 AS past_return_5, close / lag(close, 20) OVER {w} - 1 AS past_return_20,
        CASE WHEN count(ret) OVER {w20} = 20 THEN stddev_samp(ret) OVER {w20} END AS past_vol_20, ln(1 + volume) AS past_log_volume, {forward}
      FROM moves) p
    LEFT JOIN (SELECT session, close / lag(close, 5) OVER {w} - 1 AS past_return_5 FROM moves WHERE ticker = 'T4') m USING (session)
    LEFT JOIN (SELECT ticker, session, {flags} FROM aligned WHERE session IS NOT NULL GROUP BY 1, 2) e USING (ticker, session)
    WHERE p.ticker <> 'T4')"""


view("full_panel", "moves aligned", _panel_sql(HORIZONS))
view("panel", "full_panel", """SELECT *, recent_a * "event__2-HIGH" AS sequence_a_before_b FROM full_panel
    WHERE past_return_5 IS NOT NULL AND past_return_20 IS NOT NULL AND past_vol_20 IS NOT NULL AND past_log_volume IS NOT NULL
      AND market_past_return_5 IS NOT NULL""")

PANEL_VALUES = ["past_return_5", "past_return_20", "past_vol_20", "past_log_volume", "market_past_return_5"] + [
    f"{k}_{h}" for h in HORIZONS for k in ("return", "volatility")]
PANEL_FLAGS = [f"event__{c}" for c in CATEGORIES] + ["recent_a", "sequence_a_before_b"]


def study_panel(spark, folder):
    return snapshot(spark, folder, "study-panel", _study_panel)


def _study_panel(spark, folder):
    return P.study_panel(dense(spark, folder), aligned(spark, folder), CATEGORIES, HORIZONS,
                         T.BENCHMARK, "1-URGENT", "2-HIGH", 5)


@study("e1_study_panel", "SELECT ticker, session, date, " + ", ".join(f"{r(v)} AS {v}" for v in PANEL_VALUES) + ", "
       + ", ".join(f'CAST("{f}" AS INTEGER) AS "{f}"' for f in PANEL_FLAGS) + ", "
       + ", ".join(f"target_end_{h}" for h in HORIZONS) + " FROM panel", "panel")
def e1(spark, folder):
    return _study_panel(spark, folder).select(
        "ticker", "session", "date", *[rounded(v).alias(v) for v in PANEL_VALUES],
        *[F.col(f"`{f}`").cast("int").alias(f) for f in PANEL_FLAGS], *[f"target_end_{h}" for h in HORIZONS])


EXT_HORIZONS = [1, 2, 63]


def _extended_sql() -> str:
    w = "(PARTITION BY ticker ORDER BY session)"

    def frame(k):
        return f"(PARTITION BY ticker ORDER BY session ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"

    past = ", ".join(f"close / lag(close, {k}) OVER {w} - 1 AS return{k}" for k in (1, 5, 20, 60))
    vols = ", ".join(f"CASE WHEN count(ret) OVER {frame(k)} = {k} THEN sqrt(avg(ret * ret) OVER {frame(k)}) END AS vol{k}" for k in (20, 60))
    forward = ", ".join(f"{forward_sql(k, h)} AS {k}_{h}" for h in EXT_HORIZONS for k in ("return", "volatility", "downside"))
    ends = ", ".join(f"lead(date, {h}) OVER {w} AS target_end_{h}" for h in EXT_HORIZONS)
    return f"""SELECT ticker, 'I' || (CAST(substr(ticker, 2) AS INTEGER) % 5) AS issuer, session, date, close, volume, {past}, {vols},
      CASE WHEN count(close * volume) OVER {frame(20)} = 20 THEN ln(1 + avg(close * volume) OVER {frame(20)}) END AS log_adv20,
      CASE WHEN count(volume) OVER {frame(20)} = 20 THEN volume / avg(volume) OVER {frame(20)} END AS volume_state, {forward}, {ends}
    FROM (SELECT *, close / lag(close) OVER {w} - 1 AS ret FROM nation_dense)"""


view("extended_raw", "nation_dense", _extended_sql())
view("extended", "extended_raw", """SELECT e.*, m.return5 AS market_return5, m.return20 AS market_return20, m.vol20 AS market_vol20,
      CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY issuer, session) AS weight
    FROM extended_raw e LEFT JOIN (SELECT session, return5, return20, vol20 FROM extended_raw WHERE ticker = 'T4') m USING (session)
    WHERE ticker <> 'T4'""")
EXT_VALUES = (["return1", "return5", "return20", "return60", "vol20", "vol60", "log_adv20", "volume_state", "market_return5",
               "market_return20", "market_vol20", "weight"]
              + [f"{k}_{h}" for h in EXT_HORIZONS for k in ("return", "volatility", "downside")])


def extended_panel(spark, folder):
    return snapshot(spark, folder, "extended-panel", _extended_panel)


def _extended_panel(spark, folder):
    return P.extended_panel(
        nation_dense(spark, folder),
        F.concat(F.lit("I"), (F.substring("ticker", 2, 9).cast("int") % 5).cast("string")), EXT_HORIZONS, T.BENCHMARK)


@study("e2_extended_panel", "SELECT ticker, issuer, session, date, " + ", ".join(f"{r(v)} AS {v}" for v in EXT_VALUES) + ", "
       + ", ".join(f"{r(f'abs(return_{h})')} AS absolute_{h}, target_end_{h}" for h in EXT_HORIZONS) + " FROM extended", "extended")
def e2(spark, folder):
    return _extended_panel(spark, folder).select(
        "ticker", "issuer", "session", "date", *[rounded(v).alias(v) for v in EXT_VALUES + [f"absolute_{h}" for h in EXT_HORIZONS]],
        *[f"target_end_{h}" for h in EXT_HORIZONS])
