"""Queries of option selection, quote pairs, fixed-rule outcomes, effects and performance."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import ordering
from tidemark.functions.scalars import big, first_reason, flag, ratio, rounded
from tidemark.operators import contracts as C
from tidemark.operators import estimators as E
from tidemark.operators import gates as G
from tidemark.operators import joins as J
from tidemark.operators import options as O
from tidemark.operators import panel as P
from tidemark.operators import series as Z
from tidemark.operators import settlement as S
from tidemark.plans.association import trades
from tidemark.plans.basics import option_dense
from tidemark.plans.events import MAX_AGE, asof_quotes, dividend_days, features, labelled, matched
from tidemark.plans.market import aligned, dense, moves, sessions
from tidemark.plans.registry import study
from tidemark.plans.sqlviews import r, view
from tidemark.session import snapshot
from tidemark.sources import tables as T

KEY = ["ticker", "pair_session", "role"]
view("option_anchors", "matched dense", """SELECT m.ticker, m.session AS pair_session, v.role, CASE v.role WHEN 'event' THEN m.session ELSE m.control_session END AS session, d.date, d.close AS spot
    FROM matched m CROSS JOIN (VALUES ('event'), ('ordinary')) v(role) JOIN dense d ON d.ticker = m.ticker AND d.session = CASE v.role WHEN 'event' THEN m.session ELSE m.control_session END WHERE d.close IS NOT NULL""")
view("standard", "contracts", "SELECT * FROM contracts WHERE shares = 100 AND NOT extra AND style IN ('american', 'european')")
view("listed_pairs", "standard", """SELECT ticker, expiry, strike, min(contract) FILTER (WHERE contract_type = 'call') AS call, min(contract) FILTER (WHERE contract_type = 'put') AS put FROM standard GROUP BY 1, 2, 3""")


def anchors(spark, folder):
    def build(s, f):
        rows = matched(s, f).select("ticker", F.col("session").alias("pair_session"), F.explode(F.array(
            F.struct(F.lit("event").alias("role"), F.col("session").alias("session")), F.struct(F.lit("ordinary").alias("role"), F.col("control_session").alias("session")))).alias("x")).select("ticker", "pair_session", "x.*")
        return rows.join(dense(s, f).select("ticker", "session", "date", F.col("close").alias("spot")), ["ticker", "session"]).where("spot is not null").select(*KEY, "session", "date", "spot")
    return snapshot(spark, folder, "option-anchors", build)


def standard(spark, folder):
    return T.contracts(spark, folder).where("shares = 100 and not extra and style in ('american', 'european')")


_BUCKET = "CASE WHEN dte BETWEEN 21 AND 45 THEN 'short' WHEN dte BETWEEN 46 AND 80 THEN 'middle' WHEN dte BETWEEN 90 AND 180 THEN 'long' END"
_TARGET = "CASE WHEN dte BETWEEN 21 AND 45 THEN 30 WHEN dte BETWEEN 46 AND 80 THEN 60 ELSE 120 END"
view("bucket_pairs", "option_anchors listed_pairs", f"""WITH x AS (SELECT a.*, p.expiry, p.strike, p.call, p.put, CAST(p.expiry - a.date AS INTEGER) AS dte FROM option_anchors a JOIN listed_pairs p ON p.ticker = a.ticker AND p.expiry - a.date BETWEEN 21 AND 180),
    y AS (SELECT *, {_BUCKET} AS bucket, {_TARGET} AS target FROM x), z AS (SELECT ticker, pair_session, role, bucket, arg_min(struct_pack(expiry := expiry, strike := strike, dte := dte, call := call, put := put), (abs(dte - target), expiry, abs(strike / spot - 1), strike)) AS p FROM y WHERE bucket IS NOT NULL GROUP BY 1, 2, 3, 4)
    SELECT a.*, b.bucket, p.expiry, p.strike, p.dte, p.call, p.put, CASE WHEN p IS NULL THEN 'no_pair_in_maturity_bucket' END AS reason FROM option_anchors a CROSS JOIN (VALUES ('short'), ('middle'), ('long')) b(bucket) LEFT JOIN z USING (ticker, pair_session, role, bucket)""")


def bucket_pairs(spark, folder):
    return snapshot(spark, folder, "bucket-pairs", lambda s, f: O.pair_by_bucket(anchors(s, f), J.call_put_pairs(standard(s, f)), KEY))


@study("k1_maturity_pairs", "SELECT ticker, pair_session, role, bucket, expiry, strike, dte, call, put, reason FROM bucket_pairs", "bucket_pairs")
def k1(spark, folder):
    return bucket_pairs(spark, folder).select(*KEY, "bucket", "expiry", "strike", "dte", "call", "put", "reason")


LEGS = [("atm_call", "call", 1.0), ("atm_put", "put", 1.0), ("upper_call", "call", 1.05), ("lower_put", "put", 0.95)]


def _leg_sql(side: str, moneyness: float, tolerance: float) -> str:
    return f"""SELECT a.*, '{side}' AS contract_type, p.contract, p.expiry, p.strike, p.dte, p.style, CASE WHEN p IS NULL THEN 'no_contract_in_term' WHEN abs(p.strike / (spot * {moneyness}::DOUBLE) - 1) > {tolerance}::DOUBLE THEN 'strike_outside_tolerance' END AS reason
    FROM option_anchors a LEFT JOIN (SELECT a.ticker, pair_session, role, arg_min(struct_pack(contract := contract, expiry := expiry, strike := strike, dte := CAST(expiry - date AS INTEGER), style := style),
      (abs(expiry - date - 30), expiry, abs(strike - spot * {moneyness}::DOUBLE), strike, contract)) AS p FROM option_anchors a JOIN standard c ON c.ticker = a.ticker AND c.contract_type = '{side}' AND c.expiry - a.date BETWEEN 7 AND 90 GROUP BY 1, 2, 3) USING (ticker, pair_session, role)"""


@study("k2_leg_selection", " UNION ALL ".join(f"SELECT ticker, pair_session, role, '{n}' AS leg, contract, strike, reason FROM ({_leg_sql(s, m, 0.05)})" for n, s, m in LEGS), "option_anchors standard")
def k2(spark, folder):
    found = None
    for name, side, moneyness in LEGS:
        part = O.nearest_leg(anchors(spark, folder), standard(spark, folder), KEY, side, moneyness, 30, 0.05).select(*KEY, F.lit(name).alias("leg"), "contract", "strike", "reason")
        found = part if found is None else found.unionByName(part)
    return found


@study("k3_single_leg", f"SELECT ticker, pair_session, role, 'covered_call' AS shape, contract, expiry, strike, reason FROM ({_leg_sql('call', 1.02, 0.01)}) UNION ALL SELECT ticker, pair_session, role, 'protective_put', contract, expiry, strike, reason FROM ({_leg_sql('put', 0.98, 0.01)})", "option_anchors standard")
def k3(spark, folder):
    call = O.nearest_leg(anchors(spark, folder), standard(spark, folder), KEY, "call", 1.02, 30, 0.01).withColumn("shape", F.lit("covered_call"))
    put = O.nearest_leg(anchors(spark, folder), standard(spark, folder), KEY, "put", 0.98, 30, 0.01).withColumn("shape", F.lit("protective_put"))
    return call.unionByName(put).select(*KEY, "shape", "contract", "expiry", "strike", "reason")


# ---------------------------------------------------------------- implied measures and quote pairs

view("priced_pairs", "bucket_pairs option_dense", """SELECT b.*, o.call AS call_mark, o.put AS put_mark, CASE WHEN b.strike * exp(-0.04::DOUBLE * b.dte / 365.25::DOUBLE) + o.call - o.put > 0 THEN b.strike * exp(-0.04::DOUBLE * b.dte / 365.25::DOUBLE) + o.call - o.put END AS parity
    FROM bucket_pairs b JOIN option_dense o USING (ticker, session) WHERE b.reason IS NULL""")


def priced_pairs(spark, folder):
    marks = option_dense(spark, folder).select("ticker", "session", F.col("call").alias("call_mark"), F.col("put").alias("put_mark"))
    rows = bucket_pairs(spark, folder).where("reason is null").join(marks, ["ticker", "session"])
    return rows.withColumn("parity", O.parity_spot(F.col("strike"), F.col("dte"), F.col("call_mark"), F.col("put_mark")))


@study("k4_parity_spot", f"SELECT ticker, pair_session, role, bucket, {r('parity', 5)} AS parity FROM priced_pairs", "priced_pairs")
def k4(spark, folder):
    return priced_pairs(spark, folder).select(*KEY, "bucket", rounded("parity", 5).alias("parity"))


_MEASURES = """(call_mark + put_mark) / parity AS implied_move, (call_mark + put_mark) / parity / sqrt(dte / 365.25::DOUBLE) AS uncertainty, CASE WHEN call_mark + put_mark <> 0 THEN (call_mark - put_mark) / (call_mark + put_mark) END AS asymmetry, strike / parity - 1 AS moneyness"""
view("implied", "priced_pairs", f"SELECT *, {_MEASURES} FROM priced_pairs")


def implied(spark, folder):
    return priced_pairs(spark, folder).select("*", *O.implied_measures(F.col("parity"), F.col("strike"), F.col("dte"), F.col("call_mark"), F.col("put_mark")))


@study("k5_implied_measures", f"SELECT ticker, pair_session, role, bucket, {r('implied_move')} AS implied_move, {r('uncertainty')} AS uncertainty, {r('asymmetry')} AS asymmetry, {r('moneyness')} AS moneyness FROM implied", "implied")
def k5(spark, folder):
    return implied(spark, folder).select(*KEY, "bucket", *[rounded(c).alias(c) for c in ("implied_move", "uncertainty", "asymmetry", "moneyness")])


@study("j17_cross_maturity", f"SELECT a.ticker, a.pair_session, a.role, {r('a.uncertainty')} AS short_value, {r('b.uncertainty')} AS long_value, {r('a.uncertainty - b.uncertainty')} AS slope FROM implied a JOIN implied b ON a.ticker = b.ticker AND a.pair_session = b.pair_session AND a.role = b.role WHERE a.bucket = 'short' AND b.bucket = 'long'", "implied")
def j17(spark, folder):
    rows = implied(spark, folder)
    a = rows.where("bucket = 'short'").select(*KEY, F.col("uncertainty").alias("s"))
    b = rows.where("bucket = 'long'").select(*KEY, F.col("uncertainty").alias("l"))
    return a.join(b, KEY).select(*KEY, rounded("s").alias("short_value"), rounded("l").alias("long_value"), rounded(F.col("s") - F.col("l")).alias("slope"))


def _aged(k: int) -> str:
    w = f"(PARTITION BY ticker ORDER BY session ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"
    return f"last_value(call IGNORE NULLS) OVER {w} AS call_{k}, last_value(put IGNORE NULLS) OVER {w} AS put_{k}"


view("aged_marks", "option_dense", f"SELECT ticker, session, {_aged(0)}, {_aged(1)}, {_aged(3)} FROM option_dense")


def aged_marks(spark, folder):
    return option_dense(spark, folder).select("ticker", "session", *[J.aged_mark(side, k)[0].alias(f"{side}_{k}") for k in (0, 1, 3) for side in ("call", "put")])


@study("k6_option_panel", f"""
SELECT b.ticker, b.pair_session, b.role, b.bucket, g.buffer, g.age, {r('(CASE g.age WHEN 0 THEN e.call_0 + e.put_0 WHEN 1 THEN e.call_1 + e.put_1 ELSE e.call_3 + e.put_3 END) / b.spot')} AS entry_move,
  {r('(CASE g.age WHEN 0 THEN x.call_0 + x.put_0 WHEN 1 THEN x.call_1 + x.put_1 ELSE x.call_3 + x.put_3 END) / (CASE g.age WHEN 0 THEN e.call_0 + e.put_0 WHEN 1 THEN e.call_1 + e.put_1 ELSE e.call_3 + e.put_3 END) - 1')} AS premium_change
FROM bucket_pairs b CROSS JOIN (SELECT buffer, age FROM (VALUES (0), (1), (3)) x(buffer), (VALUES (0), (1), (3)) y(age)) g JOIN aged_marks e ON e.ticker = b.ticker AND e.session = b.session + g.buffer LEFT JOIN aged_marks x ON x.ticker = b.ticker AND x.session = b.session + g.buffer + 5 WHERE b.reason IS NULL""", "bucket_pairs aged_marks")
def k6(spark, folder):
    grid = F.array(*[F.struct(F.lit(b).alias("buffer"), F.lit(a).alias("age")) for b in (0, 1, 3) for a in (0, 1, 3)])
    rows = bucket_pairs(spark, folder).where("reason is null").select("*", F.explode(grid).alias("g")).select("*", "g.buffer", "g.age")
    premium = aged_marks(spark, folder).select("ticker", "session", F.explode(F.array(*[F.struct(F.lit(k).alias("age"), (F.col(f"call_{k}") + F.col(f"put_{k}")).alias("p")) for k in (0, 1, 3)])).alias("m")).select("ticker", "session", "m.age", "m.p")
    entry = premium.select("ticker", F.col("session").alias("at"), "age", F.col("p").alias("p0"))
    later = premium.select("ticker", (F.col("session") - 5).alias("at"), "age", F.col("p").alias("p1"))
    joined = rows.withColumn("at", F.col("session") + F.col("buffer")).join(entry, ["ticker", "at", "age"]).join(later, ["ticker", "at", "age"], "left")
    return joined.select(*KEY, "bucket", "buffer", "age", rounded(ratio("p0", "spot")).alias("entry_move"), rounded(ratio("p1", "p0") - 1).alias("premium_change"))


SPAN = 8 * 3600 * 1000000000
view("quote_pairs", "asof_quotes", f"""SELECT s.ticker, s.session, s.cutoff_ns, s.bid AS stock_bid, s.ask AS stock_ask, s.ts_ns AS stock_ts, o.bid AS option_bid, o.ask AS option_ask, o.ts_ns AS option_ts, o.bid_size, o.ask_size,
      CASE WHEN s.ts_ns IS NULL THEN 'stock_quote_missing' WHEN o.ts_ns IS NULL THEN 'option_quote_missing' WHEN abs(s.ts_ns - o.ts_ns) > {SPAN} THEN 'asynchronous_quote_legs' END AS reason
    FROM asof_quotes s JOIN asof_quotes o ON o.ticker = s.ticker AND o.session = s.session AND s.leg = 'stock' AND o.leg = 'option'""")


def quote_pairs(spark, folder):
    q = asof_quotes(spark, folder)
    s = q.where("leg = 'stock'").select("ticker", "session", "cutoff_ns", F.col("bid").alias("stock_bid"), F.col("ask").alias("stock_ask"), F.col("ts_ns").alias("stock_ts"))
    o = q.where("leg = 'option'").select("ticker", "session", F.col("bid").alias("option_bid"), F.col("ask").alias("option_ask"), F.col("ts_ns").alias("option_ts"), "bid_size", "ask_size")
    reason = first_reason((F.col("stock_ts").isNull(), "stock_quote_missing"), (F.col("option_ts").isNull(), "option_quote_missing"),
                          (F.abs(F.col("stock_ts") - F.col("option_ts")) > SPAN, "asynchronous_quote_legs"))
    return s.join(o, ["ticker", "session"]).withColumn("reason", reason)


@study("k7_quote_pairs", "SELECT ticker, session, stock_bid, option_ask, reason FROM quote_pairs", "quote_pairs")
def k7(spark, folder):
    return quote_pairs(spark, folder).select("ticker", "session", "stock_bid", "option_ask", "reason")


@study("k8_quote_statistics", f"""SELECT ticker, session, (stock_bid + stock_ask) / 2 AS mid, {r('(option_ask - option_bid) / ((option_ask + option_bid) / 2)')} AS relative_spread, {r('(cutoff_ns - option_ts) / 1e9::DOUBLE')} AS age_seconds, {r('abs(stock_ts - option_ts) / 1e9::DOUBLE')} AS leg_gap_seconds
FROM quote_pairs WHERE reason IS NULL""", "quote_pairs")
def k8(spark, folder):
    rows = quote_pairs(spark, folder).where("reason is null")
    mid = (F.col("option_ask") + F.col("option_bid")) / 2
    return rows.select("ticker", "session", ((F.col("stock_bid") + F.col("stock_ask")) / 2).alias("mid"), rounded(ratio(F.col("option_ask") - F.col("option_bid"), mid)).alias("relative_spread"),
                       rounded((F.col("cutoff_ns") - F.col("option_ts")) / 1e9).alias("age_seconds"), rounded(F.abs(F.col("stock_ts") - F.col("option_ts")) / 1e9).alias("leg_gap_seconds"))


@study("k9_staleness_flags", "SELECT ticker, session, CAST(call_0 IS NOT NULL AND put_0 IS NOT NULL AS INTEGER) AS same_session, CAST(call_1 IS NOT NULL AND put_1 IS NOT NULL AS INTEGER) AS within_1, CAST(call_3 IS NOT NULL AND put_3 IS NOT NULL AS INTEGER) AS within_3 FROM aged_marks", "aged_marks")
def k9(spark, folder):
    return aged_marks(spark, folder).select("ticker", "session", *[flag(F.col(f"call_{k}").isNotNull() & F.col(f"put_{k}").isNotNull()).alias(n) for k, n in ((0, "same_session"), (1, "within_1"), (3, "within_3"))])


view("spot_paths", "bucket_pairs option_dense", """SELECT b.ticker, b.pair_session, b.role, b.bucket, b.dte, g.k, o.call + o.put AS premium, CASE WHEN b.strike * exp(-0.04::DOUBLE * (b.expiry - o.date) / 365.25::DOUBLE) + o.call - o.put > 0 THEN b.strike * exp(-0.04::DOUBLE * (b.expiry - o.date) / 365.25::DOUBLE) + o.call - o.put END AS s
    FROM bucket_pairs b CROSS JOIN generate_series(0, 10) g(k) JOIN option_dense o ON o.ticker = b.ticker AND o.session = b.session + g.k WHERE b.reason IS NULL""")


@study("k10_premium_features", f"""
WITH l AS (SELECT *, ln(s / lag(s) OVER (PARTITION BY ticker, pair_session, role, bucket ORDER BY k)) AS move FROM spot_paths),
g AS (SELECT ticker, pair_session, role, bucket, any_value(dte) AS dte, max(premium) FILTER (WHERE k = 0) AS p0, max(premium) FILTER (WHERE k = 5) AS p5, max(s) FILTER (WHERE k = 0) AS s0, max(s) FILTER (WHERE k = 5) AS s5, min(s) FILTER (WHERE k <= 5) AS early, min(s) FILTER (WHERE k >= 5) AS late,
  count(s) FILTER (WHERE k <= 5) AS n5, count(s) AS n10, sqrt(avg(move * move) FILTER (WHERE k BETWEEN 1 AND 5)) AS rms FROM l GROUP BY 1, 2, 3, 4)
SELECT ticker, pair_session, role, bucket, CASE WHEN n5 = 6 THEN 'measured' ELSE 'incomplete_five_session_same_contract_path' END AS status, {r('CASE WHEN n5 = 6 THEN ln(p5 / p0) END')} AS premium_log_change, {r('CASE WHEN n5 = 6 THEN s5 / s0 - 1 END')} AS synthetic_return, {r('CASE WHEN n5 = 6 THEN rms END')} AS rms,
  {r('CASE WHEN n5 = 6 THEN greatest(0::DOUBLE, 1 - early / s0) END')} AS early_downside, {r('CASE WHEN n10 = 11 THEN greatest(0::DOUBLE, 1 - late / s5) END')} AS late_downside,
  {r('CASE WHEN n10 = 11 THEN (greatest(0::DOUBLE, 1 - early / s0) - greatest(0::DOUBLE, 1 - late / s5)) / (p0 / s0 / sqrt(dte / 365.25::DOUBLE) * sqrt(5 / 252::DOUBLE)) END', 5)} AS concentration FROM g""", "spot_paths")
def k10(spark, folder):
    rows = bucket_pairs(spark, folder).where("reason is null").select(*KEY, "bucket", "session", "strike", "expiry", "dte", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k"))
    marks = option_dense(spark, folder).select("ticker", F.col("session").alias("at"), F.col("date").alias("day"), "call", "put")
    walk = rows.withColumn("at", F.col("session") + F.col("k")).join(marks, ["ticker", "at"]).withColumn(
        "s", O.parity_spot(F.col("strike"), F.datediff("expiry", "day"), F.col("call"), F.col("put"))).withColumn("premium", F.col("call") + F.col("put"))
    walk = walk.withColumn("move", F.log(F.col("s") / F.lag("s").over(W.partitionBy(*KEY, "bucket").orderBy("k"))))

    def at(k, c):
        return F.max(F.when(F.col("k") == k, F.col(c)))

    g = walk.groupBy(*KEY, "bucket").agg(F.first("dte").alias("dte"), at(0, "premium").alias("p0"), at(5, "premium").alias("p5"), at(0, "s").alias("s0"), at(5, "s").alias("s5"),
                               F.min(F.when(F.col("k") <= 5, F.col("s"))).alias("low_early"), F.min(F.when(F.col("k") >= 5, F.col("s"))).alias("low_late"),
                               F.count(F.when(F.col("k") <= 5, F.col("s"))).alias("n5"), F.count("s").alias("n10"), F.sqrt(F.avg(F.when(F.col("k").between(1, 5), F.col("move") * F.col("move")))).alias("rms"))
    five, ten = F.col("n5") == 6, F.col("n10") == 11
    early, late = F.greatest(F.lit(0.0), 1 - F.col("low_early") / F.col("s0")), F.greatest(F.lit(0.0), 1 - F.col("low_late") / F.col("s5"))
    norm = F.col("p0") / F.col("s0") / F.sqrt(F.col("dte") / O.YEAR) * F.sqrt(F.lit(5 / 252))
    return g.select(*KEY, "bucket", F.when(five, "measured").otherwise("incomplete_five_session_same_contract_path").alias("status"), rounded(F.when(five, F.log(F.col("p5") / F.col("p0")))).alias("premium_log_change"),
                    rounded(F.when(five, F.col("s5") / F.col("s0") - 1)).alias("synthetic_return"), rounded(F.when(five, F.col("rms"))).alias("rms"), rounded(F.when(five, early)).alias("early_downside"),
                    rounded(F.when(ten, late)).alias("late_downside"), rounded(F.when(ten, (early - late) / norm), 5).alias("concentration"))


@study("k11_leg_volume", f"SELECT ticker, session, {r('CASE WHEN count(call_volume) OVER w = 5 THEN avg(call_volume) OVER w END')} AS call_adv, {r('CASE WHEN count(put_volume) OVER w = 5 THEN avg(put_volume) OVER w END')} AS put_adv FROM option_dense WINDOW w AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "option_dense")
def k11(spark, folder):
    return option_dense(spark, folder).select("ticker", "session", *[rounded(P.full_frame(f"{s}_volume", F.avg, -4, 0)).alias(f"{s}_adv") for s in ("call", "put")])


@study("k12_nominal_adjusted", "SELECT a.ticker, a.date, a.close AS adjusted, n.close AS nominal, CASE WHEN n.close IS NULL THEN 'missing_nominal_bar' END AS reason FROM bars a LEFT JOIN option_bars n ON n.ticker = a.ticker AND n.date = a.date AND n.contract_type = 'call'", "bars option_bars")
def k12(spark, folder):
    nominal = T.option_bars(spark, folder).where("contract_type = 'call'").select("ticker", "date", F.col("close").alias("nominal"))
    return T.bars(spark, folder).select("ticker", "date", F.col("close").alias("adjusted")).join(nominal, ["ticker", "date"], "left").withColumn("reason", F.when(F.col("nominal").isNull(), "missing_nominal_bar"))


@study("a29_option_input_counts", """
WITH o AS (SELECT ticker, session FROM option_dense WHERE call IS NOT NULL AND put IS NOT NULL AND stock IS NOT NULL), c AS (SELECT a.category, l.lag, a.ticker, a.session + l.lag AS session FROM aligned a CROSS JOIN (VALUES (0), (1), (5)) l(lag) WHERE a.session IS NOT NULL)
SELECT category, lag, count(DISTINCT (c.ticker, c.session)) AS issuer_dates, count(DISTINCT CASE WHEN o.session IS NOT NULL THEN (c.ticker, c.session) END) AS complete_inputs, CASE WHEN count(o.session) >= 20 THEN 'available' ELSE 'insufficient_option_inputs' END AS status FROM c LEFT JOIN o ON o.ticker = c.ticker AND o.session = c.session GROUP BY 1, 2""", "aligned option_dense")
def a29(spark, folder):
    days = P.event_days(aligned(spark, folder)).select("ticker", "category", "session", "filings", F.explode(F.array(F.lit(0), F.lit(1), F.lit(5))).alias("lag")).withColumn("session", F.col("session") + F.col("lag"))
    ready = option_dense(spark, folder).where("call is not null and put is not null and stock is not null").select("ticker", "session", F.lit(1).alias("ready"))
    joined = days.join(ready, ["ticker", "session"], "left")
    return joined.groupBy("category", "lag").agg(F.count(F.lit(1)).alias("issuer_dates"), F.count("ready").alias("complete_inputs"),
                                                 F.when(F.sum(F.when(F.col("ready") == 1, F.col("filings"))) >= 20, "available").otherwise("insufficient_option_inputs").alias("status"))


# ---------------------------------------------------------------- holding-period outcomes

HORIZON = 10
view("dividend_rows", "dividends sessions", """SELECT v.ticker, s.session, v.accession, v.declared, p.date AS previous_date, v.cash, v.currency FROM dividends v ASOF JOIN sessions s ON v.ex_date <= s.date LEFT JOIN sessions p ON p.session = s.session - 1""")
view("split_days", "splits sessions", """SELECT v.ticker, s.session, product(CASE WHEN split_to > 0 AND split_from > 0 THEN split_to::DOUBLE / split_from ELSE 1 END) AS factor, bool_and(split_to > 0 AND split_from > 0) AS ratio_known FROM splits v ASOF JOIN sessions s ON v.execution_date <= s.date GROUP BY 1, 2""")
view("actions", "dividend_rows split_days", """SELECT coalesce(c.ticker, f.ticker) AS ticker, coalesce(c.session, f.session) AS session, c.cash, coalesce(c.unsupported, false) AS unsupported, f.factor, f.ratio_known
    FROM (SELECT ticker, session, sum(CASE WHEN currency = 'USD' THEN cash END) AS cash, bool_or(currency <> 'USD') AS unsupported FROM dividend_rows GROUP BY 1, 2) c FULL JOIN split_days f ON f.ticker = c.ticker AND f.session = c.session""")
view("records", "option_anchors standard option_dense sessions", f"""WITH x AS (SELECT *, 'covered_call' AS shape, -1 AS sign FROM ({_leg_sql('call', 1.02, 0.25)}) UNION ALL SELECT *, 'protective_put', 1 FROM ({_leg_sql('put', 0.98, 0.25)}))
    SELECT x.ticker, x.pair_session, x.role, x.shape, h.stock_only, x.sign, x.session + 1 AS entry_session, {HORIZON} AS horizon, x.strike, x.style, x.dte, (SELECT max(session) FROM sessions s WHERE s.date <= x.expiry) AS expiry_session, 1 AS cost_multiplier,
      d.date AS decision_date, e.stock AS stock_entry, CASE x.shape WHEN 'covered_call' THEN e.call ELSE e.put END AS option_entry, (CASE x.shape WHEN 'covered_call' THEN d.call ELSE d.put END) / d.stock AS premium_ratio, CASE x.shape WHEN 'covered_call' THEN x.strike / d.stock - 1 ELSE 1 - x.strike / d.stock END AS achieved_otm,
      CASE WHEN x.reason IS NOT NULL THEN x.reason WHEN d.stock IS NULL OR e.stock IS NULL OR (CASE x.shape WHEN 'covered_call' THEN d.call ELSE d.put END) IS NULL OR (CASE x.shape WHEN 'covered_call' THEN e.call ELSE e.put END) IS NULL THEN 'missing_decision_or_entry_bar'
        WHEN x.session + 1 + {HORIZON} > (SELECT max(session) FROM sessions) THEN 'initiated_outcome_outside_history' WHEN x.session + 1 + {HORIZON} > (SELECT max(session) FROM sessions s WHERE s.date <= x.expiry) THEN 'unavailable_after_expiry' END AS ineligible
    FROM x CROSS JOIN (VALUES (false), (true)) h(stock_only) JOIN option_dense d ON d.ticker = x.ticker AND d.session = x.session LEFT JOIN option_dense e ON e.ticker = x.ticker AND e.session = x.session + 1""")
RKEY = [*KEY, "shape", "stock_only"]
_RK = ", ".join(RKEY)


def actions(spark, folder):
    """Dividends and splits by the session on or after their day, with the date of the session before."""
    days = sessions(spark, folder)
    before = days.select((F.col("session") + 1).alias("session"), F.col("date").alias("previous_date"))
    paid = P.align_forward(T.dividends(spark, folder), days, "ex_date").where("session is not null").join(F.broadcast(before), "session", "left")
    split = P.align_forward(T.splits(spark, folder), days, "execution_date").where("session is not null")
    return S.action_days(paid, split)


def records(spark, folder):
    """Decision anchors with their contract, entry marks and eligibility, for both shapes with and without the option."""
    def build(s, f):
        legs = []
        for shape, side, money, sign in (("covered_call", "call", 1.02, -1), ("protective_put", "put", 0.98, 1)):
            leg = O.nearest_leg(anchors(s, f), standard(s, f), KEY, side, money, 30, 0.25)
            marks = option_dense(s, f).select("ticker", "session", F.col("stock").alias("ds"), F.col(side).alias("do"))
            entry = option_dense(s, f).select("ticker", (F.col("session") - 1).alias("session"), F.col("stock").alias("stock_entry"), F.col(side).alias("option_entry"))
            joined = leg.join(marks, ["ticker", "session"]).join(entry, ["ticker", "session"], "left").withColumns({"shape": F.lit(shape), "sign": F.lit(sign)})
            otm = F.col("strike") / F.col("ds") - 1 if shape == "covered_call" else 1 - F.col("strike") / F.col("ds")
            legs.append(joined.withColumn("achieved_otm", otm))
        both = legs[0].unionByName(legs[1]).withColumn("stock_only", F.explode(F.array(F.lit(False), F.lit(True))))
        days = P.next_session(sessions(s, f)).select(F.date_sub("day", 1).alias("expiry"), (F.col("session") - 1).alias("expiry_session"))
        last = sessions(s, f).agg(F.max("session")).scalar()
        end = sessions(s, f).agg(F.max("date")).scalar()
        placed = both.join(F.broadcast(days), "expiry", "left").withColumn("expiry_session", F.when(F.col("expiry") >= end, last).otherwise(F.col("expiry_session")))
        target = F.col("session") + 1 + HORIZON
        missing = F.col("ds").isNull() | F.col("do").isNull() | F.col("stock_entry").isNull() | F.col("option_entry").isNull()
        reason = first_reason((missing, "missing_decision_or_entry_bar"), (target > last, "initiated_outcome_outside_history"), (target > F.col("expiry_session"), "unavailable_after_expiry"))
        return placed.select(*RKEY, "sign", (F.col("session") + 1).alias("entry_session"), F.lit(HORIZON).alias("horizon"), "strike", "style", "dte", "expiry_session", F.lit(1.0).alias("cost_multiplier"),
                             F.col("date").alias("decision_date"), "stock_entry", "option_entry", (F.col("do") / F.col("ds")).alias("premium_ratio"), "achieved_otm", F.coalesce("reason", reason).alias("ineligible"))
    return snapshot(spark, folder, "outcome-records", build)


view("paths", "records option_dense actions", f"""SELECT r.*, o.session, o.date, o.stock, CASE r.shape WHEN 'covered_call' THEN o.call ELSE o.put END AS "option", a.cash, coalesce(a.unsupported, false) AS unsupported, a.factor, a.ratio_known FROM records r
    JOIN option_dense o ON o.ticker = r.ticker AND o.session BETWEEN r.entry_session AND r.entry_session + r.horizon + 5 LEFT JOIN actions a ON a.ticker = o.ticker AND a.session = o.session WHERE r.ineligible IS NULL""")


def settled(spark, folder):
    def build(s, f):
        marks = option_dense(s, f).select("ticker", "session", "stock", "call", "put")
        rows = S.paths(records(s, f).where("ineligible is null"), marks, actions(s, f))
        rows = rows.withColumn("option", F.when(F.col("shape") == "covered_call", F.col("call")).otherwise(F.col("put"))).drop("call", "put")
        return S.settle(rows, RKEY)
    return snapshot(spark, folder, "settled-records", build)


_ITM = "(CASE WHEN sign = -1 THEN stock > strike ELSE stock < strike END)"
view("held_days", "paths", f"""SELECT *, lag(stock) OVER w AS prev_stock, lag("option") OVER w AS prev_option, 100 * coalesce(product(CASE WHEN session > entry_session AND ratio_known THEN factor ELSE 1 END) OVER w, 1) AS shares FROM paths WINDOW w AS (PARTITION BY {_RK} ORDER BY session)""")
view("called", "held_days dividend_rows", f"""SELECT {_RK}, session, min(accession) AS accession FROM held_days p JOIN dividend_rows v USING (ticker, session) WHERE p.session > entry_session AND NOT stock_only AND sign = -1 AND style = 'american' AND v.declared <= v.previous_date AND prev_stock > strike
    AND v.currency = 'USD' AND prev_option - (prev_stock - strike) < v.cash GROUP BY ALL""")
view("candidates", "held_days called", f"""SELECT {_RK}, session, 0 AS priority, CASE WHEN NOT ratio_known THEN 'unknown_share_split_ratio' WHEN NOT stock_only THEN 'adjusted_option_deliverable_unknown' ELSE 'fractional_share_cash_in_lieu_unknown' END AS why, NULL::DOUBLE AS s, NULL::DOUBLE AS o FROM held_days
      WHERE session > entry_session AND factor IS NOT NULL AND (NOT ratio_known OR NOT stock_only OR abs(shares - round(shares)) > 1e-9)
    UNION ALL SELECT {_RK}, session, 1, 'unsupported_dividend_cashflow', NULL, NULL FROM held_days WHERE session > entry_session AND unsupported
    UNION ALL SELECT {_RK}, session, 2, 'modelled_early_assignment', strike, 0 FROM held_days JOIN called USING ({_RK}, session)
    UNION ALL SELECT {_RK}, session, 3, CASE WHEN stock IS NULL THEN 'missing_expiry_stock' WHEN {_ITM} THEN 'modelled_physical_expiry' ELSE 'expiry_worthless' END, CASE WHEN stock IS NULL THEN NULL WHEN {_ITM} THEN strike ELSE stock END, CASE WHEN stock IS NOT NULL THEN 0 END FROM held_days WHERE session > entry_session AND NOT stock_only AND session >= expiry_session
    UNION ALL SELECT {_RK}, session, 4, 'scheduled_exit', stock, CASE WHEN stock_only THEN 0 ELSE "option" END FROM held_days WHERE session > entry_session AND session >= entry_session + horizon AND stock IS NOT NULL AND (stock_only OR "option" IS NOT NULL)""")
view("settled", "candidates records held_days", f"""SELECT {', '.join('r.' + k for k in RKEY)}, x.session AS exit_session, coalesce(x.why, 'unfilled_exit_after_retries') AS exit_reason, x.s AS stock_exit, x.o AS option_exit, coalesce(h.shares, z.shares) AS shares_exit FROM records r LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_RK} ORDER BY session, priority) AS k FROM candidates) WHERE k = 1) x USING ({_RK}) LEFT JOIN held_days h ON {' AND '.join(f'h.{k} = r.{k}' for k in RKEY)} AND h.session = x.session
    LEFT JOIN (SELECT {_RK}, arg_max(shares, session) AS shares FROM held_days GROUP BY ALL) z ON {' AND '.join(f'z.{k} = r.{k}' for k in RKEY)} WHERE r.ineligible IS NULL""")


@study("l1_settlement", f"SELECT {_RK}, CAST(exit_session AS INTEGER) AS exit_session, exit_reason, stock_exit, {r('shares_exit')} AS shares_exit FROM settled", "settled")
def l1(spark, folder):
    return settled(spark, folder).select(*RKEY, "exit_session", "exit_reason", "stock_exit", rounded("shares_exit").alias("shares_exit"))


def fee(shares: str, s: str, o: str) -> str:
    return f"({shares} * {s} * 0.0006::DOUBLE + CASE WHEN stock_only THEN 0::DOUBLE ELSE 100 * {o} * 0.05::DOUBLE + 0.65::DOUBLE END)"


view("outcomes", "records settled held_days called dividend_rows", f"""WITH w AS (SELECT p.*, exit_session, exit_reason, coalesce(stock, lag(stock) OVER k) AS ms, CASE WHEN stock_only THEN 0 ELSE coalesce("option", lag("option") OVER k) END AS mo,
        sum(CASE WHEN session > entry_session THEN shares * coalesce(cash, 0) ELSE 0 END) OVER k AS accrued
      FROM held_days p JOIN settled USING ({_RK}) WINDOW k AS (PARTITION BY {_RK} ORDER BY session)),
    v AS (SELECT *, (shares * ms - 100 * stock_entry + CASE WHEN stock_only THEN 0 ELSE sign * 100 * (mo - option_entry) END + accrued - {fee('100', 'stock_entry', 'option_entry')} - {fee('shares', 'ms', 'mo')}) / (100 * stock_entry) AS net FROM w),
    first_paid AS (SELECT {', '.join('c.' + k for k in RKEY)}, coalesce(sum(v.cash), 0) AS paid FROM (SELECT * FROM called JOIN settled USING ({_RK}) WHERE session = exit_session AND exit_reason = 'modelled_early_assignment') c LEFT JOIN dividend_rows v ON v.ticker = c.ticker AND v.session = c.session AND v.accession < c.accession GROUP BY ALL),
    g AS (SELECT {_RK}, coalesce(sum(shares * cash) FILTER (WHERE session > entry_session AND (exit_session IS NULL OR session < exit_session OR session = exit_session AND exit_reason NOT IN ('modelled_early_assignment', 'unknown_share_split_ratio', 'adjusted_option_deliverable_unknown', 'fractional_share_cash_in_lieu_unknown', 'unsupported_dividend_cashflow'))), 0)
        + 100 * coalesce(any_value(paid), 0) AS dividends,
      min(net) FILTER (WHERE exit_session IS NULL OR session < exit_session) AS lowest, count_if((exit_session IS NULL OR session < exit_session) AND (ms IS NULL OR mo IS NULL)) AS mark_gaps FROM v LEFT JOIN first_paid USING ({_RK}) GROUP BY ALL),
    f AS (SELECT r.*, s.exit_session, s.exit_reason, s.shares_exit, CASE WHEN r.ineligible IS NOT NULL THEN r.ineligible WHEN s.stock_exit IS NOT NULL THEN 'completed' ELSE 'initiated_unresolved' END AS status, shares_exit * stock_exit - 100 * stock_entry AS stock_pnl, CASE WHEN stock_only THEN 0 ELSE sign * 100 * (option_exit - option_entry) END AS option_pnl, g.dividends, g.lowest, g.mark_gaps,
      {fee('100', 'stock_entry', 'option_entry')} AS opening, {fee('shares_exit', 'stock_exit', 'option_exit')} AS closing FROM records r LEFT JOIN settled s USING ({_RK}) LEFT JOIN g USING ({_RK})),
    n AS (SELECT *, CASE WHEN status = 'completed' THEN stock_pnl + option_pnl + dividends - opening - closing END AS net_pnl FROM f)
    SELECT *, net_pnl / (100 * stock_entry) AS net_return, coalesce(status = 'completed' AND mark_gaps = 0, false) AS path_complete, coalesce(status = 'completed' AND (exit_session = entry_session + horizon OR (exit_session < entry_session + horizon AND exit_reason = 'modelled_early_assignment')), false) AS evaluation_aligned,
      CASE WHEN status = 'completed' AND mark_gaps = 0 THEN greatest(0::DOUBLE, -least(lowest, net_pnl / (100 * stock_entry))) END AS downside_loss FROM n""")


def outcomes(spark, folder):
    return snapshot(spark, folder, "outcomes", lambda s, f: S.outcomes(records(s, f), settled(s, f), RKEY))


@study("l2_net_return", f"SELECT {_RK}, status, {r('net_pnl', 4)} AS net_pnl, {r('net_return')} AS net_return, {r('dividends', 5)} AS dividends FROM outcomes", "outcomes")
def l2(spark, folder):
    return outcomes(spark, folder).select(*RKEY, "status", rounded("net_pnl", 4).alias("net_pnl"), rounded("net_return").alias("net_return"), rounded("dividends", 5).alias("dividends"))


@study("l3_path_downside", f"SELECT {_RK}, CAST(path_complete AS INTEGER) AS path_complete, CAST(evaluation_aligned AS INTEGER) AS evaluation_aligned, mark_gaps, {r('downside_loss')} AS downside_loss FROM outcomes", "outcomes")
def l3(spark, folder):
    return outcomes(spark, folder).select(*RKEY, F.col("path_complete").cast("int").alias("path_complete"), F.col("evaluation_aligned").cast("int").alias("evaluation_aligned"), "mark_gaps", rounded("downside_loss").alias("downside_loss"))


@study("l4_quote_outcome", f"""
SELECT {', '.join('o.' + k for k in RKEY)}, CASE WHEN o.status <> 'completed' THEN 'bar_outcome_not_completed' WHEN NOT o.evaluation_aligned OR o.exit_reason <> 'scheduled_exit' OR o.shares_exit <> 100 THEN 'unsupported_actual_delivery_or_exit_clock' WHEN d.ticker IS NULL OR d.reason IS NOT NULL THEN 'decision_' || coalesce(d.reason, 'missing') WHEN e.ticker IS NULL OR e.reason IS NOT NULL THEN 'entry_' || coalesce(e.reason, 'missing') WHEN x.ticker IS NULL OR x.reason IS NOT NULL THEN 'exit_' || coalesce(x.reason, 'missing') ELSE 'completed_bounded_proxy' END AS quote_status,
  {r("CASE WHEN o.status = 'completed' AND o.evaluation_aligned AND o.exit_reason = 'scheduled_exit' AND o.shares_exit = 100 AND d.ticker IS NOT NULL AND d.reason IS NULL AND e.reason IS NULL AND x.reason IS NULL THEN (100 * (x.stock_bid - e.stock_ask) + CASE WHEN stock_only THEN 0 WHEN sign = -1 THEN -100 * (x.option_ask - e.option_bid) ELSE 100 * (x.option_bid - e.option_ask) END + dividends - o.cost_multiplier * (100 * (e.stock_ask + x.stock_bid) * 0.0002::DOUBLE + CASE WHEN stock_only THEN 0 WHEN sign = -1 THEN 100 * (e.option_bid + x.option_ask) * 0.01::DOUBLE + 1.3::DOUBLE ELSE 100 * (e.option_ask + x.option_bid) * 0.01::DOUBLE + 1.3::DOUBLE END)) / (100 * e.stock_ask) END")} AS quote_net_return
FROM outcomes o LEFT JOIN quote_pairs d ON d.ticker = o.ticker AND d.session = o.entry_session - 1 LEFT JOIN quote_pairs e ON e.ticker = o.ticker AND e.session = o.entry_session LEFT JOIN quote_pairs x ON x.ticker = o.ticker AND x.session = o.exit_session""", "outcomes quote_pairs")
def l4(spark, folder):
    return quote_outcomes(spark, folder).select(*RKEY, "quote_status", rounded("quote_net_return").alias("quote_net_return"))


def quote_outcomes(spark, folder):
    """Ask in, bid out: the quoted version of every completed scheduled outcome."""
    q = quote_pairs(spark, folder).drop("cutoff_ns", "bid_size", "ask_size", "stock_ts", "option_ts")
    e = q.select("ticker", F.col("session").alias("entry_session"), F.col("stock_ask").alias("s_in"), F.col("option_bid").alias("ob_in"), F.col("option_ask").alias("oa_in"), F.coalesce("reason", F.lit("")).alias("e_reason"))
    x = q.select("ticker", F.col("session").alias("exit_session"), F.col("stock_bid").alias("s_out"), F.col("option_bid").alias("ob_out"), F.col("option_ask").alias("oa_out"), F.coalesce("reason", F.lit("")).alias("x_reason"))
    d = q.select("ticker", (F.col("session") + 1).alias("entry_session"), F.coalesce("reason", F.lit("")).alias("d_reason"))
    rows = outcomes(spark, folder).join(d, ["ticker", "entry_session"], "left").join(e, ["ticker", "entry_session"], "left").join(x, ["ticker", "exit_session"], "left")
    reason = first_reason((F.col("status") != "completed", "bar_outcome_not_completed"), (~F.col("evaluation_aligned") | (F.col("exit_reason") != "scheduled_exit") | (F.col("shares_exit") != 100), "unsupported_actual_delivery_or_exit_clock"))
    d_bad = F.coalesce(F.col("d_reason"), F.lit("missing"))
    e_bad, x_bad = F.coalesce(F.col("e_reason"), F.lit("missing")), F.coalesce(F.col("x_reason"), F.lit("missing"))
    status = F.when(reason.isNotNull(), reason).when(d_bad != "", F.concat(F.lit("decision_"), d_bad)).when(e_bad != "", F.concat(F.lit("entry_"), e_bad)).when(x_bad != "", F.concat(F.lit("exit_"), x_bad)).otherwise("completed_bounded_proxy")
    option = F.when(F.col("stock_only"), 0.0).when(F.col("sign") == -1, -100 * (F.col("oa_out") - F.col("ob_in"))).otherwise(100 * (F.col("ob_out") - F.col("oa_in")))
    traded = F.when(F.col("stock_only"), 0.0).when(F.col("sign") == -1, F.col("ob_in") + F.col("oa_out")).otherwise(F.col("oa_in") + F.col("ob_out"))
    option_cost = F.when(F.col("stock_only"), 0.0).otherwise(100 * traded * O.QUOTE_OPTION_IMPACT + 2 * O.OPTION_FEE)
    costs = F.col("cost_multiplier") * (100 * (F.col("s_in") + F.col("s_out")) * (O.QUOTE_STOCK_FEE + O.QUOTE_STOCK_IMPACT) + option_cost)
    net = 100 * (F.col("s_out") - F.col("s_in")) + option + F.col("dividends") - costs
    return rows.withColumn("quote_status", status).withColumn("quote_net_return", F.when(F.col("quote_status") == "completed_bounded_proxy", net / (100 * F.col("s_in"))))


MARK_AGE = 63  # sessions that a contract's last mark may be old
LEG_TOLERANCE = 0.25
WINGS = [("upper_call", "call", 1.05), ("lower_put", "put", 0.95)]
_SIGNS = [(s, leg, q) for s, legs in O.SHAPES.items() for leg, q in legs.items()]
_SELECTED = "ticker, pair_session, role, bucket"
view("contract_marks", "contract_days sessions", "SELECT contract, s.session, price, volume, q.bid AS bid, q.ask AS ask FROM contract_days JOIN sessions s USING (date)")
view("leg_contracts", "bucket_pairs listed_pairs", f"""WITH g AS (SELECT ticker, pair_session, role, bucket, session, spot, expiry, strike, call, put FROM bucket_pairs WHERE reason IS NULL),
    w AS (SELECT {_SELECTED}, {', '.join(f"arg_min(struct_pack(contract := p.{side}, strike := p.strike), (abs(p.strike - g.spot * {m}::DOUBLE), p.strike)) AS {leg}" for leg, side, m in WINGS)} FROM g JOIN listed_pairs p USING (ticker, expiry) GROUP BY ALL)
    SELECT {_SELECTED}, session, spot, strike, 'atm_call' AS leg, call AS contract, strike AS leg_strike FROM g UNION ALL SELECT {_SELECTED}, session, spot, strike, 'atm_put', put, strike FROM g
    {' '.join(f"UNION ALL SELECT {_SELECTED}, session, spot, strike, '{leg}', CASE WHEN abs({leg}.strike / (spot * {m}::DOUBLE) - 1) <= {LEG_TOLERANCE} THEN {leg}.contract END, {leg}.strike FROM g JOIN w USING ({_SELECTED})" for leg, _, m in WINGS)}""")
view("shape_legs", "leg_contracts contract_marks", f"""SELECT l.*, v.shape, v.sign, m.bid, m.ask, m.session AS marked FROM leg_contracts l JOIN (VALUES {', '.join(f"('{s}', '{leg}', {q})" for s, leg, q in _SIGNS)}) v(shape, leg, sign) USING (leg)
    ASOF LEFT JOIN contract_marks m ON m.contract = l.contract AND l.session >= m.session""")
_PRICED = f"(bid IS NOT NULL AND session - marked <= {MARK_AGE})"
view("shape_cash", "shape_legs", f"""SELECT {_SELECTED}, shape, c.m AS costs, count(*) AS legs, count(*) FILTER (WHERE {_PRICED}) AS priced, count(*) FILTER (WHERE contract IS NULL) AS absent, any_value(CASE shape WHEN 'cash_secured_put' THEN leg_strike ELSE strike END) AS reserve_strike, any_value(spot) AS spot,
      CAST(sum(CAST(round((-sign * 100 * ((bid + ask) / 2 + sign(sign) * (ask - bid) / 2 * c.m) - abs(sign) * 0.65::DOUBLE * c.m) * 1000000) AS BIGINT)) FILTER (WHERE {_PRICED}) AS DOUBLE) / 1000000 AS cash
    FROM shape_legs CROSS JOIN (VALUES (1), (2)) c(m) GROUP BY ALL""")


def contract_marks(spark, folder):
    """(contract, session, price, volume, bid, ask): every contract's own trading days on the session grid."""
    def build(s, f):
        return T.contract_days(s, f).join(F.broadcast(sessions(s, f).select("date", "session")), "date").select("contract", "session", "price", "volume", "bid", "ask")
    return snapshot(spark, folder, "contract-marks", build)


def leg_contracts(spark, folder):
    """One row per anchor and maturity bucket with a pair; `legs` maps each leg to its own (contract, strike). A wing's strike is the listed one nearest to its goal."""
    def build(s, f):
        rows = bucket_pairs(s, f).where("reason is null").select(*KEY, "bucket", "session", "spot", "expiry", "strike", "call", "put")
        listed = J.call_put_pairs(standard(s, f)).select("ticker", "expiry", "strike", "call", "put")
        legs = {"atm_call": F.struct(F.col("call").alias("contract"), F.col("strike").alias("strike")), "atm_put": F.struct(F.col("put").alias("contract"), F.col("strike").alias("strike"))}
        for leg, side, moneyness in WINGS:
            rows = rows.withColumn("goal", F.col("spot") * moneyness)
            rows = J.nearest_listed(rows, listed, ["ticker", "expiry"], "goal", "strike", lambda row, near: F.abs(near["strike"] - row["goal"]))
            fits = F.abs(F.col("near.strike") / F.col("goal") - 1) <= LEG_TOLERANCE
            rows = rows.withColumn(leg, F.struct(F.when(fits, F.col(f"near.{side}")).alias("contract"), F.col("near.strike").alias("strike"))).drop("near", "goal")
            legs[leg] = F.col(leg)
        pairs = [x for name, column in legs.items() for x in (F.lit(name), column)]
        return rows.select(*KEY, "bucket", "session", "spot", "strike", F.create_map(*pairs).alias("legs"))
    return snapshot(spark, folder, "leg-contracts", build)


def shape_cash(spark, folder):
    """Opening cash of every shape from each leg's own last quote, bid/ask friction counted once; no cash unless every leg is priced."""
    def build(s, f):
        legs = C.expand(leg_contracts(s, f), O.SHAPES)
        rows = C.latest(legs, contract_marks(s, f), MARK_AGE, ["bid", "ask"]).withColumn("costs", F.explode(F.array(F.lit(1), F.lit(2))))
        cash = C.leg_cash(F.col("sign"), F.col("mark.bid"), F.col("mark.ask"), F.col("costs"))
        strike = F.when(F.col("shape") == "cash_secured_put", F.col("leg_strike")).otherwise(F.col("strike"))
        return rows.groupBy(*KEY, "bucket", "shape", "costs").agg(
            F.count(F.lit(1)).alias("legs"), F.count("mark").alias("priced"), F.count_if(F.col("contract").isNull()).alias("absent"), F.first(strike).alias("reserve_strike"), F.first("spot").alias("spot"),
            (F.sum(F.round(cash * 1000000).cast("bigint")) / 1000000).alias("cash"))
    return snapshot(spark, folder, "shape-cash", build)


_CASH_STATUS = "CASE WHEN absent > 0 THEN 'required_leg_unavailable' WHEN priced < legs THEN 'required_leg_quote_missing' ELSE 'priced' END"


def with_cash_status(rows):
    status = first_reason((F.col("absent") > 0, "required_leg_unavailable"), (F.col("priced") < F.col("legs"), "required_leg_quote_missing"))
    return rows.withColumn("status", F.coalesce(status, F.lit("priced"))).withColumn("cash", F.when(F.col("status") == "priced", F.col("cash")))


@study("l5_leg_cash_flow", f"SELECT {_SELECTED}, shape, costs, legs, priced, {_CASH_STATUS} AS status, CASE WHEN priced = legs THEN cash END AS opening_cash FROM shape_cash", "shape_cash")
def l5(spark, folder):
    return with_cash_status(shape_cash(spark, folder)).select(*KEY, "bucket", "shape", "costs", "legs", "priced", "status", F.col("cash").alias("opening_cash"))


_GROWTH = "(exp(0.04::DOUBLE * 14 / 365.25::DOUBLE) - 1)"


@study("l6_reserve_interest", f"""SELECT {_SELECTED}, shape, costs, {_CASH_STATUS} AS status, {r('100 * reserve_strike', 5)} AS reserve, {r(f'CASE WHEN priced = legs THEN (100 * reserve_strike + cash) * {_GROWTH} END', 4)} AS interest, {r('CASE WHEN priced = legs THEN cash / (100 * reserve_strike) END')} AS collateral_return FROM shape_cash""", "shape_cash")
def l6(spark, folder):
    funding = 100 * F.col("reserve_strike")
    return with_cash_status(shape_cash(spark, folder)).select(*KEY, "bucket", "shape", "costs", "status", rounded(funding, 5).alias("reserve"), rounded((funding + F.col("cash")) * F.expm1(F.lit(O.RATE * 14 / O.YEAR)), 4).alias("interest"),
                                                              rounded(F.col("cash") / funding).alias("collateral_return"))


HAIRCUTS = [0.0, 0.01, 0.05]
_AGED = f"CASE WHEN m.session >= x.at - {MARK_AGE} THEN m.{{}} END"


@study("l7_mark_scenario", f"""
WITH x AS (SELECT {_SELECTED}, spot, leg, contract, t.offset_ AS step, session + t.offset_ AS at FROM leg_contracts CROSS JOIN (VALUES (1), (11)) t(offset_) WHERE leg IN ('atm_call', 'atm_put')),
m AS (SELECT x.*, {_AGED.format('price')} AS price, x.at - {_AGED.format('session')} AS age FROM x ASOF LEFT JOIN contract_marks m ON m.contract = x.contract AND x.at >= m.session),
w AS (SELECT {_SELECTED}, any_value(spot) AS spot, max(age) AS oldest, {', '.join(f"max(price) FILTER (WHERE leg = 'atm_{side}' AND step = {k}) AS {side[0]}{k}" for side in ('call', 'put') for k in (1, 11))} FROM m GROUP BY ALL)
SELECT {_SELECTED}, haircut, CASE WHEN c1 + p1 + c11 + p11 IS NULL THEN 'inconclusive' ELSE 'measured' END AS status, CASE WHEN c1 + p1 + c11 + p11 IS NOT NULL THEN CAST(oldest AS INTEGER) END AS oldest_mark,
  {r('(100 * ((c11 - c1) - (p11 - p1)) - 100 * haircut * (c1 + c11 + p1 + p11) - 4 * 0.65::DOUBLE) / (100 * spot)')} AS scenario_return FROM w CROSS JOIN (SELECT unnest([0::DOUBLE, 0.01::DOUBLE, 0.05::DOUBLE]) AS haircut) h""", "leg_contracts contract_marks")
def l7(spark, folder):
    legs = leg_contracts(spark, folder).select(*KEY, "bucket", "spot", "session", F.explode(F.map_filter("legs", lambda k, v: k.isin("atm_call", "atm_put"))).alias("leg", "l"))
    asked = legs.select(*KEY, "bucket", "spot", "leg", F.col("l.contract").alias("contract"), "session", F.explode(F.array(F.lit(1), F.lit(11))).alias("step")).withColumn("session", F.col("session") + F.col("step"))
    rows = C.latest(asked, contract_marks(spark, folder), MARK_AGE, ["price"])

    def at(side, k):
        return F.max(F.when((F.col("leg") == f"atm_{side}") & (F.col("step") == k), F.col("mark.price"))).alias(f"{side[0]}{k}")

    wide = rows.groupBy(*KEY, "bucket").agg(F.first("spot").alias("spot"), F.max(F.col("session") - F.col("mark.session")).alias("oldest"), *[at(side, k) for side in ("call", "put") for k in (1, 11)])
    wide = wide.withColumn("haircut", F.explode(F.array(*[F.lit(h) for h in HAIRCUTS])))
    change = 100 * ((F.col("c11") - F.col("c1")) - (F.col("p11") - F.col("p1"))) - 100 * F.col("haircut") * (F.col("c1") + F.col("c11") + F.col("p1") + F.col("p11")) - 4 * O.OPTION_FEE
    value = change / (100 * F.col("spot"))
    return wide.select(*KEY, "bucket", "haircut", F.when(value.isNull(), "inconclusive").otherwise("measured").alias("status"), F.when(value.isNotNull(), F.col("oldest")).cast("int").alias("oldest_mark"), rounded(value).alias("scenario_return"))


# Units of stock, call and put that a shape holds; the synthetic long is every other one's baseline.
UNITS = {"synthetic_long": (0, 1, -1), "covered_call": (1, -1, 0), "protective_put": (1, 0, 1), "cash_secured_put": (0, 0, -1)}
BASELINE = "synthetic_long"


def _held(units: str, text: str) -> str:
    return f"CASE WHEN {units} = 0 THEN 0::DOUBLE ELSE {text} END"


view("outcome_grid", "option_anchors option_dense", f"""SELECT *, CASE WHEN net_return IS NULL THEN 'inconclusive' ELSE 'measured' END AS status FROM (SELECT a.ticker, a.pair_session, a.role, g.horizon, g.delay, g.costs, g.shape,
      (100 * (g.su * (x.stock - e.stock) + {_held('g.cu', 'g.cu * (x.call - e.call)')} + {_held('g.pu', 'g.pu * (x.put - e.put)')}) - g.costs * (100 * g.su * (e.stock + x.stock) * 0.0006::DOUBLE
        + 100 * ({_held('g.cu', 'e.call + x.call')} + {_held('g.pu', 'e.put + x.put')}) * 0.05::DOUBLE + 1.3::DOUBLE * (abs(g.cu) + abs(g.pu)))) / (100 * e.stock) AS net_return, (x.stock - e.stock) / e.stock AS stock_return
    FROM option_anchors a CROSS JOIN (SELECT * FROM (VALUES (5), (10), (21)) h(horizon), (VALUES (1), (3)) d(delay), (VALUES (1), (2)) c(costs), (VALUES {', '.join(f"('{k}', {u[0]}, {u[1]}, {u[2]})" for k, u in UNITS.items())}) s(shape, su, cu, pu)) g
      LEFT JOIN option_dense e ON e.ticker = a.ticker AND e.session = a.session + g.delay LEFT JOIN option_dense x ON x.ticker = a.ticker AND x.session = a.session + g.delay + g.horizon)""")


def outcome_grid(spark, folder):
    def build(s, f):
        shapes = [F.struct(F.lit(k).alias("shape"), *[F.lit(u).alias(n) for n, u in zip(("su", "cu", "pu"), units)]) for k, units in UNITS.items()]
        clocks = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(d).alias("delay")) for h in (5, 10, 21) for d in (1, 3)])
        rows = anchors(s, f).select(*KEY, "session", F.explode(clocks).alias("g")).select(*KEY, "session", "g.*").withColumns({"at0": F.col("session") + F.col("delay"), "at1": F.col("session") + F.col("delay") + F.col("horizon")})
        m = option_dense(s, f)
        e = m.select("ticker", F.col("session").alias("at0"), F.col("stock").alias("s0"), F.col("call").alias("c0"), F.col("put").alias("p0"))
        x = m.select("ticker", F.col("session").alias("at1"), F.col("stock").alias("s1"), F.col("call").alias("c1"), F.col("put").alias("p1"))
        # Marks meet a clock once; shapes and costs are laid out afterwards.
        j = rows.join(e, ["ticker", "at0"], "left").join(x, ["ticker", "at1"], "left")
        j = j.withColumn("z", F.explode(F.array(*shapes))).select("*", "z.*").withColumn("costs", F.explode(F.array(F.lit(1), F.lit(2))))

        def held(units, value):
            return F.when(F.col(units) == 0, 0.0).otherwise(value)

        change = F.col("su") * (F.col("s1") - F.col("s0")) + held("cu", F.col("cu") * (F.col("c1") - F.col("c0"))) + held("pu", F.col("pu") * (F.col("p1") - F.col("p0")))
        traded = held("cu", F.col("c0") + F.col("c1")) + held("pu", F.col("p0") + F.col("p1"))
        cost = F.col("costs") * (100 * F.col("su") * (F.col("s0") + F.col("s1")) * O.STOCK_FRICTION + 100 * traded * O.OPTION_FRICTION + 2 * O.OPTION_FEE * (F.abs("cu") + F.abs("pu")))
        net = (100 * change - cost) / (100 * F.col("s0"))
        return j.select(*KEY, "horizon", "delay", "costs", "shape", F.when(net.isNull(), "inconclusive").otherwise("measured").alias("status"), net.alias("net_return"), ((F.col("s1") - F.col("s0")) / F.col("s0")).alias("stock_return"))
    return snapshot(spark, folder, "outcome-grid", build)


GRID = ["horizon", "delay", "costs", "shape"]


@study("l8_outcome_grid", f"SELECT ticker, pair_session, role, horizon, delay, costs, shape, status, {r('net_return')} AS net_return FROM outcome_grid", "outcome_grid")
def l8(spark, folder):
    return outcome_grid(spark, folder).select(*KEY, *GRID, "status", rounded("net_return").alias("net_return"))


@study("a30_trial_cells", f"SELECT shape, horizon, delay, costs, count_if(status = 'measured') AS measured, count_if(status <> 'measured') AS missing, count(DISTINCT CASE WHEN status = 'measured' THEN ticker END) AS issuers, {r('avg(net_return)')} AS mean FROM outcome_grid GROUP BY 1, 2, 3, 4", "outcome_grid")
def a30(spark, folder):
    good = F.col("status") == "measured"
    return outcome_grid(spark, folder).groupBy(*GRID).agg(F.count_if(good).alias("measured"), F.count_if(~good).alias("missing"), F.count_distinct(F.when(good, F.col("ticker"))).alias("issuers"), rounded(F.avg("net_return")).alias("mean"))


@study("j11_strategy_baseline", f"""SELECT a.ticker, a.pair_session, a.role, a.horizon, a.delay, a.costs, a.shape, {r('a.net_return - b.net_return')} AS difference, {r('a.net_return - a.stock_return')} AS over_stock
  FROM outcome_grid a JOIN outcome_grid b USING (ticker, pair_session, role, horizon, delay, costs) WHERE a.status = 'measured' AND b.status = 'measured' AND b.shape = '{BASELINE}' AND a.shape <> '{BASELINE}'""", "outcome_grid")
def j11(spark, folder):
    """Every shape less the synthetic long of the same anchor, clock and cost; both come from one group, so nothing is joined."""
    keys = [*KEY, "horizon", "delay", "costs"]
    rows = outcome_grid(spark, folder).where("status = 'measured'").groupBy(*keys).agg(
        F.max(F.when(F.col("shape") == BASELINE, F.col("net_return"))).alias("b"), F.collect_list(F.when(F.col("shape") != BASELINE, F.struct("shape", "net_return", "stock_return"))).alias("own"))
    rows = rows.where("b is not null").select(*keys, "b", F.explode("own").alias("o"))
    return rows.select(*keys, "o.shape", rounded(F.col("o.net_return") - F.col("b")).alias("difference"), rounded(F.col("o.net_return") - F.col("o.stock_return")).alias("over_stock"))


# ---------------------------------------------------------------- quartets and effects

def _member(role: str, stock_only: str, field: str) -> str:
    return f"max({field}) FILTER (WHERE role = '{role}' AND stock_only = {stock_only})"


_MEMBERS = {"e": ("event", "false"), "es": ("event", "true"), "o": ("ordinary", "false"), "os": ("ordinary", "true")}
_AGGS = ", ".join([f"{_member(a, b, 'net_return')} AS {n}, {_member(a, b, 'downside_loss')} AS {n}_loss, {_member(a, b, 'CAST(evaluation_aligned AS INTEGER)')} AS {n}_ok, {_member(a, b, '1')} AS {n}_here" for n, (a, b) in _MEMBERS.items()]
                  + [f"{_member(a, 'false', f)} AS {n}_{f}" for n, a in (("e", "event"), ("o", "ordinary")) for f in ("dte", "achieved_otm", "premium_ratio")])
view("quartets", "outcomes", f"""WITH g AS (SELECT ticker, pair_session, shape, year(max(decision_date) FILTER (WHERE role = 'event')) AS year, {_AGGS} FROM outcomes GROUP BY 1, 2, 3)
    SELECT *, CASE WHEN e_here IS NULL OR es_here IS NULL OR o_here IS NULL OR os_here IS NULL THEN 'missing_quartet_member' WHEN e IS NULL OR es IS NULL OR o IS NULL OR os IS NULL THEN 'incomplete_return' WHEN e_ok + es_ok + o_ok + os_ok < 4 THEN 'stock_counterfactual_clock_differs'
      WHEN NOT (abs(e_dte - o_dte) <= 30 AND abs(e_achieved_otm - o_achieved_otm) <= 0.1::DOUBLE AND e_premium_ratio > 0 AND o_premium_ratio > 0 AND greatest(e_premium_ratio, o_premium_ratio) / least(e_premium_ratio, o_premium_ratio) <= 4) THEN 'option_caliper_failed' END AS reason FROM g""")


def make_quartets(rows, value="net_return"):
    """Event and ordinary, with and without the option, side by side per pair and shape; a reason when not usable."""
    def pick(role, only, field):
        return F.max(F.when((F.col("role") == role) & (F.col("stock_only") == only), F.col(field)))
    aggs = [F.year(F.max(F.when(F.col("role") == "event", F.col("decision_date")))).alias("year")]
    for n, role, only in (("e", "event", False), ("es", "event", True), ("o", "ordinary", False), ("os", "ordinary", True)):
        aggs += [pick(role, only, value).alias(n), pick(role, only, "downside_loss").alias(f"{n}_loss"), pick(role, only, "aligned").alias(f"{n}_ok"), pick(role, only, "here").alias(f"{n}_here")]
    for n, role in (("e", "event"), ("o", "ordinary")):
        aggs += [pick(role, False, f).alias(f"{n}_{f}") for f in ("dte", "achieved_otm", "premium_ratio")]
    wide = rows.withColumns({"aligned": F.col("evaluation_aligned").cast("int"), "here": F.lit(1)}).groupBy("ticker", "pair_session", "shape").agg(*aggs)
    names = ["e", "es", "o", "os"]
    absent = sum((F.col(f"{n}_here").isNull().cast("int") for n in names[1:]), F.col("e_here").isNull().cast("int")) > 0
    incomplete = sum((F.col(n).isNull().cast("int") for n in names[1:]), F.col("e").isNull().cast("int")) > 0
    close = ((F.abs(F.col("e_dte") - F.col("o_dte")) <= 30) & (F.abs(F.col("e_achieved_otm") - F.col("o_achieved_otm")) <= 0.1) & (F.col("e_premium_ratio") > 0) & (F.col("o_premium_ratio") > 0)
             & (F.greatest("e_premium_ratio", "o_premium_ratio") / F.least("e_premium_ratio", "o_premium_ratio") <= 4))
    reason = first_reason((absent, "missing_quartet_member"), (incomplete, "incomplete_return"),
                          (F.col("e_ok") + F.col("es_ok") + F.col("o_ok") + F.col("os_ok") < 4, "stock_counterfactual_clock_differs"), (~close, "option_caliper_failed"))
    return wide.withColumn("reason", reason)


def quartets(spark, folder):
    return snapshot(spark, folder, "quartets", lambda s, f: make_quartets(outcomes(s, f)))


@study("j10_quartets", f"SELECT ticker, pair_session, shape, reason, {r('e')} AS event_return, {r('os')} AS ordinary_stock_return FROM quartets", "quartets")
def j10(spark, folder):
    return quartets(spark, folder).select("ticker", "pair_session", "shape", "reason", rounded("e").alias("event_return"), rounded("os").alias("ordinary_stock_return"))


@study("j22_common_cohort", f"SELECT ticker, pair_session, {r('a.e')} AS call_return, {r('b.e')} AS put_return FROM quartets a JOIN quartets b USING (ticker, pair_session) WHERE a.shape = 'covered_call' AND b.shape = 'protective_put' AND a.reason IS NULL AND b.reason IS NULL AND a.year = b.year", "quartets")
def j22(spark, folder):
    q = quartets(spark, folder).where("reason is null")
    a = q.where("shape = 'covered_call'").select("ticker", "pair_session", "year", F.col("e").alias("a"))
    b = q.where("shape = 'protective_put'").select("ticker", "pair_session", "year", F.col("e").alias("b"))
    return a.join(b, ["ticker", "pair_session", "year"]).select("ticker", "pair_session", rounded("a").alias("call_return"), rounded("b").alias("put_return"))


METRICS = {"overlay_increment": "(e - es) - (o - os)", "strategy_increment": "e - o", "hedge_increment": "(es_loss - e_loss) - (os_loss - o_loss)", "event_downside_reduction": "es_loss - e_loss", "event_return_drag": "e - es"}
view("effect_rows", "quartets", "SELECT q.ticker, q.pair_session, q.shape, q.year, m.metric, CASE m.metric " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in METRICS.items()) + " END AS value FROM quartets q CROSS JOIN (VALUES " + ", ".join(f"('{k}')" for k in METRICS) + ") m(metric) WHERE q.reason IS NULL")


def effect_rows(quads):
    """Long form of the signed leg combinations."""
    items = F.array(*[F.struct(F.lit(k).alias("metric"), F.expr(v).alias("value")) for k, v in METRICS.items()])
    return quads.where("reason is null").select("ticker", "pair_session", "shape", "year", F.explode(items).alias("m")).select("ticker", "pair_session", "shape", "year", "m.*")


def effect_table(rows, keys):
    issuers = rows.where("value is not null").groupBy(*keys, "ticker").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    table = issuers.groupBy(*keys).agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("issuers"), (F.sum("s") / F.sum("n")).alias("estimate"))
    good = (F.col("pairs") >= 20) & (F.col("issuers") >= 5)
    return table.withColumn("status", F.when(good, "eligible_descriptive").otherwise("insufficient_support"))


_EFFECT = f"count(value) AS pairs, count(DISTINCT CASE WHEN value IS NOT NULL THEN ticker END) AS issuers, {r('avg(value)')} AS estimate, CASE WHEN count(value) >= 20 AND count(DISTINCT CASE WHEN value IS NOT NULL THEN ticker END) >= 5 THEN 'eligible_descriptive' ELSE 'insufficient_support' END AS status"


@study("c15_quartet_effects", f"SELECT shape, metric, {_EFFECT} FROM effect_rows WHERE value IS NOT NULL GROUP BY 1, 2", "effect_rows")
def c15(spark, folder):
    return effect_table(effect_rows(quartets(spark, folder)), ["shape", "metric"]).withColumn("estimate", rounded("estimate"))


@study("c19_robustness_grid", f"""
WITH g AS (SELECT 'year:' || year AS slice, * FROM effect_rows UNION ALL SELECT 'without:' || t.ticker, e.* FROM effect_rows e JOIN (SELECT DISTINCT ticker FROM effect_rows) t ON t.ticker <> e.ticker)
SELECT slice, shape, metric, {_EFFECT} FROM g WHERE value IS NOT NULL GROUP BY 1, 2, 3""", "effect_rows")
def c19(spark, folder):
    rows = effect_rows(quartets(spark, folder)).where("value is not null")
    yearly = effect_table(rows.withColumn("slice", F.concat(F.lit("year:"), F.col("year").cast("string"))), ["slice", "shape", "metric"])
    parts = rows.groupBy("shape", "metric", "ticker").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    every = rows.agg(F.array_sort(F.collect_set("ticker"))).scalar()
    total = parts.groupBy("shape", "metric").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"), F.count(F.lit(1)).alias("tk")).withColumn("ticker", F.explode(every))
    rest = total.join(parts, ["shape", "metric", "ticker"], "left").select(
        F.concat(F.lit("without:"), "ticker").alias("slice"), "shape", "metric", (F.col("tn") - F.coalesce("n", F.lit(0))).alias("pairs"), (F.col("tk") - F.col("n").isNotNull().cast("int")).alias("issuers"),
        F.try_divide(F.col("ts") - F.coalesce("s", F.lit(0.0)), F.col("tn") - F.coalesce("n", F.lit(0))).alias("estimate")).where("pairs > 0")
    rest = rest.withColumn("status", F.when((F.col("pairs") >= 20) & (F.col("issuers") >= 5), "eligible_descriptive").otherwise("insufficient_support"))
    return yearly.unionByName(rest).withColumn("estimate", rounded("estimate"))


@study("c21_quote_side_effects")
def c21(spark, folder):
    rows = quote_outcomes(spark, folder).withColumn("net_return", F.col("quote_net_return"))
    quads = make_quartets(rows)
    return quads.groupBy("shape", F.coalesce("reason", F.lit("accepted")).alias("result")).agg(F.count(F.lit(1)).alias("pairs"), rounded(F.avg(F.when(F.col("reason").isNull(), F.expr(METRICS["overlay_increment"])))).alias("overlay_increment"))


@study("a31_method_checks", """
WITH f AS (SELECT count(*) AS records, count_if(status = 'completed') AS completed, count_if(path_complete) AS path_complete, count_if(status = 'initiated_unresolved') AS unresolved FROM outcomes), q AS (SELECT count_if(reason IS NULL) AS accepted FROM quartets),
c AS (SELECT * FROM (VALUES ('completed_outcomes', 200), ('complete_paths', 200), ('accepted_quartets', 20), ('unresolved_records', 1)) v("check", floor))
SELECT c."check", CASE c."check" WHEN 'completed_outcomes' THEN completed WHEN 'complete_paths' THEN path_complete WHEN 'accepted_quartets' THEN accepted ELSE unresolved END AS count, CASE WHEN CASE c."check" WHEN 'completed_outcomes' THEN completed WHEN 'complete_paths' THEN path_complete WHEN 'accepted_quartets' THEN accepted ELSE unresolved END >= floor THEN 'reached' ELSE 'not_reached' END AS status FROM c, f, q""", "outcomes quartets")
def a31(spark, folder):
    facts = outcomes(spark, folder).agg(F.count_if(F.col("status") == "completed").alias("completed_outcomes"), F.count_if("path_complete").alias("complete_paths"), F.count_if(F.col("status") == "initiated_unresolved").alias("unresolved_records"))
    facts = facts.selectExpr("stack(3, 'completed_outcomes', completed_outcomes, 'complete_paths', complete_paths, 'unresolved_records', unresolved_records) as (check, count)")
    quads = quartets(spark, folder).agg(F.lit("accepted_quartets").alias("check"), F.count_if(F.col("reason").isNull()).alias("count"))
    floors = F.create_map(*[F.lit(x) for kv in {"completed_outcomes": 200, "complete_paths": 200, "accepted_quartets": 20, "unresolved_records": 1}.items() for x in kv])
    return facts.unionByName(quads).withColumn("status", F.when(F.col("count") >= F.try_element_at(floors, F.col("check")), "reached").otherwise("not_reached"))


# ---------------------------------------------------------------- value series and performance

view("positions", "trades sessions", """SELECT ticker, session, sum(q) AS quantity_delta, sum(c) AS cash_delta FROM (SELECT t.ticker, s.session, 1 AS q, -entry_price AS c FROM trades t JOIN sessions s ON s.date = t.entry_date UNION ALL SELECT t.ticker, s.session, -1, exit_price FROM trades t JOIN sessions s ON s.date = t.exit_date) GROUP BY 1, 2""")
view("nav", "positions dense", """SELECT ticker, session, date, CASE WHEN quantity = 0 THEN cash ELSE cash + quantity * close END AS nav, cash, quantity FROM (SELECT d.ticker, d.session, d.date, d.close, 100000 + sum(coalesce(cash_delta, 0)) OVER w AS cash, sum(coalesce(quantity_delta, 0)) OVER w AS quantity
    FROM dense d LEFT JOIN positions USING (ticker, session) WINDOW w AS (PARTITION BY ticker ORDER BY session))""")


def nav(spark, folder):
    def build(s, f):
        t = trades(s, f)
        moves_ = t.select("ticker", F.col("entry_date").alias("date"), F.lit(1).alias("q"), (-F.col("entry_price")).alias("c")).unionByName(
            t.where("exit_date is not null").select("ticker", F.col("exit_date").alias("date"), F.lit(-1).alias("q"), F.col("exit_price").alias("c")))
        positions = moves_.join(P.calendar(sessions(s, f)), "date").groupBy("ticker", "session").agg(F.sum("q").alias("quantity_delta"), F.sum("c").alias("cash_delta"))
        out = O.net_value(positions, dense(s, f).withColumnRenamed("close", "mark"), ["ticker"])
        return out.select("ticker", "session", "date", (F.col("nav") + 100000).alias("nav"), (F.col("cash") + 100000).alias("cash"), "quantity")
    return snapshot(spark, folder, "nav", build)


@study("l9_net_value", f"SELECT ticker, session, {r('nav', 3)} AS nav, {r('cash', 3)} AS cash, CAST(quantity AS BIGINT) AS quantity FROM nav", "nav")
def l9(spark, folder):
    return nav(spark, folder).select("ticker", "session", rounded("nav", 3).alias("nav"), rounded("cash", 3).alias("cash"), "quantity")


def _perf_sql(keys: str, source: str, start: str = "100000", rate: str = "0.04::DOUBLE") -> str:
    return f"""WITH x AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN {start} ELSE lag(nav) OVER w END AS previous, exp({rate} * coalesce(date - lag(date) OVER w, 0) / 365.25::DOUBLE) - 1 AS rf, {start} AS origin, greatest({start}, max(nav) OVER (PARTITION BY {keys} ORDER BY session)) AS peak FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY session)),
    y AS (SELECT *, nav / previous - 1 AS ret FROM x)
    SELECT {keys}, count(*) AS observations, CASE WHEN count(*) = count(nav) AND max(origin) IS NOT NULL THEN 'measured' ELSE 'inconclusive' END AS status, {r('CASE WHEN count(*) = count(nav) AND max(origin) IS NOT NULL THEN pow(arg_max(nav, session) / max(origin), 252::DOUBLE / count(*)) - 1 END', 5)} AS annualized_return,
      {r('CASE WHEN count(*) = count(nav) AND max(origin) IS NOT NULL THEN stddev_samp(ret) * sqrt(252) END', 5)} AS annualized_volatility, {r('CASE WHEN count(*) = count(nav) AND max(origin) IS NOT NULL AND stddev_samp(ret - rf) > 1e-15 THEN avg(ret - rf) / stddev_samp(ret - rf) * sqrt(252) END', 4)} AS sharpe, {r('CASE WHEN count(*) = count(nav) AND max(origin) IS NOT NULL THEN least(0, min(nav / peak - 1)) END', 5)} AS max_drawdown FROM y GROUP BY ALL"""


def _show_perf(df, keys):
    return df.select(*keys, "observations", "status", *[rounded(c, 4 if c == "sharpe" else 5).alias(c) for c in ("annualized_return", "annualized_volatility", "sharpe", "max_drawdown")])


view("nav_filled", "nav", "SELECT ticker, session, date, last_value(nav IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS nav FROM nav")


@study("l10_performance", "SELECT 'strict' AS rule, * FROM (" + _perf_sql("ticker", "nav") + ") UNION ALL SELECT 'carried', * FROM (" + _perf_sql("ticker", "nav_filled") + ")", "nav nav_filled")
def l10(spark, folder):
    strict = O.performance(nav(spark, folder), ["ticker"], 100000.0, O.RATE).withColumn("rule", F.lit("strict"))
    carried = nav(spark, folder).select("ticker", "session", "date", J.aged_mark("nav", 3)[0].alias("nav"))
    filled = O.performance(carried, ["ticker"], 100000.0, O.RATE).withColumn("rule", F.lit("carried"))
    return _show_perf(strict.unionByName(filled), ["rule", "ticker"])


view("nav_year", "nav_filled", """SELECT ticker, year, session, date, nav, first_value(before) OVER (PARTITION BY ticker, year ORDER BY session) AS start FROM (
    SELECT ticker, year(date) AS year, session, date, nav, CASE WHEN row_number() OVER w = 1 THEN 100000 ELSE lag(nav) OVER w END AS before FROM nav_filled WINDOW w AS (PARTITION BY ticker ORDER BY session))""")


@study("l11_performance_by_year", "SELECT p.*, CAST(p.observations = c.n AS INTEGER) AS calendar_complete FROM (" + _perf_sql("ticker, year", "nav_year", "start", "0::DOUBLE") + ") p JOIN (SELECT year(date) AS year, count(*) AS n FROM sessions GROUP BY 1) c USING (year)", "nav_year sessions")
def l11(spark, folder):
    carried = nav(spark, folder).select("ticker", F.year("date").cast("bigint").alias("year"), "session", "date", J.aged_mark("nav", 3)[0].alias("nav"))
    # A year starts from the value before its first session, the first one from the initial cash; a missing one blocks the year.
    w = W.partitionBy("ticker").orderBy("session")
    before = F.when(F.row_number().over(w) == 1, F.lit(100000.0)).otherwise(F.lag("nav").over(w))
    carried = carried.withColumn("before", before).withColumn("start_nav", F.first("before").over(W.partitionBy("ticker", "year").orderBy("session")))
    days = sessions(spark, folder).groupBy(F.year("date").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    out = O.performance(carried, ["ticker", "year"], "start_nav", 0.0).join(F.broadcast(days), "year")
    return _show_perf(out, ["ticker", "year", "n"]).withColumn("calendar_complete", flag(F.col("observations") == F.col("n"))).drop("n")


@study("l12_chart_series", f"""
SELECT ticker, session, 'equity' AS series, {r('nav', 3)} AS value FROM nav WHERE nav IS NOT NULL UNION ALL SELECT ticker, session, 'close', close FROM dense WHERE close IS NOT NULL UNION ALL SELECT ticker, session, 'volume', volume FROM dense WHERE volume IS NOT NULL
UNION ALL SELECT t.ticker, s.session, 'buy_marker', entry_price FROM trades t JOIN sessions s ON s.date = t.entry_date UNION ALL SELECT t.ticker, s.session, 'sell_marker', exit_price FROM trades t JOIN sessions s ON s.date = t.exit_date""", "nav dense trades")
def l12(spark, folder):
    bars = dense(spark, folder).unpivot(["ticker", "session"], ["close", "volume"], "series", "value").where("value is not null")
    equity = nav(spark, folder).where("nav is not null").select("ticker", "session", F.lit("equity").alias("series"), F.col("nav").alias("value"))
    t = trades(spark, folder)
    marks = t.select("ticker", F.col("entry_date").alias("date"), F.lit("buy_marker").alias("series"), F.col("entry_price").alias("value")).unionByName(
        t.where("exit_date is not null").select("ticker", F.col("exit_date").alias("date"), F.lit("sell_marker").alias("series"), F.col("exit_price").alias("value")))
    marks = marks.join(P.calendar(sessions(spark, folder)), "date").select("ticker", "session", "series", "value")
    digits = F.when(F.col("series") == "equity", rounded("value", 3)).otherwise(F.col("value"))
    return bars.unionByName(equity).unionByName(marks).select("ticker", "session", "series", digits.alias("value"))
