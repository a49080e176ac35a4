"""Queries of joins, ordered selection, event alignment and pattern mining."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import big, counter_draw, first_reason, flag, no_nulls, rounded
from tidemark.operators import estimators as E
from tidemark.operators import joins as J
from tidemark.operators import matching as M
from tidemark.operators import panel as P
from tidemark.operators import patterns as N
from tidemark.operators import series as Z
from tidemark.plans.basics import option_dense
from tidemark.plans.market import CATEGORIES, aligned, dense, moves, sessions
from tidemark.plans.registry import study
from tidemark.plans.sqlviews import draw, r, view
from tidemark.session import snapshot
from tidemark.sources import tables as T

NAMES = ["return20", "vol20", "log_adv20"]
A, B = T.EVENT_LABELS

_W = "(PARTITION BY ticker ORDER BY session)"
_F20 = "(PARTITION BY ticker ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
view("features", "moves", f"""SELECT ticker, session, date, close, close / lag(close, 20) OVER {_W} - 1 AS return20,
      CASE WHEN count(ret) OVER {_F20} = 20 THEN sqrt(avg(ret * ret) OVER {_F20}) END AS vol20,
      CASE WHEN count(close * volume) OVER {_F20} = 20 THEN ln(1 + avg(close * volume) OVER {_F20}) END AS log_adv20,
      lead(date, 5) OVER {_W} AS target_end, CASE WHEN count(ret) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 THEN lead(close, 5) OVER {_W} / close - 1 END AS return_5
    FROM moves""")
view("complete", "features", "SELECT * FROM features WHERE return20 IS NOT NULL AND vol20 IS NOT NULL AND log_adv20 IS NOT NULL")
_H = "(PARTITION BY ticker ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
view("scaled", "complete", "SELECT *, " + ", ".join(
    f"CASE WHEN count(*) OVER {_H} >= 21 THEN greatest(stddev_pop({n}) OVER {_H}, 1e-8::DOUBLE) END AS scale_{n}" for n in NAMES) + " FROM complete")
view("cohort", "aligned filing_labels", """SELECT a.* FROM aligned a WHERE session IS NOT NULL AND accession IN (SELECT accession FROM filing_labels WHERE label = 'Brand#7')
    AND accession IN (SELECT accession FROM filing_labels WHERE label = 'Brand#12')""")
view("component", "aligned filing_labels", """SELECT a.* FROM aligned a WHERE session IS NOT NULL AND accession IN (SELECT accession FROM filing_labels WHERE label = 'Brand#7')
    AND accession NOT IN (SELECT accession FROM filing_labels WHERE label = 'Brand#12')""")


def features(spark, folder):
    """Prior state per ticker and session, with the five-session outcome."""
    return snapshot(spark, folder, "features", lambda s, f: moves(s, f).select(
        "ticker", "session", "date", "close", P.past_return(20).alias("return20"), P.rolling_rms(20).alias("vol20"),
        F.log1p(P.average_dollar_volume(20)).alias("log_adv20"), P.target_end(5).alias("target_end"), P.forward_return(5).alias("return_5")))


def complete(spark, folder):
    return features(spark, folder).where(no_nulls(*NAMES))


def labelled(spark, folder):
    """Aligned filings with their label array."""
    return snapshot(spark, folder, "labelled", lambda s, f: aligned(s, f).join(
        T.label_arrays(s, f), "accession", "left").withColumn(
        "labels", F.coalesce("labels", F.array().cast("array<string>"))))


def event_filings(spark, folder):
    """Aligned filings with the first event label, and whether they have the second: lines of other labels are dropped before anything is shuffled."""
    def build(s, f):
        parts = snapshot(s, f, "event-parts", lambda s, f: T.table(s, f, "part").where(F.col("p_brand").isin(A, B)).select("p_partkey", F.col("p_brand").alias("label")))
        lines = T.table(s, f, "lineitem").select(F.col("l_orderkey").alias("accession"), "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
        marks = lines.groupBy("accession").agg(F.bool_or(F.col("label") == A).alias("first"), F.bool_or(F.col("label") == B).alias("second")).where("first").select("accession", "second")
        return P.align_forward(T.filings(s, f, marks), sessions(s, f), "available_date").where("session is not null")
    return snapshot(spark, folder, "event-filings", build)


def cohort(spark, folder):
    return event_filings(spark, folder).where("second").drop("second")


def component(spark, folder):
    return event_filings(spark, folder).where("not second").drop("second")


def sessions_of(rows):
    return rows.select("ticker", "session").distinct()


# ---------------------------------------------------------------- as-of and offset joins

@study("j4_aged_marks", f"""
SELECT ticker, session, CASE WHEN session - s <= 3 THEN c END AS mark, CASE WHEN session - s <= 3 THEN session - s END AS age
FROM (SELECT d.ticker, d.session, o.session AS s, o.call AS c FROM option_dense d ASOF LEFT JOIN (SELECT ticker, session, call FROM option_dense WHERE call IS NOT NULL) o ON o.ticker = d.ticker AND d.session >= o.session)""", "option_dense")
def j4(spark, folder):
    mark, age = J.aged_mark("call", 3)
    return option_dense(spark, folder).select("ticker", "session", mark.alias("mark"), age.alias("age"))


MAX_AGE = 12 * 3600 * 1000000000


def cutoffs(spark, folder):
    """16:00 of every session for each ticker and leg with quotes."""
    close = (F.unix_date("date").cast("bigint") * 86400 + 57600) * 1000000000
    return dense(spark, folder).select("ticker", "session", close.alias("cutoff_ns"), F.explode(F.array(F.lit("stock"), F.lit("option"))).alias("leg"))


view("cutoffs", "dense", "SELECT ticker, session, leg, (CAST(date - DATE '1970-01-01' AS BIGINT) * 86400 + 57600) * 1000000000 AS cutoff_ns FROM dense CROSS JOIN (VALUES ('stock'), ('option')) v(leg)")
view("asof_quotes", "cutoffs quotes", f"""SELECT ticker, session, leg, cutoff_ns, q.ts_ns, q.bid, q.ask, q.bid_size, q.ask_size FROM cutoffs LEFT JOIN LATERAL (
    SELECT arg_max(struct_pack(ts_ns := ts_ns, bid := bid, ask := ask, bid_size := bid_size, ask_size := ask_size), struct_pack(t := ts_ns, s := sequence)) AS q FROM quotes
    WHERE quotes.ticker = cutoffs.ticker AND quotes.leg = cutoffs.leg AND quotes.ts_ns BETWEEN cutoff_ns - {MAX_AGE} AND cutoff_ns) ON true""")


def asof_quotes(spark, folder):
    return snapshot(spark, folder, "asof-quotes", lambda s, f: J.latest_quote(cutoffs(s, f), T.quotes(s, f), ["ticker", "leg"], MAX_AGE))


@study("j5_latest_quote", f"SELECT ticker, session, leg, ts_ns, bid, ask FROM asof_quotes", "asof_quotes")
def j5(spark, folder):
    found = J.latest_quote(cutoffs(spark, folder), T.quotes(spark, folder), ["ticker", "leg"], MAX_AGE)
    return found.select("ticker", "session", "leg", "ts_ns", "bid", "ask")


@study("j6_session_shift", "SELECT a.ticker, a.session, a.close, b.close AS close_5 FROM dense a LEFT JOIN dense b ON b.ticker = a.ticker AND b.session = a.session - 5 WHERE a.close IS NOT NULL", "dense")
def j6(spark, folder):
    rows = dense(spark, folder).where("close is not null").select("ticker", "session", "close")
    return J.shifted(rows, "close", 5, "close_5")


@study("j7_gap_guarded_lag", f"""SELECT ticker, session, {r(f'CASE WHEN session - lag(session, 2) OVER {_W} = 2 THEN lag(ret, 2) OVER {_W} END')} AS lagged FROM moves WHERE ret IS NOT NULL""", "moves")
def j7(spark, folder):
    return moves(spark, folder).where("ret is not null").select("ticker", "session", rounded(E.gap_lag("ret", 2)).alias("lagged"))


@study("j8_cotags", """
SELECT a.accession, coalesce(string_agg(l.label, '|' ORDER BY l.label), '') AS cotags, CAST(a.issuer IN (SELECT issuer FROM component) AS INTEGER) AS covered
FROM aligned a LEFT JOIN filing_labels l ON l.accession = a.accession AND l.label <> 'Brand#7' WHERE a.accession IN (SELECT accession FROM filing_labels WHERE label = 'Brand#7') GROUP BY a.accession, a.issuer""", "aligned filing_labels component")
def j8(spark, folder):
    events = aligned(spark, folder).join(T.filing_labels(spark, folder).where(F.col("label") == A).select("accession"), "accession", "left_semi")
    tags = T.filing_labels(spark, folder).where(F.col("label") != A)
    covered = component(spark, folder).select("issuer").distinct().withColumn("c", F.lit(1))
    joined = events.join(tags, "accession", "left").groupBy("accession", "issuer").agg(F.array_sort(F.collect_set("label")).alias("tags"))
    return joined.join(covered, "issuer", "left").select("accession", F.array_join("tags", "|").alias("cotags"), F.coalesce("c", F.lit(0)).alias("covered"))


# ---------------------------------------------------------------- matching

_NUM = " + ".join(f"((e.{n} - c.{n}) / e.scale_{n}) * ((e.{n} - c.{n}) / e.scale_{n})" for n in NAMES)
_CAL = " AND ".join(f"abs((e.{n} - c.{n}) / e.scale_{n}) <= 2" for n in NAMES)
view("matched", "scaled cohort", f"""SELECT ticker, session, arg_min(c_session, (distance, -c_session)) AS control_session, min(distance) AS distance FROM (
      SELECT e.ticker, e.session, c.session AS c_session, ({_NUM}) / 3 AS distance FROM scaled e JOIN complete c ON c.ticker = e.ticker AND c.session BETWEEN e.session - 252 AND e.session - 84
      WHERE e.session >= 84 AND c.session >= 21 AND (e.ticker, e.session) IN (SELECT (ticker, session) FROM cohort) AND {_CAL}
        AND NOT EXISTS (SELECT 1 FROM cohort x WHERE x.ticker = c.ticker AND c.session BETWEEN x.session AND x.session + 4)) GROUP BY 1, 2""")
view("component_matched", "scaled cohort component", f"""SELECT ticker, session, arg_min(c_session, (distance, -c_session)) AS control_session, min(distance) AS distance FROM (
      SELECT e.ticker, e.session, c.session AS c_session, ({_NUM}) / 3 AS distance FROM scaled e JOIN complete c ON c.ticker = e.ticker AND c.session BETWEEN e.session - 504 AND e.session - 84
      WHERE e.session >= 84 AND c.session >= 21 AND (e.ticker, e.session) IN (SELECT (ticker, session) FROM cohort) AND {_CAL}
        AND (c.ticker, c.session) IN (SELECT (ticker, session) FROM component)) GROUP BY 1, 2""")


def scaled_events(spark, folder):
    scaled = M.expanding_scales(complete(spark, folder), NAMES, 21)
    return scaled.join(sessions_of(cohort(spark, folder)), ["ticker", "session"], "left_semi").where("session >= 84")


def matched(spark, folder):
    return snapshot(spark, folder, "matched", lambda s, f: M.nearest_prior(
        scaled_events(s, f), M.quiet_sessions(complete(s, f), sessions_of(cohort(s, f)), M.NEAREST["quiet"]).where("session >= 21"), NAMES,
        M.NEAREST["back_near"], M.NEAREST["back_far"]))


def component_matched(spark, folder):
    pool = complete(spark, folder).join(sessions_of(component(spark, folder)), ["ticker", "session"], "left_semi").where("session >= 21")
    return snapshot(spark, folder, "component-matched", lambda s, f: M.nearest_prior(scaled_events(s, f), pool, NAMES, 84, 504))


@study("j12_nearest_prior", f"SELECT ticker, session, control_session, {r('distance')} AS distance FROM matched", "matched")
def j12(spark, folder):
    return matched(spark, folder).withColumn("distance", rounded("distance"))


@study("j15_component_match", f"SELECT ticker, session, control_session, {r('distance')} AS distance FROM component_matched", "component_matched")
def j15(spark, folder):
    return component_matched(spark, folder).withColumn("distance", rounded("distance"))


def early_scaled_events(spark, folder):
    """Event sessions from the cutoff on, scaled by the sample deviation of the first 40 % of sessions before it."""
    rows = complete(spark, folder)
    cut = F.floor(sessions(spark, folder).agg(F.count(F.lit(1))).scalar() * 0.4)
    early = rows.where(F.col("session") < cut)
    scales = {f"scale_{n}": F.coalesce(F.nullif(early.agg(F.stddev_samp(n)).scalar(), F.lit(0.0)), F.lit(1.0)) for n in NAMES}
    return rows.where(F.col("session") >= cut).join(sessions_of(cohort(spark, folder)), ["ticker", "session"], "left_semi").withColumns(scales)


def unique_matches(spark, folder):
    quiet = complete(spark, folder).join(sessions_of(cohort(spark, folder).unionByName(component(spark, folder))), ["ticker", "session"], "left_anti")
    return snapshot(spark, folder, "unique-matches", lambda s, f: M.unique_nearest(early_scaled_events(s, f), quiet, NAMES, 60))


@study("j13_unique_nearest")
def j13(spark, folder):
    return unique_matches(spark, folder).withColumn("distance", rounded("distance"))


def standardized(spark, folder):
    """Features as z-scores of the training years."""
    rows = complete(spark, folder)
    train = rows.where(F.col("date") < "2000-01-01")
    return rows.withColumns({n: (F.col(n) - train.agg(F.avg(n)).scalar()) / train.agg(F.stddev_pop(n)).scalar() for n in NAMES})


# The rule keeps controls 21 sessions away from events. The supplied tickers file so often that no session is left then, so the queries name their own distance.
EXCLUSION, DATA_EXCLUSION = 21, 5


def spaced_matches(spark, folder, exclusion=EXCLUSION):
    """Up to five ordinary sessions with a known outcome, outside the exclusion zone of any event, more than the horizon apart."""
    rows = standardized(spark, folder).where(F.col("return_5").isNotNull())
    active = sessions_of(cohort(spark, folder))
    return M.spaced_prior(rows.join(active, ["ticker", "session"], "left_semi"), J.outside_zones(rows, active, ["ticker"], exclusion), NAMES, 252, 5, 5)


@study("j14_spaced_prior_matches")
def j14(spark, folder):
    return spaced_matches(spark, folder, DATA_EXCLUSION).select("ticker", "session", F.array_join(F.col("controls").cast("array<string>"), ",").alias("controls"))


@study("j9_event_ordinary_pairs", f"""
SELECT m.ticker, m.session, {r('e.return_5')} AS event_value, {r('c.return_5')} AS ordinary_value, {r('e.return_5 - c.return_5')} AS difference
FROM matched m JOIN features e ON e.ticker = m.ticker AND e.session = m.session JOIN features c ON c.ticker = m.ticker AND c.session = m.control_session WHERE e.return_5 IS NOT NULL AND c.return_5 IS NOT NULL""", "matched features")
def j9(spark, folder):
    return paired(spark, folder).select("ticker", "session", *[rounded(c).alias(c) for c in ("event_value", "ordinary_value", "difference")])


def cohort_values(spark, folder):
    """Long form: one row per pair and role with its five-session return."""
    m = matched(spark, folder)
    roles = m.select("ticker", "session", F.explode(F.array(
        F.struct(F.lit("event").alias("role"), F.col("session").alias("at")), F.struct(F.lit("ordinary").alias("role"), F.col("control_session").alias("at")))).alias("x"))
    rows = features(spark, folder).select("ticker", F.col("session").alias("at"), F.col("return_5").alias("value"))
    return roles.select("ticker", "session", "x.role", "x.at").join(rows, ["ticker", "at"]).where("value is not null")


def paired(spark, folder):
    """One row per pair that has exactly one value for each role."""
    wide = cohort_values(spark, folder).groupBy("ticker", "session").agg(
        F.count_if(F.col("role") == "event").alias("events"), F.count_if(F.col("role") == "ordinary").alias("ordinaries"),
        F.max(F.when(F.col("role") == "event", F.col("value"))).alias("event_value"), F.max(F.when(F.col("role") == "ordinary", F.col("value"))).alias("ordinary_value"))
    return wide.where("events = 1 and ordinaries = 1").withColumn("difference", F.col("event_value") - F.col("ordinary_value"))


@study("j16_exclusion_zone", """SELECT ticker, session FROM dense d WHERE close IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cohort c WHERE c.ticker = d.ticker AND abs(c.session - d.session) <= 5)""", "dense cohort")
def j16(spark, folder):
    return J.outside_zones(dense(spark, folder).where("close is not null").select("ticker", "session"), sessions_of(cohort(spark, folder)), ["ticker"], 5)


@study("j18_call_put_pairs", """SELECT ticker, expiry, strike, min(contract) FILTER (WHERE contract_type = 'call') AS call, min(contract) FILTER (WHERE contract_type = 'put') AS put FROM contracts GROUP BY 1, 2, 3""", "contracts")
def j18(spark, folder):
    return J.call_put_pairs(T.contracts(spark, folder))


@study("j20_reconciliation", """
WITH e AS (SELECT t.ticker, y.year, c.category FROM (SELECT DISTINCT ticker FROM filings) t CROSS JOIN generate_series(1995, 2002) y(year) CROSS JOIN (SELECT DISTINCT category FROM filings) c),
d AS (SELECT ticker, year(filing_date) AS year, category, count(*) AS deliveries, count_if(amount > 250000) AS failures FROM filings WHERE amount > 200000 GROUP BY 1, 2, 3)
SELECT ticker, year, category, coalesce(deliveries, 0) AS deliveries, CASE WHEN deliveries IS NULL THEN 'missing' WHEN failures = deliveries THEN 'failed' ELSE 'complete' END AS status FROM e LEFT JOIN d USING (ticker, year, category)""", "filings")
def j20(spark, folder):
    rows = T.filings(spark, folder).withColumn("year", F.year("filing_date").cast("bigint"))
    expected = rows.select("ticker", "category").distinct().select("*", F.explode(F.sequence(F.lit(1995).cast("bigint"), F.lit(2002).cast("bigint"))).alias("year"))
    delivered = rows.where("amount > 200000").withColumn("failed", F.col("amount") > 250000)
    return J.reconcile(expected, delivered, ["ticker", "year", "category"])


@study("j21_count_reconciliation", """
WITH a AS (SELECT label, count(*) AS reference_count FROM filing_labels WHERE label <> 'Brand#3' GROUP BY 1), b AS (SELECT p_brand AS label, count(*) AS line_count FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#4' GROUP BY 1)
SELECT coalesce(a.label, b.label) AS label, reference_count, line_count, CAST(coalesce(reference_count = line_count, false) AS INTEGER) AS agrees FROM a FULL JOIN b ON a.label = b.label""", "filing_labels")
def j21(spark, folder):
    a = T.filing_labels(spark, folder).where("label <> 'Brand#3'").groupBy("label").agg(F.count(F.lit(1)).alias("reference_count"))
    lines = T.table(spark, folder, "lineitem").join(T.table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    b = lines.where("p_brand <> 'Brand#4'").groupBy(F.col("p_brand").alias("label")).agg(F.count(F.lit(1)).alias("line_count"))
    return a.join(b, "label", "full").withColumn("agrees", flag(F.col("reference_count") == F.col("line_count")))


@study("j24_parameter_grid", """
SELECT c.category, h.horizon, l.lag, k.kind FROM (SELECT DISTINCT category FROM filings) c, (VALUES (1), (5), (21), (63)) h(horizon), (VALUES (0), (1), (5)) l(lag), (VALUES ('return'), ('absolute'), ('volatility'), ('downside')) k(kind)""", "filings")
def j24(spark, folder):
    def each(df, values, name):
        return df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    cells = T.filings(spark, folder).select("category").distinct()
    return each(each(each(cells, [1, 5, 21, 63], "horizon"), [0, 1, 5], "lag"), ["return", "absolute", "volatility", "downside"], "kind")


@study("j25_annotation_default", "SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'accepted' WHEN 0 THEN 'rejected' END, 'unreviewed') AS status, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j25(spark, folder):
    docs, labels = T.table(spark, folder, "documents").select("doc_id"), T.table(spark, folder, "labels")
    status = F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce(status, F.lit("unreviewed")).alias("status"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


def dividend_days(spark, folder):
    """USD cash per ticker and session of the ex-date, on the dense grid."""
    rows = T.dividends(spark, folder).where("currency = 'USD'")
    cash = P.align_forward(rows, sessions(spark, folder), "ex_date").groupBy("ticker", "session").agg(F.sum("cash").alias("cash"))
    return dense(spark, folder).select("ticker", "session").join(cash, ["ticker", "session"], "left")


@study("j26_dividends_held", f"""
WITH d AS (SELECT v.ticker, v.cash, s.session FROM dividends v ASOF JOIN sessions s ON v.ex_date <= s.date WHERE currency = 'USD'),
p AS (SELECT DISTINCT ticker, session AS entry_session, session + 10 AS exit_session FROM cohort WHERE session + 10 <= (SELECT max(session) FROM sessions))
SELECT p.ticker, p.entry_session, p.exit_session, {r('coalesce(sum(d.cash), 0)', 8)} AS cash FROM p LEFT JOIN d ON d.ticker = p.ticker AND d.session > p.entry_session AND d.session <= p.exit_session GROUP BY 1, 2, 3""", "dividends sessions cohort")
def j26(spark, folder):
    last = sessions(spark, folder).agg(F.max("session")).scalar()
    held = sessions_of(cohort(spark, folder)).select("ticker", F.col("session").alias("entry_session"), (F.col("session") + 10).alias("exit_session")).where(F.col("exit_session") <= last)
    totals = J.running_total(dividend_days(spark, folder), ["ticker"], "cash", "total")
    return J.interval_sum(held, totals, ["ticker"], "total", "cash").withColumn("cash", rounded("cash", 8))


# ---------------------------------------------------------------- ordered selection

@study("o1_ordered_output", "SELECT issuer, session, accession, row_number() OVER (PARTITION BY issuer, session ORDER BY accession) AS place FROM cohort ORDER BY issuer, session, accession", "cohort")
def o1(spark, folder):
    place = F.row_number().over(W.partitionBy("issuer", "session").orderBy("accession")).cast("bigint")
    return cohort(spark, folder).select("issuer", "session", "accession", place.alias("place")).orderBy("issuer", "session", "accession")


@study("o2_hash_sample", """
SELECT category, year, accession FROM (SELECT category, year(filing_date) AS year, accession, row_number() OVER (PARTITION BY category, year(filing_date) ORDER BY sha256('review|' || accession)) AS k FROM filings) WHERE k <= 5""", "filings")
def o2(spark, folder):
    return hash_sample(T.filings(spark, folder).withColumn("year", F.year("filing_date").cast("bigint")), ["category", "year"], "accession", "review", 5).select("category", "year", "accession")


def hash_sample(rows, strata, key, salt, n):
    """First n rows of every stratum in hash order; each task keeps only its own first n."""
    order = F.row_number().over(W.partitionBy(*strata).orderBy(F.sha2(F.concat_ws("|", F.lit(salt), F.col(key).cast("string")), 256)))
    return rows.withColumn("_k", order).where(F.col("_k") <= n).drop("_k")


@study("o3_nearest_contract", """
SELECT c.ticker, arg_min(contract, (abs(CAST(expiry - DATE '1998-01-02' AS INTEGER) - 30), expiry, abs(strike - 2000), strike, contract)) AS contract, count(*) AS considered FROM contracts c WHERE expiry > DATE '1998-01-02' GROUP BY 1""", "contracts")
def o3(spark, folder):
    rows = T.contracts(spark, folder).where("expiry > date'1998-01-02'")
    away = F.abs(F.datediff("expiry", F.lit("1998-01-02").cast("date")) - 30)
    order = F.struct(away.alias("a"), "expiry", F.abs(F.col("strike") - 2000).alias("d"), "strike", "contract")
    return rows.groupBy("ticker").agg(F.min_by("contract", order).alias("contract"), F.count(F.lit(1)).alias("considered"))


@study("o4_uniform_subsample", f"SELECT accession FROM filings ORDER BY {draw('11', 'accession')}, accession LIMIT 500", "filings")
def o4(spark, folder):
    return T.filings(spark, folder).orderBy(counter_draw(11, "accession"), "accession").limit(500).select("accession")


@study("o5_first_events", "SELECT issuer, year, accession FROM (SELECT issuer, year(filing_date) AS year, accession, row_number() OVER (PARTITION BY issuer, year(filing_date) ORDER BY filing_date, accession) AS k FROM cohort) WHERE k <= 3", "cohort")
def o5(spark, folder):
    k = F.row_number().over(W.partitionBy("issuer", F.year("filing_date")).orderBy("filing_date", "accession"))
    return cohort(spark, folder).withColumn("k", k).where("k <= 3").select("issuer", F.year("filing_date").cast("bigint").alias("year"), "accession")


@study("o6_spaced_events", """
WITH d AS (SELECT ticker, list_sort(list(DISTINCT session)) AS days FROM cohort GROUP BY 1)
SELECT ticker, unnest(list_reduce(list_transform(days, lambda d: [d]), lambda a, b: CASE WHEN b[1] - a[-1] > 21 THEN list_append(a, b[1]) ELSE a END)) AS session FROM d""", "cohort")
def o6(spark, folder):
    days = sessions_of(cohort(spark, folder)).groupBy("ticker").agg(F.array_sort(F.collect_list("session")).alias("days"))
    return days.select("ticker", F.explode(Z.spaced(F.col("days"), 21)).alias("session"))


# ---------------------------------------------------------------- event alignment

view("label_grid", "aligned filing_labels sessions", """SELECT i.issuer, s.session, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(ab, 0) AS ab FROM (SELECT DISTINCT issuer FROM aligned) i CROSS JOIN sessions s LEFT JOIN (
      SELECT issuer, session, count_if(ha) AS a, count_if(hb) AS b, count_if(ha AND hb) AS ab FROM (SELECT issuer, session, accession IN (SELECT accession FROM filing_labels WHERE label = 'Brand#7') AS ha,
        accession IN (SELECT accession FROM filing_labels WHERE label = 'Brand#12') AS hb FROM aligned WHERE session IS NOT NULL) GROUP BY 1, 2) c USING (issuer, session)""")


def label_grid(spark, folder):
    """Counts per issuer and session of filings with the first label, the second, and both."""
    rows = labelled(spark, folder).select("issuer", "session", F.array_contains("labels", A).alias("ha"), F.array_contains("labels", B).alias("hb"))
    counts = rows.where("session is not null").groupBy("issuer", "session").agg(
        F.count_if("ha").alias("a"), F.count_if("hb").alias("b"), F.count_if(F.col("ha") & F.col("hb")).alias("ab"))
    last = sessions(spark, folder).agg(F.max("session")).scalar()
    grid = rows.select("issuer").distinct().select("issuer", F.explode(F.sequence(F.lit(0), last)).alias("session"))
    return grid.join(counts, ["issuer", "session"], "left").na.fill(0, ["a", "b", "ab"])


@study("j23_earlier_within", """
SELECT b.issuer, b.session, CAST(coalesce(sum(a.a), 0) AS BIGINT) AS earlier, max(a.session) FILTER (WHERE a.a > 0) AS latest_session FROM label_grid b LEFT JOIN label_grid a ON a.issuer = b.issuer AND b.session - a.session BETWEEN 1 AND 5 WHERE b.b > 0 GROUP BY 1, 2""", "label_grid")
def j23(spark, folder):
    return J.earlier_in_window(label_grid(spark, folder), "a", "b", 5, ["issuer"]).select("issuer", "session", "earlier", "latest_session")


@study("e3_ordered_pair_flag", """
SELECT DISTINCT y.issuer, y.session FROM aligned x JOIN filing_labels lx ON lx.accession = x.accession AND lx.label = 'Brand#7' JOIN aligned y ON y.issuer = x.issuer JOIN filing_labels ly ON ly.accession = y.accession AND ly.label = 'Brand#12'
WHERE y.session - x.session BETWEEN 1 AND 5 AND x.filing_date < y.filing_date AND x.accession <> y.accession""", "aligned filing_labels")
def e3(spark, folder):
    return J.earlier_in_window(label_grid(spark, folder), "a", "b", 5, ["issuer"]).where("earlier > 0").select("issuer", "session")


@study("e14_date_order_report", """
SELECT b.issuer, b.session, b.b AS second_filings, CAST(coalesce((SELECT sum(a.a) FROM label_grid a WHERE a.issuer = b.issuer AND b.session - a.session BETWEEN 1 AND 21), 0) AS BIGINT) AS strictly_earlier,
  CAST(b.a * b.b - b.ab AS BIGINT) AS same_day_pairs, b.ab AS same_accession, (SELECT max(a.session) FROM label_grid a WHERE a.issuer = b.issuer AND a.a > 0 AND b.session - a.session BETWEEN 1 AND 21) AS latest_earlier FROM label_grid b WHERE b.b > 0""", "label_grid")
def e14(spark, folder):
    rows = J.earlier_in_window(label_grid(spark, folder), "a", "b", 21, ["issuer"])
    return rows.select("issuer", "session", F.col("b").alias("second_filings"), F.col("earlier").alias("strictly_earlier"), (F.col("a") * F.col("b") - F.col("ab")).alias("same_day_pairs"),
                       F.col("ab").alias("same_accession"), F.col("latest_session").alias("latest_earlier"))


@study("e13_event_dedup", """
SELECT l_orderkey AS accession, count(*) AS excerpts, min(CAST(l_shipdate AS DATE)) AS first_date, CASE WHEN count(DISTINCT CAST(l_shipdate AS DATE)) = 1 THEN 'one_event' ELSE 'date_conflict' END AS result FROM lineitem GROUP BY 1""")
def e13(spark, folder):
    day = F.to_date("l_shipdate")
    return T.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("accession")).agg(
        F.count(F.lit(1)).alias("excerpts"), F.min(day).alias("first_date"), F.when(F.min(day) == F.max(day), "one_event").otherwise("date_conflict").alias("result"))


view("anchors", "cohort sessions", """WITH e AS (SELECT c.issuer, c.ticker, c.accession, c.session AS first_session, s.session - 1 AS pre FROM cohort c ASOF LEFT JOIN sessions s ON c.filing_date <= s.date),
    o AS (SELECT *, pre - 84 AS control FROM e)
    SELECT issuer, ticker, accession, 'event' AS cohort, pre AS pre_session, first_session, CASE WHEN pre < 0 THEN 'no_session_before_filing' END AS reason FROM e
    UNION ALL SELECT issuer, ticker, accession, 'ordinary', control, first_session - 84, CASE WHEN control < 0 THEN 'insufficient_history' WHEN EXISTS (SELECT 1 FROM cohort x WHERE x.ticker = o.ticker AND abs(x.session - o.control) <= 5) THEN 'near_another_event' END FROM o""")


@study("e10_anchors", "SELECT accession, cohort, pre_session, first_session, reason FROM anchors", "anchors")
def e10(spark, folder):
    return anchors(spark, folder).select("accession", "cohort", "pre_session", "first_session", "reason")


def anchors(spark, folder):
    """Event anchors and ordinary ones 84 sessions earlier, each with a reason when not usable."""
    rows = cohort(spark, folder).select("issuer", "ticker", "accession", "filing_date", F.col("session").alias("first_session"))
    placed = P.align_forward(rows, sessions(spark, folder), "filing_date").withColumn("pre", F.col("session") - 1)
    both = placed.select("issuer", "ticker", "accession", F.explode(F.array(
        F.struct(F.lit("event").alias("cohort"), F.col("pre").alias("pre_session"), F.col("first_session").alias("first_session")),
        F.struct(F.lit("ordinary").alias("cohort"), (F.col("pre") - 84).alias("pre_session"), (F.col("first_session") - 84).alias("first_session")))).alias("x")).select("issuer", "ticker", "accession", "x.*")
    zone = sessions_of(cohort(spark, folder)).select("ticker", F.explode(F.sequence(F.col("session") - 5, F.col("session") + 5)).alias("pre_session"), F.lit(True).alias("near")).distinct()
    marked = both.join(zone, ["ticker", "pre_session"], "left")
    reason = first_reason(((F.col("cohort") == "event") & (F.col("pre_session") < 0), "no_session_before_filing"),
                          ((F.col("cohort") == "ordinary") & (F.col("pre_session") < 0), "insufficient_history"),
                          ((F.col("cohort") == "ordinary") & F.col("near"), "near_another_event"))
    return marked.withColumn("reason", reason).drop("near")


@study("e11_study_cohorts", """
WITH r AS (SELECT 'event' AS role, (SELECT count(*) FROM (SELECT DISTINCT ticker, session FROM cohort)) AS anchors UNION ALL SELECT 'ordinary', count(*) FROM matched UNION ALL SELECT 'component', count(*) FROM component_matched)
SELECT v.variant, s.shape, role, CAST(anchors AS BIGINT) AS anchors FROM r, (VALUES ('primary'), ('delayed'), ('doubled_cost')) v(variant), (VALUES ('covered_call'), ('protective_put')) s(shape)""", "cohort matched component_matched")
def e11(spark, folder):
    events = sessions_of(cohort(spark, folder)).select("ticker", "session", F.lit("event").alias("role"))
    ordinary = matched(spark, folder).select("ticker", F.col("control_session").alias("session"), F.lit("ordinary").alias("role"))
    parts = component_matched(spark, folder).select("ticker", F.col("control_session").alias("session"), F.lit("component").alias("role"))
    counts = events.unionByName(ordinary).unionByName(parts).groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(s).alias("shape"), F.lit(o).alias("role")) for v in ("primary", "delayed", "doubled_cost")
                     for s in ("covered_call", "protective_put") for o in ("event", "ordinary", "component")])
    planned = spark.range(1).select(F.explode(grid).alias("g")).select("g.*")
    return planned.join(counts, "role", "left").select("variant", "shape", "role", F.coalesce("n", F.lit(0)).alias("anchors"))


@study("e12_context_flags", """
SELECT c.accession, CAST(EXISTS (SELECT 1 FROM filing_labels l WHERE l.accession = c.accession AND l.label IN ('Brand#1', 'Brand#2', 'Brand#3')) AS INTEGER) AS same_filing,
  CAST(CASE WHEN c.session >= 21 THEN EXISTS (SELECT 1 FROM label_grid g WHERE g.issuer = c.issuer AND g.b > 0 AND c.session - g.session BETWEEN 1 AND 21) END AS INTEGER) AS recent_second FROM cohort c""", "cohort filing_labels label_grid")
def e12(spark, folder):
    recent = label_grid(spark, folder).select("issuer", "session", Z.prior_flag("b", 21, ["issuer"]).alias("recent_second"))
    group = F.array(F.lit("Brand#1"), F.lit("Brand#2"), F.lit("Brand#3"))
    rows = labelled(spark, folder).where(F.col("session").isNotNull() & F.array_contains("labels", A) & F.array_contains("labels", B))
    return rows.join(recent, ["issuer", "session"], "left").select("accession", flag(F.arrays_overlap("labels", group)).alias("same_filing"), "recent_second")


# ---------------------------------------------------------------- patterns

@study("e4_tag_activations", """SELECT l.label, count(*) AS source_filings, count(DISTINCT a.issuer) AS source_issuers, count(DISTINCT (a.issuer, a.session)) AS issuer_dates
FROM aligned a JOIN filing_labels l USING (accession) WHERE a.session IS NOT NULL GROUP BY 1""", "aligned filing_labels")
def e4(spark, folder):
    tags = labelled(spark, folder).where("session is not null").select("issuer", "session", F.explode("labels").alias("label"))
    days = N.label_days(tags, ["issuer"])
    return days.groupBy("label").agg(F.sum("filings").alias("source_filings"), F.count_distinct("issuer").alias("source_issuers"), F.count(F.lit(1)).alias("issuer_dates"))


def _sets_sql() -> str:
    two = "SELECT a.accession, a.label || '&' || b.label AS pattern, 2 AS length FROM filing_labels a JOIN filing_labels b ON b.accession = a.accession AND b.label > a.label"
    three = "SELECT a.accession, a.label || '&' || b.label || '&' || c.label, 3 FROM filing_labels a JOIN filing_labels b ON b.accession = a.accession AND b.label > a.label JOIN filing_labels c ON c.accession = a.accession AND c.label > b.label"
    four = "SELECT a.accession, a.label || '&' || b.label || '&' || c.label || '&' || d.label, 4 FROM filing_labels a JOIN filing_labels b ON b.accession = a.accession AND b.label > a.label JOIN filing_labels c ON c.accession = a.accession AND c.label > b.label JOIN filing_labels d ON d.accession = a.accession AND d.label > c.label"
    return f"{two} UNION ALL {three} UNION ALL {four}"


view("itemsets", "filing_labels", _sets_sql())


def itemset_support(spark, folder, longest=4):
    rows = N.itemsets(labelled(spark, folder), longest)
    counts = rows.groupBy("pattern", "length", "issuer").agg(F.count(F.lit(1)).alias("filings"))
    return counts.groupBy("pattern", "length").agg(F.sum("filings").alias("source_filings"), F.count(F.lit(1)).alias("source_issuers"))


@study("e5_itemset_support", "SELECT pattern, length, count(*) AS source_filings, count(DISTINCT issuer) AS source_issuers FROM itemsets JOIN filings USING (accession) GROUP BY 1, 2", "itemsets filings")
def e5(spark, folder):
    return itemset_support(spark, folder)


WINDOWS = [5, 21, 63]
view("cat_days", "aligned", "SELECT issuer, session, category AS label, count(*) AS filings FROM aligned WHERE session IS NOT NULL GROUP BY 1, 2, 3")


def _sequence_sql() -> str:
    """Growth by as-of joins, one per preceding label."""
    levels = ["level1 AS MATERIALIZED (SELECT issuer, session, label, filings, label AS pattern, session AS start FROM cat_days)"]
    for k in (2, 3, 4):
        union = " UNION ALL ".join(
            f"SELECT l.issuer, l.session, l.label, l.filings, '{c}>' || l.pattern AS pattern, d.session AS start FROM level{k - 1} l ASOF JOIN (SELECT issuer, session FROM cat_days WHERE label = '{c}') d "
            f"ON d.issuer = l.issuer AND l.start > d.session WHERE l.session - d.session <= 63" for c in CATEGORIES)
        levels.append(f"level{k} AS MATERIALIZED ({union})")
    return "WITH " + ", ".join(levels) + " SELECT *, 2 AS length, session - start AS span FROM level2 UNION ALL SELECT *, 3, session - start FROM level3 UNION ALL SELECT *, 4, session - start FROM level4"


view("sequences", "cat_days", _sequence_sql())


def cat_days(spark, folder):
    return snapshot(spark, folder, "category-days", lambda s, f: N.label_days(aligned(s, f).withColumn("label", F.col("category")), ["issuer"]))


def sequence_rows(spark, folder):
    def build(s, f):
        days = cat_days(s, f)
        before = N.last_before(days, ["issuer"])
        return N.sequences(days, before, ["issuer"], 4, max(WINDOWS))
    return snapshot(spark, folder, "sequences", build)


@study("e6_gapped_sequences", """
SELECT 'seq' || w || ':' || pattern AS pattern, w AS "window", length, CAST(sum(filings) AS BIGINT) AS source_filings, count(DISTINCT issuer) AS source_issuers, count(*) AS activations
FROM sequences, (VALUES (5), (21), (63)) v(w) WHERE span <= w GROUP BY 1, 2, 3""", "sequences")
def e6(spark, folder):
    return N.windowed_support(sequence_rows(spark, folder), cat_days(spark, folder), "issuer", WINDOWS)


@study("e7_pattern_catalog", """
WITH t AS (SELECT 'tag:' || t.label AS pattern, 'tag' AS family, count(l.accession) AS source_filings, count(DISTINCT issuer) AS source_issuers FROM (SELECT DISTINCT p_brand AS label FROM part UNION ALL SELECT 'Brand#none') t
    LEFT JOIN filing_labels l USING (label) LEFT JOIN filings USING (accession) GROUP BY 1),
  s AS (SELECT 'set:' || pattern AS pattern, 'itemset' AS family, count(*) AS source_filings, count(DISTINCT issuer) AS source_issuers FROM itemsets JOIN filings USING (accession) WHERE length <= 4 GROUP BY 1),
  q AS (SELECT 'seq' || w || ':' || pattern AS pattern, 'sequence' AS family, CAST(sum(filings) AS BIGINT) AS source_filings, count(DISTINCT issuer) AS source_issuers FROM sequences, (VALUES (5), (21), (63)) v(w) WHERE span <= w GROUP BY 1)
SELECT *, CAST(family = 'tag' OR (source_filings >= 20 AND source_issuers >= 5) AS INTEGER) AS fitted FROM (SELECT * FROM t UNION ALL SELECT * FROM s UNION ALL SELECT * FROM q)""", "itemsets sequences filings filing_labels")
def e7(spark, folder):
    taxonomy = T.table(spark, folder, "part").select(F.col("p_brand").alias("label")).distinct().unionByName(spark.range(1).select(F.lit("Brand#none").alias("label")))
    tags = labelled(spark, folder).select("issuer", F.explode("labels").alias("label")).groupBy("label", "issuer").agg(F.count(F.lit(1)).alias("filings"))
    tag = taxonomy.join(tags, "label", "left").groupBy(F.concat(F.lit("tag:"), "label").alias("pattern")).agg(
        F.coalesce(F.sum("filings"), F.lit(0)).alias("source_filings"), F.count("issuer").alias("source_issuers")).withColumn("family", F.lit("tag"))
    sets = itemset_support(spark, folder, 4).select(F.concat(F.lit("set:"), "pattern").alias("pattern"), "source_filings", "source_issuers", F.lit("itemset").alias("family"))
    seqs = e6(spark, folder).select("pattern", "source_filings", "source_issuers", F.lit("sequence").alias("family"))
    fitted = (F.col("family") == "tag") | ((F.col("source_filings") >= 20) & (F.col("source_issuers") >= 5))
    return tag.unionByName(sets).unionByName(seqs).withColumn("fitted", fitted.cast("int"))


@study("e8_training_eligibility", """
SELECT l.label, count(DISTINCT (issuer, session)) AS train_dates, count(DISTINCT issuer) AS train_issuers, CAST(count(DISTINCT (issuer, session)) >= 600 AND count(DISTINCT issuer) >= 5 AS INTEGER) AS eligible
FROM aligned JOIN filing_labels l USING (accession) WHERE session_date < DATE '2000-01-01' GROUP BY 1""", "aligned filing_labels")
def e8(spark, folder):
    tags = labelled(spark, folder).where(F.col("session_date") < "2000-01-01").select("issuer", "session", F.explode("labels").alias("label"))
    rows = N.label_days(tags, ["issuer"]).groupBy("label", "issuer").agg(F.count(F.lit(1)).alias("d")).groupBy("label").agg(F.sum("d").alias("train_dates"), F.count(F.lit(1)).alias("train_issuers"))
    return rows.withColumn("eligible", flag((F.col("train_dates") >= 600) & (F.col("train_issuers") >= 5)))


@study("e9_lagged_activation", "SELECT issuer, label, session + lag AS session, lag, filings FROM cat_days, (VALUES (0), (1), (5), (21)) v(lag) WHERE session + lag <= (SELECT max(session) FROM sessions)", "cat_days sessions")
def e9(spark, folder):
    last = sessions(spark, folder).agg(F.max("session")).scalar()
    rows = cat_days(spark, folder).select("issuer", "label", "session", "filings", F.explode(F.array(*[F.lit(k) for k in (0, 1, 5, 21)])).alias("lag"))
    return rows.withColumn("session", F.col("session") + F.col("lag")).where(F.col("session") <= last)


view("placebo", "aligned sessions", f"""WITH p AS (SELECT session, year(date) AS year, row_number() OVER (PARTITION BY year(date) ORDER BY session) - 1 AS place, count(*) OVER (PARTITION BY year(date)) AS size, min(session) OVER (PARTITION BY year(date)) AS first FROM sessions),
    o AS (SELECT a.*, p.*, r.replica, 1 + {draw("'23'", "'shift'", 'CAST(r.replica AS VARCHAR)', 'a.issuer', 'CAST(p.year AS VARCHAR)')} % (size - 1) AS "offset" FROM aligned a JOIN p ON p.session = a.session CROSS JOIN (VALUES (0), (1), (2)) r(replica))
    SELECT replica, issuer, accession, category, CAST(first + (place + "offset") % size AS INTEGER) AS placebo_session, CAST(floor((place + "offset") / size) AS INTEGER) AS segment, year, first, CAST(first + "offset" AS INTEGER) AS wrap_session FROM o""")


def placebo(spark, folder):
    return snapshot(spark, folder, "placebo", lambda s, f: N.circular_shift(aligned(s, f).where("session is not null"), sessions(s, f), 3, 23))


@study("e15_shifted_calendar", "SELECT replica, issuer, accession, placebo_session, segment FROM placebo", "placebo")
def e15(spark, folder):
    return placebo(spark, folder).select("replica", "issuer", "accession", "placebo_session", "segment")


@study("e16_wrap_censoring", """
WITH z AS (SELECT DISTINCT replica, issuer, m + k AS session FROM (SELECT DISTINCT replica, issuer, unnest([first, wrap_session]) AS m FROM placebo) CROSS JOIN generate_series(0, 20) g(k)),
d AS (SELECT replica, issuer, placebo_session AS session, count(*) AS filings FROM placebo GROUP BY 1, 2, 3),
g AS (SELECT i.replica, i.issuer, s.session, coalesce(filings, 0) AS filings FROM (SELECT DISTINCT replica, issuer FROM placebo) i CROSS JOIN sessions s LEFT JOIN d USING (replica, issuer, session)),
p AS (SELECT *, CASE WHEN session >= 21 THEN coalesce(sum(filings) OVER (PARTITION BY replica, issuer ORDER BY session ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING), 0) END AS prior FROM g)
SELECT p.replica, p.issuer, p.session, CAST(CASE WHEN z.session IS NULL THEN prior END AS BIGINT) AS prior_21 FROM p LEFT JOIN z USING (replica, issuer, session)""", "placebo sessions")
def e16(spark, folder):
    moved = placebo(spark, folder)
    days = moved.groupBy("replica", "issuer", F.col("placebo_session").alias("session")).agg(F.count(F.lit(1)).alias("filings"))
    last = sessions(spark, folder).agg(F.max("session")).scalar()
    grid = moved.select("replica", "issuer").distinct().select("*", F.explode(F.sequence(F.lit(0), last)).alias("session")).join(days, ["replica", "issuer", "session"], "left").na.fill(0, ["filings"])
    prior = grid.select("replica", "issuer", "session", Z.prior_count("filings", 21, ["replica", "issuer"]).alias("prior"))
    zone = N.censored_zone(moved, 21).withColumn("z", F.lit(1))
    return prior.join(zone, ["replica", "issuer", "session"], "left").select("replica", "issuer", "session", F.when(F.col("z").isNull(), F.col("prior")).alias("prior_21"))


@study("e17_observation_requests")
def e17(spark, folder):
    ready = complete(spark, folder).select("ticker", "session")
    events = cohort(spark, folder).select("ticker", "session", "category", F.explode(F.array(F.lit(0), F.lit(1), F.lit(5))).alias("lag"))
    asked = events.select("ticker", (F.col("session") + F.col("lag")).alias("session"), "category", F.lit("event").alias("role"))
    controls = spaced_matches(spark, folder, DATA_EXCLUSION).select("ticker", F.explode("controls").alias("session"), F.lit("ordinary").alias("category"), F.lit("ordinary").alias("role"))
    both = asked.unionByName(controls).join(ready, ["ticker", "session"], "left_semi")
    return both.groupBy("ticker", "session").agg(F.array_join(F.array_sort(F.collect_set("category")), "|").alias("categories"), F.array_join(F.array_sort(F.collect_set("role")), "|").alias("roles"))
