"""Queries of sources and sinks, validation, scalar functions and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.scalars import (big, clip, counter_draw, first_reason, flag, ratio, rounded, row_identity,
                                        uniform_draw)
from tidemark.operators import gates as G
from tidemark.operators import panel as P
from tidemark.plans.market import aligned, dense, market_grid, moves, sessions, study_panel
from tidemark.plans.registry import study
from tidemark.plans.sqlviews import draw, r, view
from tidemark.session import fresh_path
from tidemark.sources import files as S
from tidemark.sources import tables as T

START, END = "1995-06-01", "2001-06-30"

# ---------------------------------------------------------------- sources and sinks


def bar_pages(spark, folder):
    """Bars as one page per ticker and year, with the millisecond clock of the wire format."""
    path = fresh_path(spark, "bar-pages")
    clock = (F.unix_date("date").cast("bigint") * 86400 + 5 * 3600) * 1000
    (T.bars(spark, folder).groupBy("ticker", F.year("date").alias("year"))
     .agg(F.collect_list(F.struct(clock.alias("t"), F.col("close").alias("c"), F.col("volume").alias("v"))).alias("results"))
     .write.json(path))
    return path


@study("s1_read_bars", f"SELECT ticker, date, close, volume FROM bars WHERE date BETWEEN DATE '{START}' AND DATE '{END}'", "bars")
def s1(spark, folder):
    return S.read_bars(spark, bar_pages(spark, folder), START, END)


@study("s2_read_bar_payload", "SELECT ticker, date, close AS open, close AS high, close AS low, close, volume FROM bars", "bars")
def s2(spark, folder):
    price = F.col("close").cast("string")
    bar = F.struct(F.col("date").cast("string").alias("time"), *[price.alias(n) for n in ("open", "high", "low", "close")],
                   F.col("volume").cast("string").alias("volume"))
    pages = T.bars(spark, folder).groupBy("ticker", F.year("date").alias("year")).agg(F.collect_list(bar).alias("bars"))
    nested = F.struct(F.array(F.struct(F.col("bars").alias("result"))).alias("result"))
    body = F.when(F.col("year") % 2 == 0, F.to_json("bars")).otherwise(F.to_json(nested))
    return S.read_bar_payload(pages.select("ticker", body.alias("body")), "body")


@study("s3_read_disclosures", """
WITH listed AS (SELECT *, CASE WHEN accession % 50 = 0 THEN NULL ELSE [ticker, 'T' || (accession % 7), 'T' || (accession % 11)] END AS tickers
  FROM filings),
matched AS (SELECT issuer, accession, tickers, list_distinct(list_filter(tickers, lambda x: x IN ('T0', 'T1', 'T2', 'T3'))) AS hit FROM listed)
SELECT issuer, accession, CASE WHEN tickers IS NULL THEN 'missing_ticker_list' WHEN len(hit) = 0 THEN 'outside_universe' ELSE 'matched' END AS source_status,
  u.ticker FROM matched LEFT JOIN LATERAL (SELECT unnest(hit) AS ticker) u ON true
""", "filings")
def s3(spark, folder):
    listed = F.array("ticker", F.concat(F.lit("T"), (F.col("accession") % 7).cast("string")),
                     F.concat(F.lit("T"), (F.col("accession") % 11).cast("string")))
    rows = T.filings(spark, folder).withColumn("tickers", F.when(F.col("accession") % 50 != 0, listed))
    return S.explode_universe(rows, ["T0", "T1", "T2", "T3"]).select("issuer", "accession", "source_status", "ticker")


@study("s4_typed_tables", """
SELECT 'contracts' AS source, count(*) AS rows, count(DISTINCT ticker) AS tickers FROM contracts
UNION ALL SELECT 'quotes', count(*), count(DISTINCT ticker) FROM quotes
UNION ALL SELECT 'actions', count(*), count(DISTINCT ticker) FROM dividends
""", "contracts quotes dividends")
def s4(spark, folder):
    found = None
    for name, df, schema in (("contracts", T.contracts(spark, folder), S.CONTRACT), ("quotes", T.quotes(spark, folder), S.QUOTE),
                             ("actions", T.dividends(spark, folder), S.ACTION)):
        path = fresh_path(spark, name)
        df.write.json(path)
        part = spark.read.schema(schema).json(path).agg(
            F.lit(name).alias("source"), F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("tickers"))
        found = part if found is None else found.unionByName(part)
    return found


@study("s5_panel_snapshot", f"""SELECT ticker, session, {r('past_return_5')} AS past_return_5, {r('return_5')} AS return_5, target_end_5 FROM panel""", "panel")
def s5(spark, folder):
    panel = study_panel(spark, folder).select("ticker", "session", "past_return_5", "return_5", "target_end_5")
    path = fresh_path(spark, "panel")
    S.write_snapshot(panel, path, "ticker")
    table = fresh_path(spark, "panel-csv")
    spark.read.schema(panel.schema).parquet(path).select(*panel.columns).write.option("header", True).csv(table)
    back = spark.read.schema(panel.schema).option("header", True).csv(table)
    return back.select("ticker", "session", rounded("past_return_5").alias("past_return_5"), rounded("return_5").alias("return_5"), "target_end_5")


@study("s6_overlap_merge", """
WITH pages AS (SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS price FROM lineitem WHERE l_returnflag IN ('A', 'R')
  UNION ALL SELECT l_partkey, CAST(l_shipdate AS DATE), l_extendedprice FROM lineitem WHERE l_returnflag IN ('R', 'N'))
SELECT part, date, count(*) AS copies, CASE WHEN min(price) = max(price) THEN 'accepted' ELSE 'conflict' END AS merge_status,
  CASE WHEN min(price) = max(price) THEN min(price) END AS price FROM pages GROUP BY 1, 2""")
def s6(spark, folder):
    lines = T.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("date"),
                                                      F.col("l_extendedprice").alias("price"), "l_returnflag")
    first = lines.where(F.col("l_returnflag").isin("A", "R")).drop("l_returnflag")
    second = lines.where(F.col("l_returnflag").isin("R", "N")).drop("l_returnflag")
    return S.merge_overlap([first, second], ["part", "date"], ["price"])


@study("s7_sharded_output", f"""
SELECT ticker, session, h AS horizon, 'return' AS kind, {r('CASE h WHEN 1 THEN return_1 WHEN 5 THEN return_5 ELSE return_21 END')} AS value
FROM panel CROSS JOIN (VALUES (1), (5), (21)) v(h)
WHERE CASE h WHEN 1 THEN return_1 WHEN 5 THEN return_5 ELSE return_21 END IS NOT NULL""", "panel")
def s7(spark, folder):
    panel = study_panel(spark, folder)
    rows = panel.selectExpr("ticker", "session", "stack(3, 1, return_1, 5, return_5, 21, return_21) as (horizon, value)")
    path = fresh_path(spark, "shards")
    S.write_shards(rows.where("value is not null").withColumn("kind", F.lit("return")), path, ["kind", "horizon"])
    back = spark.read.schema("ticker string, session int, value double, kind string, horizon int").json(path)
    return back.select("ticker", "session", "horizon", "kind", rounded("value").alias("value"))


@study("s8_ledger_append", """
SELECT year(o_orderdate) AS year, CAST(count(*) AS BIGINT) AS rows, count(DISTINCT o_orderkey) AS ids FROM orders GROUP BY 1""")
def s8(spark, folder):
    filings = T.filings(spark, folder).select(F.col("accession").alias("id"), "filing_date")
    path = fresh_path(spark, "ledger")
    filings.where(F.year("filing_date") <= 1999).write.parquet(path)
    for _ in range(2):
        S.append_ledger(path, spark.read.parquet(path), filings.where(F.year("filing_date") >= 1998), "id")
    return spark.read.parquet(path).groupBy(F.year("filing_date").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))


@study("s9_row_identity", """SELECT accession, sha256('{"accession":' || accession || ',"category":"' || category || '","issuer":"' || issuer || '"}') AS row_id
FROM filings""", "filings")
def s9(spark, folder):
    return S.with_identity(T.filings(spark, folder), ["issuer", "accession", "category"]).select("accession", "row_id")


@study("s10_seeded_fixture", f"""
WITH steps AS (SELECT ticker, session, (({draw("'7'", "'walk'", 'ticker', 'CAST(session AS VARCHAR)')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE - 0.5::DOUBLE) * 0.02::DOUBLE AS step FROM dense)
SELECT ticker, session, {r('100 * exp(sum(step) OVER (PARTITION BY ticker ORDER BY session))', 5)} AS close FROM steps""", "dense")
def s10(spark, folder):
    grid = dense(spark, folder).select("ticker", "session")
    step = (uniform_draw(7, F.lit("walk"), "ticker", "session") - 0.5) * 0.02
    walk = F.sum("step").over(P.by_session().rowsBetween(W.unboundedPreceding, 0))
    return grid.withColumn("step", step).select("ticker", "session", rounded(100 * F.exp(walk), 5).alias("close"))


# ---------------------------------------------------------------- filters, predicates, validation

@study("p1_input_contract", f"""
WITH marks AS (SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS close, l_quantity - 2 AS volume, n_regionkey AS region
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
grid AS (SELECT DISTINCT date FROM bars WHERE ticker = 'T4'),
dup AS (SELECT count(*) - count(DISTINCT (part, date)) AS n FROM marks)
SELECT 'duplicate_key' AS rule, n AS violations FROM dup
UNION ALL SELECT 'nonpositive_close', count_if(NOT close > 0) FROM marks
UNION ALL SELECT 'negative_volume', count_if(volume < 0) FROM marks
UNION ALL SELECT 'outside_boundary', count_if(date NOT BETWEEN DATE '{START}' AND DATE '{END}') FROM marks
UNION ALL SELECT 'off_grid', count_if(date NOT IN (SELECT date FROM grid)) FROM marks
UNION ALL SELECT 'missing_identity', count_if(part IS NULL) FROM marks""", "bars")
def p1(spark, folder):
    marks = T.table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), (F.col("l_quantity") - 2).alias("volume"))
    grid = T.bars(spark, folder).where(F.col("ticker") == T.BENCHMARK).select("date", F.lit(True).alias("on_grid"))
    rows = marks.join(F.broadcast(grid), "date", "left")
    return G.contract_violations(rows, ["part", "date"], {
        "nonpositive_close": ~(F.col("close") > 0), "negative_volume": F.col("volume") < 0,
        "outside_boundary": ~F.col("date").between(START, END), "off_grid": F.col("on_grid").isNull(),
        "missing_identity": F.col("part").isNull()})


@study("p2_complete_cases", f"SELECT ticker, session, {r('ret')} AS ret FROM moves WHERE close IS NOT NULL AND ret IS NOT NULL", "moves")
def p2(spark, folder):
    return G.complete_cases(moves(spark, folder), ["close", "ret"]).select("ticker", "session", rounded("ret").alias("ret"))


@study("p3_support_gate", """
WITH cells AS (SELECT c AS category, CASE c WHEN '1-URGENT' THEN "event__1-URGENT" WHEN '2-HIGH' THEN "event__2-HIGH" ELSE sequence_a_before_b END AS x,
  return_21 AS y, date, ticker FROM panel CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('sequence')) v(c) WHERE return_21 IS NOT NULL),
s AS (SELECT category, year(date) AS year, count(*) AS rows, count(DISTINCT date) AS dates, count(DISTINCT ticker) AS issuers, count_if(x <> 0) AS positive_rows,
  count(DISTINCT CASE WHEN x <> 0 THEN ticker END) AS positive_issuers, count(DISTINCT CASE WHEN x <> 0 THEN date END) AS positive_dates,
  min(x) < max(x) AND min(y) < max(y) AS varies FROM cells GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN rows < 120 OR NOT varies THEN 'Too few rows or no feature/target variation'
  WHEN positive_rows < 8 OR positive_issuers < 3 THEN 'Insufficient event/issuer support' END AS reason FROM s)
SELECT category, year, rows, dates, issuers, positive_rows, positive_issuers, positive_dates, reason,
  CASE WHEN reason IS NULL THEN 'measured' ELSE 'inconclusive' END AS status FROM w""", "panel")
def p3(spark, folder):
    panel = study_panel(spark, folder).where(F.col("return_21").isNotNull())
    cells = panel.selectExpr("ticker", "date", "return_21 as y",
                             "stack(3, '1-URGENT', `event__1-URGENT`, '2-HIGH', `event__2-HIGH`, 'sequence', sequence_a_before_b) as (category, x)")
    grouped = cells.groupBy("category", F.year("date").cast("bigint").alias("year")).agg(*G.support_columns("x", "y", issuer="ticker"))
    return G.support_gate(grouped, min_rows=120)


@study("p4_standard_contract", """
SELECT contract, CASE WHEN shares <> 100 THEN 'nonstandard_share_count' WHEN extra THEN 'additional_deliverable'
  WHEN style NOT IN ('american', 'european') THEN 'unknown_exercise_style' WHEN expiry <= DATE '1998-01-02' THEN 'expired' END AS reason FROM contracts""", "contracts")
def p4(spark, folder):
    rows = T.contracts(spark, folder).withColumn("day", F.lit("1998-01-02").cast("date"))
    return rows.select("contract", G.standard_contract("day").alias("reason"))


@study("p5_quote_validity", """
SELECT leg, CASE WHEN bid <= 0 OR ask < bid THEN 'nonpositive_or_crossed_quote' WHEN ask - bid > CAST(0.05 AS DOUBLE) * ((bid + ask) / 2) THEN 'relative_spread_above_cap'
  WHEN bid_size < 2 OR ask_size < 2 THEN 'insufficient_displayed_size' END AS reason, count(*) AS quotes FROM quotes GROUP BY 1, 2""", "quotes")
def p5(spark, folder):
    return T.quotes(spark, folder).groupBy("leg", G.quote_reason(0.05, 2).alias("reason")).agg(F.count(F.lit(1)).alias("quotes"))


view("option_dense", "dense option_bars", """SELECT d.ticker, d.session, d.date, d.close AS stock, d.volume AS stock_volume, c.close AS call, c.volume AS call_volume,
      p.close AS put, p.volume AS put_volume
    FROM dense d LEFT JOIN option_bars c ON c.ticker = d.ticker AND c.date = d.date AND c.contract_type = 'call'
    LEFT JOIN option_bars p ON p.ticker = d.ticker AND p.date = d.date AND p.contract_type = 'put'""")


def option_dense(spark, folder):
    """Stock close with the call and put marks of the same ticker and session."""
    return market_grid(spark, folder).withColumnsRenamed({"close": "stock", "volume": "stock_volume"})


@study("p6_prior_liquidity", """
SELECT ticker, session, CASE WHEN count(CASE WHEN call_volume IS NOT NULL AND stock_volume IS NOT NULL THEN 1 END) OVER w <> 5 THEN 'incomplete_prior_liquidity'
  WHEN sum(call_volume) OVER w < 200 THEN 'thin_prior_option_volume' WHEN avg(stock_volume) OVER w < 110 THEN 'thin_prior_stock_volume' END AS reason
FROM option_dense WINDOW w AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""", "option_dense")
def p6(spark, folder):
    return option_dense(spark, folder).select("ticker", "session", G.liquidity_reason("call_volume", "stock_volume", 200, 110).alias("reason"))


@study("p7_taxonomy_check", """
WITH taxonomy AS (SELECT p_brand AS label, min_by(p_type, p_partkey) AS parent FROM part WHERE p_brand <> 'Brand#25' GROUP BY 1)
SELECT p_brand AS label, p_type AS parent, count(*) AS rows, CASE WHEN t.parent IS NULL THEN 'unknown_label' WHEN t.parent <> p_type THEN 'parent_mismatch' ELSE 'valid' END AS result
FROM part LEFT JOIN taxonomy t ON t.label = p_brand GROUP BY 1, 2, 4""")
def p7(spark, folder):
    part = T.table(spark, folder, "part").select(F.col("p_brand").alias("label"), F.col("p_type").alias("parent"), "p_partkey")
    taxonomy = part.where("label <> 'Brand#25'").groupBy("label").agg(F.min_by("parent", "p_partkey").alias("parent"))
    return G.taxonomy_check(part, taxonomy, "label", "parent")


@study("p9_result_projection", "SELECT session, category, status_date FROM (SELECT session, category, session_date AS status_date, amount FROM aligned)", "aligned")
def p9(spark, folder):
    wide = aligned(spark, folder).withColumnRenamed("session_date", "status_date")
    return wide.drop("amount", "ticker", "issuer").select("session", "category", "status_date")


@study("p10_increasing_time", f"""
WITH o AS (SELECT l_partkey AS part, l_orderkey AS o, l_linenumber AS n, CAST(l_shipdate AS DATE) AS date,
  max(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
  FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{START}' AND DATE '{END}')
SELECT part, count(*) AS bars, count_if(earlier IS NULL OR date > earlier) AS kept FROM o GROUP BY 1""")
def p10(spark, folder):
    rows = T.table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("part"), "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", F.to_date("l_shipdate").alias("date"))
    rows = rows.where(F.col("date").between(START, END)).withColumn("bucket", F.floor(F.col("l_orderkey") / 4096))
    ordered = G.earlier_maximum(rows, ["part"], "bucket", ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"], "date", "earlier")
    keep = F.col("earlier").isNull() | (F.col("date") > F.col("earlier"))
    return ordered.groupBy("part").agg(F.count(F.lit(1)).alias("bars"), F.count_if(keep).alias("kept"))


@study("p11_criteria_flags", """
WITH y AS (SELECT ticker, year(date) AS year, avg(ret) AS m, count(*) AS n, sum(ret) AS s FROM moves WHERE ret IS NOT NULL GROUP BY 1, 2),
t AS (SELECT ticker, sum(s) / sum(n) AS estimate, min(m) AS lower FROM y GROUP BY 1),
l AS (SELECT ticker, min((ts - s) / (tn - n)) AS lowest, max((ts - s) / (tn - n)) AS highest FROM (SELECT *, sum(s) OVER (PARTITION BY ticker) AS ts, sum(n) OVER (PARTITION BY ticker) AS tn FROM y) GROUP BY 1),
d AS (SELECT ticker, quantile_cont(ret, 0.1) AS tail FROM moves WHERE ret IS NOT NULL GROUP BY 1)
SELECT ticker, CAST(coalesce(lower > 0, false) AS INTEGER) AS interval_above_zero, CAST(coalesce(sign(lowest) = sign(highest), false) AS INTEGER) AS leave_one_sign_stable,
  CAST(coalesce(tail >= 0, false) AS INTEGER) AS tail_not_worse, CAST(coalesce(estimate > 0 AND lower > 0 AND tail >= 0, false) AS INTEGER) AS passes
FROM t JOIN l USING (ticker) JOIN d USING (ticker)""", "moves")
def p11(spark, folder):
    ret = moves(spark, folder).where("ret is not null")
    years = ret.groupBy("ticker", F.year("date").alias("year")).agg(F.avg("ret").alias("m"), F.sum("ret").alias("s"), F.count("ret").alias("n"))
    total = W.partitionBy("ticker")
    rest = (F.sum("s").over(total) - F.col("s")) / (F.sum("n").over(total) - F.col("n"))
    summary = years.withColumn("rest", rest).groupBy("ticker").agg(
        (F.sum("s") / F.sum("n")).alias("estimate"), F.min("m").alias("lower"), F.min("rest").alias("lowest"), F.max("rest").alias("highest"))
    tails = ret.groupBy("ticker").agg(F.percentile("ret", 0.1).alias("tail"))
    return summary.join(tails, "ticker").select("ticker", *G.criteria_flags("lower", "lowest", "highest", "tail", "estimate"))


# ---------------------------------------------------------------- scalar functions

@study("f1_identifier", """
WITH raw AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '  ' || c_custkey || ' ' WHEN 1 THEN 'x' || c_custkey ELSE '' || c_custkey END AS raw FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(trim(raw), '[0-9]+') THEN lpad(trim(raw), 10, '0') END AS cik FROM raw""")
def f1(spark, folder):
    key = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), key, F.lit(" "))).when(
        F.col("c_custkey") % 3 == 1, F.concat(F.lit("x"), key)).otherwise(key)
    return T.table(spark, folder, "customer").select("c_custkey", X.identifier(raw).alias("cik"))


@study("f2_normalized_text", r"""SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS text_hash FROM documents""")
def f2(spark, folder):
    return T.table(spark, folder, "documents").select("doc_id", F.md5(X.normalized(F.col("text"))).alias("text_hash"))


@study("f3_clause_split", r"""
SELECT doc_id, CAST(len(string_split(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1))) AS INTEGER) AS clauses,
  md5(array_to_string(string_split(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)), '|')) AS clause_hash FROM documents""")
def f3(spark, folder):
    parts = X.clauses(F.col("text"))
    return T.table(spark, folder, "documents").select("doc_id", F.size(parts).alias("clauses"), F.md5(F.array_join(parts, "|")).alias("clause_hash"))


@study("f4_term_flags", r"""
SELECT doc_id, CAST(regexp_matches(text, '(?i)salary|compensation|equity award|incentive') AS INTEGER) AS pay_terms,
  CAST(regexp_matches(text, '(?i)\bthe\b') AS INTEGER) AS article, CAST(regexp_matches(text, '(?i)[a-z0-9._]+@[a-z0-9.]+') AS INTEGER) AS address,
  CAST(regexp_matches(text, '(?i)licen[cs]e') AS INTEGER) AS license FROM documents""")
def f4(spark, folder):
    text = F.col("text")
    return T.table(spark, folder, "documents").select(
        "doc_id", flag(text.rlike(X.PAY_WORDS)).alias("pay_terms"), flag(text.rlike(r"(?i)\bthe\b")).alias("article"),
        flag(text.rlike(r"(?i)[a-z0-9._]+@[a-z0-9.]+")).alias("address"), flag(text.rlike(r"(?i)licen[cs]e")).alias("license"))


@study("f5_calendar_days", """SELECT accession, filing_date + 45 AS due, filing_date - 30 AS back, CAST(DATE '2002-01-01' - filing_date AS INTEGER) AS days_left FROM filings""", "filings")
def f5(spark, folder):
    return T.filings(spark, folder).select("accession", F.date_add("filing_date", 45).alias("due"), F.date_sub("filing_date", 30).alias("back"),
                                           F.datediff(F.lit("2002-01-01").cast("date"), "filing_date").alias("days_left"))


@study("f6_date_buckets", """SELECT year(filing_date) AS year, strftime(filing_date, '%Y-%m') AS month, make_date(year(filing_date), 1, 1) AS fold_start, count(*) AS filings
FROM filings GROUP BY 1, 2, 3""", "filings")
def f6(spark, folder):
    year = F.year("filing_date")
    return T.filings(spark, folder).groupBy(year.cast("bigint").alias("year"), F.date_format("filing_date", "yyyy-MM").alias("month"),
                                            F.make_date(year, F.lit(1), F.lit(1)).alias("fold_start")).agg(F.count(F.lit(1)).alias("filings"))


@study("f7_market_clock", """
WITH u AS (SELECT l_orderkey, l_linenumber, l_shipdate + INTERVAL (CAST((l_orderkey * 7919) % 86400 AS BIGINT)) SECOND AS utc, year(l_shipdate) AS y FROM lineitem),
b AS (SELECT *, make_date(y, 4, 1) + CAST((7 - dayofweek(make_date(y, 4, 1))) % 7 AS INTEGER) AS first_sunday, make_date(y, 10, 31) - CAST(dayofweek(make_date(y, 10, 31)) AS INTEGER) AS last_sunday FROM u)
SELECT l_orderkey, l_linenumber, strftime(utc - CASE WHEN utc >= first_sunday + INTERVAL 7 HOUR AND utc < last_sunday + INTERVAL 6 HOUR THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END, '%Y-%m-%d %H:%M:%S') AS local_time FROM b""")
def f7(spark, folder):
    utc = F.col("l_shipdate") + F.make_dt_interval(secs=((F.col("l_orderkey") * 7919) % 86400).cast("decimal(18,6)"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(S.MARKET_ZONE), utc)
    return T.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@study("f8_timestamp_parse", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 1 THEN strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS utc FROM orders""")
def f8(spark, folder):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    raw = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
           .when(k == 2, F.date_format(d, "MM/dd/yyyy HH:mm")).otherwise(F.lit("unknown")))
    return T.table(spark, folder, "orders").withColumn("raw", raw).select("o_orderkey", F.date_format(parse_clock(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("utc"))


def parse_clock(raw):
    """First of the accepted clock formats that fits; NULL when none does."""
    formats = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm"]
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in formats])


# Codes of the trading sessions.
SESSION_CODES = {"pre": 0, "regular": 1, "after": 2, "night": 3}


@study("f9_session_codes", """
WITH s AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'pre' WHEN 'click' THEN 'regular' WHEN 'purchase' THEN 'after' WHEN 'signup' THEN 'night' ELSE event_type END AS session FROM events),
c AS (SELECT *, CASE session WHEN 'pre' THEN 0 WHEN 'regular' THEN 1 WHEN 'after' THEN 2 WHEN 'night' THEN 3 ELSE -1 END AS code FROM s)
SELECT event_id, code, CASE code WHEN 0 THEN 'pre' WHEN 1 THEN 'regular' WHEN 2 THEN 'after' WHEN 3 THEN 'night' ELSE 'unknown' END AS decoded FROM c""")
def f9(spark, folder):
    names = {"view": "pre", "click": "regular", "purchase": "after", "signup": "night"}
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    codes = F.create_map(*[F.lit(x) for kv in SESSION_CODES.items() for x in kv])
    back = F.create_map(*[F.lit(x) for k, v in SESSION_CODES.items() for x in (v, k)])
    session = F.coalesce(F.try_element_at(lookup, F.col("event_type")), F.col("event_type"))
    rows = T.events(spark, folder).select("event_id", F.coalesce(F.try_element_at(codes, session), F.lit(-1)).alias("code"))
    return rows.withColumn("decoded", F.coalesce(F.try_element_at(back, F.col("code")), F.lit("unknown")))


@study("f10_epoch_seconds", "SELECT ticker, CAST(epoch(CAST(date AS TIMESTAMP)) AS BIGINT) AS time, close AS value FROM bars", "bars")
def f10(spark, folder):
    return T.bars(spark, folder).select("ticker", (F.unix_date("date").cast("bigint") * 86400).alias("time"), F.col("close").alias("value"))


@study("f11_math", f"""SELECT ticker, session, {r('ln(1 + volume)')} AS log_volume, {r('ln(close)')} AS log_close, {r('exp(least(1::DOUBLE, ret)) - 1')} AS grown, {r('sqrt(abs(ret))')} AS root,
  {r('greatest(-0.5::DOUBLE, least(0.5::DOUBLE, ret))')} AS clipped FROM moves WHERE ret IS NOT NULL""", "moves")
def f11(spark, folder):
    return moves(spark, folder).where("ret is not null").select(
        "ticker", "session", rounded(F.log1p("volume")).alias("log_volume"), rounded(F.log("close")).alias("log_close"),
        rounded(F.expm1(F.least(F.lit(1.0), F.col("ret")))).alias("grown"), rounded(F.sqrt(F.abs("ret"))).alias("root"), rounded(clip("ret", -0.5, 0.5)).alias("clipped"))


@study("f12_safe_ratio", f"""SELECT l_orderkey, l_linenumber, {r('CASE WHEN l_discount <> 0 THEN l_tax / l_discount END')} AS ratio,
  {r('CASE WHEN l_tax <> 0 THEN (l_tax - l_discount) / l_tax END')} AS relative_improvement FROM lineitem""")
def f12(spark, folder):
    return T.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", rounded(ratio("l_tax", "l_discount")).alias("ratio"),
                                                     rounded(ratio(F.col("l_tax") - F.col("l_discount"), "l_tax")).alias("relative_improvement"))


@study("f14_arrays", """
SELECT f.accession, array_to_string(list_sort(list_distinct(list_append(coalesce(l.labels, []), f.category))), '|') AS joined, CAST(len(coalesce(l.labels, [])) AS INTEGER) AS labels
FROM filings f LEFT JOIN (SELECT accession, list(label) AS labels FROM filing_labels GROUP BY 1) l USING (accession)""", "filings filing_labels")
def f14(spark, folder):
    both = F.array_sort(F.array_distinct(F.array_union("labels", F.array("category"))))
    return T.labelled_filings(spark, folder).select("accession", F.array_join(both, "|").alias("joined"), F.size("labels").alias("labels"))


@study("f15_label_combinations", """
SELECT a.accession, a.label || '&' || b.label AS combo FROM filing_labels a JOIN filing_labels b ON a.accession = b.accession AND a.label < b.label
UNION ALL SELECT a.accession, a.label || '&' || b.label || '&' || c.label FROM filing_labels a JOIN filing_labels b ON a.accession = b.accession AND a.label < b.label
  JOIN filing_labels c ON a.accession = c.accession AND b.label < c.label
UNION ALL SELECT a.accession, a.label || '&' || b.label || '&' || c.label || '&' || d.label FROM filing_labels a JOIN filing_labels b ON a.accession = b.accession AND a.label < b.label
  JOIN filing_labels c ON a.accession = c.accession AND b.label < c.label JOIN filing_labels d ON a.accession = d.accession AND c.label < d.label""", "filing_labels")
def f15(spark, folder):
    rows = T.filing_labels(spark, folder).groupBy("accession").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    both = F.concat(*[X.combinations(F.col("labels"), k) for k in (2, 3, 4)])
    return rows.select("accession", F.explode(both).alias("combo"))


@study("f16_json_payload", """SELECT accession, '{"issuer":"' || issuer || '","accession":' || accession || ',"category":"' || category || '"}' AS payload FROM filings""", "filings")
def f16(spark, folder):
    return T.filings(spark, folder).select("accession", F.to_json(F.struct("issuer", "accession", "category")).alias("payload"))


@study("f17_comparison_id", """SELECT DISTINCT category, year(filing_date) AS year, h AS horizon,
  sha256('{"category":"' || category || '","horizon":' || h || ',"year":' || year(filing_date) || '}') AS comparison_id FROM filings CROSS JOIN (VALUES (1), (5), (21)) v(h)""", "filings")
def f17(spark, folder):
    cells = T.filings(spark, folder).select("category", F.year("filing_date").cast("bigint").alias("year")).distinct()
    cells = cells.select("*", F.explode(F.array(F.lit(1), F.lit(5), F.lit(21))).alias("horizon"))
    return cells.withColumn("comparison_id", row_identity("category", "year", "horizon"))


@study("f18_volume_bars", """SELECT ticker, session, volume, CASE WHEN close >= prior THEN 'up' ELSE 'down' END AS direction, format('{:.2f}%', round((close / prior - 1) * 100, 6)) AS change
FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY session) AS prior FROM dense) WHERE prior IS NOT NULL AND close IS NOT NULL""", "dense")
def f18(spark, folder):
    rows = dense(spark, folder).withColumn("prior", F.lag("close").over(P.by_session())).where("prior is not null and close is not null")
    change = X.percent((F.col("close") / F.col("prior") - 1) * 100)
    return rows.select("ticker", "session", "volume", F.when(F.col("close") >= F.col("prior"), "up").otherwise("down").alias("direction"), change.alias("change"))


# ---------------------------------------------------------------- set operations

@study("u1_union_studies", """
SELECT 'stock' AS study, ticker, date, close, volume, CAST(NULL AS VARCHAR) AS contract_type FROM bars
UNION ALL SELECT 'option', ticker, date, close, volume, contract_type FROM option_bars""", "bars option_bars")
def u1(spark, folder):
    stock = T.bars(spark, folder).withColumn("study", F.lit("stock"))
    option = T.option_bars(spark, folder).withColumn("study", F.lit("option"))
    return stock.unionByName(option, allowMissingColumns=True).select("study", "ticker", "date", "close", "volume", "contract_type")


@study("u2_required_labels", """SELECT accession FROM filing_labels WHERE label IN ('Brand#7', 'Brand#12') GROUP BY 1 HAVING count(*) = 2""", "filing_labels")
def u2(spark, folder):
    need = F.array(*[F.lit(x) for x in T.EVENT_LABELS])
    return T.labelled_filings(spark, folder).where(F.size(F.array_except(need, "labels")) == 0).select("accession")


@study("u3_label_group", """SELECT f.accession, CAST(count(l.label) > 0 AS INTEGER) AS in_group FROM filings f
LEFT JOIN filing_labels l ON l.accession = f.accession AND l.label IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1""", "filings filing_labels")
def u3(spark, folder):
    group = F.array(F.lit("Brand#1"), F.lit("Brand#2"), F.lit("Brand#3"))
    return T.labelled_filings(spark, folder).select("accession", flag(F.arrays_overlap("labels", group)).alias("in_group"))


@study("u4_component_only", """
SELECT accession FROM filing_labels WHERE label = 'Brand#7' EXCEPT SELECT accession FROM filing_labels WHERE label = 'Brand#12'""", "filing_labels")
def u4(spark, folder):
    first, second = T.EVENT_LABELS
    return T.labelled_filings(spark, folder).where(F.array_contains("labels", first) & ~F.array_contains("labels", second)).select("accession")


@study("u5_share_classes", """
WITH c AS (SELECT DISTINCT n_regionkey AS region, n_nationkey AS nation FROM nation)
SELECT 'I' || region AS issuer, 'T' || nation AS ticker, CASE WHEN nation = min(nation) OVER (PARTITION BY region) THEN 'kept' ELSE 'excluded' END AS outcome FROM c""")
def u5(spark, folder):
    classes = T.table(spark, folder, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation")).distinct()
    rank = F.row_number().over(W.partitionBy("region").orderBy("nation"))
    return classes.select(F.concat(F.lit("I"), F.col("region").cast("string")).alias("issuer"), F.concat(F.lit("T"), F.col("nation").cast("string")).alias("ticker"),
                          F.when(rank == 1, "kept").otherwise("excluded").alias("outcome"))


@study("u6_accept_exclude", """
SELECT accession, session, CASE WHEN session IS NULL THEN 'outside_grid' WHEN session < 84 THEN 'insufficient_history' WHEN session + 21 > (SELECT max(session) FROM sessions) THEN 'outcome_outside_history' END AS reason,
  CASE WHEN session IS NULL OR session < 84 OR session + 21 > (SELECT max(session) FROM sessions) THEN 'excluded' ELSE 'accepted' END AS outcome FROM aligned""", "aligned")
def u6(spark, folder):
    rows = aligned(spark, folder)
    last = sessions(spark, folder).agg(F.max("session")).scalar()
    reason = first_reason((F.col("session").isNull(), "outside_grid"), (F.col("session") < 84, "insufficient_history"),
                          (F.col("session") + 21 > last, "outcome_outside_history"))
    return rows.withColumn("reason", reason).select("accession", "session", "reason", F.when(F.col("reason").isNull(), "accepted").otherwise("excluded").alias("outcome"))
