"""Logical inputs (bars, filings, contracts, quotes, ...) read from the supplied tables.

Every adapter is lazy, reads only the columns it needs, and aggregates before it
joins. Only calendar-sized tables are broadcast; other join sides are left to
adaptive execution, which checks their size at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import snapshot

# Fixed values of the adapters.
BENCHMARK = "T4"
EVENT_LABELS = ["Brand#7", "Brand#12"]
SIDES = ["call", "put"]
FIRST_EXPIRY = "1995-01-06"
EXPIRY_STEP_DAYS, EXPIRY_STEPS = 28, 92
OPTION_SCALE = 0.05


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def cents(value: str) -> Column:
    """Price in whole cents, so that sums are exact in any order."""
    return F.round(F.col(value) * 100).cast("bigint")


def supplier_homes(spark: SparkSession, folder: str, level: str = "region") -> DataFrame:
    """(s_suppkey, ticker). A stage table, so that its true size decides whether the lines have to be shuffled to meet it."""
    def build(s: SparkSession, f: str) -> DataFrame:
        return (table(s, f, "supplier")
                .join(F.broadcast(table(s, f, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
                .select("s_suppkey", F.concat(F.lit("T"), F.col(_level_key(level)).cast("string")).alias("ticker")))
    return snapshot(spark, folder, f"supplier-homes-{level}", build)


def market_days(spark: SparkSession, folder: str, level: str = "region") -> DataFrame:
    """(ticker, date, close, volume, call, call_volume, put, put_volume) from one pass over the lines.

    The stock series takes all lines of a region or nation; the call and put
    marks take the lines with return flag A and R. Unused series are pruned.
    """
    homes = supplier_homes(spark, folder, level)
    lines = table(spark, folder, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), cents("l_extendedprice").alias("amount"),
                                                    "l_quantity", "l_returnflag")
    sums = []
    for name, flag in (("stock", None), ("call", "A"), ("put", "R")):
        for column in ("amount", "l_quantity"):
            value = F.col(column) if flag is None else F.when(F.col("l_returnflag") == flag, F.col(column))
            sums.append(F.sum(value).alias(f"{name}_{column}"))
    days = lines.join(homes, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("ticker", "date").agg(*sums)

    def price(name: str) -> Column:
        return F.col(f"{name}_amount") / 100.0 / F.col(f"{name}_l_quantity")

    return days.select("ticker", "date", price("stock").alias("close"), F.col("stock_l_quantity").alias("volume"),
                       (price("call") * OPTION_SCALE).alias("call"), F.col("call_l_quantity").alias("call_volume"),
                       (price("put") * OPTION_SCALE).alias("put"), F.col("put_l_quantity").alias("put_volume"))


def bars(spark: SparkSession, folder: str, level: str = "region") -> DataFrame:
    """(ticker, date, close, volume): volume-weighted daily price of a region or nation."""
    return market_days(spark, folder, level).select("ticker", "date", "close", "volume")


def _level_key(level: str) -> str:
    return {"region": "n_regionkey", "nation": "n_nationkey"}[level]


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """(session, date): the numbered trading days. Calendar-sized, so one ordered pass is bounded."""
    days = table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return days.select((F.row_number().over(W.orderBy("date")) - 1).alias("session"), "date")


def filings(spark: SparkSession, folder: str, only: DataFrame | None = None) -> DataFrame:
    """(issuer, ticker, accession, filing_date, available_date, category, amount).

    `only` holds the accessions that are asked for, once each, and columns to add; the others then go before the orders meet their customers.
    """
    def build(s: SparkSession, f: str) -> DataFrame:
        return (table(s, f, "customer")
                .join(F.broadcast(table(s, f, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
                .select("c_custkey", F.col("n_regionkey").cast("string").alias("home")))

    homes = snapshot(spark, folder, "customer-homes", build)
    orders, more = table(spark, folder, "orders"), []
    if only is not None:
        orders = orders.join(only, F.col("o_orderkey") == F.col("accession")).drop("accession")
        more = [c for c in only.columns if c != "accession"]
    return (orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.concat(F.lit("I"), "home").alias("issuer"), F.concat(F.lit("T"), "home").alias("ticker"),
                    F.col("o_orderkey").alias("accession"), F.to_date("o_orderdate").alias("filing_date"),
                    F.date_add(F.to_date("o_orderdate"), 1).alias("available_date"),
                    F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("amount"), *more))


def _line_labels(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("label"))
    return (table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("accession"), "l_partkey")
            .join(parts, F.col("l_partkey") == F.col("p_partkey")).select("accession", "label"))


def filing_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(accession, label): the distinct brands of a filing's lines."""
    return _line_labels(spark, folder).distinct()


def label_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """(accession, labels): the sorted distinct brands of a filing's lines, by one shuffle."""
    return _line_labels(spark, folder).groupBy("accession").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def labelled_filings(spark: SparkSession, folder: str) -> DataFrame:
    """One row per filing with its sorted label array (empty when it has none)."""
    return filings(spark, folder).join(label_arrays(spark, folder), "accession", "left").withColumn(
        "labels", F.coalesce("labels", F.array().cast("array<string>")))


def contracts(spark: SparkSession, folder: str) -> DataFrame:
    """(contract, ticker, contract_type, strike, expiry, shares, style, extra): two sides per part."""
    part = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    return part.select(
        F.explode(F.array(*[F.lit(s) for s in SIDES])).alias("contract_type"), "*").select(
        F.concat_ws("-", F.lit("C"), F.col("p_partkey").cast("string"), "contract_type").alias("contract"),
        F.concat(F.lit("T"), (F.col("p_partkey") % 5).cast("string")).alias("ticker"), "contract_type",
        (2000 * (0.8 + (F.col("p_retailprice") - 900) / 250)).alias("strike"),
        F.date_add(F.lit(FIRST_EXPIRY).cast("date"), (EXPIRY_STEP_DAYS * (F.col("p_partkey") % EXPIRY_STEPS)).cast("int")).alias("expiry"),
        F.when(F.col("p_size") == 50, 10).otherwise(100).alias("shares"),
        F.when(F.col("p_type") == "PROMO", "european").when(F.col("p_type") == "SMALL", "other")
        .otherwise("american").alias("style"),
        (F.col("p_size") == 49).alias("extra"))


def option_bars(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, contract_type, date, close, volume): one option mark series per ticker and side."""
    sides = F.array(*[F.struct(F.lit(x).alias("contract_type"), F.col(x).alias("close"), F.col(f"{x}_volume").alias("volume")) for x in SIDES])
    return market_days(spark, folder).select("ticker", "date", F.explode(sides).alias("s")).select(
        "ticker", "s.contract_type", "date", "s.close", "s.volume").where("close is not null")


def contract_days(spark: SparkSession, folder: str) -> DataFrame:
    """(contract, date, price, volume, bid, ask): one row per contract and day with trades, from the lines of its part and side.

    Price is volume-weighted; bid and ask are those of the day's last line.
    """
    side = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "R", "put")
    mid = F.col("l_extendedprice") / F.col("l_quantity") * OPTION_SCALE
    last = F.struct(F.col("l_orderkey"), F.col("l_linenumber"), (mid * (1 - F.col("l_discount") / 2)).alias("bid"), (mid * (1 + F.col("l_tax") / 2)).alias("ask"))
    lines = table(spark, folder, "lineitem").where(side.isNotNull()).select(
        F.concat_ws("-", F.lit("C"), F.col("l_partkey").cast("string"), side).alias("contract"), F.to_date("l_shipdate").alias("date"), cents("l_extendedprice").alias("amount"), "l_quantity", last.alias("last"))
    days = lines.groupBy("contract", "date").agg(F.sum("amount").alias("amount"), F.sum("l_quantity").alias("volume"), F.max("last").alias("last"))
    return days.select("contract", "date", (F.col("amount") / 100.0 / F.col("volume") * OPTION_SCALE).alias("price"), "volume", "last.bid", "last.ask")


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, leg, ts_ns, sequence, bid, ask, bid_size, ask_size) with a nanosecond clock.

    The leg is the stock for unreturned lines and the option for the others; the
    time of day comes from the order number, because the source clock has none.
    """
    homes = supplier_homes(spark, folder)
    mid = F.col("l_extendedprice") / F.col("l_quantity")
    leg = F.when(F.col("l_returnflag") == "N", "stock").otherwise("option")
    mid = F.when(F.col("l_returnflag") == "N", mid).otherwise(mid * OPTION_SCALE)
    second = F.unix_date(F.to_date("l_shipdate")).cast("bigint") * 86400 + (F.col("l_orderkey") * 7919) % 86400
    return (table(spark, folder, "lineitem")
            .join(homes, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("ticker", leg.alias("leg"), (second * 1000000000).alias("ts_ns"),
                    (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sequence"),
                    (mid * (1 - F.col("l_discount") / 2)).alias("bid"), (mid * (1 + F.col("l_tax") / 2)).alias("ask"),
                    F.col("l_quantity").alias("bid_size"), (51 - F.col("l_quantity")).alias("ask_size")))


def dividends(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, declared, ex_date, cash, currency, accession): large filings of the low priority class."""
    return (filings(spark, folder).where((F.col("category") == "5-LOW") & (F.col("amount") > 480000))
            .select("ticker", F.col("filing_date").alias("declared"), F.date_add("filing_date", 10).alias("ex_date"),
                    (F.col("amount") * 1e-5).alias("cash"),
                    F.when(F.col("accession") % 17 == 0, "CAD").otherwise("USD").alias("currency"), "accession"))


def splits(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, execution_date, split_to, split_from): the largest urgent filing of a ticker and year; some ratios are unknown (0) or break shares."""
    urgent = filings(spark, folder).where(F.col("category") == "1-URGENT").withColumn("year", F.year("filing_date"))
    best = urgent.groupBy("ticker", "year").agg(F.max(F.struct("amount", "accession", "filing_date")).alias("f"))
    number = F.col("f.accession")
    parts = F.when(number % 7 == 0, 0).when(number % 5 == 0, 7).when(number % 3 == 0, 2).otherwise(1)
    return best.select("ticker", F.date_add("f.filing_date", 20).alias("execution_date"), (2 + number % 2).cast("int").alias("split_to"), parts.alias("split_from"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, ts, user_id, event_type, value, props) as stored."""
    return table(spark, folder, "events")
