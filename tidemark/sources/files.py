"""File sources and sinks: page files, payload text, typed tables, snapshots, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import row_identity

# Wire formats of the inputs.
MARKET_ZONE = "America/New_York"
BAR_PAGE = "ticker string, results array<struct<t: bigint, c: double, v: double>>"
PAYLOAD_BAR = "time string, open string, high string, low string, close string, volume string"
CONTRACT = ("contract string, ticker string, contract_type string, strike double, expiry date, shares int, "
            "style string, extra boolean")
QUOTE = "ticker string, leg string, ts_ns bigint, sequence bigint, bid double, ask double, bid_size double, ask_size double"
ACTION = "ticker string, declared date, ex_date date, cash double, currency string"


def market_date(epoch_ms: Column) -> Column:
    """Exchange-local date of a UTC millisecond clock."""
    utc = F.timestamp_millis(epoch_ms)
    return F.to_date(F.from_utc_timestamp(utc.cast("timestamp"), MARKET_ZONE))


def read_bars(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Daily bars from JSON page files, limited to the declared date range."""
    page = spark.read.schema(BAR_PAGE).json(path).select("ticker", F.explode("results").alias("bar"))
    return page.select("ticker", market_date(F.col("bar.t")).alias("date"), F.col("bar.c").alias("close"),
                       F.col("bar.v").alias("volume")).where(F.col("date").between(start, end))


def read_bar_payload(payloads: DataFrame, body: str) -> DataFrame:
    """Bars from response text of either shape: a flat list, or result lists inside a result list."""
    row = f"struct<{', '.join(f'{c.split()[0]}: string' for c in PAYLOAD_BAR.split(', '))}>"
    flat = F.from_json(body, f"array<{row}>")
    nested = F.from_json(body, f"result array<struct<result: array<{row}>>>")
    is_list = F.ltrim(F.col(body)).startswith("[")
    found = F.when(is_list, flat).otherwise(F.flatten(F.transform(nested["result"], lambda x: x["result"])))
    bars = payloads.select("ticker", F.explode(found).alias("bar"))
    return bars.select("ticker", F.col("bar.time").cast("date").alias("date"),
                       *[F.col(f"bar.{n}").try_cast("double").alias(n) for n in ("open", "high", "low", "close", "volume")])


def explode_universe(rows: DataFrame, universe: list[str]) -> DataFrame:
    """One row per listed ticker of the universe; a missing list is kept and marked."""
    known = F.array(*[F.lit(t) for t in universe])
    matched = F.array_intersect("tickers", known)
    return rows.withColumn("source_status", F.when(F.col("tickers").isNull(), "missing_ticker_list")
                           .when(F.size(matched) == 0, "outside_universe").otherwise("matched")
                           ).withColumn("ticker", F.explode_outer(matched))


def merge_overlap(parts: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """Union of overlapping pages; a repeated key must carry equal values, or it is a conflict.

    Values of conflicting keys are NULL, so the caller can quarantine or stop.
    """
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    body = F.struct(*values)
    grouped = union.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min(body).alias("low"), F.max(body).alias("high"))
    same = F.col("low") == F.col("high")
    return grouped.select(*keys, "copies", F.when(same, "accepted").otherwise("conflict").alias("merge_status"),
                          *[F.when(same, F.col(f"low.{v}")).alias(v) for v in values])


def reject_conflicts(merged: DataFrame) -> DataFrame:
    """Fail the job when a conflict is present."""
    stop = F.raise_error(F.lit("conflicting duplicate rows"))
    return merged.withColumn("merge_status", F.when(F.col("merge_status") == "conflict", stop).otherwise(F.col("merge_status")))


def write_shards(results: DataFrame, path: str, keys: list[str]) -> None:
    """One directory per key combination, written in one job."""
    results.write.partitionBy(*keys).json(path)


def write_snapshot(panel: DataFrame, path: str, key: str) -> None:
    panel.write.partitionBy(key).parquet(path)


def new_ledger_rows(ledger: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose id the ledger does not hold yet, one row per id."""
    return rows.dropDuplicates([key]).join(ledger.select(key), key, "left_anti")


def append_ledger(path: str, ledger: DataFrame, rows: DataFrame, key: str) -> None:
    new_ledger_rows(ledger, rows, key).write.mode("append").parquet(path)


def with_identity(rows: DataFrame, columns: list[str], name: str = "row_id") -> DataFrame:
    return rows.withColumn(name, row_identity(*columns))
