"""Label patterns of filings: tags, itemsets and ordered sequences with a window.

Sequences are found at (issuer, session, label) grain. Growing a sequence
backwards, the latest possible start is always the best one, so each step is an
equality join with "last session of label a before session s" and there is one
row per issuer, session and sequence. No pairs of filings are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import counter_draw


def label_days(activations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, session, label, filings) from one row per filing and label."""
    return activations.where(F.col("session").isNotNull()).groupBy(*keys, "session", "label").agg(F.count(F.lit(1)).alias("filings"))


def last_before(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, session, earlier, earlier_session): last session of each label strictly before each active session."""
    active = days.select(*keys, "session").distinct()
    labels = days.select(*keys, F.col("label").alias("earlier")).distinct()
    grid = active.join(labels, list(keys))
    seen = days.select(*keys, "session", F.col("label").alias("earlier"), F.col("session").alias("here"))
    w = W.partitionBy(*keys, "earlier").orderBy("session").rowsBetween(W.unboundedPreceding, -1)
    return grid.join(seen, [*keys, "session", "earlier"], "left").select(
        *keys, "session", "earlier", F.last("here", ignorenulls=True).over(w).alias("earlier_session")).where("earlier_session is not null")


def sequences(days: DataFrame, before: DataFrame, keys: Sequence[str], length: int, window: int) -> DataFrame:
    """(keys, session, prefix, length, span): what can stand before a session's own label.

    The part before the last label is the same for every label of that session,
    so it is grown once per (keys, session); `closed` adds the last label.
    """
    active = days.select(*keys, "session").distinct()
    level = active.select("*", F.lit(None).cast("string").alias("prefix"), F.col("session").alias("start"))
    previous = before.withColumnRenamed("session", "start")
    found = None
    for size in range(2, length + 1):
        level = level.join(previous, [*keys, "start"]).where(F.col("session") - F.col("earlier_session") <= window).select(
            *keys, "session", F.concat_ws(">", "earlier", "prefix").alias("prefix"), F.col("earlier_session").alias("start"))
        rows = level.select(*keys, "session", "prefix", F.lit(size).alias("length"), (F.col("session") - F.col("start")).alias("span"))
        found = rows if found is None else found.unionByName(rows)
    return found


def closed(prefixes: DataFrame, days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sequences with their last label and the filings that carry it."""
    return prefixes.join(days, [*keys, "session"]).withColumn("pattern", F.concat_ws(">", "prefix", "label"))


def windowed(sequence_rows: DataFrame, windows: Sequence[int]) -> DataFrame:
    """One row per window that is wide enough for the sequence."""
    fits = F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: w >= F.col("span"))
    return sequence_rows.withColumn("window", F.explode(fits))


def windowed_support(prefixes: DataFrame, days: DataFrame, issuer: str, windows: Sequence[int]) -> DataFrame:
    """(pattern, window, length, source_filings, source_issuers, activations) of all sequences.

    Rows are summed by issuer with one conditional sum per window; windows become
    rows and patterns become text only after that reduction.
    """
    joined = prefixes.join(days, [issuer, "session"])
    sums = []
    for w in windows:
        inside = F.col("span") <= w
        sums += [F.sum(F.when(inside, F.col("filings"))).alias(f"f_{w}"), F.count_if(inside).alias(f"a_{w}")]
    by_issuer = joined.groupBy("prefix", "label", "length", issuer).agg(*sums)
    rows = F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"f_{w}").alias("filings"), F.col(f"a_{w}").alias("activations")) for w in windows])
    long = by_issuer.select("prefix", "label", "length", F.explode(rows).alias("r")).select("prefix", "label", "length", "r.*").where("activations > 0")
    return long.groupBy("prefix", "label", "length", "window").agg(
        F.sum("filings").alias("source_filings"), F.count(F.lit(1)).alias("source_issuers"), F.sum("activations").alias("activations")).select(
        F.concat(F.lit("seq"), F.col("window").cast("string"), F.lit(":"), F.concat_ws(">", "prefix", "label")).alias("pattern"),
        "window", "length", "source_filings", "source_issuers", "activations")


def itemsets(filings: DataFrame, longest: int) -> DataFrame:
    """(issuer, accession, session, pattern, length): label combinations inside each filing's own array.

    A combination grows by the labels after its last one, so every level is an
    explode of the same row and nothing is shuffled.
    """
    level = filings.select("issuer", "accession", "session", "labels", F.posexplode("labels").alias("last", "pattern"))
    found = None
    for length in range(2, longest + 1):
        open_rows = level.where(F.col("last") + 1 < F.size("labels"))
        level = open_rows.select("issuer", "accession", "session", "labels", "pattern",
                                 F.explode(F.sequence(F.col("last") + 1, F.size("labels") - 1)).alias("last"))
        level = level.withColumn("pattern", F.concat_ws("&", "pattern", F.get("labels", F.col("last"))))
        rows = level.select("issuer", "accession", "session", "pattern", F.lit(length).alias("length"))
        found = rows if found is None else found.unionByName(rows)
    return found


def support(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Filings and issuers behind every pattern, issuers counted after a first reduction by issuer."""
    return rows.groupBy(*keys, "issuer").agg(F.sum("filings").alias("filings")).groupBy(*keys).agg(
        F.sum("filings").alias("source_filings"), F.count(F.lit(1)).alias("source_issuers"))


def circular_shift(filings: DataFrame, sessions: DataFrame, replicas: int, seed: int) -> DataFrame:
    """Placebo clocks: every issuer-year moves by one random offset per replica, bundles stay together.

    Adds replica, placebo_session and segment (0 before the wrap, 1 after it).
    """
    positions = sessions.select("session", F.year("date").alias("year"),
                                (F.row_number().over(W.partitionBy(F.year("date")).orderBy("session")) - 1).alias("place"))
    years = positions.groupBy("year").agg(F.count(F.lit(1)).alias("size"), F.min("session").alias("first"))
    located = filings.join(F.broadcast(positions), "session").join(F.broadcast(years), "year").withColumn(
        "replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    offset = 1 + counter_draw(seed, F.lit("shift"), "replica", "issuer", "year") % (F.col("size") - 1)
    moved = located.withColumn("offset", offset).withColumn("spot", F.col("place") + F.col("offset"))
    return moved.withColumns({"placebo_session": (F.col("first") + F.col("spot") % F.col("size")).cast("int"),
                              "segment": F.floor(F.col("spot") / F.col("size")).cast("int"),
                              "wrap_session": (F.col("first") + F.col("offset")).cast("int")})


def censored_zone(moved: DataFrame, width: int) -> DataFrame:
    """(replica, issuer, session) where shifted history crosses a year start or the wrap point."""
    marks = moved.select("replica", "issuer", F.explode(F.array("first", "wrap_session")).alias("mark")).distinct()
    return marks.select("replica", "issuer", F.explode(F.sequence(F.col("mark"), F.col("mark") + width - 1)).alias("session")).distinct()
