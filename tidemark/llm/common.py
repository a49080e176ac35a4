"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale or script."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(column: Column) -> Column:
    """Identity of a text: rows of equal text share it, whatever their ids (null counts as empty)."""
    return F.unhex(F.sha2(F.coalesce(column, F.lit("")), 256))


def chunk_id(rows: int, per_chunk: int = 50_000) -> Column:
    """A chunk number that splits any group evenly. Only for a table that is written next: the files then fix it."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(max(1, math.ceil(rows / per_chunk))))


def numbered(df: DataFrame, group: list[str], chunk: str, order: list[str], name: str) -> DataFrame:
    """Gapless row numbers from 0 in each group, without a whole group in one task.

    Rows are numbered inside (group, chunk); the chunks' counts, one row per group and chunk, give the offsets.
    """
    counts = df.groupBy(*group, chunk).agg(F.count(F.lit(1)).alias("__rows"))
    before = W.partitionBy(*group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*group, chunk, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy(*group, chunk).orderBy(*order))
    return (df.withColumn("__inside", inside).join(offsets, [*group, chunk])
            .withColumn(name, F.col("__before") + F.col("__inside") - 1).drop("__inside", "__before"))


def summed(parts: DataFrame, adders: int = 64):
    """Sum of one float64 vector per task (column `sums`, binary), added by some tasks and then by one; None without rows."""
    import numpy as np
    import pyarrow as pa

    def add(batches):
        total = None
        for batch in batches:
            for data in batch.column("sums").to_pylist():
                vector = np.frombuffer(data, np.float64)
                total = vector.copy() if total is None else np.add(total, vector, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    found = parts.repartition(adders).mapInArrow(add, "sums binary").coalesce(1).mapInArrow(add, "sums binary").collect()
    return np.frombuffer(found[0]["sums"], np.float64) if found else None
