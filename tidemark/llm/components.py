"""Connected components of a link table, by alternating star steps between written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, resting_on, stage


def _smallest(edges: DataFrame) -> DataFrame:
    """edges (u, v) plus m, the least of u and its v. A sum per u and a join: a node of any degree splits like any other rows."""
    least = edges.groupBy("u").agg(F.min("v").alias("w"))
    return edges.join(least, "u").withColumn("m", F.least("u", "w")).drop("w")


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v), any direction, repeats and loops allowed. Gives (node, root), root the least node reachable.

    Large-star links a node's larger neighbours to its least neighbour, small-star its smaller ones; both keep the components and
    end in stars, in a number of rounds that grows with the logarithm of the longest path. Empty input gives no rows.
    """
    edges = stage(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "component-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _smallest(large)  # u is the larger end of every link here
        small = down.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        older, edges = edges, stage(small.distinct(), "component-edges")
        discard(older)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return resting_on(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), edges)
        before = now
