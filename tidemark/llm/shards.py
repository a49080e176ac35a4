"""Sharding by Karmarkar-Karp differencing over groups of equal texts.

Partial partitions are vectors of shard loads. The two with the largest spread are combined in opposite order (the
heaviest part of one with the lightest of the other) until one is left. Groups are differenced in hashed blocks; a
block's result is itself a partial partition, so blocks are combined by the same rule, level by level, until one
remains. No task sees more than one block of groups or one batch of block results, whatever the corpus size.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunk_id, digest, numbered
from tidemark.session import stage

BLOCK = 1024


def difference(loads: np.ndarray) -> np.ndarray:
    """Combine partial partitions (one row of part loads each); gives for every row and part the joint part.

    Joint parts are numbered from the heaviest (0) to the lightest. An empty input gives an empty result.
    """
    m, k = loads.shape
    if m == 0:
        return np.zeros((0, k), dtype=np.int64)
    order = np.argsort(-loads, axis=1, kind="stable")
    vectors = [tuple(v) for v in np.take_along_axis(loads, order, axis=1).tolist()]
    heap = [(v[-1] - v[0], i) for i, v in enumerate(vectors)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(vectors[a], reversed(vectors[b]))]
        perm = sorted(range(k), key=sums.__getitem__, reverse=True)
        node = len(vectors)
        vectors.append(tuple(sums[p] for p in perm))
        rank = [0] * k
        for r, p in enumerate(perm):
            rank[p] = r
        merges.append((node, a, b, rank))
        heapq.heappush(heap, (vectors[node][-1] - vectors[node][0], node))
    place = {heap[0][1]: list(range(k))}
    for node, a, b, rank in reversed(merges):
        top = place.pop(node)
        place[a] = [top[rank[i]] for i in range(k)]
        place[b] = [top[rank[k - 1 - i]] for i in range(k)]
    joint = np.empty((m, k), dtype=np.int64)
    for i in range(m):
        joint[i, order[i]] = place[i]
    return joint


def _combine(loads: DataFrame, shards: int) -> DataFrame:
    """loads: (node, part, bytes), 8 parts or fewer a node; gives (node, part, shard) after all levels."""
    nodes = loads.select(F.max("node")).first()[0]
    nodes = 0 if nodes is None else nodes + 1
    path = loads.select("node", "part", F.col("node").alias("up"), F.col("part").alias("spot"), "bytes")
    while nodes > 1:

        def level(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            ids, at = np.unique(rows["up"].to_numpy(), return_inverse=True)
            matrix = np.zeros((len(ids), shards), dtype=np.int64)
            matrix[at, rows["spot"].to_numpy()] = rows["bytes"].to_numpy()
            joint = difference(matrix)
            return pd.DataFrame({"up": rows["up"], "spot": rows["spot"], "above": key[0], "joint": joint[at, rows["spot"].to_numpy()]})

        here = path.groupBy("up", "spot").agg(F.sum("bytes").alias("bytes"))
        moved = (here.withColumn("above", F.floor(F.col("up") / BLOCK)).groupBy("above")
                 .applyInPandas(level, "up long, spot long, above long, joint long"))
        path = stage(path.join(moved, ["up", "spot"]).select("node", "part", F.col("above").alias("up"), F.col("joint").alias("spot"), "bytes"),
                     "shard-level")
        nodes = math.ceil(nodes / BLOCK)
    return path.select("node", "part", F.col("spot").cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Near-equal bytes per shard, equal texts together: (id, size, text_crc32, shard, slot), one row per input row.

    size is the text's UTF-8 bytes plus 1. Null and empty texts count as one group of size-1 rows. Repeated rows and ids each keep
    a row of their own in the shard of their text; ties go by id, size and check sum. An empty table gives no rows. Other columns are
    not read. A group larger than a fair share stays whole, as it is indivisible.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
                       digest(F.col(text_column)).alias("text_key"))
    rows = stage(rows, "shard-rows")
    groups = stage(rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    count, total = groups.agg(F.count(F.lit(1)), F.sum("rows")).first()
    blocks = max(1, math.ceil(count / BLOCK))

    def first_level(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bytes", "text_key"], ascending=[False, True], ignore_index=True)
        loads = np.zeros((len(part), shards), dtype=np.int64)
        loads[:, 0] = part["bytes"].to_numpy()
        return pd.DataFrame({"text_key": part["text_key"], "node": key[0], "part": difference(loads)[:, 0], "bytes": part["bytes"]})

    blocked = groups.withColumn("node", F.pmod(F.xxhash64("text_key"), F.lit(blocks)))
    placed = stage(blocked.groupBy("node").applyInPandas(first_level, "text_key binary, node long, part long, bytes long"), "shard-blocks")
    # An empty part of a block still takes part in the combination, as load 0.
    loads = placed.groupBy("node", "part").agg(F.sum("bytes").alias("bytes"))
    final = placed.join(_combine(loads, shards), ["node", "part"]).select("text_key", "shard")
    out = rows.join(final, "text_key").select("id", "size", "crc", "shard", chunk_id(total or 0).alias("chunk"))
    return (numbered(stage(out, "shard-placed"), ["shard"], "chunk", ["id", "size", "crc"], "slot")
            .select(F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), "shard", "slot"))
