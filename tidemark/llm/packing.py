"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A solution is a set of bins. Crossover copies whole well-filled bins of one parent into the other, removes the bins that then hold a
document twice, and puts the displaced documents back by best fit; mutation dissolves the worst bins. Documents are dealt into
blocks of a bounded number of pieces; every block is worked on by several islands with populations of their own, which send
their elite to the next island between epochs. A block's best solution counts. Each block may leave one sequence part-filled.
"""

from __future__ import annotations

import base64
import math
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

LIMIT = 2048
END_ID = 0
BLOCK = 8192  # pieces packed together
ISLANDS = 4
EPOCHS = 3
GENERATIONS = 20
POPULATION = 8
ELITES = 1

# The public pattern of the vocabulary (runs that never give back what they took), and its one special token.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The byte-level BPE vocabulary in the rank file of the same name; ids equal those of the .json file."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary + ".tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(text: str | None, vocabulary: str = "byte_bpe_50k") -> array:
    """Ids of a whole text with the end id after them, as unsigned 32-bit numbers."""
    enc = encoder(vocabulary)
    text = text or ""
    ids = enc.encode(text, allowed_special="all") if "<|endoftext|>" in text else enc.encode_ordinary(text)
    ids.append(END_ID)
    return array("I", ids)


def pieces(ids: array, limit: int = LIMIT) -> list[tuple[int, int, int]]:
    """(start, length, CRC-32) of a document's pieces; all but the first are full."""
    n = len(ids)
    first = (n - 1) % limit + 1
    cuts = [0, *range(first, n + 1, limit)]
    data = memoryview(ids.tobytes())
    return [(a, b - a, zlib.crc32(data[4 * a:4 * b])) for a, b in zip(cuts, cuts[1:])]


def _cut(limit: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for i, (a, n, c) in enumerate(pieces(token_ids(text, vocabulary), limit)):
                    at.append(row)
                    piece.append(i)
                    start.append(a)
                    length.append(n)
                    crc.append(c)
            columns = [pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *columns], names=["id", "piece", "start", "length", "crc"])

    return run


class Bins:
    """Open bins by the room that they have left; a bit per room that some bin has makes best fit one lookup."""

    def __init__(self, limit: int) -> None:
        self.limit, self.rooms, self.mask = limit, {}, 0

    def add(self, bin_id: int, room: int) -> None:
        if room:
            self.rooms.setdefault(room, []).append(bin_id)
            self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """The fullest bin with room for the size, and its room."""
        fits = self.mask >> size
        if not fits:
            return None
        room = size + (fits & -fits).bit_length() - 1
        ids = self.rooms[room]
        found = ids.pop()
        if not ids:
            self.mask &= ~(1 << room)
        return found, room


def best_fit(own: np.ndarray, sizes: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """own: bin of each item, -1 for items without one. Puts those, in the order given, where the least room is left."""
    out = own.copy()
    placed = out >= 0
    fills = np.bincount(out[placed], weights=sizes[placed]).astype(np.int64) if placed.any() else np.zeros(0, np.int64)
    bins = Bins(limit)
    for b, fill in enumerate(fills.tolist()):
        bins.add(b, limit - fill)
    fresh = len(fills)
    for i in order.tolist():
        size = int(sizes[i])
        got = bins.take(size)
        if got is None:
            got = fresh, limit
            fresh += 1
        out[i] = got[0]
        bins.add(got[0], got[1] - size)
    return out


def compact(own: np.ndarray) -> np.ndarray:
    """Bins renumbered from 0 without gaps; items without a bin keep -1."""
    out = np.full(len(own), -1, np.int64)
    placed = own >= 0
    out[placed] = np.unique(own[placed], return_inverse=True)[1]
    return out


def fitness(own: np.ndarray, sizes: np.ndarray, limit: int) -> tuple[int, float]:
    """(bins, less the mean square fill): less is better."""
    fills = np.bincount(own, weights=sizes) / limit
    return len(fills), -float((fills**2).mean())


def _refill(own: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    own = compact(own)
    free = np.flatnonzero(own < 0)
    return best_fit(own, sizes, free[np.argsort(-sizes[free], kind="stable")], limit)


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """Bins of b, the fuller the likelier, injected into a; a's bins that share a document with them go, their others are placed anew."""
    fills = np.bincount(b, weights=sizes) / limit
    chosen = rng.random(len(fills)) < 0.5 * (fills >= np.median(fills))
    taken = chosen[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[taken]] = True
    child = np.where(taken, b + int(a.max()) + 1, np.where(hit[a], -1, a))
    return _refill(child, sizes, limit)


def mutate(own: np.ndarray, sizes: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve the worst-filled bins and a few others."""
    fills = np.bincount(own, weights=sizes)
    worst = np.argsort(fills, kind="stable")[:max(1, len(fills) // 50)]
    more = rng.integers(0, len(fills), max(1, len(fills) // 100))
    gone = np.zeros(len(fills), bool)
    gone[worst] = gone[more] = True
    return _refill(np.where(gone[own], -1, own), sizes, limit)


def evolve(sizes: np.ndarray, seeds: list[np.ndarray], limit: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[np.ndarray]:
    """One island's epoch: its population after some generations, best first. A solution with the least number of bins that the sizes allow ends it early."""
    rng = np.random.default_rng(seed)
    least = math.ceil(int(sizes.sum()) / limit)
    rank = lambda s: fitness(s, sizes, limit)
    pool = sorted(seeds, key=rank)
    while len(pool) < population and not (pool and rank(pool[0])[0] <= least):
        noise = sizes * (1 if not pool else rng.uniform(0.9, 1.1, len(sizes)))
        pool.append(best_fit(np.full(len(sizes), -1, np.int64), sizes, np.argsort(-noise, kind="stable"), limit))
    pool.sort(key=rank)
    for _ in range(generations):
        if rank(pool[0])[0] <= least:
            break
        i, j = rng.choice(len(pool), 2, replace=False)
        child = crossover(pool[min(i, j)], pool[max(i, j)], sizes, limit, rng)
        pool = sorted([*pool, child, mutate(child, sizes, limit, rng)], key=rank)[:population]
    return pool


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)


def _epoch(limit: int, epoch: int):
    def run(key: tuple, rows: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        rows = _ordered(rows)
        seeds = [np.frombuffer(g, np.int32).astype(np.int64) for g in sent["genome"]] if len(sent) else []
        pool = evolve(rows["length"].to_numpy(), seeds, limit, seed=int(key[0]) * 1024 + int(key[1]) * 32 + epoch)
        keep = pool[:POPULATION if epoch < EPOCHS - 1 else 1]
        ranks = [fitness(s, rows["length"].to_numpy(), limit) for s in keep]
        return pd.DataFrame({"block": key[0], "island": key[1], "place": range(len(keep)), "bins": [r[0] for r in ranks],
                             "spread": [r[1] for r in ranks], "genome": [s.astype(np.int32).tobytes() for s in keep]})

    return run


def _laid_out(key: tuple, rows: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
    rows = _ordered(rows)
    best = best.sort_values(["bins", "spread", "island", "place"], ignore_index=True)
    rows["bin"] = np.frombuffer(best["genome"][0], np.int32).astype(np.int64)
    rows = rows.sort_values(["bin", "row"], ignore_index=True)
    ends = rows.groupby("bin")["length"].cumsum()
    return pd.DataFrame({"row": rows["row"], "sequence_id": key[0] * (1 << 32) + rows["bin"], "offset": ends - rows["length"]})


def pack(docs: DataFrame, limit: int = LIMIT, vocabulary: str = "byte_bpe_50k", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece of every input row.

    A row's ids are its whole text's and one end id, so a null or empty text is a piece of length 1. Rows over the limit are cut from
    the end, so their first piece may be shorter; full pieces are sequences of their own (negative sequence_id). Repeated rows are
    packed once each; ties go by row. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    cut = rows.mapInArrow(_cut(limit, vocabulary), f"id {kind}, piece int, start long, length long, crc long")
    cut = stage(cut.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    small = cut.where(F.col("length") < limit).select("row", "length")
    blocks = max(1, math.ceil(small.count() / BLOCK))
    small = small.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    spread = small.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    schema = "block long, island int, place int, bins long, spread double, genome binary"
    sent = docs.sparkSession.createDataFrame([], schema)
    for epoch in range(EPOCHS):
        islands = spread.groupBy("block", "island").cogroup(sent.groupBy("block", "island")).applyInPandas(_epoch(limit, epoch), schema)
        solved = stage(islands, "pack-islands")
        moved = F.when(F.col("place") < ELITES, F.pmod(F.col("island") + 1, F.lit(ISLANDS))).otherwise(F.col("island"))
        sent = solved.withColumn("island", moved)
    best = solved.where(F.col("place") == 0)
    laid = small.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(_laid_out, "row long, sequence_id long, offset long")
    out = cut.join(laid, "row", "left")
    return out.select(F.col("id").alias(id_column), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
                      F.coalesce("sequence_id", -F.col("row") - 1).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
