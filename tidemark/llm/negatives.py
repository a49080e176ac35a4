"""Hard negatives by rotated one-bit codes.

A vector is scaled to whole numbers. Its rotated form keeps one sign bit a dimension (the code), its norm, and its alignment: the cosine
between rotated vector and code. The inner product with an anchor is norm * (alignment * t + sqrt(1 - alignment^2) * r), where t, the anchor's product with the
code, comes from popcounts over the bit planes of the anchor's rotated and quantised form, and r, its product with the unit residual, is at
most sqrt(|anchor|^2 - t^2) by Cauchy and Schwarz. Quantisation moves t by no more than the norm of what it dropped. So every pair
has an interval that holds its score for certain: pairs whose interval can't matter are passed over, the others are scored in whole numbers.

Anchors are taken in blocks of a bounded size, each against all rows: first for the positives, then for the negatives in the ranges that
the positives' scores give. A task keeps a few rows an anchor, so what meets afterwards grows with tasks and anchors only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.session import discard, fresh_path, stage

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
EVERY = 100
ANCHORS = 2048  # anchors held by a task
PAIRS = 1 << 20  # pairs looked at at a time
PLANES = 4  # bits a dimension of a quantised anchor
LIMIT = 2.0**56  # of a squared norm: percentages of any score then fit into 64 bits
SEED = 17

ROWS = "id long, label long, size int, ints binary, code binary, norm double, align double"


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _words(size: int) -> int:
    return -(-size // 64)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, zeros behind."""
    words = np.zeros((len(bits), _words(bits.shape[1]) * 64), np.uint8)
    words[:, :bits.shape[1]] = bits
    return np.packbits(words, axis=1).view(np.uint64)


def encode(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, norms and alignments of rows of whole numbers; the zero vector has alignment 1."""
    size = ints.shape[1]
    turned = ints.astype(np.float64) @ rotation(size).T
    norm = np.sqrt((ints.astype(np.float64) ** 2).sum(axis=1))
    align = np.abs(turned).sum(axis=1) / np.sqrt(size)
    return packed(turned > 0), norm, np.where(norm > 0, np.minimum(align / np.maximum(norm, 1e-300), 1), 1)


def _encode(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            flat = lists.flatten()
            values = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64)) if len(flat) else np.zeros(0)
            at = np.r_[0, np.cumsum(sizes)]
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                if not size:
                    continue
                ints = values[at[rows][:, None] + np.arange(size)]
                with np.errstate(over="ignore", invalid="ignore"):
                    fits = np.isfinite(ints).all(axis=1) & ((ints**2).sum(axis=1) < LIMIT)
                rows, ints = rows[fits], ints[fits].astype(np.int32)
                code, norm, align = encode(ints)
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(taken), batch.column("label").take(taken), pa.array(np.full(len(rows), size, np.int32)),
                     pa.array([r.tobytes() for r in ints], pa.binary()), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(norm), pa.array(align)],
                    names=["id", "label", "size", "ints", "code", "norm", "align"])

    return run


class Anchors:
    """A block of anchors of one vector size: exact, and rotated and cut into bit planes."""

    def __init__(self, ids: list[int], labels: list[int], ints: np.ndarray) -> None:
        self.ids, self.labels, self.ints = np.array(ids, np.int64), np.array(labels, np.int64), ints
        size = ints.shape[1]
        turned = ints.astype(np.float64) @ rotation(size).T
        self.norm = np.sqrt((turned**2).sum(axis=1))
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**PLANES - 1), 1e-12)
        level = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, 2**PLANES - 1).astype(np.int64)
        self.lost = np.sqrt(((turned - self.low[:, None] - self.step[:, None] * level) ** 2).sum(axis=1))
        self.planes = [packed(level >> b & 1) for b in range(PLANES)]
        self.total = level.sum(axis=1) * self.step + size * self.low
        self.ranges: np.ndarray | None = None  # (anchor, positive, low and high score), low > high where there is none

    def intervals(self, code: np.ndarray, norm: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores, (anchor, row)."""
        size = self.ints.shape[1]
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int32)
        weighted = np.zeros((len(self.ids), len(code)), np.int32)
        for b, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                weighted += np.bitwise_count(plane[:, w, None] & code[None, :, w]).astype(np.int32) << b
        t = 2 * (self.step[:, None] * weighted + self.low[:, None] * ones[None, :]) - self.total[:, None]
        t /= np.sqrt(size)
        least = np.maximum(np.abs(t) - self.lost[:, None], 0)
        rest = np.sqrt(np.maximum(self.norm[:, None] ** 2 - least**2, 0))
        half = align * self.lost[:, None] + np.sqrt(np.maximum(1 - align**2, 0)) * rest
        slack = 1e-6 + 1e-9 * self.norm[:, None] * norm
        return norm * (align * t - half) - slack, norm * (align * t + half) + slack

    def scores(self, ints: np.ndarray, wanted: np.ndarray, exact_in_floats: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the wanted pairs, in whole numbers. Floats hold them exactly while norms multiply to less than 2^53."""
        a, r = np.nonzero(wanted)
        if exact_in_floats and len(a) * 8 > wanted.size:
            return a, r, (self.ints.astype(np.float64) @ ints.T.astype(np.float64))[a, r].astype(np.int64)
        out = np.zeros(len(a), np.int64)
        for at in range(0, len(a), 1 << 16):
            part = slice(at, at + (1 << 16))
            out[part] = np.einsum("ij,ij->i", self.ints[a[part]].astype(np.int64), ints[r[part]].astype(np.int64))
        return a, r, out


class Best:
    """The first few rows of every slot by score, then id; kept as rows are met."""

    def __init__(self, slots: int, keep: int) -> None:
        self.keep = keep
        self.rows = np.zeros((3, 0), np.int64)  # slot, score, id
        self.bar = np.full(slots, np.iinfo(np.int64).min)  # score of a full slot's last row

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(slot):
            return
        rows = np.concatenate([self.rows, np.stack([slot, score, ident])], axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        first = np.flatnonzero(np.r_[True, np.diff(rows[0]) != 0])
        place = np.arange(rows.shape[1]) - np.repeat(first, np.diff(np.r_[first, rows.shape[1]]))
        full = place == self.keep - 1
        self.bar[rows[0][full]] = rows[1][full]
        self.rows = rows[:, place < self.keep]


def _blocks(batches: Iterator[pa.RecordBatch], anchors: dict[int, Anchors]) -> Iterator[tuple[Anchors, tuple[np.ndarray, ...]]]:
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        for size in np.unique(sizes).tolist():
            if size not in anchors:
                continue
            one = batch.filter(pa.array(sizes == size))
            step = max(16, PAIRS // len(anchors[size].ids))
            for at in range(0, one.num_rows, step):
                part = one.slice(at, step)
                ints = np.frombuffer(b"".join(part.column("ints").to_pylist()), np.int32).reshape(-1, size)
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint64).reshape(-1, _words(size))
                yield anchors[size], (*(part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "norm", "align")), code, ints)


def _nth(values: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row; the least number where a row is shorter."""
    return np.partition(values, values.shape[1] - n, axis=1)[:, values.shape[1] - n] if values.shape[1] >= n else np.full(len(values), -np.inf)


def _positives(handle, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {s: Best(len(a.ids), keep) for s, a in handle.value.items()}
        for a, (ids, labels, norm, align, code, ints) in _blocks(batches, handle.value):
            best = found[ints.shape[1]]
            same = (a.labels[:, None] == labels) & (a.ids[:, None] != ids)
            low, high = a.intervals(code, norm, align)
            bar = np.maximum(_nth(np.where(same, low, -np.inf), keep), best.bar)
            x, r, score = a.scores(ints, same & (high >= bar[:, None]), bool((a.norm.max() + 1) * (norm.max() + 1) < 2**53))
            best.add(x, score, ids[r])
        for size, best in found.items():
            slot, score, ident = best.rows
            yield pa.RecordBatch.from_arrays([pa.array(handle.value[size].ids[slot]), pa.array(ident), pa.array(score)], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(handle, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {s: Best(len(a.ids) * a.ranges.shape[1], keep) for s, a in handle.value.items()}
        for a, (ids, labels, norm, align, code, ints) in _blocks(batches, handle.value):
            best, each = found[ints.shape[1]], a.ranges.shape[1]
            other = a.labels[:, None] != labels
            low, high = a.intervals(code, norm, align)
            wanted = np.zeros(other.shape, bool)
            bars = best.bar.reshape(-1, each)
            for k in range(each):
                least, most = a.ranges[:, k, 0, None], a.ranges[:, k, 1, None]
                certain = np.where(other & (low >= least) & (high <= most), low, -np.inf)
                bar = np.maximum(np.maximum(_nth(certain, keep), bars[:, k])[:, None], least)
                wanted |= other & (high >= bar) & (low <= most) & (least <= most)
            x, r, score = a.scores(ints, wanted, bool((a.norm.max() + 1) * (norm.max() + 1) < 2**53))
            for k in range(each):
                inside = (score >= a.ranges[x, k, 0]) & (score <= a.ranges[x, k, 1]) & (score >= bars[x, k])
                best.add(x[inside] * each + k, score[inside], ids[r[inside]])
        for size, best in found.items():
            slot, score, ident = best.rows
            each = handle.value[size].ranges.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(handle.value[size].ids[slot // each]), pa.array((slot % each).astype(np.int32)), pa.array(ident), pa.array(score)],
                                             names=["anchor_id", "place", "negative_id", "negative_score"])

    return run


def _first(df: DataFrame, group: list[str], score: str, ident: str, keep: int) -> DataFrame:
    """Spark keeps the first rows of a group before and after the shuffle, so no group meets whole."""
    order = W.partitionBy(*group).orderBy(F.col(score).desc(), F.col(ident))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def prepare(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors: (id, label, vector). Gives the encoded rows that take part, each id once."""
    kind = vectors.schema["vector"].dataType.elementType.simpleString()
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
                          "vector" if kind in ("float", "double") else F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where("id is not null and label is not null and vector is not null").where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    rows = stage(rows.mapInArrow(_encode(scale), ROWS), "negative-rows")
    again = stage(rows.groupBy("id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("id"), "negative-repeats")
    if again.isEmpty():
        return rows
    once = rows.join(again, "id").groupBy("id").agg(F.min(F.struct("label", "size", "ints", "code", "norm", "align")).alias("r")).select("id", "r.*")
    return rows.join(again, "id", "left_anti").unionByName(once)


def _block(chunk: list) -> dict[int, Anchors]:
    out = {}
    for size in sorted({r["size"] for r in chunk}):
        own = [r for r in chunk if r["size"] == size]
        out[size] = Anchors([r["id"] for r in own], [r["label"] for r in own], np.frombuffer(b"".join(bytes(r["ints"]) for r in own), np.int32).reshape(-1, size))
    return out


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: int = SCALE, block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from vectors (id, label, vector).

    Anchors are the rows whose id `every` divides; a positive is one of an anchor's first rows of its label, a negative one of the first rows of another
    label whose score is `low` to `high` percent of the positive's. Higher scores come first, ties by smaller id. Rows with a null id, label, vector or
    component take no part, nor do those with a non-finite component, no component at all, or a squared norm of 2^56 or more after scaling. Only
    vectors of equal size meet. A repeated id counts once, by the least label and vector. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = prepare(vectors, scale)
    place = fresh_path(spark, "negative-found")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(place)
    anchors = rows.where(F.col("id") % every == 0).select("id", "label", "size", "ints").toLocalIterator()  # a block at a time
    while chunk := list(islice(anchors, block)):
        held = _block(chunk)
        handle = spark.sparkContext.broadcast(held)  # `block` anchors at most
        met = rows.mapInArrow(_positives(handle, positives), "anchor_id long, positive_id long, positive_score long")
        first = stage(_first(met, ["anchor_id"], "positive_score", "positive_id", positives), "negative-positives")
        by_anchor: dict[int, dict[int, int]] = {}
        for r in first.collect():  # `block` times `positives` rows at most
            by_anchor.setdefault(r["anchor_id"], {})[r["rank"] - 1] = r["positive_score"]
        for a in held.values():
            a.ranges = np.tile(np.array([1, 0], np.int64), (len(a.ids), positives, 1))
            for i, ident in enumerate(a.ids.tolist()):
                for k, score in by_anchor.get(ident, {}).items():
                    a.ranges[i, k] = -(-low * score // 100), high * score // 100
        handle = spark.sparkContext.broadcast(held)
        met = rows.mapInArrow(_negatives(handle, negatives), "anchor_id long, place int, negative_id long, negative_score long")
        met = _first(met, ["anchor_id", "place"], "negative_score", "negative_id", negatives)
        found = met.join(first.select("anchor_id", (F.col("rank") - 1).alias("place"), "positive_id", "positive_score"), ["anchor_id", "place"])
        found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(place)
        discard(first)
    return spark.read.schema(schema).parquet(place)
