"""Language identification: the nearest of several centroids per language, by cosine of normalised TF-IDF n-gram vectors.

Vectors are hashed counts of two- and three-byte grams of the lower-cased letters. Document frequencies come from all training rows;
the centroids of a language are clustered (spherical k-means) on a bounded, hashed sample of its distinct training texts, in which copies count once and
every language has a text. A text is rejected by its distance: under a share of what nearly all training rows of its language and length reach, counted over all of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidemark.session import discard, stage

DIMS = 8192
CENTROIDS = 4
SAMPLE = 2000  # distinct training texts a language, at most, on which the centroids are fitted
ROUNDS = 8
MOST_SENT = 1_000_000  # rows of the sample that may be sent to every task
ADDERS = 64  # tasks that add the document frequencies of the scanning tasks
LOW_SHARE, MARGIN = 0.01, 0.6  # a text is rejected under MARGIN times the cosine that all but LOW_SHARE of the training rows reach
FEW = 30  # training rows that a bound is taken from, at least
FLOOR = 0.02  # the bound where nothing else is known
BINS = 200  # of the counted cosines
CLASSES = 24  # lengths by powers of two
UNKNOWN = "und"
BLOCK = 128  # texts vectorised at a time
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def normalised(text: str | None) -> bytes:
    """Lower-case letters as UTF-8, other ASCII characters as single spaces, a space at both ends."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def counts(texts: list[str | None]) -> np.ndarray:
    """One row of hashed gram counts per text. Grams never span two texts; long texts are counted piece by piece with an overlap."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in enumerate(texts):
        data = normalised(text)
        for at in range(0, max(1, len(data) - 2), 1 << 20):
            a = np.frombuffer(data[at:at + (1 << 20) + 2], np.uint8).astype(np.uint32)
            two = a[:-1] << np.uint32(8) | a[1:]
            three = two[:-1] << np.uint32(8) | a[2:]
            two = two[:1 << 20]
            hashed = np.concatenate([two, three | np.uint32(1 << 24)]) * np.uint32(2654435761) >> np.uint32(32 - DIMS.bit_length() + 1)
            out[row] += np.bincount(hashed, minlength=DIMS)
    return out


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Rows of length one (or zero) with damped counts times the inverse document frequency."""
    x = counts(texts)
    np.sqrt(x, out=x)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.where(norm > 0, norm, 1)[:, None]
    return x


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        texts = batch.column("text").to_pylist()
        rows += len(texts)
        for at in range(0, len(texts), BLOCK):
            total += (counts(texts[at:at + BLOCK]) > 0).sum(axis=0)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["rows", "df"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        rows += sum(batch.column("rows").to_pylist())
        for df in batch.column("df").to_pylist():
            total += np.asarray(df, np.int64)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["rows", "df"])


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; starts are spread farthest-first, so the result depends on the rows and their order alone."""
    starts = [0]
    near = x @ x[0]
    for _ in range(1, min(k, len(x))):
        starts.append(int(near.argmin()))
        near = np.maximum(near, x @ x[starts[-1]])
    c = x[starts].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
    # The language's overall direction is a centroid too, so texts unlike any cluster still compare fairly.
    mean = x.mean(axis=0)
    return np.vstack([c, mean / max(np.linalg.norm(mean), 1e-12)])


def length_class(text: str | None) -> int:
    return min(len(text or "").bit_length(), CLASSES - 1)


def bounds(found: list[tuple[str, int, int, int]]) -> dict[str, list[float]]:
    """Least cosines from counts (language, length class, bin, rows).

    A length with few rows counts with the next shorter ones; longer texts say nothing about it. Where that is not enough, the least bound of the other
    languages at that length holds, and at last the floor.
    """
    counts: dict[str, np.ndarray] = {}
    for lang, size, b, n in found:
        counts.setdefault(lang, np.zeros((CLASSES, BINS), np.int64))[size, b] += n
    own_bounds: dict[str, list[float | None]] = {}
    for lang, own in counts.items():
        own_bounds[lang] = []
        for size in range(CLASSES):
            pool = np.zeros(BINS, np.int64)
            for near in range(size, -1, -1):
                if pool.sum() < FEW:
                    pool += own[near]
            enough = pool.sum() >= FEW
            own_bounds[lang].append(max(FLOOR, MARGIN * int(np.searchsorted(np.cumsum(pool), LOW_SHARE * pool.sum(), "right")) / BINS) if enough else None)
    least = [min((b for b in known if b is not None), default=FLOOR) for known in zip(*own_bounds.values())]
    return {lang: [x if b is None else b for b, x in zip(own_bounds[lang], least)] for lang in sorted(own_bounds)}


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    bounds: dict[str, list[float]]  # least cosine by language and length class

    def least(self, lang: str, size: int) -> float:
        own = self.bounds.get(lang)
        return own[min(size, len(own) - 1)] if own else FLOOR


def held_out(id_column: str) -> Column:
    """Rows whose CRC-32 of the id as text is divisible by 5; a null id counts as empty text, so it is held out."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Learn from the rows that are not held out and have a language and a letter in the text. No such rows: a model without languages."""
    rows = docs.where(~held_out(id_column) & F.col(lang_column).isNotNull() & F.col(text_column).rlike(r"\p{L}"))
    rows = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    schema = "rows long, df array<long>"
    parts = rows.select("text").mapInArrow(_frequencies, schema)
    # One row per task; added in two steps so that no task reads them all.
    total = parts.repartition(ADDERS).mapInArrow(_added, schema).coalesce(1).mapInArrow(_added, schema).collect()  # one row
    if not total:
        return Model([], np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), {})
    idf = np.log((1 + total[0]["rows"]) / (1 + np.asarray(total[0]["df"], np.float64))).astype(np.float32) + np.float32(0.1)
    keyed = rows.select("lang", "text", F.xxhash64("text").alias("key"))
    order = W.partitionBy("lang").orderBy("key")
    # Spark keeps the first rows of a language before and after the shuffle, so none of its groups is larger than the sample.
    chosen = keyed.groupBy("lang", "key").agg(F.lit(1).alias("one")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    chosen = stage(chosen.select("lang", "key"), "language-sample")
    wanted = F.broadcast(chosen) if chosen.count() <= MOST_SENT else chosen
    texts = keyed.join(wanted, ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))

    def fitted(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(part["text"])
        x = np.vstack([vectors(texts[at:at + BLOCK], idf) for at in range(0, len(texts), BLOCK)])
        return pd.DataFrame({"lang": key[0], "centroid": [c.astype(np.float32).tobytes() for c in cluster(x, k)]})

    found = texts.groupBy("lang").applyInPandas(fitted, "lang string, centroid binary").collect()  # languages x (k + 1) rows
    discard(chosen)
    found.sort(key=lambda r: (r["lang"], r["centroid"]))
    model = Model([r["lang"] for r in found], np.array([np.frombuffer(r["centroid"], np.float32) for r in found]).reshape(-1, DIMS), idf, {})
    counted = rows.select("lang", "text").mapInArrow(_cosines(docs.sparkSession.sparkContext.broadcast(model)), "lang string, size int, bin int, n long")
    counted = counted.groupBy("lang", "size", "bin").agg(F.sum("n").alias("n")).collect()  # languages x CLASSES x BINS rows at most
    model.bounds = bounds([tuple(r) for r in counted])
    return model


def _cosines(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Training rows by language, length and cosine to the nearest centroid of their own language, added per task."""
        m, found = handle.value, Counter()
        own = {lang: np.array([x == lang for x in m.langs]) for lang in set(m.langs)}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for at in range(0, len(texts), BLOCK):
                cos = vectors(texts[at:at + BLOCK], m.idf) @ m.centroids.T
                for row, (text, lang) in enumerate(zip(texts[at:at + BLOCK], langs[at:at + BLOCK])):
                    if lang in own:
                        found[lang, length_class(text), min(int(max(float(cos[row][own[lang]].max()), 0) * BINS), BINS - 1)] += 1
        keys = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in keys], pa.string()), *(pa.array([x[i] for x in keys], pa.int32()) for i in (1, 2)), pa.array([found[x] for x in keys], pa.int64())],
                                         names=["lang", "size", "bin", "n"])

    return run


def classify(docs: DataFrame, model: Model, text_column: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score and rejected (names after `prefix`) added to every row.

    score is the cosine to the nearest centroid, 0 to 1. Null texts and texts without a letter get "und", score 0 and are rejected,
    as is everything when no language was learned; a known language under its bound for the text's length is rejected too but keeps its name. Ties go to
    the first language by name. Repeated rows and extra columns pass through; an empty table stays empty.
    """
    names = [prefix + n for n in ("lang_pred", "score", "rejected")]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    handle = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x (centroids a language) x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = handle.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column)).to_pylist()
            langs, scores = [], []
            for at in range(0, len(texts), BLOCK):
                part = texts[at:at + BLOCK]
                if m.langs:
                    cos = vectors(part, m.idf) @ m.centroids.T
                    best = cos.argmax(axis=1)
                    top = np.clip(cos[np.arange(len(part)), best], 0, 1)
                    for text, b, s in zip(part, best.tolist(), top.tolist()):
                        known = has_letter(text)
                        langs.append(m.langs[b] if known else UNKNOWN)
                        scores.append(s if known else 0.0)
                else:
                    langs += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
            rejected = [lang == UNKNOWN or s < m.least(lang, length_class(text)) for text, lang, s in zip(texts, langs, scores)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected), one row per input row; see `fit` and `classify`."""
    model = fit(docs, id_column, text_column, lang_column)
    rows = docs.select(F.col(id_column), held_out(id_column).alias("held_out"), F.col(text_column).alias("__text"))
    return classify(rows, model, "__text").drop("__text")
