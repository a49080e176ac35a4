"""Benchmark decontamination by latent semantic retrieval.

Passages of documents and benchmark items are TF-IDF vectors over the items' words. A randomised SVD (one distributed pass for
the product of the Gram matrix with a random test matrix, Nystroem reconstruction on the driver from matrices as tall as the items' vocabulary) gives
a latent space whose rank grows with the items of a block. Windows of documents are searched there: a window is a candidate for the items whose cosine to it reaches a low
gate. It is taken for windows with some of the item's rarest words only: whoever keeps 60 % of an item's words keeps so many of any larger part of them, so nothing is lost by that.
Items that the space represents badly, by the share of their vector that is left after projection, have no gate. A candidate with as many of the item's words as
needed is a leak if the longest common subsequence of words covers enough of the item, or covers somewhat less and also keeps the item's answer, its
closing words. Short items are found as whole sequences.

Windows overlap so far that any passage of an item's length lies whole in one. Items are taken in blocks, so no task holds more than a block however many there are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import digest, summed
from tidemark.session import stage

WORD = re.compile(r"[^\W_]+")
ITEMS = 2000  # benchmark items held at once
PASSAGE = 48  # words a passage of the fit
RANK, RANK_SHARE, OVERSAMPLE, SEED = 48, 0.25, 8, 7  # latent directions: so many, or this share of a block's items if that is more
MAX_SHARE, MAX_LEAST = 0.1, 100  # words in over this share of the passages, and in over so many, carry no weight in the latent space
COSINE = 0.3  # of a window that may hold an item; recall is measured in the tests
REPRESENTED = 0.35  # least share of an item's norm that the space must keep for the cosine to tell
LCS_ALONE, LCS_WITH_ANSWER, ANSWER = 0.8, 0.6, 0.6
ANSWER_PART = 0.2  # of an item's words, at its end
MIN_WORDS = 8  # items with fewer words count only where they stand as they are: as a sequence, or, under PHRASE words, as a whole text
PHRASE = 3
CLASS_RATIO = 1.5  # item lengths that share a window
SEGMENT = 48_000  # words worked on at a time, a whole number of passages


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Block:
    """Some benchmark items: their words as numbers, and, once fitted, their latent space."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: dict[str, int]
    weighted: np.ndarray | None = None  # a row per word: its inverse document frequency times its latent direction
    vectors: np.ndarray | None = None  # a unit row per item
    gated: np.ndarray | None = None  # items that the latent space represents well
    df: np.ndarray | None = None  # passages that hold a word


def block_of(rows: list[tuple]) -> Block:
    vocabulary: dict[str, int] = {}
    ids, terms = [], []
    for ident, text in rows:
        w = words(text)
        if w:
            ids.append(ident)
            terms.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int32))
    return Block(ids, terms, vocabulary)


def _index(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = handle.value.vocabulary
        get = vocabulary.get
        kind = np.dtype("<i2" if len(vocabulary) < 2**15 else "<i4")
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                w = words(text)
                found.append(np.fromiter((get(x, -1) for x in w), kind, len(w)).tobytes())
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.binary())], names=[*keep, "terms"])

    return run


def _segments(batches: Iterator[pa.RecordBatch], vocabulary: int, gap: int, overlap: int, align: int = 1) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]]:
    """Documents laid end to end with `gap` empty words or more between them: (rows, starts, lengths, words).

    Starts are multiples of `align`. Documents over SEGMENT words are cut there, the pieces sharing `overlap` words.
    """
    kind = np.dtype("<i2" if vocabulary < 2**15 else "<i4")
    rows: list[tuple] = []
    parts: list[np.ndarray] = []
    starts: list[int] = []
    lengths: list[int] = []
    size = 0
    for batch in batches:
        names = [c for c in batch.schema.names if c != "terms"]
        columns = [batch.column(c).to_pylist() for c in names]
        for i, data in enumerate(batch.column("terms").to_pylist()):
            terms = np.frombuffer(data, kind).astype(np.int32)
            for at in range(0, max(1, len(terms) - overlap), SEGMENT):
                part = terms[at:at + SEGMENT + overlap]
                rows.append((*(c[i] for c in columns), at))
                starts.append(size)
                lengths.append(len(part))
                room = gap + -(len(part) + gap) % align
                parts += [part, np.full(room, -1, np.int32)]
                size += len(part) + room
                if size >= SEGMENT:
                    yield rows, np.array(starts), np.array(lengths), np.concatenate(parts)
                    rows, parts, starts, lengths, size = [], [], [], [], 0
    if rows:
        yield rows, np.array(starts), np.array(lengths), np.concatenate(parts)


def _passages(terms: np.ndarray, size: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, count) of the weighted item words of consecutive passages, sorted by passage and term; passages without any do not occur."""
    at = np.flatnonzero(terms >= 0 if weights is None else (terms >= 0) & (weights[terms] > 0))
    key, count = np.unique(at // PASSAGE * np.int64(size) + terms[at], return_counts=True)
    passage = np.unique(key // size, return_inverse=True)[1]
    return passage, key % size, count


def _document_frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1)
        for *_, terms in _segments(batches, size, 0, 0, PASSAGE):
            passage, term, _ = _passages(terms, size)
            total[:-1] += np.bincount(term, minlength=size)
            total[-1] += passage[-1] + 1 if len(passage) else 0
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _gram_product(passage: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, test: np.ndarray) -> np.ndarray:
    """A'(A test) for the unit TF-IDF rows A of the passages."""
    out = np.zeros(test.shape)
    if len(term):
        value = (count * idf[term]).astype(np.float32)
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        square = np.add.reduceat(value * value, first)
        z = np.add.reduceat(test[term] * value[:, None], first) / np.maximum(square, 1e-12)[:, None]
        by_term = np.argsort(term, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(term[by_term]) != 0])
        out[term[by_term][heads]] += np.add.reduceat(z[passage[by_term]] * value[by_term, None], heads)
    return out


def _products(size: int, rank: int, handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = handle.value
        test = test_matrix(size, rank).astype(np.float32)
        total = np.zeros(test.shape)
        for *_, terms in _segments(batches, size, 0, 0, PASSAGE):
            total += _gram_product(*_passages(terms, size, idf), idf, test)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def rank_of(block: Block) -> int:
    return max(RANK, math.ceil(RANK_SHARE * len(block.terms)))


def test_matrix(size: int, rank: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, min(size, rank + OVERSAMPLE)))


def leading(product: np.ndarray, test: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a positive matrix C from C @ test (shifted Nystroem)."""
    shift = 1e-6 * max(np.linalg.norm(product), 1e-12)
    y = product + shift * test
    middle = test.T @ y
    root = np.linalg.cholesky((middle + middle.T) / 2 + np.eye(len(middle)) * 1e-10 * max(np.trace(middle), 1e-12) / len(middle))
    return np.linalg.svd(np.linalg.solve(root, y.T).T, full_matrices=False)[0][:, :rank]


def fit(index: DataFrame, block: Block) -> Block:
    """Latent space of the documents' and the items' passages; both sides weigh alike, so rare item words are not drowned."""
    size = len(block.vocabulary)
    counted = summed(index.select("terms").mapInArrow(_document_frequencies(size), "sums binary"))
    df, n = (counted[:-1].copy(), counted[-1]) if counted is not None else (np.zeros(size), 0.0)
    for terms in block.terms:
        df[np.unique(terms)] += 1
    block.df = df
    idf = np.log((1 + n + len(block.terms)) / (1 + df)) + 0.05
    idf[df > max(MAX_LEAST, MAX_SHARE * n)] = 0
    handle = index.sparkSession.sparkContext.broadcast(idf)  # a number a word of the block
    rank = rank_of(block)
    product = summed(index.select("terms").mapInArrow(_products(size, rank, handle), "sums binary"))
    test = test_matrix(size, rank)
    own = np.zeros(test.shape)
    for terms in block.terms:
        t, c = np.unique(terms[idf[terms] > 0], return_counts=True)
        own += _gram_product(np.zeros(len(t), np.int64), t, c, idf, test.astype(np.float32))
    if product is not None and product.any():
        product = product.reshape(test.shape)
        own = own / np.linalg.norm(own) + product / np.linalg.norm(product)
    block.weighted = (leading(own, test, rank) * idf[:, None]).astype(np.float32)
    z = np.array([block.weighted[t].sum(axis=0) for t in block.terms])
    kept = np.linalg.norm(z, axis=1)
    block.vectors = (z / np.maximum(kept, 1e-12)[:, None]).astype(np.float32)
    whole = np.array([np.linalg.norm(np.bincount(t, minlength=size) * idf) for t in block.terms])
    block.gated = kept >= REPRESENTED * np.maximum(whole, 1e-12)
    return block


def length_classes(block: Block) -> list[tuple[int, int, int, np.ndarray]]:
    """(window, stride, least item words in a window, items): items of like length share windows that hold any of their occurrences whole."""
    order = sorted((i for i in range(len(block.terms)) if len(block.terms[i]) >= MIN_WORDS), key=lambda i: len(block.terms[i]))
    out, at = [], 0
    while at < len(order):
        least = len(block.terms[order[at]])
        members = [i for i in order[at:] if len(block.terms[i]) <= least * CLASS_RATIO]
        most = len(block.terms[members[-1]])
        stride = max(2, least // 3)
        out.append((most + stride, stride, int(np.ceil(LCS_WITH_ANSWER * least)), np.array(members)))
        at += len(members)
    return out


def common_words(masks: dict[int, int], length: int, window: list[int]) -> int:
    """Length of the longest common subsequence of an item (bit masks of its words' places) and a window."""
    rest = full = (1 << length) - 1
    for term in window:
        m = masks.get(term)
        if m:
            u = rest & m
            rest = (rest + u | rest - u) & full
    return length - rest.bit_count()


def _places(terms: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, t in enumerate(terms.tolist()):
        out[t] = out.get(t, 0) | 1 << i
    return out


def _sequences(block: Block) -> dict[int, dict[int, list[int]]]:
    """Short items by length and hash."""
    out: dict[int, dict[int, list[int]]] = {}
    for i, t in enumerate(block.terms):
        if len(t) < MIN_WORDS:
            out.setdefault(len(t), {}).setdefault(int(_grams(t, len(t))[0]), []).append(i)
    return out


def _grams(terms: np.ndarray, size: int) -> np.ndarray:
    """A number for every run of so many words; equal runs have equal ones."""
    out = np.zeros(max(0, len(terms) - size + 1), np.int64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.int64(1_000_003) + terms[k:len(terms) - size + 1 + k] + 2
    return out


def rare_words(block: Block, item: int) -> tuple[np.ndarray, int]:
    """(words, hits): an item's rarest words, and how many of their places any window must hold that keeps LCS_WITH_ANSWER of the item's."""
    terms = block.terms[item]
    lost = len(terms) - int(np.ceil(LCS_WITH_ANSWER * len(terms)))
    hits = max(1, len(terms) // 8)
    order = terms[np.lexsort((terms, block.df[terms]))]
    # All places of a chosen word count, so the number of places grows with repeated words, and with it what must be held.
    words = np.unique(order[:lost + hits])
    return words, int(np.isin(terms, words).sum()) - lost


def _by_word(block: Block, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, items, hits): the items of a class by rare word, those of word w at first[w] to first[w + 1]; hits by item."""
    pairs, hits = [], np.zeros(len(block.terms), np.int64)
    for item in members.tolist():
        words, hits[item] = rare_words(block, item)
        pairs += [(w, item) for w in words.tolist()]
    pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return np.searchsorted(pairs[:, 0], np.arange(len(block.vocabulary) + 1)), pairs[:, 1], hits


def _candidates(terms: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, stride: int, index: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(item, row, begin) of the windows with enough of an item's rare words. Every document's windows start with it."""
    first, items, hits = index
    at = np.flatnonzero(terms >= 0)
    many = first[terms[at] + 1] - first[terms[at]]
    at, many = at[many > 0], many[many > 0]
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    own = np.repeat(at, many)
    item = items[np.repeat(first[terms[at]] - (np.cumsum(many) - many), many) + np.arange(len(own))]
    row = np.searchsorted(starts, own, "right") - 1
    place = own - starts[row]
    low = np.maximum(-((width - 1 - place) // stride), 0)
    high = np.minimum(place // stride, (np.maximum(lengths[row], 1) - 1) // stride)
    count = np.maximum(high - low + 1, 0)
    window = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    most = int(lengths.max()) // stride + 1
    key, held = np.unique((np.repeat(item, count) * len(starts) + np.repeat(row, count)) * most + window, return_counts=True)
    window, rest = key % most, key // most
    item, row = rest // len(starts), rest % len(starts)
    kept = held >= hits[item]
    return item[kept], row[kept], starts[row[kept]] + window[kept] * stride


def _search(handle, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = handle.value
        classes = length_classes(block)
        gap = max([MIN_WORDS, *(w for w, *_ in classes)])
        tails = [t[-max(3, int(np.ceil(len(t) * ANSWER_PART))):] for t in block.terms]
        needed = np.array([int(np.ceil(LCS_WITH_ANSWER * len(t))) for t in block.terms])
        size = len(block.vocabulary)
        members = {i: set(t.tolist()) for i, t in enumerate(block.terms)}
        masks, tail_masks = [_places(t) for t in block.terms], [_places(t) for t in tails]
        short = _sequences(block)
        indexes = [_by_word(block, items) for *_, items in classes]
        for rows, starts, lengths, terms in _segments(batches, size, gap, gap):
            best: dict[tuple[int, int], tuple] = {}
            for n, items in short.items():
                grams = _grams(terms, n)
                for at in np.flatnonzero(np.isin(grams, np.fromiter(items, np.int64))).tolist():
                    for item in items[int(grams[at])]:
                        row = int(np.searchsorted(starts, at, "right")) - 1
                        whole = n >= PHRASE or lengths[row] == n and rows[row][-1] == 0
                        if whole and np.array_equal(terms[at:at + n], block.terms[item]):
                            found = (1.0, 1.0, 1.0 if block.vectors[item].any() else 0.0, -int(at - starts[row]) - rows[row][-1])
                            best[row, item] = max(best.get((row, item), found), found)
            for (width, stride, *_), index in zip(classes, indexes):
                seen: dict[int, tuple[list[int], np.ndarray]] = {}
                for item, row, begin in zip(*(x.tolist() for x in _candidates(terms, starts, lengths, width, stride, index))):
                    if begin not in seen:
                        window = terms[begin:begin + width]
                        window = window[window >= 0]
                        seen[begin] = window.tolist(), block.weighted[window].sum(axis=0)
                    window, z = seen[begin]
                    cosine = float(block.vectors[item] @ z / max(float(np.sqrt(z @ z)), 1e-12))
                    if block.gated[item] and cosine < COSINE:
                        continue
                    # A subsequence takes no more words than the window has of the item's.
                    if sum(map(members[item].__contains__, window)) < needed[item]:
                        continue
                    n = len(block.terms[item])
                    share = common_words(masks[item], n, window) / n
                    if share < LCS_WITH_ANSWER:
                        continue
                    answer = common_words(tail_masks[item], len(tails[item]), window) / len(tails[item])
                    if share >= LCS_ALONE or answer >= ANSWER:
                        found = (share, answer, cosine, -int(begin - starts[row]) - rows[row][-1])
                        best[row, item] = max(best.get((row, item), found), found)
            if best:
                keys = sorted(best)
                kinds = {"id": id_type, "text_key": pa.binary(), "item": pa.int32(), "lcs": pa.float64(), "answer": pa.float64(), "cosine": pa.float64(), "word": pa.int64()}
                values = [[rows[r][0] for r, _ in keys], [rows[r][1] for r, _ in keys], [i for _, i in keys], *([best[k][c] for k in keys] for c in range(3)), [-best[k][3] for k in keys]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds.values())], names=list(kinds))

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """(id, item id, cosine, lcs, answer, word, text_key): one row per id, text and item that the text holds, at its best passage.

    lcs and answer are the shares of the item's words, and of its closing words, in the passage in order; word is where its window
    starts. Null and empty texts hold nothing; items without words match nothing, those of under MIN_WORDS words only where they stand
    as a whole sequence, those of under PHRASE words only as a whole text; repeated rows count once;
    repeated items give a row each. Ties go to the earliest passage. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), digest(F.col(text_column)).alias("text_key"), F.col(text_column).alias("text"))
    kind, item_kind = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    id_type = to_arrow_type(rows.schema["id"].dataType)
    out = spark.createDataFrame([], f"{id_column} {kind}, {item_column} {item_kind}, cosine double, lcs double, answer double, word long, text_key binary")
    items = ((r[0], r[1]) for r in benchmark.select(item_column, item_text).toLocalIterator())
    while chunk := list(islice(items, ITEMS)):
        block = block_of(chunk)
        if not block.terms:
            continue
        handle = spark.sparkContext.broadcast(block)  # ITEMS items at most
        index = stage(rows.mapInArrow(_index(handle), f"id {kind}, text_key binary, terms binary"), "leak-index")
        handle = spark.sparkContext.broadcast(fit(index, block))
        found = index.mapInArrow(_search(handle, id_type), f"id {kind}, text_key binary, item int, lcs double, answer double, cosine double, word long")
        best = stage(found, "leak-found").groupBy("id", "text_key", "item").agg(F.max(F.struct("lcs", "answer", "cosine", (-F.col("word")).alias("back"))).alias("s"))
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, {item_column} {item_kind}")
        out = out.unionByName(best.join(names, "item").select(F.col("id").alias(id_column), item_column, "s.cosine", "s.lcs", "s.answer", (-F.col("s.back")).alias("word"), "text_key"))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; other rows and all columns stay."""
    bad = leaks(docs, benchmark, text_column=text_column, **options).select(F.col("text_key").alias("__leak")).distinct()
    return docs.withColumn("__key", digest(F.col(text_column))).join(bad, F.col("__key") == F.col("__leak"), "left_anti").drop("__key")
