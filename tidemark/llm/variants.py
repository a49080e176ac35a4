"""Spelling variants by a frontier over a trie held as tables.

The trie of all words is an edge table. States (word, place, node, edits) walk it together, level by level, each level one join of the
frontier with the edges; a state that ends its word with one edit spent has reached a neighbour. Without an edit a word only follows its
own path, so those states need no walk: every place of a word is one. From there an edit is spent: a letter of the word is left out
(the neighbour lacks it), or a letter of the trie is passed unread (the neighbour has another one). Letters that only the neighbour has are
the first case seen from the other side. What follows must be read letter for letter.

An edge reads the greatest power of two of the letters left, so the levels grow with the logarithm of the longest word and the first
one already tells most candidates apart; it also asks for the number of letters left. Nodes and labels are hashes of prefixes and substrings; edges
of equal hash only add candidates, and those are held against the words themselves in the end.

Spark sizes a table behind mapInArrow or explode as if each row gave one row, and a stage table by its compressed files; states, edges and words, which grow
with the vocabulary, are therefore joined by sorting (`_joined`), never broadcast by such a size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower
from tidemark.session import discard, stage

# Fixed values of the contract: what a word is, the letters that are deleted, and what a form needs.
RUN = "[A-Za-zÀ-ÿ]"
DELETED = 31
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_counts(docs: DataFrame, deleted: int = DELETED, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """(word, n): runs of letters after the deletion of a code point where crc32(id:run) says so. A null id counts as an empty one."""
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.coalesce(F.col(text_column), F.lit("")), F.lit(f"({RUN}{{{min_length},}})"), F.lit(1))).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(h % deleted == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit number of several, by multiply and shift; wraps around."""
    out = np.full(np.broadcast(*parts).shape, 0x243F6A8885A308D3, np.uint64)
    for p in parts:
        out = (out ^ p.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xC4CEB9FE1A85EC53)
        out ^= out >> np.uint64(29)
    return out


class Letters:
    """The code points of several words end to end; hashes of any prefix or substring are differences of one running sum."""

    def __init__(self, words: list[str]) -> None:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.r_[0, np.cumsum(self.length)]
        most = int(self.length.max()) if len(words) else 0
        with np.errstate(over="ignore"):
            self.power = np.r_[np.ones(1, np.uint64), np.multiply.accumulate(np.full(most, _BASE, np.uint64))]
            down = np.r_[np.ones(1, np.uint64), np.multiply.accumulate(np.full(most, _INVERSE, np.uint64))]
            self.word = np.repeat(np.arange(len(words)), self.length)
            self.place = np.arange(len(codes)) - self.start[self.word]
            self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * down[self.place], dtype=np.uint64)]
        self.codes = codes

    def between(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        at = self.start[word]
        return (self.sums[at + high] - self.sums[at + low]) * self.power[low]

    def node(self, word: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return _mixed(self.between(word, np.zeros_like(depth), depth), depth)

    def label(self, word: np.ndarray, low: np.ndarray, left: np.ndarray, passed: int) -> np.ndarray:
        """What the edge at `low` reads of the `left` letters, and how many are left; `passed` tells edges that pass a letter unread before."""
        return _mixed(self.between(word, low, low + stride(left)), 2 * left + passed)


def stride(left: np.ndarray) -> np.ndarray:
    """The greatest power of two up to each number; 0 for 0."""
    return np.where(left > 0, 1 << np.maximum(np.frexp(left.astype(np.float64))[1] - 1, 0), 0).astype(np.int64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _edges(kinds: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, label, next): from every place of a word, with (1) or without (0) a letter passed unread."""
        for batch in batches:
            x = Letters(batch.column("word").to_pylist())
            rows = []
            for passed in kinds:
                left = x.length[x.word] - x.place - passed
                low = x.place + passed
                rows.append((x.node(x.word, x.place), x.label(x.word, low, left, passed), x.node(x.word, low + stride(left))))
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(c)) for c in zip(*rows)], names=["node", "label", "next"])

    return run


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, own, node, labels): one edit spent at every place, but for the last letter left out. own is the node that an unread letter equal to the word's own leads to."""
    for batch in batches:
        x = Letters(batch.column("word").to_pylist())
        ident = x.node(np.arange(len(x.length)), x.length)
        last = (np.r_[x.codes[1:], 0] != x.codes) & (x.place < x.length[x.word] - 1)
        for passed in (0, 1):
            # Leaving out any letter of a run of equal ones gives the same: the last one stands for the run. (At the end of a word that is the last letter.)
            at = np.flatnonzero(last) if not passed else np.arange(len(x.word))
            word, low = x.word[at], x.place[at] + 1
            left = x.length[word] - low
            labels, sizes = [], np.zeros(len(at), np.int64)
            own = x.node(word, low + stride(left)) if passed else np.zeros(len(at), np.uint64)
            first = True
            where = np.arange(len(at))
            while len(where):  # one turn for each bit of the longest rest
                w, lo, le = word[where], low[where], left[where]
                if not first or not passed:
                    more = le > 0
                    where, w, lo, le = where[more], w[more], lo[more], le[more]
                labels.append((where, x.label(w, lo, le, passed if first else 0)))
                sizes[where] += 1
                low[where] += stride(le)
                left[where] -= stride(le)
                first = False
            offsets = np.r_[0, np.cumsum(sizes)]
            flat = np.zeros(offsets[-1], np.uint64)
            for turn, (where, values) in enumerate(labels):
                flat[offsets[where] + turn] = values
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _signed(flat))
            yield pa.RecordBatch.from_arrays([_signed(ident[word]), _signed(own), _signed(x.node(word, x.place[at])), lists], names=["word", "own", "node", "labels"])


def _identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = Letters(batch.column("word").to_pylist())
        ident = x.node(np.arange(len(x.length)), x.length)
        shorter = x.node(np.arange(len(x.length)), np.maximum(x.length - 1, 0))
        yield pa.RecordBatch.from_arrays([_signed(ident), _signed(shorter), batch.column("word"), batch.column("n")], names=["node", "shorter", "word", "n"])


def _joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    return left.hint("merge").join(right.hint("merge"), on, how)


def near_words(words: DataFrame) -> DataFrame:
    """words: (word, n), distinct. Gives (word, n, other, other_n), both ways, for words that differ by exactly one code point inserted, deleted or replaced."""
    written = []

    def held(df: DataFrame, name: str) -> DataFrame:
        written.append(stage(df, name))
        return written[-1]

    def edges(*kinds: int) -> DataFrame:
        """(key, next), dealt out by key for the join that follows."""
        found = words.select("word").mapInArrow(_edges(kinds), "node long, label long, next long")
        return found.select(F.xxhash64("node", "label").alias("key"), "next").repartition("key").dropDuplicates(["key", "next"])

    def facing(states: DataFrame, own: str) -> DataFrame:
        """States before their next edge: its key, and the labels after it."""
        return states.select("word", F.col(own).alias("own"), F.xxhash64("node", F.element_at("labels", 1)).alias("key"), F.slice("labels", 2, F.size("labels")).alias("labels"))

    named = held(words.mapInArrow(_identified, "node long, shorter long, word string, n long"), "variant-words")
    ends = named.select(F.col("node").alias("word"), F.col("shorter").alias("other"))
    walking, kinds = facing(words.select("word").mapInArrow(_starts, "word long, own long, node long, labels array<long>"), "own"), (0, 1)
    while True:
        step = _joined(walking, edges(*kinds), "key").where(F.col("next") != F.col("own"))
        frontier = held(step.select("word", F.col("next").alias("node"), "labels"), "variant-frontier")
        ends = ends.unionByName(frontier.where(F.size("labels") == 0).select("word", F.col("node").alias("other")))
        left = frontier.where(F.size("labels") > 0)
        if left.isEmpty():
            break
        walking, kinds = facing(left.withColumn("own", F.lit(0).cast("long")), "own"), (0,)  # the edit is spent
    pairs = ends.select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).where("a != b").distinct()
    a, b = (named.select(F.col("node").alias(k), F.col("word").alias(f"{k}_word"), F.col("n").alias(f"{k}_n")) for k in "ab")
    # An end may be a node inside the trie; it then is no word's and finds no partner here.
    found = _joined(_joined(pairs, a, "a"), b, "b").where(F.levenshtein("a_word", "b_word", 1) == 1)
    both = F.explode(F.array(*[F.struct(F.col(f"{x}_word").alias("word"), F.col(f"{x}_n").alias("n"), F.col(f"{y}_word").alias("other"), F.col(f"{y}_n").alias("other_n"))
                               for x, y in ("ab", "ba")]))
    out = stage(found.select(both.alias("p")).select("p.*"), "variant-pairs")
    discard(*written)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """forms: (word, form), form null at the end of a chain. Gives (word, root); the distance followed doubles each round."""
    here = stage(forms.select("word", F.coalesce("form", "word").alias("root")), "variant-roots")
    while True:
        ahead = here.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        after = stage(_joined(here, ahead, "root").select("word", F.col("ahead").alias("root"), (F.col("ahead") != F.col("root")).alias("moved")), "variant-roots")
        discard(here)
        here = after.select("word", "root")
        if after.where("moved").isEmpty():
            return here


def variants(docs: DataFrame, ratio: int = RATIO, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word that is long and frequent enough.

    form is the near word of the largest n (ties: the first in code-point order) if that n is at least `ratio` times the word's, else null;
    root is what following forms leads to. Null and empty texts have no words; a null id is written as an empty one; repeated rows count as often as they
    stand there; words of any length are compared whole. An empty table gives no rows; other columns are not read.
    """
    words = stage(word_counts(docs, id_column=id_column, text_column=text_column, **options), "variant-counts")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), "other")).alias("b"))
    near = stage(_joined(words, best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                             F.when(F.col("b.other_n") >= ratio * F.col("n"), F.col("b")).alias("b")), "variant-forms")
    found = _joined(near, roots(near.select("word", F.col("b.other").alias("form"))), "word")
    return found.select("word", F.col("b.other").alias("form"), "root", "n", "n_near", F.col("b.other_n").alias("form_n"))
