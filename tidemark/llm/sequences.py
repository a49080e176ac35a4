"""Packing token sequences from the histogram of their lengths, the emptiest pack first.

Every document is cut into full sequences and one rest. Rests are packed by length alone: lengths are taken longest first, and all rests of a
length go into the packs with the most room, as many at a time as there are such packs, which updates the counts of the packing patterns. Documents are
ranked within their length, and a rank tells the pattern, the copy of it, and the place there. The histogram has one number a length, and
there are at most as many patterns, so what the driver holds is bounded by the sequence length, however many documents there are.

Packs that still have room are then closed by cutting, which is free: the emptiest packs are taken apart, laid end to end, and cut to the room
of the others; what is left over goes into sequences of power-of-two sizes, which need no padding. Both lines of places are runs of equal
steps, so a document finds its cuts by itself.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import numbered
from tidemark.session import stage

LIMIT = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
PER_CHUNK = 50_000  # ranked together
CACHE = 1_000_000  # words whose ids a worker keeps
LONG_WORD = 64  # longer words are not kept

# The vocabulary's pattern for such texts, the characters that are their own normal form and not white space beyond ASCII's, and the special tokens.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼½¾"
PART = re.compile(f"[{LETTER}]+|[{NUMBER}]|'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]|[^\\s{LETTER}{NUMBER}]+")
PLAIN = re.compile("[\t-\r -~¡-ĩı-ɏ‐-‧‰-⁞₠-₿]*")
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


@lru_cache(maxsize=1)
def tokenizer(name: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


_KEPT: dict[str, bytes] = {}  # by word as it stands
_PARTS: dict[str, bytes] = {}  # by part of a word in lower case


def _library_ids(texts: list[str], name: str) -> list[bytes]:
    return [array("I", e.ids).tobytes() for e in tokenizer(name).encode_batch(texts, add_special_tokens=False)]


def token_ids(texts: list[str | None], name: str = VOCABULARY) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    No token crosses the parts that the vocabulary's pattern cuts, so the library is asked once for each new part, and for whole texts where
    normalising could move the cuts.
    """
    texts = [t or "" for t in texts]
    out: list[bytes | None] = [None] * len(texts)
    if name == VOCABULARY:
        if len(_KEPT) > CACHE:
            _KEPT.clear()
        ids, later = _KEPT.__getitem__, []
        for i, t in enumerate(texts):
            if PLAIN.fullmatch(t) and not ("<|" in t and SPECIAL.search(t)):
                words = t.split()
                try:
                    out[i] = b"".join(map(ids, words))
                except KeyError:
                    later.append((i, words))
        if len(_PARTS) > CACHE:
            _PARTS.clear()
        more = set().union(*(words for _, words in later)).difference(_KEPT)
        cut = [PART.findall(w) for w in more]
        lower = [[x.lower() for x in parts] for parts in cut]
        new = list(set().union(*lower).difference(_PARTS))
        _PARTS.update(zip(new, _library_ids(new, name)))
        part_ids = _PARTS.__getitem__
        _KEPT.update(zip(more, [b"".join(map(part_ids, parts)) for parts in lower]))
        for x in new:
            if len(x) > LONG_WORD:
                del _PARTS[x]
        for i, words in later:
            out[i] = b"".join(map(ids, words))
        for w in more:
            if len(w) > LONG_WORD:
                del _KEPT[w]
    rest = [i for i, x in enumerate(out) if x is None]
    for i, x in zip(rest, _library_ids([texts[i] for i in rest], name)):
        out[i] = x
    return out


def _cut(limit: int, name: str, end_id: int):
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                at, start, length, crc, tokens, kept = [], [], [], [], [], []
                for row, data in enumerate(token_ids(batch.column("text").to_pylist(), name)):
                    data += end
                    n = len(data) // 4
                    for a in range(0, n, limit):
                        part = data[4 * a:4 * (a + limit)]
                        at.append(row)
                        start.append(a)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        tokens.append(n)
                        ids = np.frombuffer(part, np.uint32)
                        kept.append(None if len(part) == 4 * limit else ids.astype(np.uint16).tobytes() if int(ids.max()) < 2**16 else part)
                columns = [pa.array(c, pa.int64()) for c in (start, length, crc, tokens)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *columns, pa.array(kept, pa.binary())],
                                                 names=["id", "start", "length", "crc", "doc_tokens", "ids"])

    return run


@dataclass
class Pattern:
    """`count` packs alike: runs of (length, times) in the order in which they were put in, and the room that is left."""

    count: int
    room: int
    runs: tuple[tuple[int, int], ...]


def patterns(histogram: dict[int, int], limit: int = LIMIT) -> list[Pattern]:
    """Packs all lengths, longest first, each into the packs with the most room."""
    heap: list[tuple[int, int, Pattern]] = []  # (-room, order of making, pattern)
    made = 0

    def push(p: Pattern) -> None:
        nonlocal made
        heapq.heappush(heap, (-p.room, made, p))
        made += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or -heap[0][0] < length:
                push(Pattern(left, limit - length, ((length, 1),)))
                break
            old = heapq.heappop(heap)[2]
            if old.count > left:
                push(Pattern(old.count - left, old.room, old.runs))
                old.count = left
            # As long as it stays the emptiest, the same packs take another one.
            next_room = -heap[0][0] if heap else 0
            times = max(1, min(left // old.count, old.room // length, (old.room - next_room) // length))
            left -= times * old.count
            before = old.runs[-1]
            runs = (*old.runs[:-1], (length, before[1] + times)) if before[0] == length else (*old.runs, (length, times))
            push(Pattern(old.count, old.room - times * length, runs))
    return [p for _, _, p in sorted(heap, key=lambda x: (x[0], x[1]))]


@dataclass
class Plan:
    """Where a rest goes by its length and rank, and the rooms that taken-apart packs are cut to; a few numbers a run of equal places."""

    key: np.ndarray  # length << 48 | first rank
    rows: np.ndarray  # (times in a pack, first sequence, offset, packs, first place on the line of taken-apart packs or -1, their content)
    room_at: np.ndarray  # first place on that line
    rooms: np.ndarray  # (room, first sequence, offset there)


def plan(histogram: dict[int, int], limit: int = LIMIT) -> Plan:
    packs = patterns(histogram, limit)  # the emptiest first
    total = sum(p.count for p in packs)
    gap = sum(p.count * p.room for p in packs)
    # As few packs as fill the others' room are taken apart.
    apart, content = [], 0
    for p in packs:
        need = gap - content  # a pack taken apart adds its content and takes away its own room: `limit` in all
        take = min(p.count, max(0, math.ceil(need / limit)))
        apart.append(take)
        content += take * (limit - p.room)
        gap -= take * p.room
    ranks: dict[int, int] = {}
    keys, rows, room_at, rooms = [], [], [], []
    sequence, line, closed = 0, 0, 0
    for p, take in zip(packs, apart):
        for count, on_line in ((take, True), (p.count - take, False)):
            if not count:
                continue
            offset = 0
            for length, times in p.runs:
                keys.append(length << 48 | ranks.get(length, 0))
                rows.append((times, sequence, offset, count, line if on_line else -1, limit - p.room))
                ranks[length] = ranks.get(length, 0) + times * count
                offset += length * times
            if on_line:
                line += count * (limit - p.room)
            else:
                if p.room:
                    room_at.append(closed)
                    rooms.append((p.room, sequence, limit - p.room))
                    closed += count * p.room
                sequence += count
    left = content - closed
    for bit in reversed(range(limit.bit_length())):
        if left > 0 and left >> bit & 1:
            room_at.append(closed)
            rooms.append((1 << bit, sequence, 0))
            closed += 1 << bit
            sequence += 1
    assert sequence <= total + limit.bit_length()
    order = np.argsort(np.array(keys, np.int64), kind="stable") if keys else []
    return Plan(np.array(keys, np.int64)[order], np.array(rows, np.int64).reshape(-1, 6)[order], np.array(room_at, np.int64), np.array(rooms, np.int64).reshape(-1, 3))


def _placed(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = handle.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(p.key, length << 48 | rank, "right") - 1
            times, sequence, offset, _, line, content = p.rows[at].T
            inside = rank - (p.key[at] & (1 << 48) - 1)
            copy, slot = inside // times, inside % times
            here = offset + slot * length
            keep = [c for c in batch.schema.names if c not in ("rank", "chunk")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence + copy), pa.array(here), pa.array(np.where(line < 0, -1, line + copy * content + here))],
                                             names=[*keep, "sequence_id", "offset", "line"])

    return run


def _recut(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = handle.value
        for batch in batches:
            at, start, length, crc, sequence, offset = [], [], [], [], [], []
            for row, (first, n, place, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start", "length", "line", "ids")))):
                words = np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32).astype(np.uint32)
                done = 0
                while done < n:
                    x = place + done
                    k = int(np.searchsorted(p.room_at, x, "right")) - 1
                    room, seq, base = p.rooms[k].tolist()
                    copy, used = divmod(x - int(p.room_at[k]), room)
                    part = min(n - done, room - used)
                    at.append(row)
                    start.append(first + done)
                    length.append(part)
                    crc.append(zlib.crc32(words[done:done + part].tobytes()))
                    sequence.append(seq + copy)
                    offset.append(base + used)
                    done += part
            taken = pa.array(at, pa.int64())
            columns = [pa.array(c, pa.int64()) for c in (start, length, crc)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(taken), *columns, batch.column("doc_tokens").take(taken), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                             names=["id", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece of every input row.

    A row's ids are its whole text's and one end id, so a null or empty text has one. Full pieces are sequences of their own
    (negative sequence_id). No sequence needs padding: all but the last few hold `limit` ids, those a power of two. Repeated rows are packed once each;
    ties in length go by row. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    cut = rows.mapInArrow(_cut(limit, vocabulary, end_id), f"id {kind}, start long, length long, crc long, doc_tokens long, ids binary")
    cut = stage(cut.withColumn("row", F.monotonically_increasing_id()), "sequence-pieces")
    columns = ["id", "start", "length", "crc", "doc_tokens"]
    full = cut.where(F.col("length") == limit).select(*columns, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < limit)
    histogram = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `limit` rows at most
    if histogram:
        handle = spark.sparkContext.broadcast(plan(histogram, limit))  # bounded by the histogram
        chunks = max(1, math.ceil(sum(histogram.values()) / PER_CHUNK))
        ranked = numbered(rest.select(*columns, "row", F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk")), ["length"], "chunk", ["row"], "rank")
        schema = ", ".join(f"{c} {t}" for c, t in ranked.dtypes if c not in ("rank", "chunk"))
        placed = stage(ranked.mapInArrow(_placed(handle), f"{schema}, sequence_id long, offset long, line long"), "sequence-placed")
        apart = placed.where(F.col("line") >= 0).select(*columns, "row", "line").join(cut.where(F.col("length") < limit).select("row", "ids"), "row")
        again = apart.mapInArrow(_recut(handle), f"id {kind}, start long, length long, crc long, doc_tokens long, sequence_id long, offset long")
        full = full.unionByName(placed.where(F.col("line") < 0).select(*columns, "sequence_id", "offset")).unionByName(again)
    return full.select(F.col("id").alias(id_column), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
