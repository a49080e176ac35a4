"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of radius + 1 bits, and every non-zero vector v of that length a mask of the positions
whose vector has odd product with v. Up to `radius` differing positions span at most radius dimensions, so some v is orthogonal to
all of them: under its mask the two fingerprints are equal. Each of the 2^(radius + 1) - 1 tables keeps about half of the bits.
Only distinct fingerprints enter the tables, so exact copies cost one entry however many there are. Inside a bucket a breadth-first
pass links each fingerprint once it is reached: the links that come out are a spanning forest, never all pairs.

A wider radius can ask for a second fingerprint, of five-word shingles under another seed, that must be near as well. It stands for
a similarity of about 0.8 and keeps chance links away, whose number grows with the square of the corpus.

Fingerprints of texts at a Jaccard similarity of 0.8 differ in about 10 of 64 bits, up to 18: no mask covers that and still tells texts apart.
With `similar` the sets of five-word shingles are compared as well: BANDS keys of ROWS minimum hashes each bring a pair at 0.8
together but for 3 pairs in a million, and those that meet are linked if the exact similarity of their sets reaches `similar`.
Only buckets that span several components are compared, first over a few bands and then over the rest: as stars, then as groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import digest
from tidemark.llm.components import components
from tidemark.session import discard, resting_on, stage

RADIUS = 4
SHINGLE = 4
SEED = 42
CHECK_SHINGLE, CHECK_SEED, CHECK_RADIUS = 5, 43, 18  # 18 of 64 bits: what a Jaccard similarity of 0.8 (9.7 bits) stays within, with three deviations
PIECE = 1 << 16  # shingles held as bits at a time
BANDS, ROWS, FIRST = 32, 5, 4  # (1 - 0.8^5)^32 = 3e-6; the bands of the first round link most, so few buckets are left to the second
STAR = 2000  # texts held against a centre in one task
MARKS = 1 << 27  # places that mark the texts to be compared, 16 MB; when they fill up, more texts are read than need be
_DRAWS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_TURN, _TIMES = _DRAWS[0], _DRAWS[1] | np.uint64(1)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """8 bytes, highest bit first. Words are runs without ASCII white space, A-Z lower-cased; a bit needs more than half of the hashes."""
    words = (text or b"").lower().split()  # on bytes: ASCII letters and ASCII white space only
    if not words:
        return bytes(8)
    if len(words) < shingle:
        joined = iter([b" ".join(words)])
        count = 1
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        count = len(words) - shingle + 1
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, joined, repeat(seed))), np.uint8).reshape(count, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, PIECE):
        ones += np.add.reduce(np.unpackbits(hashes[at:at + PIECE], axis=1), axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > count).tobytes()


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks; positions take the non-zero vectors in turn."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def forest(values: np.ndarray, radius: int, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked values (from, to): all within the radius of one another are joined, at most one link into each."""
    out_a, out_b, rest = [], [], np.arange(values.size)
    while rest.size > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            x = queue.pop()
            near = np.bitwise_count(values[rest] ^ values[x]) <= radius
            if checks is not None:
                near &= np.bitwise_count(checks[rest] ^ checks[x]) <= CHECK_RADIUS
            if near.any():
                found, rest = rest[near], rest[~near]
                out_a.append(np.full(found.size, x))
                out_b.append(found)
                queue.extend(found)
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _bucket_links(radius: int, check: bool):
    names = ["fp", "ck"] if check else ["fp"]

    def within(keys: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else np.zeros(0, np.int64)
        lengths = np.diff(np.r_[starts, keys.size])
        two = starts[lengths == 2]
        near = np.bitwise_count(columns[0][two] ^ columns[0][two + 1]) <= radius
        if check:
            near &= np.bitwise_count(columns[1][two] ^ columns[1][two + 1]) <= CHECK_RADIUS
        a, b = [two[near]], [two[near] + 1]
        for s, n in zip(starts[lengths > 2], lengths[lengths > 2]):
            x, y = forest(columns[0][s:s + n], radius, columns[1][s:s + n] if check else None)
            a.append(x + s)
            b.append(y + s)
        ends = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(c[end].view(np.int64)) for end in ends for c in columns], names=[side + n for side in "uv" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket that crosses batches is carried over."""
        held: list[list[np.ndarray]] = []
        for batch in batches:
            keys = batch.column("bucket").to_numpy(zero_copy_only=False)
            if not keys.size:
                continue
            columns = [keys, *(batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names)]
            last = int(np.searchsorted(keys, keys[-1]))
            if last or held and held[-1][0][-1] != keys[-1]:
                whole = [np.concatenate(c) for c in zip(*held, [c[:last] for c in columns])]
                yield within(whole[0], whole[1:])
                held = []
            held.append([c[last:] for c in columns])
        if held:
            whole = [np.concatenate(c) for c in zip(*held)]
            yield within(whole[0], whole[1:])

    return run


def _node(prefix: str, check: bool) -> Column:
    """Identity of a fingerprint in the links: itself, or the hash of both fingerprints."""
    return F.xxhash64(prefix + "fp", prefix + "ck") if check else F.col(prefix + "fp")


def links(fingerprints: DataFrame, radius: int = RADIUS, check: bool = False) -> DataFrame:
    """fingerprints: (fp) or (fp, ck), distinct. Gives links (u, v) whose components are those of all pairs within the radius."""
    tables = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m))) for i, m in enumerate(masks(radius))])
    names = ["fp", "ck"] if check else ["fp"]
    dealt = fingerprints.select(*names, F.explode(tables).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "fp")
    found = dealt.mapInArrow(_bucket_links(radius, check), ", ".join(f"{side}{n} long" for side in "uv" for n in names))
    return found.select(_node("u", check).alias("u"), _node("v", check).alias("v")).distinct()


def _fingerprints(check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            kinds = [(SHINGLE, SEED), (CHECK_SHINGLE, CHECK_SEED)][:2 if check else 1]
            found = [np.frombuffer(b"".join(fingerprint(t, *k) for t in texts), ">u8").astype(np.uint64).view(np.int64) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, found)], names=["id", "fp", "ck"][:1 + len(kinds)])

    return run


def shingles(text: bytes | None, shingle: int = CHECK_SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; words as in `fingerprint`, a shorter text is one shingle."""
    words = (text or b"").lower().split()
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)] if words else [])
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, joined, repeat(CHECK_SEED))), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """The keys of a set's minimum hashes, none for an empty set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, hashes.size, 1 << 12):
        least = np.minimum(least, ((hashes[None, at:at + (1 << 12)] ^ _TURN) * _TIMES).min(axis=1))
    keys = [xxhash.xxh64_digest(row.tobytes(), seed=i) for i, row in enumerate(least.reshape(BANDS, ROWS))] if hashes.size else []
    return np.frombuffer(b"".join(keys), np.int64).tolist()


def similar_forest(sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Places of linked sets (from, to): all pairs of at least that Jaccard similarity are joined, at most one link into each."""
    out, rest = [], np.arange(len(sets))
    size = np.array([len(x) for x in sets])
    places = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    mark = np.zeros(int(max(p.max() for p in places)) + 1, np.int32)
    laid: np.ndarray | None = None
    while rest.size > 1:
        queue, rest, laid = [rest[0]], rest[1:], None
        while queue and rest.size:
            x = queue.pop()
            if laid is None:
                laid, starts = np.concatenate([places[i] for i in rest]), np.r_[0, np.cumsum(size[rest])[:-1]]
            mark[places[x]] = 1
            common = np.add.reduceat(mark[laid], starts)
            mark[places[x]] = 0
            near = common / (size[x] + size[rest] - common) >= similar
            if near.any():
                found, rest, laid = rest[near], rest[~near], None
                out += [(int(x), int(y)) for y in found]
                queue.extend(found)
    return out


def _with_sets(check: bool):
    prints = _fingerprints(check)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sizes, keys = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                hashes = shingles(text)
                sids.append(int.from_bytes(xxhash.xxh64_digest(hashes.tobytes()), "big", signed=True))
                sizes.append(hashes.size)
                keys.append(bands(hashes))
            for found in prints(iter([batch])):
                yield pa.RecordBatch.from_arrays([*found.columns, batch.column("key"), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                                                 names=[*found.schema.names, "key", "sid", "size", "bands"])

    return run


def _group_links(similar: float):
    def within(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        roots = [r for r, _ in rows]
        ends = [(roots[a], roots[b]) for a, b in similar_forest([shingles(t) for _, t in rows], similar)] if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in range(2)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group."""
        held, group = [], None
        for batch in batches:
            for g, root, text in zip(batch.column("group").to_pylist(), batch.column("root").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if g != group and held:
                    yield within(held)
                    held = []
                group = g
                held.append((root, text))
        if held:
            yield within(held)

    return run


def _star_links(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by star and chunk, its centre first; every other row is held against the centre alone."""
        star, centre, centre_root = None, None, None
        for batch in batches:
            u, v = [], []
            stars = zip(batch.column("star").to_pylist(), batch.column("chunk").to_pylist())
            for name, far, root, text in zip(stars, *(batch.column(c).to_pylist() for c in ("far", "root")), batch.column("text").cast(pa.binary()).to_pylist()):
                hashes = shingles(text)
                if not far:
                    star, centre, centre_root = name, hashes, root
                elif name == star and min(hashes.size, centre.size) >= similar * max(hashes.size, centre.size):
                    few, many = (hashes, centre) if hashes.size < centre.size else (centre, hashes)
                    at = np.minimum(np.searchsorted(many, few), many.size - 1)
                    common = int((many[at] == few).sum()) if many.size else 0
                    if common >= similar * (few.size + many.size - common):
                        u.append(centre_root)
                        v.append(root)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _marked(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = handle.value
        for batch in batches:
            place = batch.column("place").to_numpy(zero_copy_only=False) - 1
            found = batch.filter(pa.array((marks[place >> 3] >> (place & 7)) & 1 == 1)).select(["key", "text"])
            # Copies within a batch go out once.
            first = {k: i for i, k in reversed(list(enumerate(found.column("key").to_pylist())))}
            yield found.take(pa.array(sorted(first.values()), pa.int64()))

    return run


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MARKS)) + 1


def _with_texts(docs: DataFrame, wanted: DataFrame, text_column: str) -> DataFrame:
    """wanted rows, each with the text of its `key`. Only texts that may be wanted are moved, each once."""
    spark = docs.sparkSession
    parts = wanted.select(_place("key").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()  # 4,096 rows at most
    marks = np.zeros(MARKS >> 3, np.uint8)
    for r in parts:
        marks[(r["b"] - 1) << 12:r["b"] << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    texts = docs.select(digest(F.col(text_column)).alias("key"), F.col(text_column).alias("text")).withColumn("place", _place("key"))
    texts = texts.mapInArrow(_marked(spark.sparkContext.broadcast(marks)), "key binary, text string").dropDuplicates(["key"])
    return wanted.join(texts, "key")


def _joined(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with the roots that the links (u, v) between their roots give."""
    links = stage(found.distinct(), "similar-links")
    if links.isEmpty():
        discard(links)
        return nodes
    stars = components(links)
    joined = stars.select(F.col("node").alias("root"), F.col("root").alias("__root"))
    out = stage(nodes.join(joined, "root", "left").withColumn("root", F.coalesce("__root", "root")).drop("__root"), "similar-nodes")
    discard(links, nodes, stars)
    return out


def _similar_roots(docs: DataFrame, nodes: DataFrame, similar: float, text_column: str) -> DataFrame:
    """nodes: (node, key, bands, root), one row per fingerprint and set of shingles, key the digest of one of its texts. Gives them with the roots of joined components.

    Every bucket that spans several components is a star first: its least node is its centre, and the others are held against that one. A node's text goes
    to a centre once, however many buckets they share, and a star of any size is split, the centre going along. Buckets that still span several
    components, whose texts are less alike, are then compared as groups.
    """
    for first, count in ((1, FIRST), (FIRST + 1, BANDS - FIRST)):
        dealt = nodes.select("node", "root", "size", F.explode(F.slice("bands", first, count)).alias("bucket"))
        spans = dealt.groupBy("bucket").agg(F.min(F.struct("node", "root", "size")).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
        pairs = dealt.join(spans.select("bucket", F.col("c.node").alias("star"), F.col("c.root").alias("centre"), F.col("c.size").alias("most")), "bucket").where("root != centre")
        pairs = pairs.where(F.least("size", "most") >= (similar - 1e-9) * F.greatest("size", "most"))
        pairs = stage(pairs.select("star", "centre", "node", "root").distinct(), "similar-pairs")
        sizes = pairs.groupBy("star", "centre").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("chunks"))
        far = pairs.join(sizes, ["star", "centre"]).select("star", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), F.lit(True).alias("far"), "node", "root")
        near = sizes.select("star", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("far"), F.col("star").alias("node"), F.col("centre").alias("root"))
        members = stage(far.unionByName(near).join(nodes.select("node", "key"), "node"), "similar-members")
        if not members.isEmpty():
            rows = _with_texts(docs, members, text_column).select("star", "chunk", "far", "root", "text")
            rows = rows.repartition("star", "chunk").sortWithinPartitions("star", "chunk", "far")
            nodes = _joined(nodes, rows.mapInArrow(_star_links(similar), "u long, v long"))
        discard(pairs, members)
    dealt = nodes.select("node", "root", "size", F.explode("bands").alias("bucket"))
    spans = dealt.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    # Sets that are alike enough are so in size: they share one of two neighbouring classes. A bucket of two has been compared, as a star.
    size_class = F.floor(F.log("size") / math.log(1.0001 / similar))
    dealt = dealt.join(spans.where("low != high and n > 2").select("bucket"), "bucket")
    dealt = dealt.select("node", "root", F.explode(F.array(F.xxhash64("bucket", size_class), F.xxhash64("bucket", size_class + 1))).alias("bucket"))
    spans = dealt.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"),
                                        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s"))
    # Buckets of the same members are compared once.
    spans = spans.where("low != high").select("bucket", F.xxhash64("n", "x", "s").alias("group"))
    members = dealt.join(spans, "bucket").select("group", "node", "root").distinct().join(nodes.select("node", "key"), "node")
    members = stage(members, "similar-members")
    if not members.isEmpty():
        groups = _with_texts(docs, members, text_column).select("group", "root", "text").repartition("group").sortWithinPartitions("group")
        nodes = _joined(nodes, groups.mapInArrow(_group_links(similar), "u long, v long"))
    discard(members)
    return nodes


def near_duplicates(docs: DataFrame, radius: int = RADIUS, check: bool = False, id_column: str = "doc_id", text_column: str = "text",
                    similar: float | None = None) -> DataFrame:
    """(id, fingerprint, component_id), one row per input row; component_id is the least id that links can reach.

    With `check` linked texts must also be near in the second fingerprint. With `similar` texts link as well if the Jaccard similarity of
    their five-word shingles reaches it, however far their fingerprints are apart. Null, empty and blank texts have fingerprint zero and link like
    any other. Repeated rows share a component. Null ids keep their rows; a component of null ids only has a null component_id. An
    empty table gives no rows; other columns are not read.
    """
    names = ["fp", "ck"] if check else ["fp"]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    if similar is not None:
        rows = rows.withColumn("key", digest(F.col("text")))
    schema = ", ".join([f"id {kind}", *(f"{n} long" for n in names)])
    if similar is None:
        rows = stage(rows.mapInArrow(_fingerprints(check), schema), "simhash-rows")
        nodes = rows.groupBy(*names).agg(F.min("id").alias("least"))
    else:
        names = [*names, "sid"]
        rows = stage(rows.mapInArrow(_with_sets(check), schema + ", key binary, sid long, size int, bands array<long>"), "simhash-rows")
        nodes = rows.groupBy(*names).agg(F.min("id").alias("least"), F.min("key").alias("key"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    prints = stage(nodes.withColumn("node", _node("", check)), "simhash-nodes")
    distinct = prints.select(*(n for n in names if n != "sid"))
    stars = components(links(distinct if similar is None else distinct.distinct(), radius, check))
    nodes = prints.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if similar is not None:
        nodes = stage(nodes.withColumn("node", F.xxhash64(*names)), "simhash-roots")
        discard(prints, stars)
        nodes = _similar_roots(docs, nodes, similar, text_column)
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stage(nodes.join(least, "root").select(*names, "component_id"), "simhash-components")
    discard(nodes, prints, stars)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return resting_on(rows.join(found, names).select(F.col("id").alias(id_column), hexed.alias("fingerprint"), "component_id"), rows, found)
