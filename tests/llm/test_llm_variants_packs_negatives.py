"""Spelling variants, histogram packing and hard negatives against plain loops, and on odd rows."""

import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives, queries, sequences, variants

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "a", "Naïveté naïveté", "x" * 5000 + " " + "y" * 30, "word\tword\nword", "日本語 text", "égalité", "<|endoftext|> It'S"]


def plain_variants(rows, min_count=2):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= min_count}
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in n:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda o: (-n[o], o))
            if n[best] >= 10 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def found(df):
    return {tuple(r) for r in df.collect()}


def test_variants_of_the_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = queries.op11_spelling_variants(spark, FOLDER).collect()
    assert len(got) == len({r.word for r in got})
    assert {tuple(r) for r in got} == plain_variants(docs.select("doc_id", "text").collect())


def test_variants_send_no_table_to_the_driver(spark, monkeypatch):
    """Tables that grow with the vocabulary are joined by sorting, also where Spark sizes them below its broadcast limit."""
    plans, stage = [], variants.stage

    def planned(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(variants, "stage", planned)
    out = queries.op11_spelling_variants(spark, FOLDER)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 6 and not [p for p in plans if "Broadcast" in p]


def test_variants_of_random_and_long_words(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 12))) for _ in range(400)]
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    words += [long, long[:1000] + "z" + long[1001:], long[:2000] + long[2001:], "q" + long, "aaaaaaaaaaaa", "aaaaaaaaaaa"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + " " + words[-6 + i % 6]) for i in range(120)]
    rows += [(None, " ".join(words[:20] * 30)), (5, rows[5][1]), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("x"))
    assert found(variants.variants(docs)) == plain_variants(rows)


def test_chains_lead_to_their_root(spark):
    rows = [(i, f"w{i}"[:1] + chr(97 + i), ) for i in range(12)]
    forms = spark.createDataFrame([(r[1], rows[i + 1][1] if i + 1 < len(rows) else None) for i, r in enumerate(rows)], "word string, form string")
    assert found(variants.roots(forms)) == {(r[1], rows[-1][1]) for r in rows}


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("row", F.lit("clash"))
    assert found(variants.variants(docs, min_count=1)) == plain_variants(rows, 1)
    assert variants.variants(docs.limit(0)).count() == 0
    assert sequences.pack(docs.limit(0)).count() == 0
    check_packing(docs, sequences.pack(docs), 4096)
    check_packing(docs, sequences.pack(docs, limit=64), 64)


def check_packing(docs, packed, limit):
    """Every id of every row in one piece; sequences gapless, at most `limit` long and without padding."""
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = sequences.tokenizer(sequences.VOCABULARY).encode(r.text or "", add_special_tokens=False).ids + [sequences.END_ID]
        want.update((r.doc_id, i, len(ids), x) for i, x in enumerate(ids))
    rows = packed.collect()
    by_place = defaultdict(list)
    for r in rows:
        by_place[r.sequence_id].append(r)
    for own in by_place.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limit and (at == limit or at & (at - 1) == 0)
    ids = {}
    for (ident, i, n, x), times in want.items():
        ids.setdefault((ident, n), [None] * n)[i] = x
    seen = Counter()
    for r in rows:
        data = np.array([x for x in ids[r.doc_id, r.doc_tokens][r.start:r.start + r.length]], np.uint32).tobytes()
        assert zlib.crc32(data) == r.ids_crc32
        for i in range(r.start, r.start + r.length):
            seen[r.doc_id, i, r.doc_tokens] += 1
    rest = Counter()
    for (ident, i, n, _), times in want.items():
        rest[ident, i, n] += times
    assert seen == rest


def test_packing_of_the_table(spark):
    packed = queries.op12_histogram_packing(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    check_packing(docs, packed, 4096)
    # Few documents that would fit whole are cut.
    cut = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.first("doc_tokens").alias("n")).where("pieces > ceil(n / 4096)").count()
    assert cut <= 0.1 * docs.count() + 12


def test_ids_are_the_library_s(spark):
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x301, 0x3A3, 0x130, 0x212A, 0x17F, 0x4E00, 0x1F600]] + ["'S", "'ll", "<|endoftext|>", " ", "\n", "don't"] * 9
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(3000)] + [None, "", "A" * 3000, unicodedata.normalize("NFD", "Ärger é")]
    assert sequences.token_ids(texts) == sequences._library_ids([t or "" for t in texts], sequences.VOCABULARY)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_the_histogram(seed):
    rng = random.Random(seed)
    for _ in range(50):
        limit = rng.choice([16, 256, 4096])
        histogram = {rng.randrange(1, limit): rng.randrange(1, 10 ** rng.randrange(1, 7)) for _ in range(rng.randrange(1, 40))}
        packs, seen = sequences.patterns(histogram, limit), Counter()
        for p in packs:
            assert p.room >= 0 and p.room + sum(n * t for n, t in p.runs) == limit
            for n, t in p.runs:
                seen[n] += t * p.count
        assert seen == histogram
        plan = sequences.plan(histogram, limit)
        assert len(packs) <= limit and len(plan.key) <= sum(len(p.runs) for p in packs) + max(len(p.runs) for p in packs)


def test_shortest_pack_comes_first():
    # The 4 goes to the 6, the emptier pack, although it would close the other one.
    packs = sequences.patterns({12: 1, 6: 1, 4: 1}, 16)
    assert sorted((p.room, p.runs) for p in packs) == [(4, ((12, 1),)), (6, ((6, 1), (4, 1)))]


def plain_negatives(rows):
    rows = [(i, l, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, l, v in rows]
    out = set()
    for i, l, v in rows:
        if i % 100 == 0:
            scored = sorted(((int(v @ w), j, m) for j, m, w in rows if j != i and len(w) == len(v)), key=lambda x: (-x[0], x[1]))
            for ps, p, _ in [x for x in scored if x[2] == l][:5]:
                fit = [(s, j) for s, j, m in scored if m != l and 30 * ps <= 100 * s <= 90 * ps][:10]
                out |= {(i, p, k + 1, j, ps, s) for k, (s, j) in enumerate(fit)}
    return out


@pytest.mark.parametrize("size", [1, 3, 64, 100])
def test_negatives_of_random_vectors(spark, size):
    rng = np.random.default_rng(size)
    centres = rng.standard_normal((6, size))
    rows = []
    for i in range(900):
        c = int(rng.integers(6))
        v = centres[c] + rng.standard_normal(size) * rng.choice([0.1, 1.0])
        rows.append((i * 10, c % 3, [float(x) for x in v]))
    rows += [(10_000 + i * 50, i % 3, rows[0][2]) for i in range(200)]  # many equal vectors: ties go by id
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>").repartition(5)
    assert found(negatives.mine(df, block=40)) == plain_negatives(rows)


def test_intervals_hold_the_scores():
    rng = np.random.default_rng(1)
    for size in (1, 7, 64, 130):
        ints = rng.integers(-300, 300, (500, size)).astype(np.int32)
        ints[3] = 0
        a = negatives.Anchors(list(range(20)), [0] * 20, ints[:20])
        low, high = a.intervals(*negatives.encode(ints))
        exact = ints[:20].astype(np.int64) @ ints.T.astype(np.int64)
        assert (low <= exact).all() and (exact <= high).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, i % 2, [float(i % 7), 1.0, float(i % 3)]) for i in range(0, 400, 20)]
    odd = [(1, 0, None), (2, 0, [1.0, None, 2.0]), (3, None, [1.0, 1.0, 1.0]), (4, 0, [nan, 1.0, 1.0]), (5, 0, [inf, 1.0, 1.0]), (None, 0, [1.0, 1.0, 1.0]),
           (6, 0, []), (8, 1, [1e30, 0.0, 0.0])]
    other = [(500, 0, [1.0, 2.0]), (501, 0, [1.0, 1.5]), (502, 1, [0.5, 1.0])]
    df = spark.createDataFrame(good + odd + other + [good[0], good[3]], "id long, label int, vector array<double>").withColumn("size", F.lit("clash"))
    got = found(negatives.mine(df))
    assert got == plain_negatives(good + other)
    assert any(r[0] == 500 for r in got)
    assert negatives.mine(df.limit(0)).count() == 0
    assert negatives.mine(df.where("id in (1, 2)")).count() == 0
