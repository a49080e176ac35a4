"""The corpus queries against plain loops, exact round trips, SQL or held-out accuracy on the smallest tables."""

import hashlib
import heapq
import itertools
import math
import random
import re
import time
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from tidemark.llm import decontaminate, fingerprints, langid, licences, main_text, packing, queries, secrets, shards, simhash, url_filter

FOLDER = "/root/testdata/sf0.001"


def rows(table, columns):
    return duckdb.sql(f"select {columns} from '{FOLDER}/{table}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return dict(rows("documents", "doc_id, text"))


def test_fingerprints(spark, texts):
    got = queries.op1_document_fingerprints(spark, FOLDER).toPandas()
    order = sorted(texts, reverse=True)
    paragraphs = lambda t: Counter(re.findall(r"[^\n]{1,512}", t))

    def like(a, b):
        a, b = paragraphs(a), paragraphs(b)
        whole = sum((a | b).values())
        return sum((a & b).values()) / whole if whole else 1.0

    for r in got.itertuples():
        text, follower = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(text) // 2
        edited = text[:len(text) - half] + follower[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(text, edited)) and r.near_next == pytest.approx(like(text, follower))


def test_order_holds_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PER_BUCKET", 8)
    ids = [7 * i * i % 1009 for i in range(200)] + [5, 5]
    got = fingerprints.with_next(spark.createDataFrame([(i, f"t{i}-{n}") for n, i in enumerate(ids)], "id long, text string")).toPandas()
    want = sorted(((i, f"t{i}-{n}") for n, i in enumerate(ids)), key=lambda r: (-r[0], r[1]))
    follow = {a[1]: b[1] for a, b in zip(want, want[1:] + want[:1])}
    assert len(got) == len(ids) and all(follow[r.text] == r.next_text for r in got.itertuples())


def test_larger_sketches_recover_large_differences(spark):
    a, b = "\n".join(f"left {i}" for i in range(600)), "\n".join(f"right {i}" for i in range(500)) + "\n" + "\n".join(f"left {i}" for i in range(100))
    df = spark.createDataFrame([(a, b), (a, a), ("x\nx\nx", "x"), ("", "")], "a string, b string")
    df = df.select(fingerprints.keys(df.a).alias("ka"), fingerprints.keys(df.b).alias("kb")).select("*", fingerprints.sketch("ka").alias("ca"), fingerprints.sketch("kb").alias("cb"))
    got = [r[0] for r in df.select(fingerprints.likeness("ka", "ca", "kb", "cb")).collect()]
    assert got == pytest.approx([100 / 1100, 1.0, 1 / 3, 1.0])


def test_url_filter(spark):
    got = queries.op2_url_filter(spark, FOLDER).toPandas().set_index("page_id")
    pages = rows("pages", "page_id, url")
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    rules = queries.ALLOW + queries.BLOCK
    labels = {}
    for ident, url in pages:
        rest = (url or "").partition("://")[2]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]):])[0]
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        rule = max(fits, key=len, default=None)
        assert (got.host[ident], got.path[ident], got.rule[ident]) == (host, path, rule)
        labels[ident] = rule and ("allow" if rule in queries.ALLOW else "block")
        assert rule is None or got.verdict[ident] == labels[ident]
    folds = dict(spark.createDataFrame([(u,) for _, u in pages], "url string").selectExpr("url", "pmod(xxhash64(url), 5)").collect())
    grams = lambda u: [("\2" * 4 + lower(u) + "\3")[i:i + 5] for i in range(len(u) + 1)]
    counts = {c: [Counter() for _ in range(6)] for c in ("allow", "block")}
    for ident, url in pages:
        if labels[ident] and folds[url]:
            for g in grams(url):
                for k in range(1, 6):
                    counts[labels[ident]][k][g[5 - k:]] += 1
    v = len({g[-1] for _, u in pages for g in grams(u)}) + 1

    def p(c, gram):
        if not gram:
            return 1 / v
        seen = {g: n for g, n in counts[c][len(gram)].items() if g[:-1] == gram[:-1]}
        n, t = sum(seen.values()), len(seen)
        return (seen.get(gram, 0) + t * p(c, gram[1:])) / (n + t) if n + t else p(c, gram[1:])

    score = {i: np.mean([math.log(p("allow", g) / p("block", g)) for g in grams(u)]) for i, u in pages[:60]}
    shift = {i: score[i] - got.score[i] for i in score}
    assert max(shift.values()) - min(shift.values()) < 1e-9  # they differ by the threshold alone
    assert all(got.verdict[i] == ("allow" if got.score[i] >= 0 else "block") for i in got.index if labels[i] is None)
    good = [got.score[i] for i in got.index if labels[i] == "allow"]
    bad = [got.score[i] for i in got.index if labels[i] == "block"]
    assert np.mean(good) > np.mean(bad)


def test_licences_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    want = con.execute(queries.ORACLES["op3_licence_scan"]).fetchall()
    got = [tuple(r) for r in queries.op3_licence_scan(spark, FOLDER).select("doc_id", "line", "licence", "dice").collect()]
    assert sorted(got) == sorted(want) and got


def test_licence_variants(spark):
    texts = ["Some prose.\nlicensed under the APACHE license version 2.0", "Permission is hereby granted free of charge to any person\nobtaining a copy of this software and associated documentation files",
             "the the the", "Released under the license of nobody at all, not MIT"]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line, r.licence) for r in got} == {(0, 1, "Apache-2.0"), (0, -1, "Apache-2.0"), (1, -1, "MIT")}


def test_packing_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = queries.op4_best_fit_packing(spark, FOLDER).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(got.doc_id) == set(texts)
    for ident, g in got.groupby("doc_id"):
        ids = tokenizer.encode(texts[ident], add_special_tokens=False).ids + [0]
        g = g.sort_values("piece")
        assert g.piece.tolist() == list(range(len(g))) and g.length.sum() == len(ids) and (g.length[1:] == 2048).all() and g.start.tolist() == [0, *g.length.cumsum()[:-1]]
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(array("I", ids[r.start:r.start + r.length]).tobytes())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 2048) + 1


def test_token_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", " ", "\n\n  x", "it's we'll I'd 'S", "a\u00a0b\u2003c", "½ ² Ⅷ ١٢", "\U0001f600\u200d", "e\u0301 ß İ", "tab\t\tend  ", "<|endoftext|> end", "a" * 500, " \r\n \x0b x\x85y"]
    for text in odd:
        assert packing.token_ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0]


def test_genetic_steps_keep_every_item():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 300)
    pool = packing.evolve(sizes, [], 100, seed=3, generations=6)
    for own in pool:
        assert len(own) == 300 and (own >= 0).all() and np.bincount(own, weights=sizes).max() <= 100
    first = packing.best_fit(np.full(300, -1), sizes, np.argsort(-sizes, kind="stable"), 100)
    assert packing.fitness(pool[0], sizes, 100) <= packing.fitness(first, sizes, 100)
    child = packing.crossover(pool[0], pool[1], sizes, 100, rng)
    assert (child >= 0).all() and np.bincount(child, weights=sizes).max() <= 100


def test_secret_spans(spark, texts):
    got = queries.op5_secret_scan(spark, FOLDER).toPandas().set_index("doc_id")
    patterns = [("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
                ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]
    least = {"assign": 12, "access": 18, "hex": 16}
    for ident, text in texts.items():
        spans = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(patterns) for m in p.finditer(text) if len(m[2] if kind == "assign" else m[0]) >= least[kind]]
        base = [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(spans)]
        assert got.base_sha256[ident] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[f"n_{kind}"][ident] for kind, _ in patterns] == [sum(s[2] == kind for s in spans) for kind, _ in patterns]
        assert set(base) <= set(got.spans[ident].split(",")) | {""} and [s for s in got.spans[ident].split(",") if not s.startswith("token") and s] == base


def test_ownership_separates_copied_examples(spark):
    shared, own = "Zx9Qw7Er5Ty3Ui1Op0As2Df4Gh6", "Lk8Jh6Gf4Ds2Aq1Wz3Ex5Cr7Vt9"
    docs = spark.createDataFrame([(i, f"key {shared} end {i}", "en", f"owner{i}") for i in range(5)] + [(9, f"mine {own} and {shared}\nassign: password=hunter2hunter2", "en", "owner9")],
                                 "doc_id long, text string, lang string, source string")
    got = secrets.find(docs).toPandas().set_index("doc_id")
    assert (got.spans.drop(9) == "").all() and (got.n_shared == 1).all()
    assert got.spans[9] == "token:5:32,assign:73:96" and got.n_live[9] == 2
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[0] == f"key {shared} end 0" and clean[9] == f"mine [secret] and {shared}\nassign: [secret]"


def test_copies_of_one_text_have_one_owner(spark):
    own = "Lk8Jh6Gf4Ds2Aq1Wz3Ex5Cr7Vt9"
    docs = spark.createDataFrame([(i, f"key {own} password=hunter2hunter2", lang, f"owner{i}") for i, lang in enumerate(["en", "de", "fr", "es"])], "doc_id long, text string, lang string, source string")
    assert all(r.n_live == 2 and r.n_shared == 0 and r.spans == "token:4:31,assign:32:55" for r in secrets.find(docs).collect())
    assert {r.text for r in secrets.redact(docs).collect()} == {"key [secret] [secret]"}


def test_every_owner_of_a_copied_text_counts(spark):
    """Copies add owners: whose copy a text counts for is the best choice, not the least name; a few texts copied by many still look live."""
    keys = ["Zx9Qw7Er5Ty3Ui1Op0As2Df4Gh6", "Lk8Jh6Gf4Ds2Aq1Wz3Ex5Cr7Vt9", "Mn7Bv5Cx3Zl1Kj9Hg8Fd6Sa4Qw2"]
    held = [[("t0", "a"), ("t0", "b"), ("t0", "c"), ("t1", "a"), ("t1", "b"), ("t2", "a")], [("t0", "a"), ("t0", "b"), ("t0", "c"), ("t1", "a"), ("t2", "a")], [("t0", "abcde"[i % 5]) for i in range(9)] + [("t1", "e")]]
    rows = [(k, f"{keys[k]} in {text}", "en", owner) for k, pairs in enumerate(held) for text, owner in pairs]
    got = secrets.find(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {(r.doc_id, r.n_live, r.n_shared, r.found[0].owners, r.found[0].repositories) for r in got} == {(0, 0, 1, 3, 3), (1, 1, 0, 3, 3), (2, 1, 0, 5, 5)}


def test_spread_of_values_against_all_choices(spark):
    rng = random.Random(5)
    rows = {(value, b"%d" % rng.randrange(value % 5 + 2), f"o{rng.randrange(value % 7 + 1)}") for value in range(150) for _ in range(rng.randrange(1, 25))}
    held = spark.createDataFrame([(str(v), t, o) for v, t, o in rows], "value string, text_key binary, owner string")
    for enough in (1, 2, 3, 4):
        # Koenig: there are so many pairs apart unless fewer texts and owners together cover all.
        apart = set()
        for value in range(150):
            pairs = [(t, o) for v, t, o in rows if v == value]
            ends = {("t", t) for t, _ in pairs} | {("o", o) for _, o in pairs}
            if pairs and not any(all(("t", t) in cover or ("o", o) in cover for t, o in pairs) for size in range(enough) for cover in itertools.combinations(ends, size)):
                apart.add(str(value))
        assert {r.value for r in secrets.spread(held, "owner", enough).collect()} == apart


def test_many_spans_in_linear_time():
    text = "".join(f"{i:016x} Lk8Jh6Gf4Ds2Aq1Wz3Ex5Cr7V{i:05d} " for i in range(40_000))
    began = time.time()
    base = secrets.base_spans(text)
    assert len(base) == 40_000 and len(secrets.token_spans(text, base)) == 40_000 and time.time() - began < 20
    inside = "password=Lk8Jh6Gf4Ds2Aq1Wz3Ex5Cr7Vt90"
    assert secrets.token_spans(inside, secrets.base_spans(inside)) == []


def test_leaks(spark, texts):
    got = {(r.doc_id, r.item_id) for r in queries.op6_benchmark_leaks(spark, FOLDER).collect()}
    flat = lambda t: f" {' '.join(decontaminate.words(t))} "
    items = rows("benchmark", "item_id, text")
    assert got == {(d, i) for d, t in texts.items() for i, x in items if flat(x) in flat(t)} and got


def test_paraphrased_leaks_and_answers(spark, texts):
    items = dict(rows("benchmark", "item_id, text"))
    item = max(items.values(), key=lambda t: len(decontaminate.words(t)))
    w = decontaminate.words(item)
    host = decontaminate.words(texts[min(texts)])[:300]
    swapped = [x if i % 4 else "otherword" for i, x in enumerate(w)]
    keeps = [*swapped[:-8], *w[-8:]]  # a quarter changed, the answer kept
    loses = [*swapped[:-12], *["nothing"] * 12]
    docs = [(1, " ".join([*host[:150], *keeps, *host[150:]])), (2, " ".join([*host[:150], *loses, *host[150:]])), (3, " ".join(host)), (4, item.upper()), (5, " ".join(reversed(w)))]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (1, 8), (4, 7), (4, 8)}


def test_candidates_reach_items_with_two_in_five_words_changed(spark, texts):
    rng = np.random.default_rng(8)
    block = decontaminate.block_of(rows("benchmark", "item_id, text"))
    index = spark.createDataFrame([(np.array([block.vocabulary.get(w, -1) for w in decontaminate.words(t)], "<i2").tobytes(),) for t in texts.values()], "terms binary")
    decontaminate.fit(index, block)
    other = np.array([block.vocabulary.get(w, -1) for t in texts.values() for w in decontaminate.words(t)])
    found = []
    for width, stride, least, members in decontaminate.length_classes(block):
        for i in members:
            item = block.terms[i].copy()
            at = rng.choice(len(item), int(0.4 * len(item)), replace=False)
            item[at] = rng.choice(other, len(at))
            sequence = np.concatenate([rng.choice(other, 60), item, rng.choice(other, 60)])
            windows = [sequence[s:s + width] for s in range(0, len(sequence) - width + 1, stride)]
            z = np.array([block.weighted[w[w >= 0]].sum(axis=0) for w in windows])
            found.append(((z @ block.vectors[i]) / np.maximum(np.linalg.norm(z, axis=1), 1e-12)).max() >= decontaminate.COSINE)
    assert np.mean(found) >= 0.95


def test_full_block_loses_no_item(spark):
    rng = np.random.default_rng(12)
    every = np.array([f"w{i}" for i in (6000 * rng.random(40_000) ** 2).astype(int)])
    draw = lambda n: [str(x) for x in rng.choice(every, n)]
    items = [draw(int(n)) for n in rng.integers(20, 60, decontaminate.ITEMS)]
    docs = []
    for i, item in enumerate(items):
        share = (0.0, 0.2, 0.4)[i % 3]
        at = rng.choice(len(item) - max(3, math.ceil(len(item) / 5)), int(share * len(item)), replace=False)
        changed = [f"other{k}" if k in set(at.tolist()) else x for k, x in enumerate(item)]  # the answer stays
        docs.append((i, " ".join([*draw(40), *changed, *draw(40)])))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    assert {(i, i) for i in range(len(items))} <= {(r.doc_id, r.item_id) for r in got}


def test_common_words_is_the_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 8, rng.integers(0, 40))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_words(decontaminate._places(a), len(a), b.tolist()) == table[-1, -1]


def test_sketched_eigenvectors_span_the_leading_space():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    c = q @ np.diag(np.r_[np.linspace(10, 5, 8), np.full(52, 1e-3)]) @ q.T
    test = rng.normal(size=(60, 16))
    u = decontaminate.leading(c @ test, test, 8)
    assert np.linalg.svd(u.T @ q[:, :8])[1].min() > 0.999


def test_main_text_of_supplied_pages(spark):
    got = {r.page_id: r.text for r in queries.op7_main_text(spark, FOLDER).collect()}
    import html

    for ident, page in rows("pages", "page_id, html"):
        article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[ident] == "\n\n".join(p for p in parts if p)


def test_main_text_of_other_layouts():
    words = "This sentence, which is long enough, carries the story onwards, and on it goes. " * 3
    clean = " ".join(words.split())
    page = f"""<body><div id=cookie-notice><p>We use cookies, many cookies, {words}</p></div><header><h1>Site</h1></header>
    <ul class="menu"><li><a href=x>Home</a></ul><div class=wrap><div class="post-body"><h2>Title &amp; more</h2><p>{words}<p>Second&nbsp;one, <a href=y>linked</a>
    text.<div>{words}</div><blockquote>Said</blockquote><form><p>Mail me, please, now</p></form></div><div class="sidebar"><p>{words}</p></div>
    <section id="comments"><article class="comment"><p>{words}</p></article></section></div><footer>&copy; x</footer>"""
    assert main_text.main_text(page) == "\n\n".join(["Title & more", clean, "Second one, linked text.", clean, "Said"])
    assert main_text.main_text("<p>a<br>b<i>c</i>d<!-- x --></p><script>p('</p>')</script><p>e&lt;f") == "a bcd\n\ne<f"
    assert main_text.main_text("<article><section><h1>T</h1><p>x</p></section><section><p>Short.</p></section></article><aside><p>" + words + "</p></aside>") == "T\n\nx\n\nShort."


def test_shards(spark, texts):
    got = queries.op8_byte_shards(spark, FOLDER).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == len(texts) and sizes.max() - sizes.min() <= 0.01 * sizes.mean()
    where = defaultdict(set)
    for r in got.itertuples():
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        where[data].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_differencing_matches_plain_loop(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 1000, 200)
    heap = [(-int(s), i, [(int(s), [i])] + [(0, [])] * 3) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda p: -p[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], n, parts))
        n += 1
    loads = np.zeros((200, 4), np.int64)
    loads[:, 0] = sizes
    joint = shards.difference(loads)[:, 0]
    assert [int(sizes[joint == k].sum()) for k in range(4)] == [p[0] for p in heap[0][2]]
    monkeypatch.setattr(shards, "BLOCK", 10)  # several levels
    texts = ["x" * int(s) for s in np.unique(sizes)]
    got = shards.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    totals = got.groupby("shard")["size"].sum()
    assert len(got) == len(texts) and totals.max() - totals.min() < 1000


def test_simhash_groups(spark, texts):
    got = queries.op9_simhash_groups(spark, FOLDER).toPandas().set_index("doc_id")

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: plain(t) for i, t in texts.items()}
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(prints)
    for k, a in enumerate(order):
        for b in order[k + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert all(got.fingerprint[i] == f"{prints[i]:016x}" and got.component_id[i] == root(i) for i in order)


def test_masks_cover_the_radius():
    rng = np.random.default_rng(6)
    tables = simhash.masks()
    assert len(tables) == 31
    for _ in range(3000):
        flips = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
        assert any(flips & m == 0 for m in tables)


def test_links_join_chains_and_large_groups(spark):
    rng = np.random.default_rng(7)
    centre = int(rng.integers(0, 2**63))
    near = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (800, 2))}
    chain = [int(rng.integers(0, 2**62))]
    for i in range(12):
        chain.append(chain[-1] ^ (0b1111 << 4 * i))
    values = sorted(near | set(chain) | {int(x) for x in rng.integers(0, 2**63, 500)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    from tidemark.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(df)).collect()}
    a = np.array(values, np.uint64)
    parent = list(range(len(a)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 4) + i + 1:
            x, y = root(i), root(int(j))
            parent[max(x, y)] = min(x, y)
    assert all(got.get(v, v) == values[root(i)] for i, v in enumerate(values))


def test_checked_links_match_all_pairs(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(10_000, texts[min(texts)] + " and one more"), (10_001, "alpha beta gamma delta"), (10_002, "alpha beta gamma delta")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, radius=6, check=True).collect()}
    both = {r.doc_id: (int.from_bytes(simhash.fingerprint(r.text.encode()), "big"), int.from_bytes(simhash.fingerprint(r.text.encode(), 5, 43), "big")) for r in docs.collect()}
    parent = {i: i for i in both}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(both)
    for k, a in enumerate(order):
        for b in order[k + 1:]:
            if (both[a][0] ^ both[b][0]).bit_count() <= 6 and (both[a][1] ^ both[b][1]).bit_count() <= simhash.CHECK_RADIUS:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in order}


def test_pipeline_links_all_pairs_of_similarity_08(spark, texts):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    every = [f"term{i}" for i in range(3000)]
    rows_ = list(texts.items())
    for k in range(60):  # spread edits, so that the fingerprints move far at similarities around 0.8
        base = [str(x) for x in rng.choice(every, 150 + 5 * k)]
        edited = list(base)
        for at in rng.choice(len(base), 1 + len(base) * (k % 6) // 150, replace=False):
            edited[at] = "changed"
        rows_ += [(10_000 + 2 * k, " ".join(base)), (10_001 + 2 * k, " ".join(edited))]
    docs = spark.createDataFrame(rows_, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()}

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {i: grams(t) for i, t in rows_}
    prints = {i: int.from_bytes(simhash.fingerprint(t.encode()), "big") for i, t in rows_}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    wide = 0
    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1:]:
            like = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
            apart = (prints[a] ^ prints[b]).bit_count()
            wide += like >= 0.8 and apart > 4
            if like >= 0.8 or apart <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert wide > 5 and got == {root(i) for i in order}


def test_language_accuracy(spark, texts):
    got = queries.op10_language_id(spark, FOLDER).toPandas()
    truth = dict(rows("documents", "doc_id, lang"))
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and len(got) == len(texts)
    held = got[got.held_out]
    assert np.mean([truth[i] == p for i, p in zip(held.doc_id, held.lang_pred)]) > 0.95 and not got.rejected.any()


def plain_grams(text):
    data = b" " + b" ".join(bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()).split()) + b" "
    found = Counter()
    for n, high in ((2, 0), (3, 1 << 24)):
        for i in range(len(data) - n + 1):
            found[(int.from_bytes(data[i:i + n], "big") | high) * 2654435761 % 2**32 >> 32 - 13] += 1
    return found


def test_language_by_plain_loops(spark):
    docs = [r for r in rows("documents", "doc_id, text, lang") if len(r[1] or "") < 3000][:120]
    train = [(t, lang) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 5]
    df = Counter(g for t, _ in train for g in plain_grams(t))
    idf = {g: np.log((1 + len(train)) / (1 + df[g])) + 0.1 for g in range(8192)}

    def unit(v):
        size = sum(x * x for x in v.values()) ** 0.5
        return {g: x / size for g, x in v.items()} if size else v

    def vector(text):
        return unit({g: c**0.5 * idf[g] for g, c in plain_grams(text).items()})

    def dot(a, b):
        return sum(x * b.get(g, 0.0) for g, x in a.items())

    def mean(vs):
        out = Counter()
        for v in vs:
            for g, x in v.items():
                out[g] += x / len(vs)
        return unit(out)

    centres = []
    for lang in sorted({x for _, x in train}):
        vs = [vector(t) for t in sorted({t for t, x in train if x == lang})]
        starts, near = [0], [dot(v, vs[0]) for v in vs]
        while len(starts) < min(langid.CENTROIDS, len(vs)):
            starts.append(min(range(len(vs)), key=lambda i: near[i]))
            near = [max(a, dot(v, vs[starts[-1]])) for a, v in zip(near, vs)]
        cs = [vs[i] for i in starts]
        for _ in range(langid.ROUNDS):
            own = [max(range(len(cs)), key=lambda j: dot(v, cs[j])) for v in vs]
            cs = [mean([v for v, o in zip(vs, own) if o == j]) if j in own else c for j, c in enumerate(cs)]
        centres += [(lang, c) for c in [*cs, mean(vs)]]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    same = 0
    for i, t, _ in docs:
        scores = [(dot(vector(t), c), lang) for lang, c in centres]
        best = max(s for s, _ in scores)
        assert abs(got[i].score - best) < 2e-3, (i, got[i].score, best)
        same += got[i].lang_pred == max(scores)[1]
    assert same >= len(docs) - 1


def test_unknown_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # enough rows of short lengths for their bounds
    model = langid.fit(docs)
    rng = random.Random(1)
    scripts = {"cyrillic": "абвгдежзийклмнопрстуфхцчшщ", "chinese": "的一是不了人我在有他这中大来上国个到说们", "consonants": "bcdfghjklmnpqrstvwxz", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
    odd = [(k, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n))) for k, letters in scripts.items() for n in (60, 400)]
    out = langid.classify(spark.createDataFrame(odd, "name string, text string"), model).collect()
    assert all(r.rejected for r in out), [(r.name, r.score, r.lang_pred) for r in out if not r.rejected]
    assert langid.classify(docs, model).where("rejected").count() == 0


def test_languages_of_few_texts_stay(spark):
    few = [f"die kleine katze schläft heute {w} auf dem dach" for w in ("nicht", "lange", "wieder", "gern", "tief")]
    docs = [(i, few[i % 5], "de") for i in range(4000)] + [(10_000 + i, f"the small cat {i} sleeps on the roof today", "en") for i in range(400)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), sample=50)
    assert set(model.langs) == {"de", "en"}
    out = langid.classify(spark.createDataFrame([(few[0],), ("the cat sleeps on the roof",)], "text string"), model).collect()
    assert [r.lang_pred for r in out] == ["de", "en"]


def test_pipeline(spark, texts):
    import corpus_pipeline
    from tidemark.session import fresh_path

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = []
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, FOLDER)
        if name != "best-fit packing":
            assert out.columns == docs.columns
        path = fresh_path(spark, "test-pipeline")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs)
    language, near, clean, redacted, packed = kept
    assert language.count() == len(texts)
    survivors = {r.doc_id for r in near.collect()}
    # All pairs: within four bits of the fingerprint, or similar in their five-word shingles.
    known = sorted(texts)
    prints = np.array([int.from_bytes(simhash.fingerprint(texts[i].encode()), "big") for i in known], np.uint64)
    sets = [set(simhash.shingles(texts[i].encode()).tolist()) for i in known]
    up = list(range(len(known)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(known)):
        for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 4).tolist() + [j for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]:
            a, b = sorted((root(i), root(j)))
            up[b] = a
    assert survivors == {known[i] for i in range(len(known)) if up[i] == i}
    bad = {r.doc_id for r in queries.op6_benchmark_leaks(spark, FOLDER).collect()}
    left = {r.doc_id: r.text for r in clean.collect()}
    assert set(left) == survivors - bad
    after = {r.doc_id: r for r in redacted.collect()}
    assert set(after) == set(left) and all(r.n_chars == len(r.text) for r in after.values())
    for ident, text in left.items():
        assert ("[secret]" in after[ident].text) == bool(secrets.base_spans(text)) or "[secret]" not in after[ident].text
        if not secrets.base_spans(text):
            assert after[ident].text == text
    pieces = packed.toPandas()
    assert set(pieces.doc_id) == set(after) and pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline

    rows_ = [(1, "same words here for all", "en", "s", 3), (1, "same words here for all", "en", "s", 3), (2, "same words here for all", None, None, None), (None, "nameless text row", "en", "s", 1),
             (None, "nameless text row", "en", "s", 1), (5, None, None, None, None), (6, "", "en", "s", 0), (7, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as __keep_me", "2 as id", "3 as fp")
    known = corpus_pipeline.known_language(spark, docs, FOLDER)
    assert known.columns == docs.columns and {r.doc_id for r in known.collect()} <= {1, 2, None}
    near = corpus_pipeline.near_dedup(spark, docs, FOLDER).toPandas()
    assert sorted(near.doc_id.dropna()) == [1, 5, 7] and near.doc_id.isna().sum() == 1
    assert corpus_pipeline.decontaminated(spark, docs, FOLDER).count() == len(rows_)
    assert corpus_pipeline.without_secrets(spark, docs, FOLDER).count() == len(rows_)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), FOLDER).count() == 0


PARAGRAPHS = [f"Paragraph number {i}, with a fair amount of words, commas, and sense in it, so that it scores." for i in range(4)]


@pytest.mark.parametrize("wrapper", ['<div class="content no-sidebar">%s</div>', '<div class="has-sidebar">%s</div>', '<div class="with-comments">%s</div>', '<div class="page-header-fixed">%s</div>',
                                     '<div class="entry-content share">%s</div>', '<form id="aspnetForm">%s</form>',
                                     '<div class="has-sidebar"><div class="site-header">Site name</div><article>%s</article><div class="sidebar-left">Other <a href=x>links</a> here</div></div>'])
def test_wrappers_named_like_boilerplate_keep_their_article(wrapper):
    inner = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    page = f"<html><body><nav>menu</nav>{wrapper % inner}<div class='site-footer'>Copyright</div></body></html>"
    assert main_text.main_text(page) == "\n\n".join(PARAGRAPHS)


def test_long_comments_and_teasers_stay_out():
    inner = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    page = f"<body><article>{inner}</article><section class='comments'>{inner * 5}</section><div class='related-posts'><article>A teaser</article></div><form class=signup-form>Your address</form></body>"
    assert main_text.main_text(page) == "\n\n".join(PARAGRAPHS)


def test_stray_tags_in_linear_time():
    began = time.time()
    assert main_text.main_text("<b>" * 3000 + "</i>" * 200_000 + "<hr>" * 100_000 + "text") == "text"
    assert time.time() - began < 20
