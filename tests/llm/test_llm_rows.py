"""Odd rows: nulls in any column, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fingerprints, langid, licences, main_text, packing, secrets, shards, simhash, url_filter

SECRET = 'token = "0123456789abcdef0123456789abcdef"'
LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
TEXTS = [None, "", "   \n\n ", "a", "Ünï çödé ß", LONG, LONG, SECRET, "same text here, twice\nLicensed under CC BY-NC 4.0.", "same text here, twice\nLicensed under CC BY-NC 4.0.",
         "\U0001f600" * 300, "<|endoftext|> is text", "123 456 !!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", None][i % 2], None) for i, t in enumerate(TEXTS)]
    rows += [(3, "a", "en", "s1", None), (3, "a", "en", "s1", None), (None, "no id", None, None, None), (None, None, None, None, None)]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "text_key", "fp", "row", "chunk", "label", "found", "score", "length", "keys", "bucket", "__id", "rows", "slot", "size"):
        out = out.withColumn(name, F.lit("clash"))
    return out


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (None, ""), (3, "short item")], "item_id long, text string")


PER_ROW = {
    "fingerprints": lambda d, b: fingerprints.with_edits(d),
    "packing": lambda d, b: packing.pack(d).where("piece = 0"),
    "secrets": lambda d, b: secrets.find(d),
    "shards": lambda d, b: shards.shard(d),
    "simhash": lambda d, b: simhash.near_duplicates(d),
    "langid": lambda d, b: langid.identify(d),
}
SOME = {"licences": lambda d, b: licences.scan(d), "leaks": lambda d, b: decontaminate.leaks(d, b)}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row(docs, benchmark, name):
    out = PER_ROW[name](docs, benchmark).toPandas()
    assert len(out) == docs.count()
    assert out.doc_id.isna().sum() == 2
    assert PER_ROW[name](docs.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("name", SOME)
def test_searches_pass_over_odd_rows(docs, benchmark, name):
    out = SOME[name](docs, benchmark).toPandas()
    assert set(out.doc_id) == ({8, 9} if name == "licences" else set())
    assert SOME[name](docs.limit(0), benchmark.limit(0)).count() == 0


def test_equal_texts_agree(docs):
    prints = fingerprints.with_edits(docs).toPandas().set_index("doc_id")
    assert prints.fingerprint[5] == prints.fingerprint[6] and prints.fingerprint[0] == prints.fingerprint[1]
    assert prints.near_edited.between(0, 1).all() and prints.near_next.between(0, 1).all()
    assert prints.near_next[6] == 1.0  # 6 is followed by 5
    groups = simhash.near_duplicates(docs).toPandas()
    assert groups[groups.doc_id.isin([0, 1, 2])].component_id.unique().tolist() == [0]
    assert groups[groups.doc_id.isin([5, 6])].component_id.unique().tolist() == [5]
    placed = shards.shard(docs).toPandas()
    assert placed[placed.doc_id.isin([5, 6])].shard.nunique() == 1
    for _, g in placed.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_language_of_odd_texts(docs):
    out = langid.identify(docs).toPandas()
    letterless = out.doc_id.isin([0, 1, 2, 10, 12])
    assert (out[letterless].lang_pred == "und").all() and out[letterless].rejected.all() and (out[letterless].score == 0).all()
    assert out[out.doc_id == 5].lang_pred.isin(["en", "de"]).all() and out.score.between(0, 1).all()


def test_secrets_of_odd_texts(docs):
    out = secrets.find(docs).toPandas().set_index("doc_id")
    assert out.n_assign[7] == 1 and out.n_hex[7] == 1 and out.n_live[7] == 1  # both spans hold one value
    assert out.spans[7] == "assign:0:41,hex:9:41"
    assert secrets.redact(docs).count() == docs.count() and secrets.redact(docs).columns == docs.columns


PAGES = [(1, None, None), (2, "", ""), (3, "no scheme", "plain words"), (4, "http://", "<p></p>"), (5, "HTTP://A.Example.ORG/x?y://z", "<div>" * 3000 + "deep" + "</div>" * 3000),
         (6, "http://org/", "<p>one"), (6, "http://org/", "<p>one"), (None, "http://b.com/de/1", None), (8, "http://c.com/fr/" + "x" * 5000, "<p>" + "y, " * 50_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("rule", F.lit(2)).withColumn("gram", F.lit(3))


def test_odd_pages(pages):
    out = main_text.extract(pages).toPandas()
    assert len(out) == len(PAGES) and out[out.page_id == 5].text.tolist() == ["deep"] and out[out.page_id == 6].text.tolist() == ["one", "one"]
    assert out[out.page_id == 8].n_chars.tolist() == [150_000 - 1] and out[out.page_id.isin([1, 2, 4])].text.tolist() == ["", "", ""]
    assert main_text.extract(pages.limit(0)).count() == 0


def test_odd_urls(pages):
    out = url_filter.judge(pages, ["org/", "com/fr/"], ["com/de/"]).toPandas()
    assert len(out) == len(PAGES)
    found = {k: g.iloc[0] for k, g in out.groupby("page_id")}
    assert (found[5].host, found[5].path, found[5].rule, found[5].verdict) == ("a.example.org", "/x", "org/", "allow")
    assert found[1].host == found[1].path == found[3].host == found[4].host == "" and found[1].rule is None
    assert out[out.page_id.isna()].verdict.tolist() == ["block"] and out.verdict.isin(["allow", "block"]).all()
    assert url_filter.judge(pages.limit(0), ["org/"], ["com/"]).count() == 0
