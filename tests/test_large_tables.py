"""What only larger or denser tables than the supplied ones show."""

import os
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import text as X
from tidemark.llm import packing, secrets
from tidemark.operators import joins as J
from tidemark.plans import events, forecast
from tidemark.streaming import bars as B
from tools import check

FOLDER = "/root/testdata/sf0.001"


def changed(folder, **tables):
    """A copy of the smallest tables by links, some of them replaced by a query over them."""
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        if t in tables:
            pq.write_table(con.sql(tables[t]).to_arrow_table(), f"{folder}/{t}.parquet")
        else:
            os.symlink(f"{FOLDER}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def against_sql(spark, name, folder):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    expected = check.rows_of(names, found.fetchall())
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == expected
    return expected


def test_percentages_at_halves(spark):
    """f18: SQL formats the binary value; a decimal half may lie on either side of it."""
    values = [s * k / 200 for k in range(0, 4001) for s in (1.0, -1.0)] + [-1e-9, 1e-9, -4.9e-7, 0.0, 12345.675]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", X.percent("v").alias("p"))
    con = duckdb.connect()
    sql = con.execute("SELECT format('{:.2f}%', round(v, 6)) FROM (SELECT unnest(?::DOUBLE[]) AS v, unnest(range(?)) AS i) ORDER BY i", [values, len(values)]).fetchall()
    assert [r.p for r in got.orderBy("i").collect()] == [s for s, in sql]


@pytest.mark.parametrize("nations", [None, 3])
def test_contrast_of_few_pairs(spark, tmp_path, nations):
    """c13: with events on every session no pair is left, and SQL still has its one row; then pairs of one ticker only."""
    if nations is None:
        folder = changed(tmp_path, part="SELECT * REPLACE (CASE p_partkey % 2 WHEN 0 THEN 'Brand#7' ELSE 'Brand#12' END AS p_brand) FROM part",
                         orders="SELECT * FROM orders", lineitem="SELECT * REPLACE (l_partkey + i AS l_partkey) FROM lineitem, range(2) r(i)")
    else:
        folder = changed(tmp_path, customer="SELECT * REPLACE (CAST(3 AS INTEGER) AS c_nationkey) FROM customer", supplier="SELECT * FROM supplier")
    against_sql(spark, "c13_paired_contrast", folder)


def test_text_components_match_numpy(spark):
    """x2 and x1: one row a document with its terms in it, projected where it stands."""
    rng = np.random.default_rng(3)
    dense = rng.random((300, 240)) * (rng.random((300, 240)) < 0.2) + 0.01 * np.outer(rng.random(300), rng.random(240))
    rows = [(i, [(j, float(x)) for j, x in enumerate(r) if x]) for i, r in enumerate(dense)]
    weights = spark.createDataFrame(rows, "doc_id bigint, terms array<struct<position:int,weight:double>>")
    got = {r.doc_id: (r.components, r.captured) for r in forecast.text_components(weights, 240, 7).collect()}
    basis = np.linalg.svd(dense, full_matrices=False)[2][:7].T
    assert got == {i: (7, pytest.approx(float(((r @ basis) ** 2).sum()), rel=1e-6)) for i, r in enumerate(dense)}


def test_text_components_take_rows_by_batch(spark, monkeypatch):
    """x2: rows become vectors by batch; no Python function meets each row, also not for empty rows and other id types."""
    monkeypatch.setattr(F, "udf", lambda *a, **b: pytest.fail("a function of each row"))
    dense = np.random.default_rng(4).random((120, 110))
    dense[7] = 0
    rows = [(f"d{i}", [(j, float(x)) for j, x in enumerate(r) if x]) for i, r in enumerate(dense)]
    weights = spark.createDataFrame(rows, "doc_id string, terms array<struct<position:int,weight:double>>")
    got = {r.doc_id: (r.components, r.captured) for r in forecast.text_components(weights, 110, 5).collect()}
    basis = np.linalg.svd(dense, full_matrices=False)[2][:5].T
    assert got == {f"d{i}": (5, pytest.approx(float(((r @ basis) ** 2).sum()), rel=1e-6, abs=1e-9)) for i, r in enumerate(dense)}


def test_term_weights_of_repeated_documents(spark, tmp_path):
    """x1: rows of one id count together, wherever they lie."""
    folder = changed(tmp_path, documents="SELECT * REPLACE (doc_id // 2 AS doc_id) FROM documents")
    against_sql(spark, "x1_term_weights", folder)
    weights = forecast.term_weights(spark, folder)
    assert weights.columns == ["doc_id", "terms"] and weights.count() == weights.select("doc_id").distinct().count()


def test_term_counts_by_batch_match_a_plain_loop(monkeypatch):
    """x1, x2: known words and pairs of a text and the weights of a document, in batches of any size."""
    rng = np.random.default_rng(11)
    texts = [[f"w{rng.integers(9)}" for _ in range(rng.integers(0, 30))] for _ in range(60)]
    terms = ["w1", "w2 w2", "w3 w4", "w5", "absent", "w4 w3", "w7 absent"]
    idf = np.arange(1.0, 8.0)
    plain = []
    for words in texts:
        held = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        plain.append([(i, held.count(t)) for i, t in enumerate(terms) if t in held])
    for size in (1, 40, 500_000):
        monkeypatch.setattr(forecast, "_HELD", size)
        batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts, pa.list_(pa.string()))], names=["doc_id", "words"])
        got = [r for b in forecast._counted(terms)([batch]) for r in b.to_pylist()]
        assert [(r["doc_id"], list(zip(r["positions"], r["counts"]))) for r in got] == [(i, p) for i, p in enumerate(plain) if p]
        again = [[{"positions": [i for i, _ in p], "counts": [c for _, c in p]} for p in pair if p] for pair in zip(plain, plain[1:]) if any(pair)]
        kind = pa.list_(pa.struct([("positions", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]))
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(again))), pa.array(again, kind)], names=["doc_id", "found"])
        for row, pair in zip((r for b in forecast._weighted(idf)([batch]) for r in b.to_pylist()), again, strict=True):
            raw = np.zeros(7)
            for p in pair:
                raw[p["positions"]] += np.array(p["counts"]) * idf[p["positions"]]
            assert [t["position"] for t in row["terms"]] == list(np.flatnonzero(raw))
            assert [t["weight"] for t in row["terms"]] == pytest.approx(list(raw[raw > 0] / np.linalg.norm(raw)))


def test_quotes_shrink_before_they_move(spark):
    """k8, l4: a task keeps one quote a cutoff, so the shuffle doesn't grow with the quotes."""
    cuts = spark.createDataFrame([("a", i, (i + 1) * 10**9) for i in range(3)], "k string, id int, cutoff_ns bigint")
    quotes = spark.range(5000).select(F.lit("a").alias("k"), (F.col("id") * 300000).alias("ts_ns"), F.col("id").alias("sequence"))
    found = J.latest_quote(cuts, quotes, ["k"], 10**9)
    assert "partial_max" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.sequence) for r in found.collect()} == {(0, 3333), (1, 4999), (2, None)}


def test_event_filings_are_those_of_the_label_arrays(spark):
    """j12, k4, j22: only lines of the event labels are shuffled, for the same filings."""
    rows = events.labelled(spark, FOLDER).where("session is not null").select("accession", "labels").collect()
    first, second = events.A, events.B
    assert "labels" not in events.event_filings(spark, FOLDER).columns
    assert {r.accession for r in events.cohort(spark, FOLDER).collect()} == {r.accession for r in rows if first in r.labels and second in r.labels}
    assert {r.accession for r in events.component(spark, FOLDER).collect()} == {r.accession for r in rows if first in r.labels and second not in r.labels}


def test_draws_are_taken_before_the_patterns(spark):
    """a19: a filing's draws are not taken again for each of its patterns."""
    plan = entry.queries()["a19_alias_patterns"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    made, used = plan.split("Generate explode", 1)
    assert "md5" not in made and "md5" in used
    against_sql(spark, "a19_alias_patterns", FOLDER)


def test_pairs_of_a_busy_user_take_no_loop(spark, tmp_path):
    """t7: ticks without a time and of other types have no say, and one user's rows of a trigger are not walked one by one."""
    ticks = spark.range(60000).select(F.col("id").alias("event_id"), F.when(F.col("id") != 7, F.timestamp_micros(F.col("id") * 1000 + 10**15)).alias("ts"), F.lit(1).cast("bigint").alias("user_id"),
                                      F.when(F.col("id") % 3 == 0, "click").when(F.col("id") % 3 == 1, "purchase").otherwise("view").alias("event_type"))
    ticks.write.parquet(str(tmp_path / "ticks"))
    start = time.time()
    got = B.drain(B.ordered_pairs(B.tick_source(spark, str(tmp_path / "ticks"), ticks.schema), "click", "purchase", 1000), "pairs").collect()
    assert {r.event_id for r in got} == {i for i in range(60000) if i % 3 == 1 and i != 7}
    assert time.time() - start < 60


def test_islands_beat_best_fit(spark):
    """op4, pipeline: on sizes just under a third and a half of a sequence best fit misses the least number of bins; the search with its own parameters finds fewer."""
    rng = np.random.default_rng(1)
    first = rng.integers(520, 900, 150)
    second = rng.integers(520, 900, 150)
    sizes = np.concatenate([first, second, packing.LIMIT - first - second])
    greedy = packing.fitness(packing.best_fit(np.full(len(sizes), -1), sizes, np.argsort(-sizes, kind="stable"), packing.LIMIT), sizes, packing.LIMIT)
    pool = packing.evolve(sizes, [], packing.LIMIT, seed=5)
    assert greedy[0] > 150 and packing.fitness(pool[0], sizes, packing.LIMIT)[0] < greedy[0]
    least = packing.evolve(np.full(8, 1024), [], packing.LIMIT, seed=5)
    assert len(least) == 1  # a first solution that can't be bettered needs no others


def test_secrets_that_go_beyond_a_base_span():
    """op5: a mixed token around a run of hex digits is found whole, a linear pass also over many of them."""
    token = "Zx9QpLw" + "0123456789abcdef" + "TgRkVbNmYh7"
    text = f"see {token} and my_token={'Ab3' * 8}x"
    base = secrets.base_spans(text)
    assert [s[1] for s in base] == [2, 0]
    assert [(s, e) for s, _, e, _ in secrets.token_spans(text, base)] == [(4, 4 + len(token))]
    start = time.time()
    assert len(secrets.token_spans(f"{token} " * 20000, secrets.base_spans(f"{token} " * 20000))) == 20000
    assert time.time() - start < 20
