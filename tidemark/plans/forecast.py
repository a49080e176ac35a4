"""Queries of chronological forecasting, text and annotation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.functions import text as X
from tidemark.functions.scalars import big, first_reason, flag, rounded, row_identity
from tidemark.operators import forecast as C
from tidemark.operators import linear as L
from tidemark.plans.events import hash_sample, matched
from tidemark.plans.inference import date_losses
from tidemark.plans.market import CATEGORIES, study_panel
from tidemark.plans.registry import study
from tidemark.plans.sqlviews import r, view
from tidemark.session import snapshot, stage
from tidemark.sources import tables as T

MARKET = ["past_return_5", "past_return_20", "past_vol_20", "past_log_volume", "market_past_return_5"]
LABELS = [f"event__{c}" for c in CATEGORIES]
PATTERNS = ["recent_a", "sequence_a_before_b", "event_x_return", "event_x_vol"]
GROUPS = {"market": MARKET, "labels": [*MARKET, *LABELS[:-1]], "patterns": [*MARKET, *LABELS[:-1], *PATTERNS]}
YEARS = [1999, 2000, 2001]
EVENT = "event__1-URGENT"


def modelling_rows(spark, folder):
    event = F.col(f"`{EVENT}`")
    return study_panel(spark, folder).where("return_5 is not null").withColumns({"event_x_return": event * F.col("past_return_20"), "event_x_vol": event * F.col("past_vol_20")})


@study("m1_expanding_folds", """
WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel WHERE return_5 IS NOT NULL)),
c AS (SELECT max(date) FILTER (WHERE place = floor(n * 0.4::DOUBLE)) AS c0, max(date) FILTER (WHERE place = floor(n * 0.6::DOUBLE)) AS c1, max(date) FILTER (WHERE place = floor(n * 0.8::DOUBLE)) AS c2 FROM d),
f AS (SELECT 0 AS fold, c0 AS start, c1 AS stop FROM c UNION ALL SELECT 1, c1, c2 FROM c UNION ALL SELECT 2, c2, DATE '9999-12-31' FROM c)
SELECT fold, start, count(*) FILTER (WHERE date < start AND target_end_5 < start) AS train_rows, count(*) FILTER (WHERE date >= start AND date < stop) AS valid_rows FROM panel CROSS JOIN f WHERE return_5 IS NOT NULL GROUP BY 1, 2""", "panel")
def m1(spark, folder):
    rows = modelling_rows(spark, folder)
    parts = C.assign_folds(rows, C.fold_bounds(rows), "target_end_5")
    return parts.groupBy("fold", "start").agg(F.count_if(F.col("part") == "train").alias("train_rows"), F.count_if(F.col("part") == "valid").alias("valid_rows"))


@study("m2_calendar_folds", f"""
WITH y AS (SELECT p.date, p.target_end_5 AS e, v.y AS fold_year FROM panel p CROSS JOIN (VALUES {', '.join(f'({y})' for y in YEARS)}) v(y) WHERE return_5 IS NOT NULL),
t AS (SELECT * FROM y WHERE date < make_date(fold_year, 1, 1) AND e < make_date(fold_year, 1, 1)),
d AS (SELECT fold_year, date, row_number() OVER (PARTITION BY fold_year ORDER BY date) - 1 AS place, count(*) OVER (PARTITION BY fold_year) AS n FROM (SELECT DISTINCT fold_year, date FROM t)),
b AS (SELECT fold_year, date AS boundary FROM d WHERE place = floor(n * 0.8::DOUBLE) AND n >= 60)
SELECT fold_year, boundary, count(*) FILTER (WHERE date < boundary AND e < boundary) AS inner_train_rows, count(*) FILTER (WHERE date >= boundary) AS inner_test_rows FROM t JOIN b USING (fold_year) GROUP BY 1, 2""", "panel")
def m2(spark, folder):
    train = C.assign_years(modelling_rows(spark, folder), YEARS, "target_end_5").where("part = 'train'")
    parts = C.inner_parts(train, ["fold_year"], "target_end_5")
    return parts.groupBy("fold_year", "boundary").agg(F.count_if(F.col("inner") == "inner_train").alias("inner_train_rows"), F.count_if(F.col("inner") == "inner_test").alias("inner_test_rows"))


def fold_rows(spark, folder):
    """Panel rows by expanding fold, written once: every model reads the same cohort."""
    def build(s, f):
        rows = modelling_rows(s, f)
        return C.assign_folds(rows, C.fold_bounds(rows), "target_end_5")
    return snapshot(spark, folder, "fold-rows", build)


@study("m3_ridge_forecast")
def m3(spark, folder):
    losses = C.ridge_losses(fold_rows(spark, folder), ["fold"], MARKET, "return_5", [1.0], "train", "valid")
    return losses.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), rounded(F.avg("loss")).alias("mse"))


@study("m4_boosted_trees")
def m4(spark, folder):
    """Boosted trees with fixed settings on the last expanding fold."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=GROUPS["labels"], outputCol="features").transform(fold_rows(spark, folder).where("fold = 2"))
    model = GBTRegressor(featuresCol="features", labelCol="return_5", maxIter=10, maxDepth=3, minInstancesPerNode=30, stepSize=0.1, seed=7).fit(rows.where("part = 'train'"))
    scored = model.transform(rows.where("part = 'valid'"))
    error = F.col("return_5") - F.col("prediction")
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), rounded(F.avg(error * error), 4).alias("mse"))


def group_losses(spark, folder):
    """Loss of every validation row under each feature group."""
    def build(s, f):
        found = None
        for name, columns in GROUPS.items():
            part = C.ridge_losses(fold_rows(s, f), ["fold"], columns, "return_5", [1.0], "train", "valid", carry=["ticker", "session", "date", EVENT]).withColumn("group", F.lit(name))
            found = part if found is None else found.unionByName(part)
        return found.withColumnRenamed(EVENT, "event")
    return snapshot(spark, folder, "group-losses", build)


@study("m5_paired_losses")
def m5(spark, folder):
    """Augmented against baseline forecasts on identical rows, all rows and event rows."""
    rows = group_losses(spark, folder)
    base = rows.where("group = 'market'").select("fold", "ticker", "session", F.col("loss").alias("base"))
    both = rows.where("group <> 'market'").join(base, ["fold", "ticker", "session"]).withColumn("gain", F.col("base") - F.col("loss"))
    return both.groupBy("fold", "group").agg(F.count(F.lit(1)).alias("rows"), rounded(F.avg("gain")).alias("mse_improvement"), rounded(F.try_divide(F.avg("gain"), F.avg("base"))).alias("relative_improvement"),
                                             F.count_if(F.col("event") == 1).alias("event_rows"), rounded(F.avg(F.when(F.col("event") == 1, F.col("gain")))).alias("event_improvement"))


@study("m6_nested_selection")
def m6(spark, folder):
    """Penalty chosen on the purged inner split of each calendar year, then refitted and tested."""
    outer = C.assign_years(modelling_rows(spark, folder), YEARS, "target_end_5")
    outer = snapshot(spark, folder, "year-rows", lambda s, f: outer)
    inner = C.inner_parts(outer.where("part = 'train'"), ["fold_year"], "target_end_5")
    trials = C.ridge_losses(inner, ["fold_year"], GROUPS["labels"], "return_5", C.ALPHAS, "inner_train", "inner_test", part="inner").groupBy("fold_year", "alpha").agg(F.avg("loss").alias("inner_mse"))
    chosen = trials.groupBy("fold_year").agg(F.min_by(F.struct("alpha", "inner_mse"), F.struct("inner_mse", "alpha")).alias("best")).select("fold_year", "best.*")
    final = C.ridge_losses(outer, ["fold_year"], GROUPS["labels"], "return_5", C.ALPHAS, "train", "test").groupBy("fold_year", "alpha").agg(F.avg("loss").alias("test_mse"), F.count(F.lit(1)).alias("rows"))
    return chosen.join(final, ["fold_year", "alpha"]).select("fold_year", "alpha", rounded("inner_mse").alias("inner_mse"), rounded("test_mse").alias("test_mse"), "rows")


@study("m7_feature_groups")
def m7(spark, folder):
    rows = group_losses(spark, folder)
    return rows.groupBy("group", "fold").agg(F.count(F.lit(1)).alias("rows"), rounded(F.avg("loss")).alias("mse"))


FIXED = {"zero": "0 * past_return_5", "momentum": "0.1 * past_return_5", "reversal": "-0.1 * past_return_5 - 0.05 * past_return_20"}


@study("m8_ablation_contrasts", f"""
WITH l AS (SELECT ticker, session, year(date) AS year, m.model, pow(return_5 - CASE m.model WHEN 'zero' THEN 0 WHEN 'momentum' THEN 0.1::DOUBLE * past_return_5 ELSE -0.1::DOUBLE * past_return_5 - 0.05::DOUBLE * past_return_20 END, 2) AS loss FROM panel CROSS JOIN (VALUES ('zero'), ('momentum'), ('reversal')) m(model) WHERE return_5 IS NOT NULL)
SELECT a.year, a.model AS augmented, b.model AS baseline, count(*) AS rows, {r('avg(b.loss - a.loss)')} AS mse_improvement FROM l a JOIN l b ON a.ticker = b.ticker AND a.session = b.session WHERE (a.model, b.model) IN (('momentum', 'zero'), ('reversal', 'zero'), ('reversal', 'momentum')) GROUP BY 1, 2, 3""", "panel")
def m8(spark, folder):
    """Contrasts between forecasts of the same row; the losses sit side by side, so no join is needed."""
    rows = study_panel(spark, folder).where("return_5 is not null")
    rows = rows.select(F.year("date").cast("bigint").alias("year"), *[F.pow(F.col("return_5") - F.expr(e), F.lit(2)).alias(n) for n, e in FIXED.items()])
    pairs = F.array(*[F.struct(F.lit(a).alias("augmented"), F.lit(b).alias("baseline"), (F.col(b) - F.col(a)).alias("gain")) for a, b in (("momentum", "zero"), ("reversal", "zero"), ("reversal", "momentum"))])
    return rows.select("year", F.explode(pairs).alias("p")).groupBy("year", "p.augmented", "p.baseline").agg(F.count(F.lit(1)).alias("rows"), rounded(F.avg("p.gain")).alias("mse_improvement"))


@study("m9_loss_by_date", f"SELECT date, {r('sum(diff)')} AS total, count(*) AS rows FROM date_losses GROUP BY 1", "date_losses")
def m9(spark, folder):
    return date_losses(spark, folder).groupBy("date").agg(rounded(F.sum("diff")).alias("total"), F.count(F.lit(1)).alias("rows"))


@study("m10_frozen_model", f"""
WITH f AS (SELECT ticker, regr_slope(return_5, past_return_5) AS b, regr_intercept(return_5, past_return_5) AS a FROM panel WHERE return_5 IS NOT NULL AND date < DATE '1999-01-01' AND target_end_5 < DATE '1999-01-01' GROUP BY 1)
SELECT ticker, count(*) AS rows, {r('any_value(a)', 5)} AS intercept, {r('any_value(b)', 5)} AS slope, {r('avg(pow(return_5 - a - b * past_return_5, 2))', 5)} AS mse FROM panel JOIN f USING (ticker) WHERE return_5 IS NOT NULL AND date >= DATE '1999-01-01' GROUP BY 1""", "panel")
def m10(spark, folder):
    """Coefficients fitted once, written as a table, and only read when later rows are scored."""
    rows = study_panel(spark, folder).where("return_5 is not null")
    frozen = snapshot(spark, folder, "frozen-model", lambda s, f: rows.where("date < '1999-01-01' and target_end_5 < '1999-01-01'").groupBy("ticker").agg(
        F.regr_intercept("return_5", "past_return_5").alias("intercept"), F.array(F.regr_slope("return_5", "past_return_5")).alias("coefs")))
    scored = rows.where("date >= '1999-01-01'").join(frozen, "ticker").withColumn("error", F.col("return_5") - L.predicted(["past_return_5"]))
    return scored.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), rounded(F.first("intercept"), 5).alias("intercept"), rounded(F.get(F.first("coefs"), F.lit(0)), 5).alias("slope"), rounded(F.avg(F.col("error") * F.col("error")), 5).alias("mse"))


@study("m11_label_ablation")
def m11(spark, folder):
    """Gain from the event labels for the signed and the absolute outcome."""
    targets = F.array(F.struct(F.lit("signed").alias("target"), F.col("return_5").alias("y")), F.struct(F.lit("absolute").alias("target"), F.abs("return_5").alias("y")))
    rows = fold_rows(spark, folder).withColumn("t", F.explode(targets)).select("*", "t.*").drop("t")
    keys = ["fold", "target"]
    base = C.ridge_losses(rows, keys, MARKET, "y", [1.0], "train", "valid", carry=["ticker", "session"]).select(*keys, "ticker", "session", F.col("loss").alias("base"))
    full = C.ridge_losses(rows, keys, GROUPS["labels"], "y", [1.0], "train", "valid", carry=["ticker", "session"]).select(*keys, "ticker", "session", "loss")
    return base.join(full, [*keys, "ticker", "session"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), rounded(F.avg(F.col("base") - F.col("loss"))).alias("mse_improvement"))


@study("m12_pattern_readings", f"""
WITH a AS (SELECT p.ticker, p.session, unnest([{', '.join(f"CASE WHEN \"{l}\" <> 0 THEN '{l}' END" for l in LABELS)}]) AS pattern FROM panel p)
SELECT pattern, count(*) AS activations, count(DISTINCT ticker) AS issuers, CASE WHEN count(*) >= 10 AND count(DISTINCT ticker) >= 3 THEN 'measured' ELSE 'unsupported' END AS status, {r('CASE WHEN count(*) >= 10 AND count(DISTINCT ticker) >= 3 THEN avg(diff) END')} AS event_improvement FROM a JOIN date_losses USING (ticker, session) WHERE pattern IS NOT NULL GROUP BY 1""", "panel date_losses")
def m12(spark, folder):
    active = F.array_compact(F.array(*[F.when(F.col(f"`{l}`") != 0, F.lit(l)) for l in LABELS]))
    marks = study_panel(spark, folder).select("ticker", "session", F.explode(active).alias("pattern"))
    by_issuer = marks.join(date_losses(spark, folder), ["ticker", "session"]).groupBy("pattern", "ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("diff").alias("s"))
    good = (F.col("activations") >= 10) & (F.col("issuers") >= 3)
    return by_issuer.groupBy("pattern").agg(F.sum("n").alias("activations"), F.count(F.lit(1)).alias("issuers"), (F.sum("s") / F.sum("n")).alias("m")).select(
        "pattern", "activations", "issuers", F.when(good, "measured").otherwise("unsupported").alias("status"), rounded(F.when(good, F.col("m"))).alias("event_improvement"))


@study("c18_residual_contrast")
def c18(spark, folder):
    """Pair differences of residuals from a model fitted on earlier years only."""
    outer = C.assign_years(modelling_rows(spark, folder), [1997, 1998, *YEARS], "target_end_5")
    scored = C.ridge_losses(outer, ["fold_year"], MARKET, "return_5", [1.0], "train", "test", carry=["ticker", "session", "return_5"])
    residual = scored.select("ticker", "session", "fold_year", (F.col("return_5") - F.col("prediction")).alias("e"))
    control = residual.select("ticker", F.col("session").alias("control_session"), F.col("e").alias("c"))
    pairs = matched(spark, folder).join(residual, ["ticker", "session"]).join(control, ["ticker", "control_session"])
    return pairs.groupBy("fold_year").agg(F.count(F.lit(1)).alias("pairs"), rounded(F.avg(F.col("e") - F.col("c"))).alias("residual_contrast"))


# ---------------------------------------------------------------- text and annotation

# Fixed values of the text features.
TERMS, MIN_DOCUMENTS, COMPONENTS = 20_000, 2, 64
_TERM = r"[\p{L}\p{N}_]{2,}"


_HELD = 500_000  # words or terms of the rows that are counted at once; a longer row is counted alone


def _spans(offsets: np.ndarray):
    """Ranges of rows of at most _HELD elements, one row at least."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _HELD, "right")) - 1)
        yield low, high
        low = high


def _lists(positions: np.ndarray, counts: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Both as lists of rows, which begin at `first`."""
    offsets = pa.array(np.r_[first, len(positions)].astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (positions.astype(np.int32), counts.astype(np.int64))]


def _counted(terms: list[str]):
    """(doc_id, positions, counts) of each row with a term: its words and pairs of neighbours among `terms`, counted without a row for each."""
    words = sorted({w for t in terms for w in t.split(" ")})
    code = {w: i for i, w in enumerate(words)}
    single, double = np.full(len(words), -1), []
    for position, t in enumerate(terms):
        parts = [code[w] for w in t.split(" ")]
        if len(parts) == 1:
            single[parts[0]] = position
        else:
            double.append((parts[0] * len(words) + parts[1], position))
    keys, places = np.array(sorted(double), np.int64).reshape(-1, 2).T.copy()

    def run(batches):
        known = pa.array(words, pa.string())
        for batch in batches:
            lists = batch.column("words")
            offsets = lists.offsets.to_numpy()
            for low, high in _spans(offsets):
                start, stop = int(offsets[low]), int(offsets[high])
                codes = pc.index_in(lists.values.slice(start, stop - start), value_set=known).fill_null(-1).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(high - low), np.diff(offsets[low:high + 1]))
                one = np.flatnonzero(codes >= 0)
                two = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0) & (row[:-1] == row[1:])) if len(keys) else one[:0]
                wanted = codes[two] * len(words) + codes[two + 1] if len(two) else two
                at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
                hit = keys[at] == wanted if len(two) else np.zeros(0, bool)
                place = np.r_[single[codes[one]], places[at[hit]] if len(two) else two]
                held = np.r_[row[one], row[two[hit]]]
                found, counts = np.unique(held[place >= 0] * len(terms) + place[place >= 0], return_counts=True)
                rows, first = np.unique(found // len(terms), return_index=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low).take(pa.array(rows)), *_lists(found % len(terms), counts, first)], names=["doc_id", "positions", "counts"])

    return run


def _weighted(idf: np.ndarray):
    """(doc_id, terms) from all counts of a document: counts of one term are added, times its weight, and the row scaled to length one."""
    def run(batches):
        for batch in batches:
            rows = batch.column("found")
            inner = rows.values.field("positions")
            ends = inner.offsets.to_numpy()[rows.offsets.to_numpy()]
            position, count = inner.values.to_numpy(), rows.values.field("counts").values.to_numpy()
            for low, high in _spans(ends):
                held = slice(ends[low], ends[high])
                row = np.repeat(np.arange(high - low), np.diff(ends[low:high + 1]))
                key, which = np.unique(row * len(idf) + position[held], return_inverse=True)
                raw = np.bincount(which, count[held], len(key)) * idf[key % len(idf)]
                first = np.flatnonzero(np.r_[True, key[1:] // len(idf) != key[:-1] // len(idf)])
                norm = np.sqrt(np.add.reduceat(raw * raw, first))
                places, weights = key % len(idf), raw / np.repeat(norm, np.diff(np.r_[first, len(key)]))
                terms = pa.StructArray.from_arrays([pa.array(places.astype(np.int32)), pa.array(weights)], names=["position", "weight"])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)].astype(np.int32)), terms)], names=["doc_id", "terms"])

    return run


def term_weights(spark, folder):
    """(doc_id, terms), terms an array of (position, weight) by position, of length one over one- and two-word terms; documents without a term have no row.

    Vocabulary and weights come from the labelled documents only; their texts are dealt by id, so that a document's terms are counted where they are found. With the
    vocabulary in every task, the others' texts stay where they are: what is shuffled is one row a text, its known terms and their counts.
    """
    def words_of(docs):
        return docs.select("doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_TERM), F.lit(0)).alias("words"))

    def found(docs):
        pairs = F.zip_with("words", F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), lambda x, y: F.when(y.isNotNull(), F.concat_ws(" ", x, y)))
        # A set number of tasks: by the size of their texts, whose terms take many times more memory, too few would be left.
        dealt = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
        return words_of(dealt).select("doc_id", F.explode(F.concat("words", F.filter(pairs, lambda p: p.isNotNull()))).alias("term"))

    def build(s, f):
        docs = T.table(s, f, "documents").select("doc_id", "text")
        train = docs.join(T.table(s, f, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
        size = train.agg(F.count_distinct("doc_id")).scalar()
        counts = found(train).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        known = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        # TERMS rows at most: small enough for one window and for every task.
        chosen = known.where(F.col("df") >= MIN_DOCUMENTS).orderBy(F.desc("total"), "term").limit(TERMS)
        chosen = chosen.select("term", "df", (F.row_number().over(W.orderBy(F.desc("total"), "term")) - 1).alias("position"))
        chosen = chosen.select("term", (F.ln((1.0 + size) / (1 + F.col("df"))) + 1).alias("idf")).orderBy("position").toPandas()
        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = words_of(docs).mapInArrow(_counted(chosen["term"].tolist()), f"doc_id {kind}, positions array<int>, counts array<bigint>")
        # Rows of one id count together; nearly all are alone.
        rows = rows.groupBy("doc_id").agg(F.collect_list(F.struct("positions", "counts")).alias("found"))
        return rows.mapInArrow(_weighted(chosen["idf"].to_numpy()), f"doc_id {kind}, terms array<struct<position:int,weight:double>>")
    return snapshot(spark, folder, "term-weights", build)


@study("x1_term_weights", f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_TERM}') AS w FROM documents),
t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n FROM documents SEMI JOIN labels USING (doc_id)),
v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c SEMI JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= {MIN_DOCUMENTS} ORDER BY total DESC, term LIMIT {TERMS}),
x AS (SELECT doc_id, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM c JOIN v USING (term) CROSS JOIN n)
SELECT doc_id, count(*) AS terms, {r('max(raw) / sqrt(sum(raw * raw))')} AS top_weight FROM x GROUP BY 1""")
def x1(spark, folder):
    return term_weights(spark, folder).select("doc_id", F.size("terms").cast("bigint").alias("terms"), rounded(F.array_max("terms.weight")).alias("top_weight"))


def _energy(basis: np.ndarray):
    """Per document, the squared length of its projection; the basis is TERMS x COMPONENTS numbers, whatever the input."""
    def run(batches):
        for batch in batches:
            terms, ends = batch.column("terms"), batch.column("terms").offsets.to_numpy()
            flat = terms.values
            position, weight = flat.field("position").to_numpy(zero_copy_only=False), flat.field("weight").to_numpy(zero_copy_only=False)
            parts = [weight[i:j] @ basis[position[i:j]] for i, j in zip(ends, ends[1:])]
            captured = pa.array([float(v @ v) for v in parts], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([basis.shape[1]] * len(parts), pa.int64()), captured], names=["doc_id", "components", "captured"])

    return run


def _sparse(size: int):
    """Rows of terms as sparse vectors of that size: the columns of a batch are those of a vector already, no value is touched in Python."""
    def run(batches):
        for batch in batches:
            terms = batch.column("terms")
            kinds, sizes = pa.array(np.zeros(len(terms), np.int8)), pa.array(np.full(len(terms), size, np.int32))  # 0: a sparse vector
            indices, values = (pa.ListArray.from_arrays(terms.offsets, terms.values.field(f)) for f in ("position", "weight"))
            vectors = pa.StructArray.from_arrays([kinds, sizes, indices, values], names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([vectors], names=["v"])

    return run


def text_components(weights, terms: int, components: int):
    """(doc_id, components, captured): squared length of every row's projection on the leading right singular vectors of the rows.

    The decomposition passes over the rows some hundred times, so they are kept in memory or on the executors' disks while it runs.
    """
    from pyspark.mllib.linalg import VectorUDT
    from pyspark.mllib.linalg.distributed import RowMatrix

    rows = weights.select("terms").mapInArrow(_sparse(terms), StructType([StructField("v", VectorUDT())])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        basis = RowMatrix(rows, 0, terms).computeSVD(components).V.toArray()
    finally:
        rows.unpersist()
    schema = f"doc_id {weights.schema['doc_id'].dataType.simpleString()}, components bigint, captured double"
    return weights.mapInArrow(_energy(np.ascontiguousarray(basis)), schema)


@study("x2_text_components")
def x2(spark, folder):
    """Truncated SVD of the term matrix; documents are projected where their terms are, without a join."""
    energy = text_components(term_weights(spark, folder), TERMS, COMPONENTS).withColumn("captured", rounded("captured", 4))
    docs = T.table(spark, folder, "documents").select("doc_id", flag(F.trim(F.coalesce("text", F.lit(""))) == "").alias("missing_text"))
    return docs.join(energy, "doc_id", "left").na.fill({"components": 0, "captured": 0.0})


# Clause endings that turn the invented prose into excerpts with a known meaning.
EXCERPTS = ["The company issued senior secured notes. It received the proceeds.", "The company will issue notes if markets permit.", "The company sold bonds.", "No further statement is made.", ""]


@study("x3_clause_status")
def x3(spark, folder):
    tail = F.get(F.array(*[F.lit(e) for e in EXCERPTS]), (F.col("doc_id") % len(EXCERPTS)).cast("int"))
    excerpt = F.when(tail != "", F.concat_ws(" ", "text", tail))
    out = X.financing_status(T.table(spark, folder, "documents").select("doc_id", excerpt.alias("excerpt")), "excerpt")
    return out.select("doc_id", "status", F.md5("evidence").alias("evidence_hash"))


@study("x4_excerpt_merge", """
SELECT l_orderkey AS accession, p_brand AS category, count(*) AS excerpts, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS provenance, min(CAST(l_shipdate AS DATE)) AS first_date FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def x4(spark, folder):
    lines = T.table(spark, folder, "lineitem").join(T.table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("l_orderkey").alias("accession"), F.col("p_brand").alias("category")).agg(
        F.count(F.lit(1)).alias("excerpts"), F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("provenance"), F.min(F.to_date("l_shipdate")).alias("first_date"))


@study("x5_review_cards", """
SELECT category, year, card FROM (SELECT category, year(filing_date) AS year, sha256('{"accession":' || accession || ',"category":"' || category || '"}') AS card, row_number() OVER (PARTITION BY category, year(filing_date) ORDER BY sha256('batch|' || sha256('{"accession":' || accession || ',"category":"' || category || '"}'))) AS k FROM filings) WHERE k <= 5""", "filings")
def x5(spark, folder):
    rows = T.filings(spark, folder).select("category", F.year("filing_date").cast("bigint").alias("year"), row_identity("accession", "category").alias("card"))
    return hash_sample(rows, ["category", "year"], "card", "batch", 5)


@study("x6_evidence_gate", """
WITH d AS (SELECT doc_id, quality, toxic, text, regexp_extract(text, '^[^.!?]*') AS passage FROM documents JOIN labels USING (doc_id)),
c AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN md5('altered') ELSE md5(passage) END AS stated_hash, CASE WHEN quality = 1 THEN 'verified_terms' WHEN toxic = 1 THEN 'verified_absence' ELSE 'incomplete_text_unknown' END AS claim FROM d)
SELECT doc_id, CASE WHEN claim LIKE 'verified%' AND (passage IS NULL OR passage = '') THEN 'rejected_without_evidence' WHEN claim LIKE 'verified%' AND md5(passage) <> stated_hash THEN 'rejected_changed_evidence' WHEN claim = 'verified_absence' AND doc_id % 3 <> 0 THEN 'rejected_partial_review' ELSE claim END AS classification FROM c""")
def x6(spark, folder):
    rows = T.table(spark, folder, "documents").join(T.table(spark, folder, "labels"), "doc_id").withColumn("passage", F.regexp_extract("text", "^[^.!?]*", 0))
    rows = rows.withColumn("stated_hash", F.when(F.col("doc_id") % 7 == 0, F.md5(F.lit("altered"))).otherwise(F.md5("passage")))
    rows = rows.withColumn("claim", F.when(F.col("quality") == 1, "verified_terms").when(F.col("toxic") == 1, "verified_absence").otherwise("incomplete_text_unknown"))
    return rows.select("doc_id", gated_claim(F.col("claim"), F.col("passage"), F.col("stated_hash"), F.col("doc_id") % 3 == 0).alias("classification"))


def gated_claim(claim, passage, stated_hash, full_review):
    """A verified claim needs a passage whose hash is unchanged; a claim of absence also needs a full review."""
    verified = claim.startswith("verified")
    bad = first_reason((verified & (passage.isNull() | (passage == "")), "rejected_without_evidence"), (verified & (F.md5(passage) != stated_hash), "rejected_changed_evidence"),
                       ((claim == "verified_absence") & ~full_review, "rejected_partial_review"))
    return F.coalesce(bad, claim)


@study("x7_review_agreement", """
WITH a AS (SELECT doc_id, CAST(quality AS VARCHAR) AS first FROM labels WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CAST(1 - toxic AS VARCHAR) AS second FROM labels WHERE doc_id % 4 <> 0)
SELECT CASE WHEN first IS NULL OR second IS NULL THEN 'single_pass' WHEN first = second THEN first ELSE 'unknown' END AS result, count(*) AS cards FROM a FULL JOIN b USING (doc_id) GROUP BY 1""")
def x7(spark, folder):
    labels = T.table(spark, folder, "labels")
    a = labels.where("doc_id % 5 <> 0").select("doc_id", F.col("quality").cast("string").alias("first"))
    b = labels.where("doc_id % 4 <> 0").select("doc_id", (1 - F.col("toxic")).cast("string").alias("second"))
    result = F.when(F.col("first").isNull() | F.col("second").isNull(), "single_pass").when(F.col("first") == F.col("second"), F.col("first")).otherwise("unknown")
    return a.join(b, "doc_id", "full").groupBy(result.alias("result")).agg(F.count(F.lit(1)).alias("cards"))


@study("p8_annotation_validation", """
WITH a AS (SELECT d.doc_id, d.lang, d.text, l.quality, CASE WHEN d.doc_id % 9 = 0 THEN 'draft' ELSE 'complete' END AS status, CASE WHEN d.doc_id % 11 = 0 THEN '2024-01-01T00:00:00+02:00' ELSE '2024-01-01T00:00:00Z' END AS stamp,
  CASE WHEN d.doc_id % 13 = 0 THEN 'no such passage' ELSE regexp_extract(d.text, '^[^.!?]*') END AS evidence FROM documents d JOIN labels l USING (doc_id))
SELECT CASE WHEN status NOT IN ('complete', 'pending') THEN 'unknown_status' WHEN NOT suffix(stamp, 'Z') THEN 'stamp_not_utc' WHEN lang NOT IN ('en', 'fr', 'de') THEN 'value_not_allowed' WHEN evidence = '' OR NOT contains(text, evidence) THEN 'evidence_not_in_excerpt' ELSE 'valid' END AS result, count(*) AS annotations FROM a GROUP BY 1""")
def p8(spark, folder):
    d = T.table(spark, folder, "documents").join(T.table(spark, folder, "labels").select("doc_id"), "doc_id")
    evidence = F.when(F.col("doc_id") % 13 == 0, "no such passage").otherwise(F.regexp_extract("text", "^[^.!?]*", 0))
    fields = F.create_map(F.lit("language"), F.struct(F.col("lang").alias("value"), F.array(evidence).alias("evidence")))
    rows = d.select("text", F.when(F.col("doc_id") % 9 == 0, "draft").otherwise("complete").alias("status"),
                    F.when(F.col("doc_id") % 11 == 0, "2024-01-01T00:00:00+02:00").otherwise("2024-01-01T00:00:00Z").alias("stamp"), fields.alias("fields"))
    return rows.groupBy(annotation_result(["complete", "pending"], {"language": ["en", "fr", "de"]}).alias("result")).agg(F.count(F.lit(1)).alias("annotations"))


def annotation_result(statuses, allowed):
    """First problem of an annotation row (status, stamp, fields map, text), or 'valid'."""
    lists = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(v) for v in x]) for kv in allowed.items() for x in kv])
    entries = F.map_entries("fields")
    values = F.forall(entries, lambda e: F.coalesce(F.array_contains(F.try_element_at(lists, e["key"]), e["value"]["value"]), F.lit(False)))
    proven = F.forall(entries, lambda e: F.forall(e["value"]["evidence"], lambda p: (p != "") & F.contains(F.col("text"), p)))
    problem = first_reason((~F.col("status").isin(statuses), "unknown_status"), (~F.col("stamp").endswith("Z"), "stamp_not_utc"), (~values, "value_not_allowed"), (~proven, "evidence_not_in_excerpt"))
    return F.coalesce(problem, F.lit("valid"))
