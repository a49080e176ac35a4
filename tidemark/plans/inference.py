"""Queries of resampling, family adjustment and result roll-ups."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import counter_draw, rounded, row_identity, uniform_draw
from tidemark.operators import estimators as E
from tidemark.operators import resample as R
from tidemark.plans.association import flag_rows
from tidemark.plans.events import cat_days, features, matched, placebo
from tidemark.plans.market import dense, study_panel, sessions
from tidemark.plans.registry import study
from tidemark.plans.sqlviews import draw, r, view
from tidemark.session import snapshot
from tidemark.sources import tables as T

DRAWS, BLOCK, SEED = 99, 21, 5
FAMILY_DRAWS = 4999  # a family interval needs 20 draws in each tail: 2 * 6 * 20 / 0.05 = 4800

_D = "CAST(draw AS VARCHAR)"
_S = "CAST(slot AS VARCHAR)"
for _name, _count in (("moving_weights", DRAWS), ("family_weights", FAMILY_DRAWS)):
    view(_name, "sessions", f"""WITH n AS (SELECT count(*) AS n FROM sessions),
    p AS (SELECT draw, slot, n, {draw("'5'", "'block'", _D, _S)} % greatest(1, n - {BLOCK} + 1) AS start FROM n CROSS JOIN generate_series(0, {_count - 1}) d(draw) CROSS JOIN LATERAL (SELECT unnest(generate_series(0, CAST(ceil(n / {BLOCK}) AS BIGINT) - 1)) AS slot) s)
    SELECT draw, start + step AS session, count(*) AS weight FROM p CROSS JOIN generate_series(0, {BLOCK - 1}) g(step) WHERE slot * {BLOCK} + step < n AND start + step < n GROUP BY 1, 2""")
view("year_weights", "sessions", f"""WITH y AS (SELECT year(date) AS year, count(*) AS n, min(session) AS base FROM sessions GROUP BY 1),
    p AS (SELECT draw, slot, n, base, {draw("'5'", "'year'", _D, 'CAST(year AS VARCHAR)', _S)} % n AS start FROM y CROSS JOIN generate_series(0, {DRAWS - 1}) d(draw) CROSS JOIN LATERAL (SELECT unnest(generate_series(0, CAST(ceil(n / {BLOCK}) AS BIGINT) - 1)) AS slot) s)
    SELECT draw, base + (start + step) % n AS session, count(*) AS weight FROM p CROSS JOIN generate_series(0, {BLOCK - 1}) g(step) WHERE slot * {BLOCK} + step < n GROUP BY 1, 2""")
view("issuer_weights", "cat_days", f"""WITH i AS (SELECT issuer, row_number() OVER (ORDER BY issuer) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT issuer FROM cat_days)),
    p AS (SELECT draw, {draw("'5'", "'cluster'", _D, _S)} % n AS place FROM (SELECT max(n) AS n FROM i) CROSS JOIN generate_series(0, {DRAWS - 1}) d(draw) CROSS JOIN LATERAL (SELECT unnest(generate_series(0, n - 1)) AS slot) s)
    SELECT draw, issuer, count(*) AS weight FROM p JOIN i USING (place) GROUP BY 1, 2""")
view("losses", "cat_days features", """SELECT c.label || '|' || year(f.date) AS comparison, c.label AS category, year(f.date) AS year, c.issuer, c.session, f.return_5 - f.m AS value
    FROM cat_days c JOIN (SELECT *, avg(return_5) OVER (PARTITION BY ticker) AS m FROM features WHERE return_5 IS NOT NULL) f ON 'I' || substr(f.ticker, 2) = c.issuer AND f.session = c.session""")


def moving_weights(spark, folder):
    return R.moving_block_weights(sessions(spark, folder), DRAWS, BLOCK, SEED)


def year_weights(spark, folder):
    return snapshot(spark, folder, "year-weights", lambda s, f: R.year_block_weights(sessions(s, f), DRAWS, BLOCK, SEED))


def issuer_weights(spark, folder):
    return snapshot(spark, folder, "issuer-weights", lambda s, f: R.cluster_weights(cat_days(s, f), "issuer", DRAWS, SEED))


def losses(spark, folder):
    """(comparison, category, year, issuer, session, value): event-day outcomes less the ticker's mean."""
    def build(s, f):
        known = features(s, f).where("return_5 is not null")
        excess = F.col("return_5") - F.avg("return_5").over(W.partitionBy("ticker"))
        rows = known.select(F.concat(F.lit("I"), F.substring("ticker", 2, 9)).alias("issuer"), "session", F.year("date").alias("year"), excess.alias("value"))
        joined = cat_days(s, f).join(rows, ["issuer", "session"])
        return joined.select(F.concat_ws("|", "label", F.col("year").cast("string")).alias("comparison"), F.col("label").alias("category"), "year", "issuer", "session", "value")
    return snapshot(spark, folder, "losses", build)


def date_moments(spark, folder):
    rows = flag_rows(spark, folder).where("kind = 'return'")
    return rows.groupBy("feature", "session").agg(*E.moment_sums())


_WM = ", ".join(f"sum(weight * {m}) AS {m}" for m in E.MOMENTS)
_CORR = "CASE WHEN n >= 3 AND (sxx - sx * sx / n) > 1e-9 AND (syy - sy * sy / n) > 1e-9 THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END"
for _name, _weights in (("correlation_draws", "moving_weights"), ("family_draws", "family_weights")):
    view(_name, f"cells {_weights}", f"""SELECT feature, draw, {_CORR} AS estimate FROM (SELECT feature, draw, {_WM} FROM (SELECT feature, session, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy
    FROM cells WHERE lag = 0 AND kind = 'return' AND horizon = 5 GROUP BY 1, 2) JOIN {_weights} USING (session) GROUP BY 1, 2)""")


def correlation_draws(spark, folder):
    return snapshot(spark, folder, "correlation-draws", lambda s, f: R.weighted_correlations(date_moments(s, f), moving_weights(s, f), ["feature"]))


@study("r1_block_bootstrap", f"SELECT feature, CAST(draw AS INTEGER) AS draw, {r('estimate')} AS estimate FROM correlation_draws", "correlation_draws")
def r1(spark, folder):
    return R.weighted_correlations(date_moments(spark, folder), moving_weights(spark, folder), ["feature"]).withColumn("estimate", rounded("estimate"))


_LOSS = "(return_5 * return_5 - (return_5 - 0.1::DOUBLE * past_return_5) * (return_5 - 0.1::DOUBLE * past_return_5))"
view("date_losses", "panel", f"SELECT ticker, session, date, {_LOSS} AS diff FROM panel WHERE return_5 IS NOT NULL")


def date_losses(spark, folder):
    """Squared-error gain of a fixed momentum forecast over a zero forecast."""
    y, p = F.col("return_5"), F.col("past_return_5")
    return study_panel(spark, folder).where("return_5 is not null").select("ticker", "session", "date", (y * y - (y - 0.1 * p) * (y - 0.1 * p)).alias("diff"))


@study("r2_loss_improvement", f"""
SELECT 'momentum' AS comparison, CAST(draw AS INTEGER) AS draw, {r('sum(weight * s) / sum(weight * n)')} AS estimate FROM (SELECT session, sum(diff) AS s, count(*) AS n FROM date_losses GROUP BY 1) JOIN moving_weights USING (session) GROUP BY 2""", "date_losses moving_weights")
def r2(spark, folder):
    sums = date_losses(spark, folder).groupBy(F.lit("momentum").alias("comparison"), "session").agg(F.sum("diff").alias("s"), F.count(F.lit(1)).alias("n"))
    return R.weighted_means(sums, moving_weights(spark, folder), ["comparison"], ["session"], "s", "n").withColumn("estimate", rounded("estimate"))


@study("r3_cluster_bootstrap", f"""
SELECT comparison, CAST(draw AS INTEGER) AS draw, {r('sum(weight * s) / sum(weight * n)')} AS estimate FROM (SELECT comparison, issuer, sum(value) AS s, count(*) AS n FROM losses GROUP BY 1, 2) JOIN issuer_weights USING (issuer) GROUP BY 1, 2""", "losses issuer_weights")
def r3(spark, folder):
    sums = losses(spark, folder).groupBy("comparison", "issuer").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return R.weighted_means(sums, issuer_weights(spark, folder), ["comparison"], ["issuer"], "s", "n").withColumn("estimate", rounded("estimate"))


@study("r5_joint_weights", """
SELECT issuer, session, CAST(draw AS INTEGER) AS draw, i.weight * y.weight AS weight FROM (SELECT DISTINCT issuer, session FROM losses WHERE category = '1-URGENT') c JOIN issuer_weights i USING (issuer) JOIN year_weights y USING (draw, session)""", "losses issuer_weights year_weights")
def r5(spark, folder):
    cells = losses(spark, folder).where("category = '1-URGENT'").select("issuer", "session").distinct()
    return R.joint_weights(cells, issuer_weights(spark, folder), year_weights(spark, folder), "issuer").select("issuer", "session", "draw", "weight")


@study("r6_year_block_weights", "SELECT CAST(draw AS INTEGER) AS draw, CAST(session AS INTEGER) AS session, weight FROM year_weights", "year_weights")
def r6(spark, folder):
    return R.year_block_weights(sessions(spark, folder), DRAWS, BLOCK, SEED)


view("loss_draws", "losses year_weights", """SELECT comparison, draw, sum(weight * s) / sum(weight * n) AS estimate FROM (SELECT comparison, session, sum(value) AS s, count(*) AS n FROM losses GROUP BY 1, 2) JOIN year_weights USING (session) GROUP BY 1, 2""")
view("observed", "losses", "SELECT comparison, category, year, avg(value) AS estimate, count(*) AS rows, count(DISTINCT issuer) AS issuers FROM losses GROUP BY 1, 2, 3")
view("centred", "loss_draws observed", "SELECT d.comparison, d.draw, d.estimate - o.estimate AS estimate FROM loss_draws d JOIN observed o USING (comparison)")


def _loss_draws(spark, folder):
    sums = losses(spark, folder).groupBy("comparison", "session").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return R.weighted_means(sums, year_weights(spark, folder), ["comparison"], ["session"], "s", "n")


def loss_draws(spark, folder):
    return snapshot(spark, folder, "loss-draws", _loss_draws)


def observed(spark, folder):
    return losses(spark, folder).groupBy("comparison", "category", "year").agg(
        F.avg("value").alias("estimate"), F.count(F.lit(1)).alias("rows"), F.count_distinct("issuer").alias("issuers"))


def centred(spark, folder):
    point = observed(spark, folder).select("comparison", F.col("estimate").alias("point"))
    return loss_draws(spark, folder).join(point, "comparison").select("comparison", "draw", (F.col("estimate") - F.col("point")).alias("estimate"))


@study("r7_weighted_reestimates", f"SELECT comparison, CAST(draw AS INTEGER) AS draw, {r('estimate')} AS estimate FROM loss_draws", "loss_draws")
def r7(spark, folder):
    return _loss_draws(spark, folder).withColumn("estimate", rounded("estimate"))


view("legs", "matched features", """SELECT x.effect, x.role, x.sign, 'I' || substr(m.ticker, 2) AS issuer, CASE x.role WHEN 'event' THEN m.session ELSE m.control_session END AS session,
      CASE x.role WHEN 'event' THEN e.return_5 ELSE c.return_5 END AS value FROM matched m JOIN features e ON e.ticker = m.ticker AND e.session = m.session JOIN features c ON c.ticker = m.ticker AND c.session = m.control_session
    CROSS JOIN (VALUES ('difference', 'event', 1), ('difference', 'ordinary', -1), ('event_only', 'event', 1)) x(effect, role, sign) WHERE e.return_5 IS NOT NULL AND c.return_5 IS NOT NULL""")


def legs(spark, folder):
    """Signed legs of the pair effects, each at its own issuer and session."""
    value = features(spark, folder).select("ticker", F.col("session").alias("at"), F.col("return_5").alias("v"))
    e, c = value.withColumnsRenamed({"at": "session", "v": "ev"}), value.withColumnsRenamed({"at": "control_session", "v": "cv"})
    pairs = matched(spark, folder).join(e, ["ticker", "session"]).join(c, ["ticker", "control_session"]).where("ev is not null and cv is not null")
    items = [("difference", "event", 1, "session", "ev"), ("difference", "ordinary", -1, "control_session", "cv"), ("event_only", "event", 1, "session", "ev")]
    rows = F.array(*[F.struct(F.lit(n).alias("effect"), F.lit(o).alias("role"), F.lit(g).alias("sign"), F.col(s).alias("session"), F.col(v).alias("value")) for n, o, g, s, v in items])
    return pairs.select(F.concat(F.lit("I"), F.substring("ticker", 2, 9)).alias("issuer"), F.explode(rows).alias("x")).select("issuer", "x.*")


view("influence_draws", "legs issuer_weights year_weights", """WITH k AS (SELECT effect, role, avg(value) AS centre, count(*) AS pairs FROM legs GROUP BY 1, 2),
    c AS (SELECT l.effect, issuer, session, sum(sign * (value - centre) / pairs) AS coef FROM legs l JOIN k USING (effect, role) GROUP BY 1, 2, 3)
    SELECT effect, d.draw, sum((coalesce(i.weight, 0) * coalesce(y.weight, 0) - 1) * coef) AS estimate FROM c CROSS JOIN (SELECT DISTINCT draw FROM issuer_weights) d LEFT JOIN issuer_weights i ON i.draw = d.draw AND i.issuer = c.issuer
    LEFT JOIN year_weights y ON y.draw = d.draw AND y.session = c.session GROUP BY 1, 2""")


def influence_draws(spark, folder):
    return snapshot(spark, folder, "influence-draws", lambda s, f: R.influence_draws(R.influence(legs(s, f), "effect", "role"), issuer_weights(s, f), year_weights(s, f), "effect"))


@study("r8_influence_draws", f"SELECT effect, CAST(draw AS INTEGER) AS draw, {r('estimate')} AS estimate FROM influence_draws", "influence_draws")
def r8(spark, folder):
    return influence_draws(spark, folder).withColumn("estimate", rounded("estimate"))


@study("r9_percentile_interval", f"""SELECT feature, count(*) AS draws, count(estimate) AS valid, {r('CASE WHEN count(estimate) >= 40 THEN quantile_cont(estimate, 0.025) END')} AS lower, {r('CASE WHEN count(estimate) >= 40 THEN quantile_cont(estimate, 0.975) END')} AS upper,
  CASE WHEN count(estimate) >= 40 THEN 'measured' ELSE 'inconclusive' END AS status FROM correlation_draws GROUP BY 1""", "correlation_draws")
def r9(spark, folder):
    return R.percentile_interval(correlation_draws(spark, folder), ["feature"], 40).withColumns({"lower": rounded("lower"), "upper": rounded("upper")})


@study("r10_family_interval", f"""SELECT feature, count(estimate) AS valid, {r('CASE WHEN count(estimate) * (0.05::DOUBLE / 6 / 2) >= 20::DOUBLE THEN quantile_cont(estimate, 0.05::DOUBLE / 6 / 2) END')} AS lower,
  {r('CASE WHEN count(estimate) * (0.05::DOUBLE / 6 / 2) >= 20::DOUBLE THEN quantile_cont(estimate, 1 - 0.05::DOUBLE / 6 / 2) END')} AS upper, CASE WHEN count(estimate) * (0.05::DOUBLE / 6 / 2) >= 20::DOUBLE THEN 'resolved' ELSE 'unresolved_tail' END AS status FROM family_draws GROUP BY 1""", "family_draws")
def r10(spark, folder):
    draws = R.block_correlations(date_moments(spark, folder), sessions(spark, folder), ["feature"], FAMILY_DRAWS, BLOCK, SEED)
    return R.family_interval(draws, ["feature"], 6, tail_draws=20).withColumns({"lower": rounded("lower"), "upper": rounded("upper")})


view("studentized", "centred observed", """SELECT o.comparison, o.estimate AS point, s.se, abs(o.estimate / s.se) AS t FROM observed o JOIN (SELECT comparison, stddev_samp(estimate) AS se FROM centred GROUP BY 1 HAVING count(*) = count(estimate)) s USING (comparison) WHERE se > 1e-12""")
view("stepped", "centred studentized", """SELECT comparison, any_value(t) AS t, (1 + count_if(peak >= t)) / (1 + count(*))::DOUBLE AS raw_p FROM (
    SELECT comparison, draw, t, max(abs(c.estimate / s.se)) OVER (PARTITION BY draw ORDER BY t, comparison ROWS UNBOUNDED PRECEDING) AS peak FROM centred c JOIN studentized s USING (comparison)) GROUP BY 1""")
view("adjusted", "stepped studentized", "SELECT comparison, s.point, s.se, t, raw_p, max(raw_p) OVER (ORDER BY t DESC, comparison DESC ROWS UNBOUNDED PRECEDING) AS p_adjusted FROM stepped JOIN studentized s USING (comparison, t)")


def adjusted(spark, folder):
    def build(s, f):
        t_obs, t_draw = R.studentized(observed(s, f), centred(s, f), "comparison")
        return R.step_down(t_obs, t_draw, "comparison")
    return snapshot(spark, folder, "adjusted", build)


@study("w20_step_down_maxima", f"""SELECT comparison, CAST(draw AS INTEGER) AS draw, {r('max(abs(c.estimate / s.se)) OVER (PARTITION BY draw ORDER BY t, comparison ROWS UNBOUNDED PRECEDING)')} AS peak FROM centred c JOIN studentized s USING (comparison)""", "centred studentized")
def w20(spark, folder):
    _, t_draw = R.studentized(observed(spark, folder), centred(spark, folder), "comparison")
    w = W.partitionBy("draw").orderBy("t", "comparison").rowsBetween(W.unboundedPreceding, 0)
    return t_draw.select("comparison", "draw", rounded(F.max("td").over(w)).alias("peak"))


@study("r11_step_down_p", f"SELECT comparison, {r('t')} AS t, {r('raw_p')} AS raw_p, {r('p_adjusted')} AS p_adjusted FROM adjusted", "adjusted")
def r11(spark, folder):
    t_obs, t_draw = R.studentized(observed(spark, folder), centred(spark, folder), "comparison")
    out = R.step_down(t_obs, t_draw, "comparison")
    return out.select("comparison", *[rounded(c).alias(c) for c in ("t", "raw_p", "p_adjusted")])


@study("r12_simultaneous_bounds", f"""
WITH p AS (SELECT draw, max(abs(c.estimate / s.se)) AS peak FROM centred c JOIN studentized s USING (comparison) GROUP BY 1),
q AS (SELECT peak FROM (SELECT peak, row_number() OVER (ORDER BY peak) - 1 AS place, count(*) OVER () AS n FROM p) WHERE place = ceil((n - 1) * 0.95::DOUBLE))
SELECT comparison, {r('point')} AS point, {r('se')} AS se, {r('peak')} AS critical, {r('point - peak * se')} AS lower, {r('point + peak * se')} AS upper FROM studentized CROSS JOIN q""", "centred studentized")
def r12(spark, folder):
    t_obs, t_draw = R.studentized(observed(spark, folder), centred(spark, folder), "comparison")
    out = R.simultaneous_bounds(t_obs, t_draw, "comparison")
    return out.select("comparison", *[rounded(c).alias(c) for c in ("point", "se", "critical", "lower", "upper")])


@study("r13_undefined_draw_gate", f"""SELECT comparison, CAST({DRAWS} AS INTEGER) AS draws, count(d.estimate) AS finite_draws, CASE WHEN count(d.estimate) = {DRAWS} THEN 'supported' ELSE 'unsupported' END AS status FROM observed o LEFT JOIN loss_draws d USING (comparison) GROUP BY 1""", "observed loss_draws")
def r13(spark, folder):
    found = loss_draws(spark, folder).groupBy("comparison").agg(F.count("estimate").alias("f"))
    rows = observed(spark, folder).select("comparison").join(found, "comparison", "left").withColumn("finite_draws", F.coalesce("f", F.lit(0)))
    return rows.select("comparison", F.lit(DRAWS).alias("draws"), "finite_draws", F.when(F.col("finite_draws") == DRAWS, "supported").otherwise("unsupported").alias("status"))


_SCORE = "abs(avg(value)) / nullif(stddev_pop(value), 0) * sqrt(count(*))"
view("placebo_scores", "placebo features losses", f"""SELECT replica, category, {_SCORE} AS score FROM (SELECT DISTINCT p.replica, p.category, p.issuer, p.placebo_session, f.return_5 - f.m AS value FROM placebo p
      JOIN (SELECT *, avg(return_5) OVER (PARTITION BY ticker) AS m FROM features WHERE return_5 IS NOT NULL) f ON 'I' || substr(f.ticker, 2) = p.issuer AND f.session = p.placebo_session) GROUP BY 1, 2
    UNION ALL SELECT -1, category, {_SCORE} FROM losses GROUP BY 2""")


def placebo_scores(spark, folder):
    """Search score per category for the observed clock (replica -1) and every shifted one."""
    def build(s, f):
        known = features(s, f).where("return_5 is not null")
        excess = known.select(F.concat(F.lit("I"), F.substring("ticker", 2, 9)).alias("issuer"), "session", (F.col("return_5") - F.avg("return_5").over(W.partitionBy("ticker"))).alias("value"))
        days = placebo(s, f).select("replica", "category", "issuer", F.col("placebo_session").alias("session")).distinct()
        rows = days.join(excess, ["issuer", "session"]).select("replica", "category", "value").unionByName(losses(s, f).select(F.lit(-1).alias("replica"), "category", "value"))
        return rows.groupBy("replica", "category").agg((F.try_divide(F.abs(F.avg("value")), F.stddev_pop("value")) * F.sqrt(F.count(F.lit(1)))).alias("score"))
    return snapshot(spark, folder, "placebo-scores", build)


@study("m13_search_score", f"SELECT CAST(replica AS INTEGER) AS replica, category, {r('score')} AS score FROM placebo_scores", "placebo_scores")
def m13(spark, folder):
    return placebo_scores(spark, folder).withColumn("score", rounded("score"))


@study("r14_full_search_p", f"""WITH m AS (SELECT replica, max(score) AS peak FROM placebo_scores WHERE replica >= 0 GROUP BY 1)
SELECT category, {r('any_value(o.score)')} AS score, {r('(1 + count_if(m.peak >= o.score)) / (1 + count(*))::DOUBLE')} AS placebo_p FROM (SELECT category, score FROM placebo_scores WHERE replica = -1) o CROSS JOIN m GROUP BY 1""", "placebo_scores")
def r14(spark, folder):
    rows = placebo_scores(spark, folder)
    peaks = rows.where("replica >= 0").groupBy("replica").agg(F.max("score").alias("peak")).agg(F.collect_list("peak")).scalar()
    seen = rows.where("replica = -1").withColumn("peaks", peaks)
    p = (1 + F.size(F.filter("peaks", lambda x: x >= F.col("score")))) / (1 + F.size("peaks"))
    return seen.select("category", rounded("score").alias("score"), rounded(p).alias("placebo_p"))


@study("r16_placebo_tail", f"""SELECT o.category, {r('avg(CASE WHEN p.score >= o.score THEN 1::DOUBLE ELSE 0 END)')} AS tail_fraction, count(*) AS replicas FROM (SELECT * FROM placebo_scores WHERE replica = -1) o JOIN (SELECT * FROM placebo_scores WHERE replica >= 0) p USING (category) GROUP BY 1""", "placebo_scores")
def r16(spark, folder):
    rows = placebo_scores(spark, folder)
    seen = rows.where("replica = -1").select("category", F.col("score").alias("observed"))
    return rows.where("replica >= 0").join(seen, "category").groupBy("category").agg(
        rounded(F.avg((F.col("score") >= F.col("observed")).cast("double"))).alias("tail_fraction"), F.count(F.lit(1)).alias("replicas"))


_ROWKEY = "concat_ws('|', issuer, category, CAST(session AS VARCHAR))"


@study("r15_label_permutation", f"""
WITH b AS (SELECT issuer, year, value, {_ROWKEY} AS key, CAST(category = '1-URGENT' AS INTEGER) AS event FROM losses),
c AS (SELECT b.*, replica, row_number() OVER (PARTITION BY replica, issuer, year ORDER BY key) AS slot, row_number() OVER (PARTITION BY replica, issuer, year ORDER BY {draw("'3'", "'permute'", 'CAST(replica AS VARCHAR)', 'key')}, key) AS other FROM b CROSS JOIN (VALUES (0), (1), (2), (3), (4)) r(replica))
SELECT a.replica, count_if(x.event = 1) AS event_rows, {r('avg(a.value) FILTER (WHERE x.event = 1) - avg(a.value) FILTER (WHERE x.event = 0)')} AS difference FROM c a JOIN c x ON x.replica = a.replica AND x.issuer = a.issuer AND x.year = a.year AND x.other = a.slot GROUP BY 1""", "losses")
def r15(spark, folder):
    rows = losses(spark, folder).select("issuer", "year", "value", F.concat_ws("|", "issuer", "category", F.col("session").cast("string")).alias("key"), (F.col("category") == "1-URGENT").cast("int").alias("event"))
    mixed = R.permuted_labels(rows, ["issuer", "year"], "event", "key", 5, 3)
    on, off = F.avg(F.when(F.col("permuted") == 1, F.col("value"))), F.avg(F.when(F.col("permuted") == 0, F.col("value")))
    return mixed.groupBy("replica").agg(F.count_if(F.col("permuted") == 1).alias("event_rows"), rounded(on - off).alias("difference"))


@study("r17_null_calibration")
def r17(spark, folder):
    """Rejections over synthetic families with no effect, drawn on the real issuer and session grid."""
    data, effects = 20, 6
    cells = dense(spark, folder).where(F.col("session") % 21 == 0).select(F.concat(F.lit("I"), F.substring("ticker", 2, 9)).alias("issuer"), "session")
    rows = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(data - 1))).alias("dataset")).select("*", F.explode(F.sequence(F.lit(0), F.lit(effects - 1))).alias("effect"))
    noise = uniform_draw(17, "dataset", "effect", "issuer", "session") - 0.5
    rows = rows.withColumn("value", noise)
    centre = F.avg("value").over(W.partitionBy("dataset", "effect"))
    size = F.count(F.lit(1)).over(W.partitionBy("dataset", "effect"))
    coefs = rows.select("dataset", "effect", "issuer", "session", "value", ((F.col("value") - centre) / size).alias("coef"))
    weights = R.joint_weights(coefs, issuer_weights(spark, folder), year_weights(spark, folder), "issuer")
    draws = weights.groupBy("dataset", "effect", "draw").agg(F.sum(F.col("weight") * F.col("coef")).alias("estimate"))
    point = rows.groupBy("dataset", "effect").agg(F.avg("value").alias("point"))
    errors = draws.groupBy("dataset", "effect").agg(F.stddev_samp("estimate").alias("se")).join(point, ["dataset", "effect"])
    t_obs = errors.select("dataset", "effect", "point", "se", F.abs(F.col("point") / F.col("se")).alias("t"))
    t_draw = draws.join(t_obs, ["dataset", "effect"]).select("dataset", "effect", "draw", F.abs(F.col("estimate") / F.col("se")).alias("td"), "t")
    p = R.step_down(t_obs, t_draw, "effect", ["dataset"])
    return p.groupBy("dataset").agg(F.min("p_adjusted").alias("smallest_p"), F.max((F.col("p_adjusted") <= 0.05).cast("int")).alias("rejected"))


@study("r18_combined_batches", f"""SELECT comparison, count(estimate) AS draws, {r('avg(estimate)')} AS mean_draw, {r('min(estimate)')} AS low, {r('max(estimate)')} AS high FROM loss_draws GROUP BY 1""", "loss_draws")
def r18(spark, folder):
    sums = losses(spark, folder).groupBy("comparison", "session").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    parts = None
    for first in range(0, DRAWS, 33):
        weights = R.year_block_weights(sessions(spark, folder), 33, BLOCK, SEED, first)
        batch = R.weighted_means(sums, weights, ["comparison"], ["session"], "s", "n")
        parts = batch if parts is None else parts.unionByName(batch)
    return parts.groupBy("comparison").agg(F.count("estimate").alias("draws"), rounded(F.avg("estimate")).alias("mean_draw"), rounded(F.min("estimate")).alias("low"), rounded(F.max("estimate")).alias("high"))


# ---------------------------------------------------------------- roll-ups of the results

@study("j19_result_inference", f"""
WITH i AS (SELECT comparison, 'year' AS block, stddev_samp(estimate) AS se FROM loss_draws GROUP BY 1 UNION ALL SELECT comparison, 'cluster', stddev_samp(e) FROM (SELECT comparison, draw, sum(weight * s) / sum(weight * n) AS e FROM (SELECT comparison, issuer, sum(value) AS s, count(*) AS n FROM losses GROUP BY 1, 2) JOIN issuer_weights USING (issuer) GROUP BY 1, 2) GROUP BY 1)
SELECT o.comparison, {r('o.estimate')} AS estimate, {r("max(se) FILTER (WHERE block = 'year')")} AS se_year, {r("max(se) FILTER (WHERE block = 'cluster')")} AS se_cluster FROM observed o LEFT JOIN i USING (comparison) GROUP BY 1, o.estimate""", "observed loss_draws losses issuer_weights")
def j19(spark, folder):
    sums = losses(spark, folder).groupBy("comparison", "issuer").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    cluster = R.weighted_means(sums, issuer_weights(spark, folder), ["comparison"], ["issuer"], "s", "n")
    both = loss_draws(spark, folder).withColumn("block", F.lit("year")).unionByName(cluster.withColumn("block", F.lit("cluster")))
    wide = both.groupBy("comparison").pivot("block", ["year", "cluster"]).agg(F.stddev_samp("estimate")).withColumnsRenamed({"year": "se_year", "cluster": "se_cluster"})
    return observed(spark, folder).join(wide, "comparison", "left").select("comparison", rounded("estimate").alias("estimate"), rounded("se_year").alias("se_year"), rounded("se_cluster").alias("se_cluster"))


@study("a12_category_master", f"""SELECT o.category, count(*) AS comparisons, count_if(p_adjusted <= 0.2::DOUBLE) AS notable, {r('min(p_adjusted)')} AS lowest_p, {r('max(p_adjusted)')} AS highest_p, {r('min(estimate)')} AS low, {r('max(estimate)')} AS high FROM observed o LEFT JOIN adjusted a USING (comparison) GROUP BY 1""", "observed adjusted")
def a12(spark, folder):
    p = adjusted(spark, folder).select("comparison", "p_adjusted")
    return observed(spark, folder).join(p, "comparison", "left").groupBy("category").agg(
        F.count(F.lit(1)).alias("comparisons"), F.count_if(F.col("p_adjusted") <= 0.2).alias("notable"), rounded(F.min("p_adjusted")).alias("lowest_p"),
        rounded(F.max("p_adjusted")).alias("highest_p"), rounded(F.min("estimate")).alias("low"), rounded(F.max("estimate")).alias("high"))


YEARS = list(range(1995, 2002))


@study("a13_cross_year", "SELECT category, " + ", ".join(f"{r(f'max(estimate) FILTER (WHERE year = {y})')} AS y{y}" for y in YEARS)
       + ", CAST(bool_and(estimate > 0) AS INTEGER) AS all_years_positive, count(*) AS years FROM observed GROUP BY 1", "observed")
def a13(spark, folder):
    rows = observed(spark, folder)
    wide = rows.groupBy("category").pivot("year", YEARS).agg(F.first("estimate"))
    signs = rows.groupBy("category").agg(F.bool_and(F.col("estimate") > 0).cast("int").alias("all_years_positive"), F.count(F.lit(1)).alias("years"))
    return wide.select("category", *[rounded(F.col(str(y))).alias(f"y{y}") for y in YEARS]).join(signs, "category")
