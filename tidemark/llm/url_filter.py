"""URL filter: host and path rules, and a character language-model ratio for the URLs that no rule names.

Two smoothed variable-order Markov models are counted on the URLs that rules accept and reject: a character's probability after
its last four characters is interpolated with its probability after three, two, one and none (Witten-Bell weights, so each order
counts as far as its context was seen). A URL's score is the mean log ratio of the two models over its characters; the threshold is
calibrated on labelled URLs that the models did not see. Counts come from all URLs and live in tables; nothing is collected but
the four moments of the calibration.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower
from tidemark.session import stage

ORDER = 5  # a character and up to four before it
FOLDS = 5  # one fold of the labelled URLs calibrates, the others are counted
START, END = "\u0002", "\u0003"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first "://" up to "/", "?", "#" or the end; path from there up to "?", "#" or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def longest_rule(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule that fits, else null. "example.org/a" fits example.org and its subdomains where the path starts with /a."""

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)

    ordered = sorted(dict.fromkeys(rules), key=lambda r: (-len(r), r))
    return reduce(lambda chain, rule: F.when(fits(rule), F.lit(rule)).otherwise(chain), reversed(ordered), F.lit(None).cast("string"))


def _grams(text: Column) -> Column:
    """One gram per character and one for the end: the character with the four before it."""
    padded = F.concat(F.lit(START * (ORDER - 1)), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


def log_ratios(grams: DataFrame) -> DataFrame:
    """grams: (gram, good, bad), all grams of any URL with their counts in the two classes; gives (gram, ratio)."""
    classes = ("good", "bad")
    size = F.count(F.lit(1)) + 1
    level = grams.groupBy(F.right("gram", F.lit(1)).alias("g")).agg(*[F.sum(c).alias(c) for c in classes])
    totals = level.agg(size.alias("v"), *[F.sum(c).alias("n_" + c) for c in classes], *[F.count_if(F.col(c) > 0).alias("t_" + c) for c in classes])
    v, *rest = totals.first()  # five numbers
    n, t = dict(zip(classes, rest[:2])), dict(zip(classes, rest[2:]))

    def first(c: str) -> Column:
        seen = (n[c] or 0) + t[c]
        return (F.col(c) + t[c] / v) / float(seen) if seen else F.lit(1.0 / v)

    table = level.select("g", *[first(c).alias("p_" + c) for c in classes])
    for k in range(2, ORDER + 1):
        level = grams.groupBy(F.right("gram", F.lit(k)).alias("g")).agg(*[F.sum(c).alias(c) for c in classes])
        level = level.withColumn("context", F.left("g", F.lit(k - 1))).withColumn("shorter", F.right("g", F.lit(k - 1)))
        contexts = level.groupBy("context").agg(*[F.sum(c).alias("n_" + c) for c in classes],
                                                *[F.count_if(F.col(c) > 0).alias("t_" + c) for c in classes])
        shorter = table.select(F.col("g").alias("shorter"), *[F.col("p_" + c).alias("q_" + c) for c in classes])
        joined = level.join(contexts, "context").join(shorter, "shorter")

        def blended(c: str) -> Column:
            seen = F.col("n_" + c) + F.col("t_" + c)
            return F.when(seen > 0, (F.col(c) + F.col("t_" + c) * F.col("q_" + c)) / seen).otherwise(F.col("q_" + c))

        table = joined.select("g", *[blended(c).alias("p_" + c) for c in classes])
    return table.select(F.col("g").alias("gram"), (F.ln("p_good") - F.ln("p_bad")).alias("ratio"))


def _threshold(labelled: DataFrame) -> float | None:
    """Point at equal standardised distance from the two classes' mean scores; None where a class is missing."""
    good, bad = F.col("label") == "allow", F.col("label") == "block"
    m = labelled.agg(*[f(F.when(c, F.col("score"))) for c in (good, bad) for f in (F.avg, F.stddev_pop)]).first()
    if m[0] is None or m[2] is None:
        return None
    spread = m[1] + m[3]
    return (m[0] * m[3] + m[2] * m[1]) / spread if spread > 0 else (m[0] + m[2]) / 2


def judge(pages: DataFrame, allow: list[str], block: list[str], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score), one row per input row: the rule's verdict, else the model's.

    score is the length-normalised log ratio less the threshold (null for a URL without characters). Null URLs and URLs without "://"
    have empty host and path. A URL without characters, and any URL if the rules label no accepted or no rejected URL, is allowed. A
    score of exactly the threshold allows. A rule in both lists blocks. Repeated rows give repeated rows, an empty table none; other
    columns are not read.
    """
    url = F.coalesce(F.col(url_column), F.lit(""))
    host, path = host_and_path(F.col(url_column))
    rows = pages.select(F.col(id_column).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", longest_rule(F.col("host"), F.col("path"), [*allow, *block]))
    rows = rows.withColumn("label", F.when(F.col("rule").isin(block), "block").when(F.col("rule").isin(allow), "allow"))
    rows = stage(rows, "url-rows")
    urls = rows.where(F.length("url") > 0).groupBy("url").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("times"))
    urls = urls.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    each = urls.select("url", "label", "times", "fold", F.explode(_grams(ascii_lower(F.col("url")))).alias("gram"))
    counted = F.col("fold") != 0
    grams = each.groupBy("gram").agg(F.sum(F.when(counted & (F.col("label") == "allow"), F.col("times")).otherwise(0)).alias("good"),
                                     F.sum(F.when(counted & (F.col("label") == "block"), F.col("times")).otherwise(0)).alias("bad"))
    ratios = stage(log_ratios(stage(grams, "url-grams")), "url-ratios")
    scores = each.join(ratios, "gram").groupBy("url", "label", "fold").agg(F.avg("ratio").alias("score"))
    scores = stage(scores, "url-scores")
    labelled = scores.where(F.col("label").isNotNull())
    threshold = _threshold(labelled.where(F.col("fold") == 0))
    threshold = _threshold(labelled) if threshold is None else threshold
    score = F.col("score") - F.lit(threshold if threshold is not None else 0.0)
    model = F.when(F.lit(threshold is not None) & (score < 0), "block").otherwise("allow")
    out = rows.join(scores.select("url", "score"), "url", "left")
    return out.select(F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("label", model).alias("verdict"), score.alias("score"))
