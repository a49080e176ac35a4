"""Secret scan with corpus-wide ownership frequency.

Three fixed patterns give the base spans; long mixed tokens are further candidates. Every candidate's value is hashed, and the hashes
are counted over the corpus by distinct repositories and owners, those of every copy of a text included. A value that several owners and several repositories
hold in as many different texts, one for each, is a widely copied example; one that stays with a few, or in a few texts that many have copied, looks live. Live
token candidates that no base span holds are added to the spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import digest
from tidemark.session import discard, stage

# The kinds in their order, and what each matches. Runs of fixed characters are asked for with their least length.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
MIN_ASSIGN = 12
TOKEN_BITS = 3.5

SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64()), ("value", pa.string())])
FOUND = "array<struct<start:long,rank:int,stop:long,value:string>>"


def entropy(value: str) -> float:
    """Bits a character of a value's own character counts."""
    counts = Counter(value)
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, stop, value) of the base patterns, by start and kind."""
    found = []
    small = text.lower()
    if any(w in small for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def token_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens of letters and digits with high entropy that base spans don't hold.

    A token that goes beyond an access or hex span holds more of the secret than that span, so it is a candidate of its own; one that an assignment touches is its value.
    """
    found: list[tuple[int, int, int, str]] = []
    taken: list[list[int]] = []  # base spans joined where they touch, and whether an assignment is among them; both lists run by start
    for s, rank, e, _ in base:
        if taken and s <= taken[-1][1]:
            taken[-1][1:] = max(taken[-1][1], e), taken[-1][2] or rank == 0
        else:
            taken.append([s, e, rank == 0])
    at = 0
    for m in TOKEN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        held, i = False, at
        while i < len(taken) and taken[i][0] < m.end() and not held:
            held = taken[i][2] or (taken[i][0] <= m.start() and m.end() <= taken[i][1])
            i += 1
        if not held:
            value = m[0]
            if DIGIT.search(value) and LETTER.search(value) and entropy(value) >= TOKEN_BITS:
                found.append((m.start(), 3, m.end(), value))
    return found


def _hashed(spans: list[tuple[int, int, int, str]]) -> list[dict]:
    return [{"start": s, "rank": r, "stop": e, "value": hashlib.sha256(v.encode()).hexdigest()} for s, r, e, v in spans]


def written(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[r]}:{s}:{e}" for s, r, e, _ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, shas, found = ([], [], []), [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            more = token_spans(text or "", base)
            for r in range(3):
                counts[r].append(sum(s[1] == r for s in base))
            shas.append(hashlib.sha256(written(base).encode()).hexdigest())
            found.append(_hashed(base + more))
        keep = [c for c in batch.schema.names if c != "text"]
        arrays = [batch.column(c) for c in keep]
        arrays += [pa.array(c, pa.int64()) for c in counts] + [pa.array(shas, pa.string()), pa.array(found, pa.list_(SPAN))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def matched(pairs: list[tuple], enough: int) -> bool:
    """Whether `enough` pairs (text, holder) share neither a text nor a holder; by augmenting paths."""
    texts: dict = {}
    for text, holder in pairs:
        texts.setdefault(text, []).append(holder)
    given: dict = {}

    def place(text, seen: set) -> bool:
        for holder in texts[text]:
            if holder not in seen:
                seen.add(holder)
                if holder not in given or place(given[holder], seen):
                    given[holder] = text
                    return True
        return False

    return sum(place(text, set()) for text in texts) >= enough


def spread(held: DataFrame, holder: str, enough: int) -> DataFrame:
    """held: (value, text_key, holder). Gives the values that `enough` holders have in as many different texts, a text standing for one of its holders.

    Which holder that is, is the best choice for the value, so names and the order of rows decide nothing. A few pairs of each value settle it: of a text with
    more holders, or a holder with more texts, `enough` are as good as all; and where nothing is in more than `enough` pairs, enough * (enough - 1) + 1 of them always do.
    """
    pairs = held.select("value", "text_key", F.col(holder).alias("holder")).distinct()
    for group, order, most in ((["value", "text_key"], ["holder"], enough), (["value", "holder"], ["text_key"], enough), (["value"], ["text_key", "holder"], enough * (enough - 1) + 1)):
        pairs = pairs.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("place") <= most).drop("place")
    settled = F.udf(lambda p: matched([tuple(x) for x in p], enough), "boolean")
    return pairs.groupBy("value").agg(F.collect_list(F.struct("text_key", "holder")).alias("pairs")).where(settled("pairs")).select("value")


def find(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), shared_owners: int = 3, shared_repositories: int = 3,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, found), one row per input row.

    spans lists base spans and live added ones as kind:start:stop (code points, stop exclusive). n_shared counts the row's values that `shared_owners` owners
    have in as many different texts, and `shared_repositories` repositories likewise (`spread`), n_live the others; found holds (start, rank, stop, value hash, owners,
    repositories, live), where all owners and repositories are counted. Null texts count as empty; a null owner or repository is one of its own. Rows of equal text are one
    text, of all their owners; overlapping spans of different kinds all stay; an empty table gives no rows; other columns are not read.
    """
    repo = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in repository])
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(owner).cast("string"), F.lit("?")).alias("owner"), repo.alias("repo"),
                       F.col(text_column).alias("text"), digest(F.col(text_column)).alias("text_key"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, owner string, repo string, text_key binary, n_assign long, n_access long, n_hex long, base_sha256 string, found {FOUND}"
    rows = stage(rows.mapInArrow(_scan, schema), "secret-rows")
    hits = rows.where(F.size("found") > 0)
    texts = stage(hits.groupBy("text_key").agg(F.first("found").alias("found")), "secret-texts")
    homes = hits.select("text_key", "owner", F.struct("owner", "repo").alias("home")).distinct()
    each = texts.select("text_key", F.explode(F.array_distinct(F.transform("found", lambda s: s["value"]))).alias("value"))
    # Spark sizes what comes from explode too low, so neither side is broadcast by its size.
    held = stage(each.hint("merge").join(homes.hint("merge"), "text_key"), "secret-owners")
    values = (held.select("value", "owner", "home").distinct().groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"))
              .groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repositories")))
    values = stage(values, "secret-values")
    # Too few owners or repositories in all need no look at the texts.
    shared = values.where((F.col("owners") >= shared_owners) & (F.col("repositories") >= shared_repositories)).select("value")
    for holder, enough in (("owner", shared_owners), ("home", shared_repositories)):
        shared = spread(held.join(shared, "value", "left_semi"), holder, max(enough, 1))
    values = values.join(shared.withColumn("shared", F.lit(True)), "value", "left").withColumn("live", F.col("shared").isNull()).drop("shared")
    judged = texts.select("text_key", F.explode("found").alias("s")).select("text_key", "s.*").join(values, "value")
    # One text's spans, as many as the text has room for.
    per_text = judged.groupBy("text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "stop", "value", "owners", "repositories", "live"))).alias("judged"),
        F.count_distinct(F.when(F.col("live"), F.col("value"))).alias("n_live"), F.count_distinct(F.when(~F.col("live"), F.col("value"))).alias("n_shared"))
    per_text = stage(per_text, "secret-spans")
    discard(texts, held)
    out = rows.drop("found").join(per_text, "text_key", "left")
    shown = F.filter(F.coalesce("judged", F.array().cast("array<struct<start:long,rank:int,stop:long,value:string,owners:long,repositories:long,live:boolean>>")),
                     lambda s: (s["rank"] < 3) | s["live"])
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform(shown, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return out.select(F.col("id").alias(id_column), "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"),
                      F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
                      "text_key", F.col("judged").alias("found"))


def redact(docs: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """docs with every live secret replaced by "[secret]"; other columns and all rows stay. Copied examples stay readable.

    Spans belong to a text, so rows of equal text are joined by the text's digest, whatever their ids. Overlapping spans are
    replaced as one. Null texts stay null.
    """
    spans = find(docs, text_column=text_column, **options)
    # A span is live or not by its value alone, so equal texts agree.
    live = spans.where(F.col("n_live") > 0).groupBy(F.col("text_key").alias("__key")).agg(F.first("found").alias("__found"))
    live = live.select("__key", F.transform(F.filter("__found", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))).alias("__spans"))
    rows = docs.withColumn("__key", digest(F.col(text_column))).join(live, "__key", "left")
    text = F.col(text_column)

    def between(a, b):
        return F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

    def step(state, span):
        more = F.when(span["start"] >= state["at"], F.concat(between(state["at"], span["start"]), F.lit("[secret]"))).otherwise(F.lit(""))
        moved = F.struct(F.concat(state["done"], more).alias("done"), span["stop"].alias("at"))
        return F.when(span["stop"] <= state["at"], state).otherwise(moved)

    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    joined = F.aggregate("__spans", start, step, lambda s: F.concat(s["done"], between(s["at"], F.length(text).cast("long"))))
    return rows.select(*[F.when(F.col("__spans").isNull(), text).otherwise(joined).alias(c) if c == text_column else F.col(c) for c in docs.columns])
