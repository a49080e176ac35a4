"""The queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fingerprints, langid, licences, main_text, negatives, packing, secrets, sequences, shards, simhash, url_filter, variants
from tidemark.llm.common import table

# Fixed values of the URL rules.
ALLOW = ["org/", "com/fr/"]
BLOCK = ["example.org/es/", "example.org/en/1", "com/de/"]


def op1_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, folder, "documents"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), ALLOW, BLOCK)


def op3_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op6_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_key")


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(table(spark, folder, "pages"))


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find(table(spark, folder, "documents")).drop("text_key", "found")


def op8_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    out = shards.shard(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(table(spark, folder, "documents"))


def op12_histogram_packing(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.pack(table(spark, folder, "documents"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")))


def _variant_sql() -> str:
    """CRC-32 goes by half bytes, its table of 16 by the rule of its polynomial; near words meet by the pattern that is left without one letter."""
    run = variants.RUN
    step = "xor(c >> 4, t[(xor(c, {half}) & 15) + 1])"
    crc = f"list_reduce(list_prepend(4294967295::bigint, codes), lambda c, h: {step.format(half='h')})"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive bits(i, v, k) as (select i::bigint, i::bigint, 0 from range(16) r(i)
  union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bits where k < 4),
crc_table as (select list(v order by i) t from bits where k = 4),
runs as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{run}{{{variants.MIN_LENGTH},}}')) r from documents),
lowered as (select doc_id, translate(r, '{upper}', '{lower}') r from runs),
distinct_runs as (select doc_id, r, count(*) times, coalesce(doc_id::varchar, '') || ':' || r full_text from lowered group by all),
hexed as (select *, hex(encode(full_text)) x from distinct_runs),
coded as (select doc_id, r, times, list_transform(range(0, len(x)), lambda i: (instr('0123456789ABCDEF', x[(i - i % 2) + 2 - i % 2]) - 1)::bigint) codes from hexed),
hashed as (select r, times, xor({crc}, 4294967295) h from coded, crc_table),
cut as (select times, case when h % {variants.DELETED} = 0 then r[1:(h % len(r))::int] || r[(h % len(r))::int + 2:] else r end word from hashed),
words as (select word, sum(times)::bigint n from cut where len(word) >= {variants.MIN_LENGTH} group by word having sum(times) >= {variants.MIN_COUNT}),
holes as (select word, n, unnest(range(1, len(word) + 1)) p from words),
gaps as (select word, n, p, word[1:p - 1] || word[p + 1:] rest from holes),
near as (select a.word, a.n, b.word other, b.n other_n from gaps a join gaps b on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union select g.word, g.n, w.word, w.n from gaps g join words w on g.rest = w.word union select w.word, w.n, g.word, g.n from gaps g join words w on g.rest = w.word),
best as (select word, count(*) n_near, arg_min(other, struct_pack(a := -other_n, b := other)) other, max(other_n) other_n from near group by word),
forms as (select w.word, w.n, coalesce(n_near, 0) n_near, case when other_n >= {variants.RATIO} * w.n then other end form, case when other_n >= {variants.RATIO} * w.n then other_n end form_n
  from words w left join best on w.word = best.word),
walk(word, here, deep) as (select word, word, 0 from forms union all select walk.word, f.form, deep + 1 from walk join forms f on f.word = walk.here where f.form is not null)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from forms f join (select word, arg_max(here, deep) root from walk group by word) r on r.word = f.word"""


def _negative_sql() -> str:
    pairs = "list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::bigint"
    return f"""
with rows as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor({negatives.SCALE} * x::double)::bigint) q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id anchor_id, b.vec_id other_id, a.label = b.label same, {pairs} score from rows a join rows b on a.vec_id <> b.vec_id where a.vec_id % {negatives.EVERY} = 0),
positive as (select anchor_id, other_id positive_id, score positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= {negatives.POSITIVES})
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id)::integer "rank", other_id negative_id, positive_score, score negative_score
from positive p join scored s on s.anchor_id = p.anchor_id and not same and {negatives.LOW} * positive_score <= 100 * score and 100 * score <= {negatives.HIGH} * positive_score
qualify "rank" <= {negatives.NEGATIVES}"""


def _licence_sql() -> str:
    rows = []
    for name, texts in licences.TEMPLATES.items():
        for t in texts:
            grams = licences._template_bigrams(t)
            rows.append(f"('{name}', [{', '.join(repr(g) for g in grams)}])")
    low, high = licences.THRESHOLD / (2 - licences.THRESHOLD), (2 - licences.THRESHOLD) / licences.THRESHOLD
    return f"""
with templates(licence, grams) as (values {', '.join(rows)}),
lines as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
units as (select doc_id, unnest(range(len(l))) line, unnest(l) unit from lines
          union all select doc_id, -1, text from documents where instr(text, chr(10)) > 0),
worded as (select doc_id, line, regexp_extract_all(lower(unit), '[\\p{{L}}\\p{{N}}]+') w from units),
paired as (select doc_id, line, case when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end b
           from worded where len(w) between 1 and 60),
scored as (select doc_id, line, licence, max(2.0 * len(list_intersect(list_distinct(b), grams)) / (len(b) + len(grams))) dice
           from paired join templates on len(b) between len(grams) * {low!r} and len(grams) * {high!r} group by doc_id, line, licence)
select doc_id, cast(line as integer) line, licence, round(dice, 9) dice from scored where dice >= {licences.THRESHOLD}"""


QUERIES = {"op1_document_fingerprints": op1_document_fingerprints, "op2_url_filter": op2_url_filter, "op3_licence_scan": op3_licence_scan, "op4_best_fit_packing": op4_best_fit_packing,
           "op6_benchmark_leaks": op6_benchmark_leaks, "op7_main_text": op7_main_text, "op5_secret_scan": op5_secret_scan, "op8_byte_shards": op8_byte_shards,
           "op9_simhash_groups": op9_simhash_groups, "op10_language_id": op10_language_id, "op11_spelling_variants": op11_spelling_variants, "op12_histogram_packing": op12_histogram_packing,
           "op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op3_licence_scan": _licence_sql(), "op11_spelling_variants": _variant_sql(), "op13_hard_negatives": _negative_sql()}
