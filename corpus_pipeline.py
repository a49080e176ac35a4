"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, secret redaction, best-fit packing.

Every stage reads what the one before it kept, as Parquet; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, packing, secrets, simhash
from tidemark.llm.common import table
from tidemark.session import discard, fresh_path, stage

SIMILAR = 0.8  # Jaccard similarity of five-word shingles from which near copies link


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID does not reject; null texts and texts without letters go. Rows are judged one by one."""
    judged = langid.classify(docs, langid.fit(docs), prefix="__language_")
    return judged.where(~F.col("__language_rejected")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least id. Rows that repeat that id give one row, the first by text.

    Texts link within op9's four bits, or at SIMILAR whatever their fingerprints. Rows without an id can't stand for a group; of those, one of each equal text stays.
    """
    found = simhash.near_duplicates(docs, similar=SIMILAR)
    groups = found.where(F.col("component_id").isNotNull()).groupBy(F.col("component_id").alias("__keep"))
    kept = stage(groups.agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("__times")), "pipeline-representatives")
    discard(found)
    single = docs.join(kept.where("__times = 1"), F.col("doc_id") == F.col("__keep"), "left_semi")
    # Ids are unique but for repeated rows; only those and rows without an id are compared as wholes.
    again = docs.join(kept.where("__times > 1"), F.col("doc_id") == F.col("__keep")).groupBy("__keep")
    again = again.agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns))).alias("__row")).select("__row.*")
    nameless = docs.where(F.col("doc_id").isNull()).groupBy(F.col("text").alias("__text"))
    nameless = nameless.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
    return single.unionByName(again).unionByName(nameless)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live secrets replaced in the text and n_chars counted anew; copied examples stay."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNull() | F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return packing.pack(docs)


STAGES = [("language ID", known_language), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminated),
          ("secret scans", without_secrets), ("best-fit packing", packed)]
# Fingerprints, latent retrieval and packing are beyond SQL; tests compare the stages with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
