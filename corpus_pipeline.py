"""A training-data pipeline: toxicity, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet to the cluster's
shared folder and read back as the next stage's docs. All but the last return the columns of documents. Rows without a
doc_id are kept by every filter, as nothing refers to them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, near_dedup, packing, secret_scan, store, toxicity
from stillvalid.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    rejected = scored.where("predicted = 1").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates."""
    copies = near_dedup.classes(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    leaked = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows the text."""
    clean = secret_scan.redact(docs.select(*COLUMNS).withColumn("_before", F.col("text")))
    changed = ~F.col("_before").eqNullSafe(F.col("text"))
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [("toxicity", not_toxic), ("near_duplicates", one_of_each_group), ("decontamination", not_leaked),
          ("secrets", without_secrets), ("packing", packed)]

#: The fitted toxicity models, hashes of shingles and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        with store.small_batches(spark):
            docs = store.kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
