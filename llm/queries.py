"""Registered queries: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillvalid.sources.tables import table

from . import class_lm, decontaminate, near_dedup, packing, prefix_trie, secret_scan, spelling, suffix_dedup, token_files, topk, toxicity, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, folder, "pages"))


def op2_threshold_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_bin_slack_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(table(spark, folder, "documents"))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


def op7_kneser_ney_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def op8_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.classes(table(spark, folder, "documents"))


def op9_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, folder, "documents"))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(table(spark, folder, "conversations")))


def op12_brown_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    return class_lm.score(table(spark, folder, "documents"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.words_of(table(spark, folder, "documents")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_url_filters, op2_threshold_topk, op3_latent_decontamination, op4_bin_slack_packing, op5_token_files,
    op6_secret_scan, op7_kneser_ney_toxicity, op8_order_minhash, op9_warc_index, op10_suffix_dedup,
    op11_conversation_trie, op12_brown_class_lm, op13_spelling_variants)}
SQL: dict[str, str] = {"op1_url_filters": url_filter.sql(), "op2_threshold_topk": topk.SQL,
                       "op11_conversation_trie": prefix_trie.SQL, "op13_spelling_variants": spelling.SQL}
