"""The operators on the driver tables, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkledger.llm import brown, conversations, decontamination, divergence, license_scan, line_dedup, packing, quality, simhash, substring_dedup, toxicity, vector_search, warc
from linkledger.llm.common import fold, read_table
from linkledger.llm.oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
__all__ = ["ORACLES", "QUERIES"]


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.hex_digits("fp").alias("fingerprint"), F.col("component").alias("component_id"))


@_query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = quality.score_quality(docs, labels, trains=fold("doc_id", 5) != 0)
    return scored.select(F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.build_derivatives(warc.responses_from_pages(read_table(spark, sf_dir, "pages")))
    return records.select(
        F.col("source_id").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length",
        F.sha2("header", 256).alias("header_sha256"), F.sha2("block", 256).alias("block_sha256"))


@_query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.hit_words()
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@_query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@_query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("digest").alias("kept_sha256"))


@_query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vector_search.integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return vector_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@_query
def op8_brown_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = brown.score_texts(read_table(spark, sf_dir, "documents"), trains=fold("doc_id", 7) != 2)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


@_query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, labels, trains=fold("doc_id", 5) != 0)
    return scored.select(F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations")
    found = conversations.repair_reports(conversations.damage(given))
    # Conversations of which no turn is left have a row of zeros.
    every = given.select("conv_id").distinct()
    reports = every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left").drop("conv")
    zeros = reports.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill("", ["audit"])
    return zeros.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


@_query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_divergence(read_table(spark, sf_dir, "documents"))
