"""Documents to training sequences: quality, shared lines, near copies, benchmark passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkledger.llm import decontamination, line_dedup, packing, quality, simhash
from linkledger.llm.common import cut_lineage, fold, read_table

LEAST_QUALITY = 0.3


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at ``LEAST_QUALITY`` or more, by a model of the labels outside the held-out fold."""
    scored = quality.score_quality(docs, read_table(spark, sf_dir, "labels"), trains=fold("doc_id", 5) != 0)
    kept = scored.where(F.col("score") >= LEAST_QUALITY)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents without the lines that others share; ``n_chars`` follows the text."""
    kept = line_dedup.drop_repeated_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by fingerprints of five-word shingles."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of a benchmark item occurs."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: SQL can express neither the classifier nor the tokenizer; a brute-force version checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
