"""What the text operators share: tables, folds, row keys, batch bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkledger.session import cut_lineage, drop_stored, scratch_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
ASCII_SPACE = " \t\n\u000b\u000c\r"
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

__all__ = ["ASCII_LOWER", "ASCII_SPACE", "ASCII_UPPER", "bounded_batches", "cut_lineage", "drop_stored", "fold", "free_name", "keyed", "scratch_path",
           "text_bytes", "text_key", "read_table"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of a text; null is empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("binary"), F.lit(b""))


def text_key(text: str | Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text in joins and groups (null like the empty text)."""
    value = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(value), F.xxhash64(F.lit(1), value)]


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text): all other columns travel in ``row``, so their names cannot clash with an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.struct(*rest).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
