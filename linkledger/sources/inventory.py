"""File inventories: path, name, size and SHA-256, in full or only for what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkledger.functions.text import file_name
from linkledger.sources.exports import read_files


def hash_files(files: DataFrame) -> DataFrame:
    """``inventory(path, name, mtime, bytes, sha256)`` of a file table with binary ``content``."""
    mtime = F.col("mtime") if "mtime" in files.columns else F.lit(None).cast("timestamp")
    return files.select("path", file_name("path").alias("name"), mtime.alias("mtime"),
                        F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def file_inventory(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    return hash_files(read_files(spark, path, glob))


def incremental_inventory(previous: DataFrame, files: DataFrame) -> DataFrame:
    """Inventory of ``files`` that reuses the hash of every (path, mtime, bytes) already known.

    Only unmatched rows have their content hashed. ``reused`` tells which hashes were taken over.
    """
    known = previous.select(F.col("path").alias("p_path"), F.col("mtime").alias("p_mtime"),
                            F.col("bytes").alias("p_bytes"), F.col("sha256").alias("p_sha256"))
    joined = files.join(
        known,
        (F.col("path") == F.col("p_path")) & F.col("mtime").eqNullSafe(F.col("p_mtime")) & (F.col("bytes") == F.col("p_bytes")),
        "left",
    )
    sha = F.when(F.col("p_sha256").isNotNull(), F.col("p_sha256")).otherwise(F.sha2("content", 256))
    return joined.select("path", file_name("path").alias("name"), "mtime", "bytes", sha.alias("sha256"),
                         F.col("p_sha256").isNotNull().alias("reused"))


def duplicate_names(inventory: DataFrame) -> DataFrame:
    """Names that more than one path carries, with the number of paths and the first path."""
    return (inventory.groupBy("name").agg(F.count(F.lit(1)).alias("paths"), F.min("path").alias("first_path"))
            .where(F.col("paths") > 1))
