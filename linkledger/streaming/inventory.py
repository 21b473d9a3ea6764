"""Files that arrive or change, hashed as they come and merged into an inventory table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkledger.session import cut_lineage
from linkledger.sources.inventory import hash_files

BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def read_file_stream(spark: SparkSession, path: str, glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_batch).load(path)
            .select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"), "content"))


def stream_inventory(spark: SparkSession, path: str, table: str, checkpoint: str, glob: str = "*") -> StreamingQuery:
    """Append the hash of each file that arrives to ``table``, one folder per micro-batch.

    A batch overwrites only its own folder, so a repeated batch leaves the same rows. :func:`current_inventory`
    gives the latest row per path. A file source remembers paths only; :func:`refresh_inventory` finds files that
    change in place or go.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        hash_files(batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (read_file_stream(spark, path, glob).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def refresh_inventory(spark: SparkSession, path: str, table: str, glob: str = "*") -> int:
    """Compare a listing of the folder with the table and append what is new, changed or gone; gives the batch number.

    Files are listed without their content. Paths whose time or size differs are written beside the table, and one read of
    the folder, cut by the times and sizes of the changed files at the scan, takes those in the tasks that hash them; no path
    passes through the driver. A file that is gone leaves a row without hash.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    listing = files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"))
    batches = stored_batches(spark, table)
    batch = 0 if batches is None else batches.agg(F.max("batch")).first()[0] + 1
    out, known = f"{table}/batch={batch}", current_inventory(spark, table) if batch else None
    if known is not None:
        seen = known.select("path", F.col("mtime").alias("k_mtime"), F.col("bytes").alias("k_bytes"))
        listing = listing.join(seen, "path", "left").where(~F.col("mtime").eqNullSafe(F.col("k_mtime")) | ~F.col("bytes").eqNullSafe(F.col("k_bytes")))
        listing = listing.select("path", "mtime", "bytes")
    changed = cut_lineage(listing, "changed-paths")
    low, high, least, most = changed.agg(F.min("mtime"), F.max("mtime"), F.min("bytes"), F.max("bytes")).first()
    if low is not None:
        span = F.col("modificationTime").between(F.lit(low), F.lit(high)) & F.col("length").between(least, most)
        found = files.where(span).select("path", F.col("modificationTime").alias("mtime"), "content").join(changed.select("path"), "path", "left_semi")
        hash_files(found).write.mode("append").parquet(out)
    if known is not None:
        there = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path")
        gone = known.where(F.col("sha256").isNotNull()).join(there, "path", "left_anti")
        gone.select("path", "name", "mtime", "bytes", F.lit(None).cast("string").alias("sha256")).write.mode("append").parquet(out)
    return batch


def stored_batches(spark: SparkSession, table: str) -> DataFrame | None:
    """The table's rows with their ``batch``, or None before the first."""
    try:
        return spark.read.parquet(table)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def current_inventory(spark: SparkSession, table: str, until: int | None = None) -> DataFrame:
    """Latest row per path, of the batches up to ``until``; a path that is gone has no hash."""
    rows = spark.read.parquet(table)
    if until is not None:
        rows = rows.where(F.col("batch") <= until)
    latest = F.max_by(F.struct("name", "mtime", "bytes", "sha256"), F.col("batch"))
    return rows.groupBy("path").agg(latest.alias("r")).select("path", "r.*")


def inventory_deltas(before: DataFrame, now: DataFrame) -> DataFrame:
    """Paths whose state differs: ``new``, ``changed`` or ``gone``."""
    a = before.where(F.col("sha256").isNotNull()).select("path", F.col("sha256").alias("old"))
    joined = a.join(now.where(F.col("sha256").isNotNull()).select("path", F.col("sha256").alias("new")), "path", "full")
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed")
    return joined.select("path", state.alias("delta")).where(F.col("delta").isNotNull())
