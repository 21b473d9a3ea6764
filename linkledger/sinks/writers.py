"""Writers: records, scan index, spectra cache, manifest and small reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.operators.ordered import ordered
from linkledger.sources.ranges import open_store


def write_records(records: DataFrame, path: str, partition: str | None = None) -> None:
    """One JSON document per line; the target is replaced, so a removed input leaves no record behind."""
    columns = [F.col("text").alias("value"), *([F.col(partition)] if partition else [])]
    writer = records.select(*columns).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).text(path)


def write_triples(triples: DataFrame, path: str) -> None:
    """Triples as parquet, sorted by predicate inside each file: readers that name their predicates skip the other pages."""
    triples.sortWithinPartitions("p").write.mode("overwrite").parquet(path)


def scan_index(points: DataFrame, scan: str, order: list[str], chunk: Column, keep: list[str] | None = None) -> DataFrame:
    """Members of each scan with their place, one row per member; see :func:`scan_index_header` for the head rows."""
    members = ordered(points.select(scan, *dict.fromkeys([*order, *(keep or [])])), [scan], order, chunk, rank="position")
    return members


def scan_index_header(points: DataFrame, scan: str) -> DataFrame:
    """One row per scan: number of points and the description text."""
    counts = points.groupBy(scan).agg(F.count(F.lit(1)).alias("n_points"))
    return counts.withColumn("description", F.format_string("Index of the %d point records", "n_points"))


def write_spectra_cache(cache: DataFrame, path: str) -> None:
    """Cache rows as parquet, one directory per channel."""
    cache.write.mode("overwrite").partitionBy("channel").parquet(path)


def build_manifest(build_id: str, parts: Mapping[str, DataFrame], rejects: DataFrame | None = None) -> DataFrame:
    """``manifest(build_id, kind, path, sha256, point, bytes, reason)`` from inventories by kind and the rejected files."""
    def part(kind: str, df: DataFrame) -> DataFrame:
        optional = {"point": "bigint", "bytes": "bigint", "reason": "string", "sha256": "string"}
        cells = {c: (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in optional.items()}
        return df.select(F.lit(build_id).alias("build_id"), F.lit(kind).alias("kind"), F.col("path").cast("string").alias("path"),
                         cells["sha256"], cells["point"], cells["bytes"], cells["reason"])

    frames = [part(kind, df) for kind, df in parts.items()]
    if rejects is not None:
        frames.append(part("excluded", rejects))
    return reduce(DataFrame.unionByName, frames)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Append a build to the manifest table; earlier builds stay."""
    manifest.write.mode("append").partitionBy("build_id").parquet(path)


def write_report_csv(report: DataFrame, path: str) -> None:
    """A result table as CSV with header, in order of its columns; adaptive execution makes one file of a small one."""
    report.sort(*report.columns).write.mode("overwrite").csv(path, header=True)


def write_files(files: DataFrame, folder: str) -> int:
    """Write ``files(path, content)`` as files of those relative paths below a folder, in tasks; gives their number.

    A file appears under its name when it is complete; a repeated task writes the same files again.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside, _ = open_store(folder)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                target = f"{inside}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                staged = f"{target}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(staged) as out:
                    out.write(content)
                store.move(staged, target)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return files.select("path", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
