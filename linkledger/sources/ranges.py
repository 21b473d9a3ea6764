"""Files read by byte range: only the first bytes of many files, or one large file by many tasks."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linkledger.functions.staging import computed_once
from linkledger.functions.text import parse_header
from linkledger.model import COMPONENTS
from linkledger.session import cut_lineage, scratch_path
from linkledger.sources import exports as X

RANGE_BYTES = 16 << 20
TASK_BYTES, FILES_PER_TASK = 16 << 20, 1024
LISTED_ROWS = 10_000


@dataclass
class Piece:
    """Bytes ``start`` to ``end`` of a file, and its size."""

    path: str
    size: int
    start: int
    end: int


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        super().__init__([])
        self.pieces = pieces


class StoredPieces(InputPartition):
    """Pieces that a file of :func:`deal_ranges` names; the task that reads them opens it."""

    def __init__(self, path: str):
        super().__init__([])
        self.path = path

    @property
    def pieces(self) -> Iterator[Piece]:
        import pyarrow.parquet as pq

        store, inside, _ = open_store(self.path)
        with store.open_input_file(inside) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=["path", "size", "start", "end"]):
                yield from (Piece(**r) for r in batch.to_pylist())


def open_store(path: str):
    """(file system, path in it, prefix that makes a path a URI as Spark shows it)."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store, inside, "file:" if isinstance(store, fs.LocalFileSystem) else path.split("://")[0] + "://"


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"], options.get("glob", "*")
        self.head = int(options.get("headbytes", X.HEADER_BYTES))
        self.only_heads = options.get("onlyheads", "false").lower() == "true"
        self.range = int(options.get("rangebytes", RANGE_BYTES))
        self.ranges = options.get("ranges")

    def partitions(self) -> list[Pieces | StoredPieces]:
        from pyarrow import fs

        if self.ranges:
            store, inside, prefix = open_store(self.ranges)
            parts = sorted(i.path for i in store.get_file_info(fs.FileSelector(inside)) if i.base_name.endswith(".parquet"))
            return [StoredPieces(prefix + p) for p in parts]
        store, inside, _ = open_store(self.root)
        infos = store.get_file_info(fs.FileSelector(inside, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.glob) and i.base_name[:1] not in "._")
        parts: list[list[Piece]] = [[]]
        held = 0
        for path, size in files:
            for start in [0] if self.only_heads or not size else range(0, size, self.range):
                end = min(size, self.head if self.only_heads else start + self.range)
                if parts[-1] and (held + end - start > max(self.range, TASK_BYTES) or len(parts[-1]) >= FILES_PER_TASK):
                    parts.append([])
                    held = 0
                parts[-1].append(Piece(path, size, start, end))
                held += end - start
        return [Pieces(p) for p in parts if p]

    def read(self, partition: Pieces | StoredPieces) -> Iterator[tuple]:
        store, _, prefix = open_store(self.root)
        for piece in partition.pieces:
            with store.open_input_file(piece.path) as file:
                head = file.read_at(min(self.head, piece.size), 0)
                if self.only_heads:
                    yield prefix + piece.path, piece.size, 0, head, None
                    continue
                lines = whole_lines(file, piece)
                if lines is not None or not piece.start:
                    yield prefix + piece.path, piece.size, piece.start, head, lines or b""


def whole_lines(file, piece: Piece, step: int = 1 << 16) -> bytes | None:
    """The lines that begin in a range: from the first line start in it to the end of the last line that begins there.

    A range after the first is looked at from the byte before it, so a line that begins exactly at its start is found.
    """
    def after_break(at: int) -> int:
        """Position behind the first line break at or after ``at``; the size if there is none."""
        while at < piece.size:
            found = file.read_at(min(step, piece.size - at), at)
            if (place := found.find(b"\n")) >= 0:
                return at + place + 1
            at += len(found)
        return piece.size

    begin = after_break(piece.start - 1) if piece.start else 0
    if begin >= piece.end:
        return None
    end = after_break(piece.end - 1)
    return file.read_at(end - begin, begin)


class FileRanges(DataSource):
    """``spark.read.format("file_ranges")``: ``path``, ``glob``, ``onlyHeads``, ``headBytes``, ``rangeBytes``, ``ranges``.

    One row per range: the file's first bytes, and in ``content`` the whole lines (ended by a line feed) that begin in the
    range. Small files share a task, large ones are spread. The file system must be one that Arrow opens by URI.
    ``ranges`` is a folder of :func:`deal_ranges`: then the planner names its files only. Without it the planner itself
    lists ``path`` and holds every range, which suits few files; :func:`read_ranges` always deals them.
    """

    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return "path STRING, bytes BIGINT, start BIGINT, head BINARY, content BINARY"

    def reader(self, schema) -> RangeReader:
        return RangeReader({k.lower(): v for k, v in self.options.items()})


def _entries(store, folder: str, glob: str) -> Iterator[tuple[str, int, bool]]:
    """(path, size, whether it is a folder) of the folders and the matching files right below a folder."""
    from pyarrow import fs

    def matches(name: str) -> bool:
        return fnmatch.fnmatch(name, glob) and name[:1] not in "._"

    if isinstance(store, fs.LocalFileSystem):  # as a stream, whatever the folder holds
        with os.scandir(folder or "/") as found:
            for e in found:
                if e.is_dir():
                    yield f"{folder}/{e.name}", 0, True
                elif matches(e.name) and e.is_file():
                    yield f"{folder}/{e.name}", e.stat().st_size, False
    else:
        for i in store.get_file_info(fs.FileSelector(folder)):
            if i.type == fs.FileType.Directory or i.type == fs.FileType.File and matches(i.base_name):
                yield i.path, i.size or 0, i.type == fs.FileType.Directory


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size) of the matching files below a folder, found level by level by tasks and stored.

    A folder is listed by one task. The driver learns only whether a level has folders.
    """
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, _ = open_store(path)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for rows in batched(_entries(store, folder, glob), LISTED_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "size", "folder"])

    level = spark.createDataFrame([(open_store(path)[1].rstrip("/"),)], "path STRING")
    files = []
    while True:
        found = cut_lineage(level.mapInArrow(entries, "path STRING, size BIGINT, folder BOOLEAN"), "listing")
        files.append(found.where(~F.col("folder")).drop("folder"))
        level = found.where("folder").select("path")
        if level.isEmpty():
            return reduce(DataFrame.union, files)
        level = level.repartition(spark.sparkContext.defaultParallelism, "path")


def deal_ranges(files: DataFrame, width: int | None) -> str:
    """Folder of a table (path, size, start, end), one file for each task that is to read: ranges of ``width`` bytes, or one of no bytes for a whole file.

    Tasks get about ``TASK_BYTES`` or ``FILES_PER_TASK`` ranges; the driver gets their two sums.
    """
    count = F.greatest(F.ceil(F.col("size") / width), F.lit(1)) if width else F.lit(1)
    held = F.col("size") if width else F.lit(0)
    total = files.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n"), F.coalesce(F.sum(held), F.lit(0)).alias("bytes")).first()
    n_tasks = max(1, -(-total["n"] // FILES_PER_TASK), -(-total["bytes"] // max(width or 0, TASK_BYTES)))
    zero = F.lit(0).cast("bigint")
    starts = F.sequence(zero, F.greatest(F.col("size") - 1, zero), F.lit(width).cast("bigint")) if width else F.array(zero)
    ranges = files.select("path", "size", F.explode(starts).alias("start"))
    end = F.least(F.col("size"), F.col("start") + width) if width else F.lit(0)
    folder = scratch_path(files.sparkSession, "ranges")
    ranges.select("*", end.cast("bigint").alias("end")).repartition(n_tasks).write.parquet(folder)
    return folder


def read_ranges(spark: SparkSession, path: str, glob: str = "*", only_heads: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of :class:`FileRanges` for the matching files below a folder, listed and dealt by tasks. Runs jobs at once."""
    ranges = deal_ranges(list_files(spark, path, glob), None if only_heads else range_bytes)
    spark.dataSource.register(FileRanges)
    return spark.read.format("file_ranges").option("onlyHeads", str(only_heads).lower()).option("ranges", ranges).load(path)


def read_headers(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """:func:`scan_headers` of a folder, reading no more than the bytes that may hold a header."""
    heads = read_ranges(spark, path, glob, only_heads=True)
    return X.scan_headers(heads.select("path", F.col("head").alias("content")))


def scan_export_rows(spark: SparkSession, path: str, glob: str = "*.txt", range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of exports of any size: rows as a long table, and one reason per file that is left out.

    The reasons are those of :func:`parse_exports`. Lines are parsed in the task that reads their range, once for the marks
    of a range, of which one row per file is stored, and once for the rows. ``start`` and ``line`` order the rows of a file.
    A header must lie in the bytes of ``HEADER_BYTES``, and its line among the first six.
    """
    blocks = read_ranges(spark, path, glob, range_bytes=range_bytes)
    lines = F.split(F.decode("content", "ISO-8859-1"), X._LINE_BREAK)
    files = cut_lineage(judge_files(blocks.select("path", "start", "head", lines.alias("lines"))), "judged_exports")
    good = blocks.select("path", "start", F.posexplode(lines).alias("line", "text")).where(F.trim("text") != "").join(files.where(F.col("reason").isNull()), "path")
    body = good.where(F.struct("start", "line") >= F.col("first")).withColumn("cells", F.split("text", "\t"))
    numbers = [F.trim(F.col("cells")[i]).try_cast("double").alias(name) for i, name in enumerate(("freq", *COMPONENTS))]
    return body.select("path", "h.*", "start", "line", *numbers), files.where(F.col("reason").isNotNull()).select("path", "reason")


def judge_files(blocks: DataFrame) -> DataFrame:
    """(path, h, first, reason): header, place of the first data row and reason to leave a file out, from ``blocks(path, start, head, lines)``.

    A range tells its lines before its first data row from those after, since only the file knows which of them count.
    """
    heads = F.array_join(F.slice(F.split(F.decode("head", "ISO-8859-1"), X._LINE_BREAK), 1, X.HEADER_LINES), "\n")
    placed = computed_once(blocks, {"h": parse_header(heads), "place": F.array_position(F.transform("lines", X._is_data_start), True).cast("int")})

    def marks(lines: Column) -> Column:
        cells = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.split(x, "\t"))
        widths = F.transform(cells, lambda r: F.size(r))
        return F.struct(F.exists(cells, lambda r: F.exists(r, lambda c: ~X.is_numeric(c))).alias("odd"), F.array_min(widths).alias("least"),
                        F.array_max(widths).alias("most"), F.exists(cells, lambda r: F.exists(r, X.is_endless)).alias("endless"))

    n = F.size("lines")
    place = F.when(F.col("place") > 0, F.col("place")).otherwise(n + 1)
    judged = placed.select("path", "start", "h", F.when(F.col("place") > 0, F.struct("start", (F.col("place") - 1).alias("line"))).alias("begins"),
                           marks(F.slice("lines", F.lit(1), place - 1)).alias("before"), marks(F.slice("lines", place, n)).alias("after"))
    first = F.min("begins").over(Window.partitionBy("path"))
    counted = judged.withColumn("first", first).withColumn("before", F.when(F.col("start") > F.col("first.start"), F.col("before"))).withColumn(
        "after", F.when(F.col("start") >= F.col("first.start"), F.col("after")))

    def over(total, mark: str, both) -> Column:
        return both(total(f"before.{mark}"), total(f"after.{mark}")).alias(mark)

    either = lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    files = counted.groupBy("path").agg(
        F.first("h", ignorenulls=True).alias("h"), F.first("first").alias("first"), over(F.bool_or, "odd", either), over(F.min, "least", F.least),
        over(F.max, "most", F.greatest), over(F.bool_or, "endless", either))
    reason = (F.when(F.col("h").isNull(), X.NO_HEADER).when(F.col("first").isNull(), X.NO_ROWS).when(F.col("odd"), X.NOT_NUMERIC)
              .when(F.col("least") != F.col("most"), X.RAGGED).when(F.col("most") != X.COLUMNS, X.NOT_SEVEN).when(F.col("endless"), X.NOT_FINITE))
    return files.select("path", "h", "first", reason.alias("reason"))
