"""Measurement text exports: header line, numeric rows, one reason per file that cannot be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkledger.functions.staging import computed_once
from linkledger.functions.text import HEADER_PATTERN, NUMBER_PATTERN, SPECIAL_NUMBER_PATTERN, parse_header
from linkledger.model import COMPONENTS

COLUMNS = 7
HEADER_LINES = 6
HEADER_BYTES = 2048
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85]"

# Reasons in order of precedence.
NO_HEADER = "no point header line"
NO_ROWS = "no numeric data rows"
NOT_NUMERIC = "non-numeric cell"
RAGGED = "ragged rows"
NOT_SEVEN = "not 7 columns"
NOT_FINITE = "NaN or infinity"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``files(path, mtime, bytes, content)``; a file is read by one task and must fit in its memory."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("modificationTime").alias("mtime"),
                                    F.col("length").alias("bytes"), "content")


def _cells(line: Column) -> Column:
    return F.split(line, "\t")


def _is_data_start(line: Column) -> Column:
    cells = _cells(line)
    return (F.size(cells) >= COLUMNS) & F.trim(cells[0]).rlike(r"^[-+\d.eE]+$")


def is_numeric(cell: Column) -> Column:
    return cell.rlike(NUMBER_PATTERN) | cell.rlike(SPECIAL_NUMBER_PATTERN)


def is_endless(cell: Column) -> Column:
    return cell.rlike(SPECIAL_NUMBER_PATTERN) | (F.abs(cell.try_cast("double")) == F.lit(float("inf")))


def parse_exports(files: DataFrame) -> DataFrame:
    """One row per file: header fields, seven arrays and ``reason`` (null for a usable file). No shuffle.

    ``files`` needs ``path`` and ``content`` (binary). Everything a file holds is read, on the task that
    holds the file.
    """
    kept = [c for c in files.columns if c != "content"]
    lines = files.withColumn("__lines", F.split(F.decode("content", "ISO-8859-1"), _LINE_BREAK))
    head = computed_once(lines, {
        "sha256": F.sha2("content", 256),
        "size": F.octet_length("content").cast("bigint"),
        "__header": parse_header(F.array_join(F.slice("__lines", 1, HEADER_LINES), "\n")),
        "__start": F.array_position(F.transform("__lines", _is_data_start), True).cast("int"),
    })
    body = F.filter(F.slice("__lines", F.col("__start"), F.greatest(F.size("__lines"), F.lit(1))), lambda line: F.trim(line) != "")
    rows = computed_once(head, {"__rows": F.when(F.col("__start") > 0, F.transform(body, _cells))})

    widths = F.transform("__rows", lambda r: F.size(r))
    reason = (
        F.when(F.col("__header").isNull(), NO_HEADER)
        .when(F.col("__start") == 0, NO_ROWS)
        .when(F.exists("__rows", lambda r: F.exists(r, lambda c: ~is_numeric(c))), NOT_NUMERIC)
        .when(F.array_min(widths) != F.array_max(widths), RAGGED)
        .when(F.array_max(widths) != COLUMNS, NOT_SEVEN)
        .when(F.exists("__rows", lambda r: F.exists(r, is_endless)), NOT_FINITE)
    )
    reasoned = computed_once(rows.select(*kept, "sha256", "size", "__header", "__start", "__rows"), {"reason": reason})

    def column(i: int) -> Column:
        return F.when(F.col("reason").isNull(), F.transform("__rows", lambda r: F.trim(r[i]).try_cast("double")))

    return reasoned.select(
        *kept, "sha256", "size", "__header.*",
        (F.col("__start") - 1).alias("first_data_line"),
        column(0).alias("freq"),
        *[column(i + 1).alias(name) for i, name in enumerate(COMPONENTS)],
        "reason",
    )


def split_exports(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spectra, points, rejects) views of :func:`parse_exports`; cache the input if several are used."""
    good = parsed.where(F.col("reason").isNull())
    spectra = good.select("point", "path", "freq", *COMPONENTS)
    points = good.select("point", "x", "y", "z", "path", "sha256", F.col("size").alias("bytes"), "first_data_line")
    return spectra, points, rejects_with_reason(parsed)


def rejects_with_reason(parsed: DataFrame) -> DataFrame:
    """Every file that is left out, with its one reason."""
    return parsed.where(F.col("reason").isNotNull()).select("path", "reason")


def scan_exports(spark: SparkSession, path: str, glob: str = "*.txt") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read a folder of exports into (spectra, points, rejects)."""
    return split_exports(parse_exports(read_files(spark, path, glob)))


def scan_headers(files: DataFrame) -> DataFrame:
    """Header fields found in the first 2 048 bytes of each file, null where there is no header."""
    head = F.decode(F.substring("content", 1, HEADER_BYTES), "ISO-8859-1")
    return files.select("path", parse_header(head).alias("h")).select("path", "h.*", F.col("h").isNotNull().alias("readable"))


def render_export(header: Column, rows: Column, preamble: tuple[str, ...] = ("Export", "")) -> Column:
    """Text of an export from a header line and an array of row arrays; the inverse used by fixtures."""
    body = F.array_join(F.transform(rows, lambda r: F.array_join(r, "\t")), "\n")
    names = "Frequency\tReal X\tReal Y\tReal Z\tImag X\tImag Y\tImag Z"
    units = "[ Hz ]\t[ m/s / N ]\t[ m/s / N ]\t[ m/s / N ]\t[ m/s / N ]\t[ m/s / N ]\t[ m/s / N ]"
    return F.concat_ws("\n", *[F.lit(x) for x in preamble], header, F.lit(names), F.lit(units), body)


def header_line(point: Column, x: Column, y: Column, z: Column) -> Column:
    """The header line a scan export carries."""
    text = [c.cast("string") for c in (point, x, y, z)]
    return F.concat(F.lit("Point Index:\t"), text[0], F.lit("\t[x = "), text[1], F.lit("\ty = "), text[2],
                    F.lit("\tz = "), text[3], F.lit("]"))


__all__ = ["HEADER_PATTERN", "parse_exports", "split_exports", "rejects_with_reason", "scan_exports", "scan_headers",
           "read_files", "render_export", "header_line"]
