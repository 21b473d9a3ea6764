"""Coverage of profile fields and criteria: statuses per record, outcomes, labels and subtotals."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED, CONDITIONAL, RECOMMENDED, OPTIONAL = "PROTOTYPE_REQUIRED", "CONDITIONALLY_REQUIRED", "RECOMMENDED", "OPTIONAL"


class Field(NamedTuple):
    """A profile field. ``condition``, ``valid``, ``verified`` and ``review`` are SQL conditions on the record row."""

    name: str
    level: str
    dimension: str
    critical_for: str = ""      # interpretation | reuse | empty
    value: str | None = None    # SQL of the value, the field name by default
    condition: str = "true"
    valid: str = "true"
    verified: str = "true"
    review: str = "false"


class Criterion(NamedTuple):
    """A criterion with SQL conditions on the record row; the first that holds decides."""

    name: str
    dimension: str
    priority: str
    passes: str
    partial: str = "false"
    applies: str = "true"
    verified: str = "true"
    review: str = "false"
    recommendation: str = ""


def field_status(records: DataFrame, fields: Sequence[Field], key: str = "record_id") -> DataFrame:
    """One row per record and field. Fields are unfolded inside each row; nothing is joined."""
    def status(f: Field) -> Column:
        value = F.expr(f.value or f.name).cast("string")
        blank = value.isNull() | (F.trim(value) == "")
        return (F.when(~F.coalesce(F.expr(f.condition), F.lit(False)), "NOT_APPLICABLE").when(blank, "MISSING")
                .when(~F.coalesce(F.expr(f.valid), F.lit(False)), "INVALID").when(F.coalesce(F.expr(f.review), F.lit(False)), "MANUAL_REVIEW")
                .when(~F.coalesce(F.expr(f.verified), F.lit(False)), "NOT_VERIFIED").otherwise("PRESENT"))

    cells = F.array(*[F.struct(F.lit(f.name).alias("field"), F.lit(f.level).alias("level"), F.lit(f.dimension).alias("dimension"),
                               F.lit(f.critical_for).alias("critical_for"), status(f).alias("status")) for f in fields])
    return records.select(key, F.explode(cells).alias("c")).select(key, "c.*")


def completeness_outcome(statuses: DataFrame, key: str = "record_id") -> DataFrame:
    """Outcome per record, the first that applies; coverage of recommended fields is reported beside it."""
    needed = F.col("level").isin(REQUIRED, CONDITIONAL)
    failing = needed & F.col("status").isin("MISSING", "INVALID")
    flags = statuses.groupBy(key).agg(
        F.bool_or(failing & (F.col("critical_for") == "interpretation")).alias("i"), F.bool_or(failing & (F.col("critical_for") == "reuse")).alias("r"),
        F.bool_or(failing).alias("any"), F.bool_or(needed & F.col("status").isin("NOT_VERIFIED", "MANUAL_REVIEW")).alias("open"),
        F.count_if((F.col("level") == RECOMMENDED) & (F.col("status") == "PRESENT")).alias("recommended_present"),
        F.count_if((F.col("level") == RECOMMENDED) & (F.col("status") != "NOT_APPLICABLE")).alias("recommended_active"))
    outcome = (F.when(F.col("i"), "INSUFFICIENT_FOR_INTERPRETATION").when(F.col("r"), "INSUFFICIENT_FOR_REUSE").when(F.col("any"), "PARTIALLY_COMPLETE")
               .when(F.col("open"), "VALIDATION_INCOMPLETE").otherwise("COMPLETE_FOR_PROTOTYPE"))
    return flags.select(key, outcome.alias("outcome"), "recommended_present", "recommended_active")


def coverage_by(statuses: DataFrame, *dims: str) -> DataFrame:
    """Counts per status for every combination of the dimensions, subtotals included (a null marks "all")."""
    return statuses.cube(*dims).agg(F.count(F.lit(1)).alias("fields"), F.count_if(F.col("status") == "PRESENT").alias("present"),
                                    F.count_if(F.col("status") == "MISSING").alias("missing"), F.count_if(F.col("status") == "INVALID").alias("invalid"))


def criterion_results(records: DataFrame, criteria: Sequence[Criterion], key: str = "record_id") -> DataFrame:
    """One row per record and criterion with status and, where it did not pass, a recommendation."""
    yes = lambda sql: F.coalesce(F.expr(sql), F.lit(False))

    def status(c: Criterion) -> Column:
        return (F.when(~yes(c.applies), "NOT_APPLICABLE").when(yes(c.review), "MANUAL_REVIEW").when(~yes(c.verified), "NOT_VERIFIED")
                .when(yes(c.passes), "PASS").when(yes(c.partial), "PARTIAL").otherwise("FAIL"))

    cells = F.array(*[F.struct(F.lit(c.name).alias("criterion"), F.lit(c.dimension).alias("dimension"), F.lit(c.priority).alias("priority"),
                               status(c).alias("status"), F.when(status(c).isin("PARTIAL", "FAIL"), F.lit(c.recommendation)).alias("recommendation")) for c in criteria])
    return records.select(key, F.explode(cells).alias("c")).select(key, "c.*")


def readiness_label(results: DataFrame, key: str = "record_id") -> DataFrame:
    """Label per record: required failures block, open required checks leave it incomplete, recommended ones reduce."""
    needed = F.col("priority").isin(REQUIRED, CONDITIONAL)
    weak = F.col("status").isin("FAIL", "PARTIAL")
    flags = results.groupBy(key).agg(
        F.bool_or(needed & (F.col("status") == "FAIL")).alias("blocked"), F.bool_or(needed & F.col("status").isin("NOT_VERIFIED", "MANUAL_REVIEW")).alias("open"),
        F.bool_or((needed & (F.col("status") == "PARTIAL")) | ((F.col("priority") == RECOMMENDED) & weak)).alias("reduced"))
    label = (F.when(F.col("blocked"), "INSUFFICIENT_METADATA").when(F.col("open"), "ASSESSMENT_INCOMPLETE")
             .when(F.col("reduced"), "PARTIALLY_READY").otherwise("READY_FOR_PROTOTYPE_REUSE"))
    return flags.select(key, label.alias("label"))


def evaluation_metrics(cases: DataFrame) -> DataFrame:
    """One row of rates over ``cases(case_id, injected, expected_code, detected_code, conforms, sha_before, sha_after, run_a, run_b)``."""
    found = F.col("injected") & F.col("detected_code").eqNullSafe(F.col("expected_code"))
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), F.avg(F.col("conforms").cast("int")).alias("conformance_rate"),
        F.try_divide(F.count_if(found), F.count_if("injected")).alias("detection_rate"),
        F.count_if(~F.col("injected") & F.col("detected_code").isNotNull()).alias("false_positives"),
        F.avg(F.col("sha_before").eqNullSafe(F.col("sha_after")).cast("int")).alias("preservation_rate"),
        F.avg(F.col("run_a").eqNullSafe(F.col("run_b")).cast("int")).alias("repeatability"))


def detections_by_code(cases: DataFrame) -> DataFrame:
    return cases.where(F.col("detected_code").isNotNull()).groupBy("detected_code").agg(F.count(F.lit(1)).alias("detections"))


def payload_profile(files: DataFrame, key: str = "path", text: str = "text", separator: str = "\t") -> DataFrame:
    """Per file: lines, numeric rows, widths, rectangular or not, point header, and whether the first cells rise like an axis.

    Nothing about row count or axis is assumed; the whole text is looked at, on the task that holds the row.
    """
    lines = F.filter(F.split(F.col(text), r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    table = files.select(key, F.col(text).contains("Point Index:").alias("header_found"), lines.alias("l"))
    cells = table.withColumn("r", F.transform("l", lambda x: F.split(x, separator)))
    number = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
    numeric = cells.withColumn("n", F.filter("r", lambda row: F.forall(row, lambda c: c.rlike(number))))
    widths = F.transform("n", lambda row: F.size(row))
    first = F.transform("n", lambda row: F.trim(row[0]).try_cast("double"))
    count = F.size("n")
    rising = F.when(count > 1, F.forall(F.zip_with(F.slice("f", F.lit(2), count - 1), F.slice("f", F.lit(1), count - 1), lambda b, a: b > a), lambda x: x))
    return numeric.withColumn("f", first).select(
        key, F.size("l").alias("lines"), count.alias("numeric_rows"), F.array_min(widths).alias("min_width"), F.array_max(widths).alias("max_width"),
        F.coalesce(F.array_min(widths) == F.array_max(widths), F.lit(False)).alias("rectangular"), "header_found", F.coalesce(rising, F.lit(False)).alias("axis_candidate"))


def catalog_search(catalog: DataFrame, **filters) -> DataFrame:
    """Rows that match every given filter; a list means any of its values."""
    out = catalog
    for column, wanted in filters.items():
        out = out.where(F.col(column).isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else F.col(column) == wanted)
    return out
