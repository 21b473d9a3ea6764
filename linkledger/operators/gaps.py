"""What records declare as absent or unresolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_report(quality: DataFrame) -> DataFrame:
    """``(record_id, section, metric, value)`` with section absent, unresolved or note, one row per value; of a note one
    row per measurement, if there is a ``measurement`` column, with its values joined.

    Long form on purpose: a record's lists have no bound of their own. Unit states that are still open are only
    counted, see :func:`gap_totals`.
    """
    section = (F.when(F.col("metric") == "absentFields", "absent").when(F.col("metric") == "unresolvedFields", "unresolved")
               .when((F.col("metric") == "unitStatus") & F.coalesce(F.col("value").contains("not yet resolved"), F.lit(False)), "units_pending")
               .otherwise("note"))
    if "measurement" in quality.columns:
        listed = F.col("metric").isin("absentFields", "unresolvedFields")
        joined = quality.where(~listed).groupBy("record_id", "measurement", "metric").agg(F.array_join(F.array_sort(F.collect_list("value")), "; ").alias("value"))
        quality = quality.where(listed).select("record_id", "metric", "value").unionByName(joined.select("record_id", "metric", "value"))
    return quality.select("record_id", section.alias("section"), "metric", "value").where(F.col("section") != "units_pending")


def gap_totals(quality: DataFrame) -> DataFrame:
    """Counts per record: absent and unresolved names, and measurements that are pending units or notes.

    With a ``measurement`` column the latter two count measurements, a unit judged by its least value; without one every
    row is a measurement.
    """
    is_absent, is_open = F.col("metric") == "absentFields", F.col("metric") == "unresolvedFields"
    each = quality
    if "measurement" in quality.columns:
        each = quality.groupBy("record_id", "measurement", "metric").agg(F.min("value").alias("value"), F.count("value").alias("__values"))
    else:
        each = quality.withColumn("__values", F.col("value").isNotNull().cast("long"))
    pending = (F.col("metric") == "unitStatus") & F.coalesce(F.col("value").contains("not yet resolved"), F.lit(False))
    names = lambda test: F.coalesce(F.sum(F.when(test, F.col("__values"))), F.lit(0)).cast("long")
    return each.groupBy("record_id").agg(
        names(is_absent).alias("absent"), names(is_open).alias("unresolved"),
        F.count_if(pending).alias("units_pending"), F.count_if(~is_absent & ~is_open & ~pending).alias("notes"))


def gap_frequency(quality: DataFrame) -> DataFrame:
    """How many records declare each gap."""
    gaps = quality.where(F.col("metric").isin("absentFields", "unresolvedFields") & F.col("value").isNotNull())
    return gaps.groupBy("metric", F.col("value").alias("field")).agg(F.count_distinct("record_id").alias("records"))
