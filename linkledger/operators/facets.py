"""Faceted search over bitmaps: filters are bit operations, counts stand beside the hits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def facet_index(catalog: DataFrame, id_col: str, facets: Sequence[str]) -> DataFrame:
    """``(facet, value, bucket, bits)``: one bitmap of 4,096 bytes per facet value and 32,768 ids.

    The table is read once; bitmaps are built in the tasks that read and merged by (facet, value, bucket), so a value that a
    third of all rows have is no hot group. ``id_col`` holds distinct non-null integers, best dense ones: a bucket in which a
    value occurs costs a bitmap, so facets are columns of few values. Values are texts; null is a value of its own.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets])).alias("cell")
    each = catalog.select(F.bitmap_bucket_number(id_col).alias("bucket"), F.bitmap_bit_position(id_col).alias("bit"), cells)
    return each.groupBy("cell.facet", "cell.value", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def facet_hits(index: DataFrame, filters: Mapping[str, Sequence[str | None]]) -> DataFrame:
    """``(bucket, bits)`` of the ids that have one of the given values in every filtered facet; all ids without filters.

    Values of a facet are united, facets intersected. A bucket in which a facet has none of its values drops out.
    """
    if not filters:
        return index.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    tests = [(F.col("facet") == f) & reduce(lambda a, b: a | b, [F.col("value").eqNullSafe(F.lit(v)) for v in values], F.lit(False)) for f, values in filters.items()]
    united = index.where(reduce(lambda a, b: a | b, tests)).groupBy("facet", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    met = united.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return met.where((F.col("n") == len(filters)) & (F.bitmap_count("bits") > 0)).select("bucket", "bits")


def facet_counts(index: DataFrame, hits: DataFrame) -> DataFrame:
    """``(facet, value, n)``: how many hits have each value; values of no hit are left out."""
    pairs = index.join(hits.select("bucket", F.col("bits").alias("hit")), "bucket")
    both = pairs.select("facet", "value", "bucket", F.explode(F.array("bits", "hit")).alias("bits"))
    met = both.groupBy("facet", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    return met.groupBy("facet", "value").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def hit_rows(catalog: DataFrame, id_col: str, hits: DataFrame) -> DataFrame:
    """The catalog's rows whose bit is set; rows of buckets without hits are dropped by the join."""
    place = F.bitmap_bit_position(id_col)
    byte = F.conv(F.hex(F.substr("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = catalog.withColumn("__bucket", F.bitmap_bucket_number(id_col)).join(hits.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")), "__bucket")
    return marked.where(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1).select(*catalog.columns)
