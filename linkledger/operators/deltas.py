"""Verdicts kept up to date from changed files: only points, layers and totals that a change touches are worked on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkledger.operators.integrity import assess_points, latest_build, layer_states, overall_from_totals

LAYERS = ("data", "record", "element")
COUNTS = ("valid", "total", "bad", "lines")


def touched_points(deltas: DataFrame, view: DataFrame, records: DataFrame) -> DataFrame:
    """Points whose data file or record file is among the changed paths; ``deltas(path, delta)``."""
    named = [view.select("point", F.col("file").alias("path")), *[records.select("point", F.col(c).alias("path")) for c in ("url", "record_path")]]
    every = reduce(DataFrame.unionByName, named).where(F.col("path").isNotNull())
    return every.join(deltas.select("path"), "path", "left_semi").select("point").distinct()


def assess_touched(touched: DataFrame, view: DataFrame, records: DataFrame, inventory: DataFrame, headers: DataFrame, manifest: DataFrame,
                   elements: DataFrame) -> DataFrame:
    """:func:`assess_points` of the touched points, from the rows of the other tables that they name."""
    of_points = lambda df: df.join(touched, "point", "left_semi")
    v, r = of_points(view), of_points(records)
    paths = v.select(F.col("file").alias("path")).union(r.select("url")).union(r.select("record_path")).where("path IS NOT NULL").distinct()
    of_paths = lambda df: df.join(paths, "path", "left_semi")
    entries = latest_build(manifest).drop("build_id")
    entries = of_paths(entries.where("kind <> 'cache'")).unionByName(of_points(entries.where("kind = 'cache'")))
    return assess_points(v, r, of_paths(inventory), of_paths(headers), entries, of_points(elements))


def _sides(points: DataFrame, prefix: str = "") -> DataFrame:
    """One row per point and layer: state and distinct reasons; the layer ``point`` says whether all three are valid."""
    sides = [F.struct(F.lit(k).alias("layer"), F.col(k).alias("state"), F.array_distinct(f"{k}_reasons").alias("reasons")) for k in LAYERS]
    whole = F.struct(F.lit("point").alias("layer"), F.when(F.col("valid"), "valid").otherwise("unverified").alias("state"), F.array().cast("array<string>").alias("reasons"))
    each = points.select("point", F.explode(F.array(*sides, whole)).alias("s")).select("point", "s.*")
    return each.select("point", "layer", F.col("state").alias(f"{prefix}state"), F.col("reasons").alias(f"{prefix}reasons"))


def _parts(prefix: str) -> dict[str, F.Column]:
    """What a point adds to the counts of a layer."""
    state = F.col(f"{prefix}state")
    parts = {"valid": state == "valid", "total": state.isNotNull(), "bad": ~state.isin("valid", "unverified")}
    return {**{k: F.coalesce(c.cast("long"), F.lit(0)) for k, c in parts.items()}, "lines": F.greatest(F.size(f"{prefix}reasons"), F.lit(0)).cast("long")}


def start_verdicts(points: DataFrame, problems: DataFrame, store: str) -> None:
    """Keep a full assessment below ``store``; ``problems(layer, line)`` are all problem lines, also those of no point."""
    points.write.mode("overwrite").parquet(f"{store}/states/batch=0")
    spark = points.sparkSession
    sides = _sides(spark.read.parquet(f"{store}/states/batch=0"))
    counts = sides.groupBy("layer").agg(*[F.sum(c).alias(k) for k, c in _parts("").items() if k != "lines"])
    lines = problems.groupBy("layer").agg(F.count(F.lit(1)).alias("lines"))
    names = spark.createDataFrame([(k,) for k in (*LAYERS, "point")], "layer STRING")
    totals = names.join(counts, "layer", "left").join(lines, "layer", "left").na.fill(0, list(COUNTS))
    totals.select("layer", *COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{store}/totals/batch=0")


def refresh_verdicts(store: str, batch: int, deltas: DataFrame, view: DataFrame, records: DataFrame, inventory: DataFrame, headers: DataFrame,
                     manifest: DataFrame, elements: DataFrame, prefix: str = "data/") -> None:
    """Take the changed paths of one inventory batch into the verdicts below ``store``.

    ``deltas(path, delta)`` as :func:`linkledger.streaming.inventory.inventory_deltas` gives them; the other tables are those of
    the full assessment, as they are now. Only touched points are assessed again; counts and problem lines of the
    layers change by what they gain and lose, also by files below ``prefix`` that no record or view names. Batches start at 1, in order; a
    repeated batch overwrites its own folders.
    """
    spark = deltas.sparkSession
    touched = touched_points(deltas, view, records)
    fresh = assess_touched(touched, view, records, inventory, headers, manifest, elements)
    fresh.write.mode("overwrite").parquet(f"{store}/states/batch={batch}")
    before = current_states(spark, store, batch - 1)
    now = spark.read.parquet(f"{store}/states").where(F.col("batch") == batch)
    sides = _sides(now, "new_").join(_sides(before.join(now.select("point"), "point", "left_semi"), "old_"), ["point", "layer"], "left")
    differs = ~F.col("old_state").eqNullSafe(F.col("new_state")) | ~F.col("old_reasons").eqNullSafe(F.col("new_reasons"))
    sides.where(differs).write.mode("overwrite").parquet(f"{store}/deltas/batch={batch}")

    gains = spark.read.parquet(f"{store}/deltas").where(F.col("batch") == batch).groupBy("layer").agg(
        *[F.sum(_parts("new_")[k] - _parts("old_")[k]).alias(k) for k in COUNTS])
    known = records.select(F.col("url").alias("path")).union(view.select("file")).where("path IS NOT NULL")
    loose = deltas.where(F.col("path").startswith(prefix) & F.col("delta").isin("new", "gone")).join(known, "path", "left_anti")
    lines = loose.agg(F.lit("data").alias("layer"), *[F.lit(0).cast("long").alias(k) for k in COUNTS[:3]],
                      F.coalesce(F.sum(F.when(F.col("delta") == "new", 1).otherwise(-1)), F.lit(0)).cast("long").alias("lines"))
    last = spark.read.parquet(f"{store}/totals").where(F.col("batch") == batch - 1).select("layer", *COUNTS)
    totals = last.unionByName(gains).unionByName(lines).groupBy("layer").agg(*[F.sum(k).alias(k) for k in COUNTS])
    totals.coalesce(1).write.mode("overwrite").parquet(f"{store}/totals/batch={batch}")


def current_states(spark: SparkSession, store: str, until: int | None = None) -> DataFrame:
    """The latest assessment of each point, of the batches up to ``until``."""
    rows = spark.read.parquet(f"{store}/states")
    if until is not None:
        rows = rows.where(F.col("batch") <= until)
    rest = [c for c in rows.columns if c not in ("point", "batch")]
    return rows.groupBy("point").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("point", "r.*")


def verdict_deltas(spark: SparkSession, store: str, batch: int) -> DataFrame:
    """(point, layer, old, new, old_reasons, new_reasons) of one batch; the layer ``point`` turns ``valid`` or ``unverified`` as a whole."""
    rows = spark.read.parquet(f"{store}/deltas").where(F.col("batch") == batch)
    return rows.select("point", "layer", F.col("old_state").alias("old"), F.col("new_state").alias("new"), "old_reasons", "new_reasons")


def current_layers(spark: SparkSession, store: str, batch: int) -> DataFrame:
    """:func:`layer_verdict` from the kept counts."""
    return layer_states(spark.read.parquet(f"{store}/totals").where((F.col("batch") == batch) & (F.col("layer") != "point")))


def current_overall(spark: SparkSession, store: str, batch: int) -> DataFrame:
    """:func:`overall_verdict` from the kept counts."""
    whole = spark.read.parquet(f"{store}/totals").where((F.col("batch") == batch) & (F.col("layer") == "point"))
    return overall_from_totals(whole.select(F.col("total").alias("points"), F.col("valid").alias("valid_points")), current_layers(spark, store, batch))
