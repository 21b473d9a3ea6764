"""Model elements: targets, extents, layers and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkledger.functions.hashing import fingerprint
from linkledger.operators.ordered import number_chunk, ordered

AXES = ("x", "y", "z")


def fingerprint_elements(elements: DataFrame, rounding: str = "binary") -> DataFrame:
    """Add ``fingerprint`` to ``elements(gid, cls, material, lo, hi)`` with three-cell corner arrays."""
    corners = [[F.get(side, i) for i in range(3)] for side in ("lo", "hi")]
    return elements.withColumn("fingerprint", fingerprint("gid", "cls", "material", *corners, rounding=rounding))


def select_targets(elements: DataFrame, edges: DataFrame, gid: str | None = None, mode: str = "auto") -> DataFrame:
    """Elements a measurement is about, with ``kind`` (single, parts, all) and ``role`` (target, part).

    An explicit id takes itself and its children; otherwise a lone element, else the lone assembly with its
    children, else everything. Decisions rest on two scalar counts, the rows are found with semi joins. An explicit id
    that no element has gives one row with that id, all else null and ``kind`` unknown.
    """
    known_edges = edges.join(elements.select(F.col("gid").alias("child")), "child", "left_semi")
    parents = known_edges.select(F.col("parent").alias("gid")).distinct()
    if gid is not None:
        target = elements.where(F.col("gid") == gid)
    elif mode == "all":
        target = elements.limit(0)
    else:
        total = elements.agg(F.count(F.lit(1))).scalar()
        assemblies = elements.join(parents, "gid", "left_semi")
        assembly_count = assemblies.agg(F.count(F.lit(1))).scalar()
        alone = elements.where(total == 1)
        target = alone.unionByName(assemblies.where((total > 1) & (assembly_count == 1)))
    children = known_edges.join(target.select(F.col("gid").alias("parent")), "parent", "left_semi").select(F.col("child").alias("gid")).distinct()
    found_target = target.agg(F.count(F.lit(1))).scalar()
    found_children = children.agg(F.count(F.lit(1))).scalar()
    kind = F.when(found_children > 0, "parts").otherwise("single")
    chosen = target.withColumn("role", F.lit("target")).unionByName(
        elements.join(children, "gid", "left_semi").withColumn("role", F.lit("part"))).withColumn("kind", kind)
    if gid is not None:
        wanted = elements.sparkSession.range(1).select(F.lit(gid).alias("gid"))
        unknown = wanted.join(elements.select("gid"), "gid", "left_anti").select(
            *[(F.col("gid") if c == "gid" else F.lit(None)).cast(elements.schema[c].dataType).alias(c) for c in elements.columns],
            F.lit(None).cast("string").alias("role"), F.lit("unknown").alias("kind"))
        return chosen.unionByName(unknown)
    everything = elements.where(found_target == 0).withColumns({"role": F.lit("part"), "kind": F.lit("all")})
    return chosen.unionByName(everything)


def bbox_union(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Extent per key over ``lo_x..hi_z`` columns with length, thickness and height."""
    aggs = [F.min(f"lo_{a}").alias(f"lo_{a}") for a in AXES] + [F.max(f"hi_{a}").alias(f"hi_{a}") for a in AXES]
    box = elements.groupBy(*keys).agg(*aggs)
    sizes = [(F.col(f"hi_{a}") - F.col(f"lo_{a}")).alias(n) for a, n in zip(AXES, ("length", "thickness", "height"))]
    return box.select("*", *sizes)


def centroid(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean position over all points, or per key."""
    return points.groupBy(*(keys or [])).agg(*[F.avg(a).alias(a) for a in AXES])


def layer_offsets(layers: DataFrame, key: str = "gid", order: tuple[str, ...] = ("layer_order",), chunk=None) -> DataFrame:
    """Running thickness before each layer (``offset_m``) and after it (``end_m``), in layer order."""
    chunk = number_chunk(order[0]) if chunk is None else chunk
    out = ordered(layers, [key], list(order), chunk, running_sum={"end_m": "thickness_m"})
    return out.withColumn("offset_m", F.col("end_m") - F.col("thickness_m"))


def unit_mismatch(layers: DataFrame, boxes: DataFrame, units: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Elements whose declared unit is millimetre although the layer sum equals the thickness in metres."""
    total = layers.groupBy("gid").agg(F.sum("thickness_m").alias("layer_sum"))
    found = total.join(boxes.select("gid", "thickness"), "gid").join(units.select("gid", "unit"), "gid")
    odd = (F.col("unit") == "MILLIMETRE") & (F.abs(F.col("layer_sum") - F.col("thickness")) < tol)
    return found.where(odd).select("gid", "layer_sum", "thickness", F.lit("layer thickness is written in metres").alias("note"))


def relative_offsets(elements: DataFrame, key: str) -> DataFrame:
    """Offset of each part from the lowest face of its specimen, and its own thickness.

    The low face is a partial aggregate per specimen joined back, not a window over the specimen.
    """
    low = elements.groupBy(key).agg(F.min("lo_y").alias("__low"))
    return (elements.join(low, key)
            .withColumns({"offset_m": F.round(F.col("lo_y") - F.col("__low"), 6) + 0.0,
                          "thickness_m": F.round(F.col("hi_y") - F.col("lo_y"), 6) + 0.0}).drop("__low"))


def bound_elements(flat: DataFrame) -> DataFrame:
    """``bound(record_id, gid, fingerprint)``: target and sub-elements that have both an id and a fingerprint."""
    each = flat.select("record_id", F.explode(F.array_distinct("binding.targets")).alias("t"))
    return each.where(F.col("t.gid").isNotNull() & F.col("t.fingerprint").isNotNull()).select("record_id", "t.gid", "t.fingerprint")


