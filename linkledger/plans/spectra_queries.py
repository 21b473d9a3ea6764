"""Queries on spectra and element geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkledger.operators import elements as E
from linkledger.operators import spectra as SP
from linkledger.operators.ordered import number_chunk
from linkledger.plans import standins as S
from linkledger.plans.catalog import query
from linkledger.sources.exports import parse_exports


@query("spectral_levels", "WITH " + S.LEVELS_SQL + """
SELECT point, bin::BIGINT AS bin, freq, round(X,4) AS X, round(Y,4) AS Y, round(Z,4) AS Z, round(NORM,4) AS NORM FROM LEVELS""")
def spectral_levels(spark, sf_dir):
    levels = SP.spectral_levels(S.spectra(spark, sf_dir))
    return levels.select("point", F.col("bin").cast("bigint").alias("bin"), "freq", *[F.round(c, 4).alias(c) for c in ("X", "Y", "Z", "NORM")])


# Axis of the exported files: code 11 starts ten higher, code 12 ends half a step late.
AXIS_SQL = f"""A AS (SELECT {S.EXPORT_PATH_SQL} AS path, vec_id, CASE WHEN vec_id%16=10 THEN vec_id-10 ELSE vec_id END AS point,
  CASE WHEN vec_id%16=11 THEN 30.0 ELSE 20.0 END::DOUBLE AS f_min, CASE WHEN vec_id%16=11 THEN 39.0 WHEN vec_id%16=12 THEN 29.5 ELSE 29.0 END::DOUBLE AS f_max,
  1.0::DOUBLE AS step, 10::BIGINT AS bins FROM embeddings WHERE vec_id%16 NOT IN (1,2,3,4,5,6,7,8))"""


@query("axis_summary", "WITH " + AXIS_SQL + " SELECT path, point, f_min, f_max, step, bins FROM A")
def axis_summary(spark, sf_dir):
    good = parse_exports(S.exports(spark, sf_dir)).where(F.col("reason").isNull())
    return SP.axis_summary(good).select("path", "point", "f_min", "f_max", "step", F.col("bins").cast("bigint").alias("bins"))


@query("axis_consistency", "WITH " + AXIS_SQL + " SELECT path, vec_id%16 NOT IN (11,12) AS axis_ok FROM A")
def axis_consistency(spark, sf_dir):
    good = parse_exports(S.exports(spark, sf_dir)).where(F.col("reason").isNull())
    return SP.axis_consistency(good).select("path", "axis_ok")


@query("dedupe_points", "WITH " + AXIS_SQL + """, K AS (SELECT path, point, first_value(path) OVER (PARTITION BY point ORDER BY path) AS winner FROM A)
SELECT path, point, CASE WHEN path<>winner THEN 'point index ' || point || ' already read from ' || winner END AS reason FROM K""")
def dedupe_points(spark, sf_dir):
    good = parse_exports(S.exports(spark, sf_dir)).where(F.col("reason").isNull()).select("point", "path")
    kept, listed = SP.dedupe_points(good)
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(listed.select("point", "path", "reason"))


@query("level_at_frequency", "WITH " + S.LEVELS_SQL + " SELECT point, 24.0::DOUBLE AS freq, round(Z,4) AS level_db FROM LEVELS WHERE bin=4")
def level_at_frequency(spark, sf_dir):
    # 24.5 Hz lies between two bins; the first one wins.
    at = SP.level_at_frequency(S.spectra(spark, sf_dir), 24.5, "Z")
    return at.select("point", "freq", F.round("level_db", 4).alias("level_db"))


@query("level_range", "WITH " + S.LEVELS_SQL + " SELECT round(min(NORM),4) AS min_db, round(max(NORM),4) AS max_db FROM LEVELS")
def level_range(spark, sf_dir):
    r = SP.level_range(SP.spectral_levels(S.spectra(spark, sf_dir)), "NORM")
    return r.select(F.round("min_db", 4).alias("min_db"), F.round("max_db", 4).alias("max_db"))


def boxes(spark, sf_dir):
    """Line items as boxes of the part they name: price, quantity and discount span the axes."""
    i = S.table(spark, sf_dir, "lineitem")
    return i.select(F.col("l_partkey").alias("gid"), F.col("l_orderkey").alias("box"), "l_linenumber", "l_suppkey",
                    F.col("l_quantity").alias("lo_x"), F.col("l_discount").alias("lo_y"), F.col("l_tax").alias("lo_z"),
                    (F.col("l_quantity") + 2).alias("hi_x"), (F.col("l_discount") + F.col("l_linenumber")).alias("hi_y"), (F.col("l_tax") + 1).alias("hi_z"))


@query("bbox_union", """
SELECT l_partkey AS gid, min(l_quantity) AS lo_x, round(min(l_discount),6) AS lo_y, max(l_quantity)+2 AS hi_x, round(max(l_discount+l_linenumber),6) AS hi_y,
  max(l_quantity)+2-min(l_quantity) AS length, round(max(l_discount+l_linenumber)-min(l_discount),6) AS thickness, round(max(l_tax+1)-min(l_tax),6) AS height FROM lineitem GROUP BY 1""")
def bbox_union(spark, sf_dir):
    b = E.bbox_union(boxes(spark, sf_dir), ["gid"])
    return b.select("gid", "lo_x", F.round("lo_y", 6).alias("lo_y"), "hi_x", F.round("hi_y", 6).alias("hi_y"), "length", F.round("thickness", 6).alias("thickness"), F.round("height", 6).alias("height"))


@query("centroid", "SELECT l_returnflag AS face, round(avg(l_quantity),6) AS x, round(avg(l_discount),6) AS y, round(avg(l_tax),6) AS z FROM lineitem GROUP BY 1")
def centroid(spark, sf_dir):
    p = S.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("face"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    return E.centroid(p, ["face"]).select("face", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("layer_offsets", """
SELECT l_suppkey AS gid, l_orderkey, l_linenumber, l_partkey, l_quantity AS thickness_m,
  (sum(l_quantity) OVER w - l_quantity)::DOUBLE AS offset_m, (sum(l_quantity) OVER w)::DOUBLE AS end_m FROM lineitem
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice ROWS UNBOUNDED PRECEDING)""")
def layer_offsets(spark, sf_dir):
    # A supplier's items stand for the layers of a stack; quantities are whole numbers, so sums are exact.
    i = S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("gid"), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice",
                                                  F.col("l_quantity").alias("thickness_m"))
    out = E.layer_offsets(i, "gid", ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"), number_chunk("l_orderkey", 1024))
    return out.select("gid", "l_orderkey", "l_linenumber", "l_partkey", "thickness_m", "offset_m", "end_m")


@query("unit_mismatch", """
WITH L AS (SELECT l_orderkey AS gid, round(sum(l_extendedprice),2) AS s FROM lineitem GROUP BY 1)
SELECT gid, s AS layer_sum, CASE WHEN gid%4=0 THEN s ELSE s+1 END AS thickness, 'layer thickness is written in metres' AS note FROM L WHERE gid%4=0 AND gid%3<>0""")
def unit_mismatch(spark, sf_dir):
    i = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_extendedprice").alias("thickness_m"))
    # Geometry equal to the layer sum for some elements, apart by one for the others.
    true_size = i.groupBy("gid").agg(F.round(F.sum("thickness_m"), 2).alias("s"))
    boxes_ = true_size.select("gid", F.when(F.col("gid") % 4 == 0, F.col("s")).otherwise(F.col("s") + 1).alias("thickness"))
    units = true_size.select("gid", F.when(F.col("gid") % 3 == 0, "METRE").otherwise("MILLIMETRE").alias("unit"))
    out = E.unit_mismatch(i, boxes_, units)
    return out.select("gid", F.round("layer_sum", 2).alias("layer_sum"), "thickness", "note")


@query("relative_offsets", """
SELECT l_partkey AS gid, l_orderkey AS box, l_linenumber, l_suppkey, round(l_discount - min(l_discount) OVER (PARTITION BY l_partkey), 6) AS offset_m, l_linenumber::DOUBLE AS thickness_m FROM lineitem""")
def relative_offsets(spark, sf_dir):
    return E.relative_offsets(boxes(spark, sf_dir), "gid").select("gid", "box", "l_linenumber", "l_suppkey", "offset_m", "thickness_m")


def edges(spark, sf_dir):
    """Regions and nations as elements; a region is the assembly of its nations."""
    r = S.table(spark, sf_dir, "region").select(F.col("r_name").alias("gid"), F.lit("IfcWall").alias("cls"))
    n = S.table(spark, sf_dir, "nation")
    both = r.unionByName(n.select(F.col("n_name").alias("gid"), F.lit("IfcWall").alias("cls")))
    links = n.join(S.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    return both, links


@query("select_targets", """
SELECT 'explicit' AS run, r_name AS gid, 'target' AS role, 'parts' AS kind FROM region WHERE r_name='ASIA'
UNION ALL SELECT 'explicit', n_name, 'part', 'parts' FROM nation JOIN region ON n_regionkey=r_regionkey WHERE r_name='ASIA'
UNION ALL SELECT 'leaf', n_name, 'target', 'single' FROM nation WHERE n_name='NATION_3'
UNION ALL SELECT 'auto', r_name, 'part', 'all' FROM region UNION ALL SELECT 'auto', n_name, 'part', 'all' FROM nation""")
def select_targets(spark, sf_dir):
    elements, links = edges(spark, sf_dir)
    named = lambda run, df: df.select(F.lit(run).alias("run"), "gid", "role", "kind")
    return (named("explicit", E.select_targets(elements, links, gid="ASIA")).unionByName(named("leaf", E.select_targets(elements, links, gid="NATION_3")))
            .unionByName(named("auto", E.select_targets(elements, links))))


@query("bound_elements", "WITH " + S.RECORD_SQL + """
SELECT record_id, 'G' || lpad(doc_id::VARCHAR, CASE WHEN k=14 THEN 20 ELSE 21 END, '0') AS gid, sha256('fp' || doc_id) AS fingerprint FROM R WHERE k<>15
UNION ALL SELECT record_id, 'P' || lpad(doc_id::VARCHAR, 21, '0'), sha256('part' || doc_id) FROM R WHERE doc_id%2=1""")
def bound_elements(spark, sf_dir):
    return E.bound_elements(S.flat_records(spark, sf_dir))


@query("fingerprint_elements", """
SELECT l_partkey AS gid, l_orderkey, l_linenumber, l_suppkey, sha256(l_partkey || '|IfcWall|' || l_returnflag || '|' || printf('%.3f', l_quantity) || ',' || printf('%.3f', l_discount) || ',' || printf('%.3f', l_tax)
  || '|' || printf('%.3f', l_quantity+2) || ',' || printf('%.3f', l_discount+1) || ',' || printf('%.3f', l_tax+1)) AS fingerprint FROM lineitem""")
def fingerprint_elements(spark, sf_dir):
    i = S.table(spark, sf_dir, "lineitem")
    e = i.select(F.col("l_partkey").alias("gid"), "l_orderkey", "l_linenumber", "l_suppkey", F.lit("IfcWall").alias("cls"), F.col("l_returnflag").alias("material"),
                 F.array("l_quantity", "l_discount", "l_tax").alias("lo"), F.array(F.col("l_quantity") + 2, F.col("l_discount") + 1, F.col("l_tax") + 1).alias("hi"))
    return E.fingerprint_elements(e).select("gid", "l_orderkey", "l_linenumber", "l_suppkey", "fingerprint")
