"""Queries on coverage, criteria and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkledger.operators import coverage as C
from linkledger.operators import facets as FA
from linkledger.plans import standins as S
from linkledger.plans.catalog import query

FIELDS = [
    C.Field("c_name", C.REQUIRED, "F", "interpretation", value="CASE WHEN c_custkey%12=0 THEN '' ELSE c_name END"),
    C.Field("c_mktsegment", C.REQUIRED, "R", "reuse", valid="c_custkey%15 <> 1"),
    C.Field("c_acctbal", C.CONDITIONAL, "R", condition="c_mktsegment = 'BUILDING'", valid="c_acctbal >= 0"),
    C.Field("c_nationkey", C.REQUIRED, "I", verified="c_nationkey % 5 <> 0"),
    C.Field("licence", C.RECOMMENDED, "A", value="CASE WHEN c_custkey%2=0 THEN 'CC' END", review="c_custkey % 8 = 0"),
]
FIELD_SQL = """B AS (SELECT c_custkey AS record_id, c_custkey, c_mktsegment, c_acctbal, c_nationkey FROM customer),
FS AS (SELECT record_id, 'c_name' AS field, 'PROTOTYPE_REQUIRED' AS level, 'F' AS dimension, 'interpretation' AS critical_for, CASE WHEN c_custkey%12=0 THEN 'MISSING' ELSE 'PRESENT' END AS status FROM B
  UNION ALL SELECT record_id, 'c_mktsegment', 'PROTOTYPE_REQUIRED', 'R', 'reuse', CASE WHEN c_custkey%15=1 THEN 'INVALID' ELSE 'PRESENT' END FROM B
  UNION ALL SELECT record_id, 'c_acctbal', 'CONDITIONALLY_REQUIRED', 'R', '', CASE WHEN c_mktsegment<>'BUILDING' THEN 'NOT_APPLICABLE' WHEN c_acctbal<0 THEN 'INVALID' ELSE 'PRESENT' END FROM B
  UNION ALL SELECT record_id, 'c_nationkey', 'PROTOTYPE_REQUIRED', 'I', '', CASE WHEN c_nationkey%5=0 THEN 'NOT_VERIFIED' ELSE 'PRESENT' END FROM B
  UNION ALL SELECT record_id, 'licence', 'RECOMMENDED', 'A', '', CASE WHEN c_custkey%2<>0 THEN 'MISSING' WHEN c_custkey%8=0 THEN 'MANUAL_REVIEW' ELSE 'PRESENT' END FROM B)"""


def statuses(spark, sf_dir):
    return C.field_status(S.table(spark, sf_dir, "customer").withColumn("record_id", F.col("c_custkey")), FIELDS)


@query("field_status", "WITH " + FIELD_SQL + " SELECT * FROM FS")
def field_status(spark, sf_dir):
    return statuses(spark, sf_dir)


@query("completeness_outcome", "WITH " + FIELD_SQL + """, X AS (SELECT record_id, max(CASE WHEN field='c_name' THEN status END) AS n, max(CASE WHEN field='c_mktsegment' THEN status END) AS m,
  max(CASE WHEN field='c_acctbal' THEN status END) AS b, max(CASE WHEN field='c_nationkey' THEN status END) AS k, max(CASE WHEN field='licence' THEN status END) AS l FROM FS GROUP BY 1)
SELECT record_id, CASE WHEN n='MISSING' THEN 'INSUFFICIENT_FOR_INTERPRETATION' WHEN m='INVALID' THEN 'INSUFFICIENT_FOR_REUSE' WHEN b='INVALID' THEN 'PARTIALLY_COMPLETE' WHEN k='NOT_VERIFIED' THEN 'VALIDATION_INCOMPLETE' ELSE 'COMPLETE_FOR_PROTOTYPE' END AS outcome,
  (l='PRESENT')::BIGINT AS recommended_present, 1::BIGINT AS recommended_active FROM X""")
def completeness_outcome(spark, sf_dir):
    return C.completeness_outcome(statuses(spark, sf_dir))


@query("completeness_by_group", "WITH " + FIELD_SQL + """
SELECT level, dimension, count(*)::BIGINT AS fields, count(*) FILTER (status='PRESENT')::BIGINT AS present, count(*) FILTER (status='MISSING')::BIGINT AS missing, count(*) FILTER (status='INVALID')::BIGINT AS invalid FROM FS GROUP BY CUBE(level, dimension)""")
def completeness_by_group(spark, sf_dir):
    return C.coverage_by(statuses(spark, sf_dir), "level", "dimension")


CRITERIA = [
    C.Criterion("F1", "F", C.REQUIRED, "s_name IS NOT NULL AND s_suppkey % 9 <> 0", recommendation="add an identifier"),
    C.Criterion("A1", "A", C.CONDITIONAL, "s_acctbal >= 0", applies="s_nationkey < 20", verified="s_suppkey % 7 <> 0", recommendation="document access"),
    C.Criterion("I1", "I", C.RECOMMENDED, "s_suppkey % 4 = 0", partial="s_suppkey % 4 = 1", recommendation="name the format"),
    C.Criterion("R1", "R", C.OPTIONAL, "false", review="s_suppkey % 2 = 0", recommendation="state the licence"),
]
CRITERION_SQL = """CR AS (SELECT s_suppkey AS record_id, 'F1' AS criterion, 'F' AS dimension, 'PROTOTYPE_REQUIRED' AS priority, CASE WHEN s_suppkey%9<>0 THEN 'PASS' ELSE 'FAIL' END AS status, 'add an identifier' AS rec FROM supplier
  UNION ALL SELECT s_suppkey, 'A1', 'A', 'CONDITIONALLY_REQUIRED', CASE WHEN s_nationkey>=20 THEN 'NOT_APPLICABLE' WHEN s_suppkey%7=0 THEN 'NOT_VERIFIED' WHEN s_acctbal>=0 THEN 'PASS' ELSE 'FAIL' END, 'document access' FROM supplier
  UNION ALL SELECT s_suppkey, 'I1', 'I', 'RECOMMENDED', CASE s_suppkey%4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PARTIAL' ELSE 'FAIL' END, 'name the format' FROM supplier
  UNION ALL SELECT s_suppkey, 'R1', 'R', 'OPTIONAL', CASE WHEN s_suppkey%2=0 THEN 'MANUAL_REVIEW' ELSE 'FAIL' END, 'state the licence' FROM supplier)"""


def criteria(spark, sf_dir):
    return C.criterion_results(S.table(spark, sf_dir, "supplier").withColumn("record_id", F.col("s_suppkey")), CRITERIA)


@query("criterion_results", "WITH " + CRITERION_SQL + " SELECT record_id, criterion, dimension, priority, status, CASE WHEN status IN ('PARTIAL','FAIL') THEN rec END AS recommendation FROM CR")
def criterion_results(spark, sf_dir):
    return criteria(spark, sf_dir)


@query("readiness_label", "WITH " + CRITERION_SQL + """
SELECT record_id, CASE WHEN bool_or(priority IN ('PROTOTYPE_REQUIRED','CONDITIONALLY_REQUIRED') AND status='FAIL') THEN 'INSUFFICIENT_METADATA'
  WHEN bool_or(priority IN ('PROTOTYPE_REQUIRED','CONDITIONALLY_REQUIRED') AND status IN ('NOT_VERIFIED','MANUAL_REVIEW')) THEN 'ASSESSMENT_INCOMPLETE'
  WHEN bool_or(priority='RECOMMENDED' AND status IN ('FAIL','PARTIAL')) THEN 'PARTIALLY_READY' ELSE 'READY_FOR_PROTOTYPE_REUSE' END AS label FROM CR GROUP BY 1""")
def readiness_label(spark, sf_dir):
    return C.readiness_label(criteria(spark, sf_dir))


def cases(spark, sf_dir):
    """Documents as evaluation cases with injected and detected issues."""
    d = S.table(spark, sf_dir, "documents")
    n, sha = F.col("doc_id"), F.sha2("text", 256)
    expected = F.when(n % 4 == 0, "MEASUREMENT_HASH_MISMATCH").when(n % 4 == 1, "IFC_CLASS_MISMATCH")
    detected = F.when(n % 20 == 0, F.lit(None)).when(n % 25 == 2, "FALSE_ALARM").otherwise(expected)
    return d.select(n.alias("case_id"), (n % 4 < 2).alias("injected"), expected.alias("expected_code"), detected.alias("detected_code"), (n % 4 >= 2).alias("conforms"),
                    sha.alias("sha_before"), F.when(n % 50 == 3, F.reverse(sha)).otherwise(sha).alias("sha_after"), F.lit("a").alias("run_a"), F.when(n % 10 == 9, "b").otherwise("a").alias("run_b"))


CASE_SQL = """K AS (SELECT doc_id, CASE doc_id%4 WHEN 0 THEN 'MEASUREMENT_HASH_MISMATCH' WHEN 1 THEN 'IFC_CLASS_MISMATCH' END AS e FROM documents),
K2 AS (SELECT *, CASE WHEN doc_id%20=0 THEN NULL WHEN doc_id%25=2 THEN 'FALSE_ALARM' ELSE e END AS d FROM K)"""


@query("evaluation_metrics", "WITH " + CASE_SQL + """
SELECT count(*)::BIGINT AS cases, round(avg((doc_id%4>=2)::INT),6) AS conformance_rate, round(count(*) FILTER (doc_id%4<2 AND d IS NOT DISTINCT FROM e)/count(*) FILTER (doc_id%4<2),6) AS detection_rate,
  count(*) FILTER (doc_id%4>=2 AND d IS NOT NULL)::BIGINT AS false_positives, round(avg((doc_id%50<>3)::INT),6) AS preservation_rate, round(avg((doc_id%10<>9)::INT),6) AS repeatability FROM K2""")
def evaluation_metrics(spark, sf_dir):
    m = C.evaluation_metrics(cases(spark, sf_dir))
    return m.select("cases", "false_positives", *[F.round(c, 6).alias(c) for c in ("conformance_rate", "detection_rate", "preservation_rate", "repeatability")])


@query("detections_by_code", "WITH " + CASE_SQL + " SELECT d AS detected_code, count(*)::BIGINT AS detections FROM K2 WHERE d IS NOT NULL GROUP BY 1")
def detections_by_code(spark, sf_dir):
    return C.detections_by_code(cases(spark, sf_dir))


@query("payload_profile", f"""
SELECT {S.EXPORT_PATH_SQL} AS path, CASE WHEN vec_id%16=3 THEN 0 WHEN vec_id%16 IN (4,7,8) THEN 9 ELSE 10 END::BIGINT AS numeric_rows,
  CASE vec_id%16 WHEN 3 THEN NULL WHEN 5 THEN 6 WHEN 6 THEN 8 ELSE 7 END::BIGINT AS min_width, CASE vec_id%16 WHEN 3 THEN NULL WHEN 6 THEN 8 ELSE 7 END::BIGINT AS max_width,
  vec_id%16 NOT IN (3,5) AS rectangular, true AS header_found, vec_id%16<>3 AS axis_candidate FROM embeddings""")
def payload_profile(spark, sf_dir):
    files = S.exports(spark, sf_dir).select("path", F.decode("content", "ISO-8859-1").alias("text"))
    p = C.payload_profile(files)
    return p.select("path", *[F.col(c).cast("bigint").alias(c) for c in ("numeric_rows", "min_width", "max_width")], "rectangular", "header_found", "axis_candidate")


@query("catalog_search", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY') AND c_nationkey=3")
def catalog_search(spark, sf_dir):
    return C.catalog_search(S.table(spark, sf_dir, "customer"), c_mktsegment=["BUILDING", "MACHINERY"], c_nationkey=3).select("c_custkey", "c_mktsegment")


ORDER_FACETS = ["status", "priority", "year"]
FACET_SQL = """O AS (SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey%9<>0 THEN o_orderpriority END AS priority, year(o_orderdate)::VARCHAR AS year FROM orders),
H AS (SELECT * FROM O WHERE status IN ('F','O') AND (priority IS NULL OR priority='1-URGENT'))"""
FACET_FILTERS = {"status": ["F", "O"], "priority": [None, "1-URGENT"]}


def order_catalog(spark, sf_dir):
    return S.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("priority"), F.year("o_orderdate").cast("string").alias("year"))


def order_index(spark, sf_dir):
    return S.written(spark, sf_dir, "order_facets", lambda: FA.facet_index(order_catalog(spark, sf_dir), "o_orderkey", ORDER_FACETS))


@query("facet_counts", "WITH " + FACET_SQL + """
SELECT 'status' AS facet, status AS value, count(*)::BIGINT AS n FROM H GROUP BY 2 UNION ALL SELECT 'priority', priority, count(*)::BIGINT FROM H GROUP BY 2 UNION ALL SELECT 'year', year, count(*)::BIGINT FROM H GROUP BY 2""")
def facet_counts(spark, sf_dir):
    index = order_index(spark, sf_dir)
    return FA.facet_counts(index, FA.facet_hits(index, FACET_FILTERS))


@query("facet_search", "WITH " + FACET_SQL + " SELECT o_orderkey, status, priority, year FROM H")
def facet_search(spark, sf_dir):
    return FA.hit_rows(order_catalog(spark, sf_dir), "o_orderkey", FA.facet_hits(order_index(spark, sf_dir), FACET_FILTERS))
