"""Queries on versions, triggers, histories and relation evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkledger.operators import chains as C
from linkledger.operators import lifecycle as L
from linkledger.plans import standins as S
from linkledger.plans.catalog import query

ATTRS = ["material", "thickness", "title"]

# The previous values of every version and the rows that differ.
CHANGE_SQL = S.VERSION_SQL + """, G AS (SELECT *, lag(material) OVER w AS m0, lag(thickness) OVER w AS t0, lag(title) OVER w AS e0, row_number() OVER w AS rn FROM V WINDOW w AS (PARTITION BY entity ORDER BY ts, version)),
TR AS (SELECT entity, ts, version, 'material' AS attribute, m0 AS old, material AS new, 'component-semantic' AS category, 'HIGH' AS severity, 'SEMANTICALLY_STALE' AS resulting_state FROM G WHERE rn>1 AND m0 IS DISTINCT FROM material
  UNION ALL SELECT entity, ts, version, 'thickness', t0::VARCHAR, thickness::VARCHAR, 'component-semantic', 'HIGH', 'SEMANTICALLY_STALE' FROM G WHERE rn>1 AND t0 IS DISTINCT FROM thickness
  UNION ALL SELECT entity, ts, version, 'title', e0::VARCHAR, title::VARCHAR, 'editorial', 'INFO', 'ACCEPTABLE' FROM G WHERE rn>1 AND e0 IS DISTINCT FROM title)"""


@query("reassessment_triggers", "WITH " + CHANGE_SQL + " SELECT entity, version, attribute, old, new, category, severity, resulting_state FROM TR")
def reassessment_triggers(spark, sf_dir):
    t = L.reassessment_triggers(S.versions(spark, sf_dir), ATTRS)
    return t.select("entity", "version", "attribute", "old", "new", "category", "severity", "resulting_state")


@query("assertion_history", """
SELECT user_id AS relation, event_id AS assertion, lag(event_id) OVER w AS previous, row_number() OVER w AS revision, lead(event_id) OVER w IS NULL AS is_current FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def assertion_history(spark, sf_dir):
    a = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("relation"), "ts", F.col("event_id").alias("assertion"))
    h = L.assertion_history(a, "relation", ["ts", "assertion"], "assertion")
    return h.select("relation", "assertion", "previous", "revision", "is_current")


# Every event is superseded by its user's next one; some point elsewhere: to two others, back, or to nothing known.
HEAD_LINKS = """N AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pv FROM events),
K AS (SELECT a, CASE WHEN a%97=0 THEN -a-1 WHEN a%89=0 AND pv IS NOT NULL THEN pv ELSE nx END AS nx FROM N),
D AS (SELECT a, nx FROM K UNION ALL SELECT a, nx + 1000000000 FROM K WHERE a%83=0 AND nx >= 0)"""


@query("assertion_heads", "WITH RECURSIVE " + HEAD_LINKS + """, L AS (SELECT a, min(nx) AS nx, count(DISTINCT nx) > 1 AS forked FROM D GROUP BY a),
R(a, pos, steps, fork) AS (SELECT a, a, 0, false FROM L UNION ALL SELECT R.a, L.nx, steps + 1, fork OR forked FROM R JOIN L ON L.a = R.pos WHERE L.nx IS NOT NULL AND steps <= (SELECT count(*) FROM L)),
E AS (SELECT a, pos, steps, fork FROM R WHERE NOT EXISTS (SELECT 1 FROM L WHERE L.a = R.pos AND L.nx IS NOT NULL))
SELECT L.a AS assertion, E.pos AS head, E.steps::BIGINT AS steps, CASE WHEN E.pos IS NULL THEN 'cycle' WHEN E.pos NOT IN (SELECT a FROM L) THEN 'unknown successor' WHEN fork THEN 'fork' END AS reason
FROM L LEFT JOIN E USING (a)""")
def assertion_heads(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a, after, before = F.col("event_id"), F.lead("event_id").over(along), F.lag("event_id").over(along)
    links = e.select(a.alias("assertion"), F.when(a % 97 == 0, -a - 1).when((a % 89 == 0) & before.isNotNull(), before).otherwise(after).alias("superseded_by"))
    twice = links.where((F.col("assertion") % 83 == 0) & (F.col("superseded_by") >= 0)).withColumn("superseded_by", F.col("superseded_by") + 1_000_000_000)
    return C.assertion_heads(links.unionByName(twice))


@query("latest_version_asof", """
WITH D AS (SELECT event_id AS decision_id, user_id AS entity, ts - INTERVAL 90 MINUTE AS ts FROM events)
SELECT decision_id, D.entity, v.event_id AS version, v.event_type AS material FROM D ASOF LEFT JOIN (SELECT user_id AS entity, ts, event_id, event_type FROM events) v ON D.entity=v.entity AND D.ts>=v.ts""")
def latest_version_asof(spark, sf_dir):
    # A decision 90 minutes before every version looks back to the version that was current then.
    v = S.versions(spark, sf_dir)
    decisions = v.select(F.col("version").alias("decision_id"), "entity", (F.col("ts") - F.expr("INTERVAL 90 MINUTES")).alias("ts"))
    return L.asof_version(decisions, v, carry=["material"]).select("decision_id", "entity", "version", "material")


@query("evidence_summary", """
SELECT user_id AS relation_id, count(*) FILTER (event_type='click')::BIGINT AS click, count(*) FILTER (event_type='error')::BIGINT AS error, count(*) FILTER (event_type='view')::BIGINT AS "view", count(*) FILTER (event_type='never')::BIGINT AS never FROM events GROUP BY 1""")
def evidence_summary(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("relation_id"), F.col("event_type").alias("comparison"))
    return L.evidence_summary(e, states=["click", "error", "view", "never"])


@query("contradictions", "SELECT event_id AS evidence_id, user_id AS relation_id FROM events WHERE event_type='error'")
def contradictions(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select(F.col("event_id").alias("evidence_id"), F.col("user_id").alias("relation_id"), F.when(F.col("event_type") == "error", "CONTRADICTS").otherwise("SUPPORTS").alias("comparison"))
    return L.contradictions(e).select("evidence_id", "relation_id")


@query("relation_type_guard", """
SELECT o_orderkey AS relation_id, 'measuredOn' AS relation_type, CASE o_orderstatus WHEN 'P' THEN NULL ELSE 'CATALOG_RECORD' END AS origin FROM orders WHERE o_custkey%2=0 AND o_orderstatus<>'F'""")
def relation_type_guard(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    origin = F.when(F.col("o_orderstatus") == "F", "RAW_MEASUREMENT").when(F.col("o_orderstatus") != "P", "CATALOG_RECORD")
    return L.relation_type_guard(o.select(F.col("o_orderkey").alias("relation_id"), F.when(F.col("o_custkey") % 2 == 0, "measuredOn").otherwise("references").alias("relation_type"), origin.alias("origin")))
