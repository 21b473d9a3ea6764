"""Queries on matching and scenario reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkledger.operators import matching as M
from linkledger.operators.ordered import time_chunk
from linkledger.operators import overlap as O
from linkledger.plans import standins as S
from linkledger.plans.catalog import query

PART_FAMILIES = {"small": "S", "red": "R", "widget": "W"}


@query("construction_family", """
SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%widget%' THEN 'W' WHEN lower(p_name) LIKE '%small%' THEN 'S' WHEN lower(p_name) LIKE '%red%' THEN 'R' ELSE 'unknown' END AS family FROM part""")
def construction_family(spark, sf_dir):
    return S.table(spark, sf_dir, "part").select("p_partkey", M.construction_family("p_name", PART_FAMILIES).alias("family"))


TOKEN_SQL = """T AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name || ' mit ab ' || p_type), ' '), lambda x: length(x)>=3 AND x<>'mit')) AS a,
  list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type || ' board'), ' '), lambda x: length(x)>=3)) AS b,
  list_distinct(list_filter(string_split(lower(p_name || ' red small'), ' '), lambda x: length(x)>=3)) AS c FROM part)"""


@query("token_overlap", "WITH " + TOKEN_SQL + """
SELECT p_partkey, round(len(list_intersect(a,b))/len(list_distinct(list_concat(a,b))),6) AS overlap, round(len(list_intersect(a,c))/len(list_distinct(list_concat(a,c))),6) AS other FROM T""")
def token_overlap(spark, sf_dir):
    a = F.array("p_name", F.lit("mit 12 ab"), "p_type")
    p = S.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(M.token_overlap(a, F.array("p_name", "p_type", F.lit("(board)"))), 6).alias("overlap"),
                    F.round(M.token_overlap(a, F.array(F.col("p_name"), F.lit("Red-Small"))), 6).alias("other"))


@query("best_overlaps", "WITH " + S.WALL_SQL + """, A AS (SELECT gid, list_distinct(list_filter(string_split(lower(p_name),' '), lambda x: length(x)>=3)) AS a FROM W),
B AS (SELECT record_uri, list_distinct(list_filter(string_split(lower(p_name),' '), lambda x: length(x)>=3)) AS b FROM C),
X AS (SELECT gid, record_uri, len(list_intersect(a,b))::DOUBLE / len(list_distinct(list_concat(a,b))) AS o FROM A, B WHERE len(a)>0 AND len(b)>0),
Y AS (SELECT gid, count(*) AS matches, max(o) AS overlap FROM X WHERE o >= 0.5 - 1e-9 GROUP BY gid)
SELECT A.gid, coalesce(matches, 0)::BIGINT AS matches, (SELECT min(record_uri) FROM X WHERE X.gid=A.gid AND X.o=Y.overlap) AS best, round(overlap, 6) AS overlap FROM A LEFT JOIN Y ON A.gid=Y.gid""")
def best_overlaps(spark, sf_dir):
    # Every wall against all records, whatever their family.
    found = O.best_overlaps(S.walls(spark, sf_dir), S.registry(spark, sf_dir), 0.5)
    return found.select("gid", "matches", "best", F.round("overlap", 6).alias("overlap"))


@query("find_candidates", "WITH " + S.WALL_SQL + """, F AS (SELECT family, count(*) AS n, min(record_uri) AS u FROM C GROUP BY 1)
SELECT gid, W.family, coalesce(n,0)::BIGINT AS candidates, CASE WHEN n=1 THEN u END AS candidate, CASE WHEN n IS NULL THEN 'UNMATCHED' WHEN n>1 THEN 'MULTIPLE_CANDIDATES' ELSE 'CANDIDATE' END AS status
FROM W LEFT JOIN F ON W.family=F.family""")
def find_candidates(spark, sf_dir):
    return M.find_candidates(S.walls(spark, sf_dir), S.registry(spark, sf_dir))


@query("thickness_band_join", "WITH " + S.WALL_SQL + """, X AS (SELECT gid, W.family, W.thickness_m, record_uri, C.thickness_m AS t, abs(W.thickness_m-C.thickness_m) AS d FROM W LEFT JOIN C ON W.family=C.family),
N AS (SELECT gid, record_uri AS nearest, d, row_number() OVER (PARTITION BY gid ORDER BY d, t, record_uri) AS rn FROM X WHERE record_uri IS NOT NULL)
SELECT X.gid, X.family, X.thickness_m, count(*) FILTER (X.d<=0.02+1e-12)::BIGINT AS in_band, min(N.nearest) AS nearest, round(min(N.d),6) AS nearest_delta FROM X LEFT JOIN N ON N.gid=X.gid AND N.rn=1 GROUP BY 1,2,3""")
def thickness_band_join(spark, sf_dir):
    out = M.band_candidates(S.walls(spark, sf_dir), S.registry(spark, sf_dir))
    return out.select("gid", "family", "thickness_m", "in_band", "nearest", F.round("nearest_delta", 6).alias("nearest_delta"))


def links(spark, sf_dir):
    """One link per part to the record of the part 2 keys on; every 13th points to a record nobody has, every 7th to its own part."""
    p = S.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    other = F.when(k % 7 == 0, k).otherwise(k + 2)
    uri = F.when(k % 13 == 0, F.format_string("https://example.org/record/gone-%d", "p_partkey")).otherwise(
        F.concat(F.lit("https://example.org/record/"), F.lpad(other.cast("string"), 9, "0")))
    return p.select(F.concat(F.lit("link-"), k.cast("string")).alias("link_id"), k.alias("gid"), uri.alias("record_uri"))


def matches(spark, sf_dir):
    """Links judged against walls and records of the same brand family."""
    walls = S.walls(spark, sf_dir).withColumn("family", F.substring_index("family", "/", 1))
    registry = S.registry(spark, sf_dir).withColumn("family", F.substring_index("family", "/", 1))
    return M.match_status(links(spark, sf_dir), walls, registry, tol=0.105, min_overlap=0.3)


MATCH_SQL = S.WALL_SQL + """, L AS (SELECT 'link-' || p_partkey AS link_id, p_partkey AS gid, CASE WHEN p_partkey%13=0 THEN 'https://example.org/record/gone-' || p_partkey
    ELSE 'https://example.org/record/' || lpad((CASE WHEN p_partkey%7=0 THEN p_partkey ELSE p_partkey+2 END)::VARCHAR,9,'0') END AS record_uri FROM part),
J AS (SELECT L.*, split_part(W.family,'/',1) AS wf, split_part(C.family,'/',1) AS rf, W.thickness_m AS wt, C.thickness_m AS rt, C.record_uri IS NOT NULL AS resolved,
    list_filter(string_split(lower(W.p_name),' '), lambda x: length(x)>=3) AS a, list_filter(string_split(lower(C.p_name || ' ' || C.p_type),' '), lambda x: length(x)>=3) AS b
  FROM L JOIN W ON W.gid=L.gid LEFT JOIN C ON C.record_uri=L.record_uri),
K AS (SELECT *, CASE WHEN resolved AND wf=rf THEN round(abs(wt-rt),6) END AS delta,
    CASE WHEN NOT resolved THEN NULL WHEN wf=rf THEN round(len(list_intersect(a,b))/len(list_distinct(list_concat(a,b))),6) ELSE 0 END::DOUBLE AS overlap FROM J),
MS AS (SELECT *, CASE WHEN NOT resolved THEN 'BROKEN' WHEN wf<>rf THEN 'INVALID' WHEN delta<=0.105 AND overlap>=0.3 THEN 'ACCEPTABLE' ELSE 'AMBIGUOUS' END AS status FROM K)"""


@query("match_status", "WITH " + MATCH_SQL + " SELECT link_id, gid, record_uri, resolved, status, delta AS thickness_delta_m, overlap FROM MS")
def match_status(spark, sf_dir):
    m = matches(spark, sf_dir)
    return m.select("link_id", "gid", "record_uri", "resolved", "status", F.round("thickness_delta_m", 6).alias("thickness_delta_m"), F.round("overlap", 6).alias("overlap"))


@query("semantic_staleness", """
WITH H AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'INVALID' WHEN 'view' THEN 'AMBIGUOUS' ELSE 'ACCEPTABLE' END AS status, event_id%4<>0 AS resolved FROM events),
P AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior_status FROM H)
SELECT user_id AS link_id, event_id AS version, prior_status, CASE WHEN prior_status='ACCEPTABLE' AND status='INVALID' AND resolved THEN 'SEMANTICALLY_STALE' ELSE status END AS observed FROM P""")
def semantic_staleness(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "INVALID").when(F.col("event_type") == "view", "AMBIGUOUS").otherwise("ACCEPTABLE")
    history = e.select(F.col("user_id").alias("link_id"), F.col("event_id").alias("version"), "ts", status.alias("status"), (F.col("event_id") % 4 != 0).alias("resolved"))

    return M.staleness(history, time_chunk("ts"), ("ts", "version")).select("link_id", "version", "prior_status", "observed")


# ------------------------------------------------------------------ reports

def cases(spark, sf_dir):
    """Scenario cases: the judged links with a kind, a truth and a rationale."""
    m = matches(spark, sf_dir)
    kind = F.when(F.col("gid") % 3 == 0, "ACTUAL_IFC_WALL").when(F.col("gid") % 3 == 1, "CONTROLLED_FIXTURE").otherwise("OTHER")
    truth = F.when(F.col("gid") % 10 == 0, "AMBIGUOUS").otherwise(F.col("status"))
    return m.select(F.col("link_id").alias("case_id"), kind.alias("case_kind"), "gid", truth.alias("truth"), F.col("status").alias("observed"), "wall_family", "record_family",
                    F.round("thickness_delta_m", 6).alias("thickness_delta_m"), "rationale")


CASE_SQL = MATCH_SQL + """, CS AS (SELECT link_id AS case_id, CASE gid%3 WHEN 0 THEN 'ACTUAL_IFC_WALL' WHEN 1 THEN 'CONTROLLED_FIXTURE' ELSE 'OTHER' END AS case_kind, gid,
  CASE WHEN gid%10=0 THEN 'AMBIGUOUS' ELSE status END AS truth, status AS observed, wf, rf, delta, overlap FROM MS)"""


@query("case_kind_counts", "WITH " + CASE_SQL + """
SELECT count(*)::BIGINT AS total, count(*) FILTER (case_kind LIKE '%ACTUAL_IFC%')::BIGINT AS real_cases, count(*) FILTER (case_kind LIKE '%CONTROLLED%')::BIGINT AS controlled_cases FROM CS""")
def case_kind_counts(spark, sf_dir):
    return M.case_scope(cases(spark, sf_dir))


@query("family_counts", "SELECT p_type || '/' || p_brand AS family, count(*)::BIGINT AS walls FROM part GROUP BY 1")
def family_counts(spark, sf_dir):
    return M.family_counts(S.walls(spark, sf_dir))


@query("tolerance_sweep", "WITH " + CASE_SQL + """, T AS (SELECT unnest([0.01,0.02,0.05,0.10,0.15,0.20])::DOUBLE AS tol), D AS (SELECT * FROM CS WHERE delta IS NOT NULL)
SELECT tol AS tolerance_m, count(*) FILTER (wf=rf AND delta<=tol)::BIGINT AS acceptable, count(*) FILTER (wf=rf AND delta>tol)::BIGINT AS ambiguous,
  round_even(count(*) FILTER (wf=rf AND delta<=tol)/count(*)*100,1) AS acceptable_pct, round_even(count(*) FILTER (wf=rf AND delta>tol)/count(*)*100,1) AS ambiguous_pct FROM T CROSS JOIN D GROUP BY 1""")
def tolerance_sweep(spark, sf_dir):
    return M.tolerance_sweep(cases(spark, sf_dir))


@query("root_causes", "WITH " + CASE_SQL + """
SELECT cause, count(*)::BIGINT AS cases FROM (
  SELECT 'insufficient_ifc_detail' AS cause FROM CS WHERE (observed='AMBIGUOUS' AND overlap<0.3) OR observed='ACCEPTABLE'
  UNION ALL SELECT 'thickness_mismatch' FROM CS WHERE observed='AMBIGUOUS' AND delta>0.105 UNION ALL SELECT 'family_mismatch' FROM CS WHERE observed='INVALID'
  UNION ALL SELECT 'resource_unavailable' FROM CS WHERE observed='BROKEN') t GROUP BY 1""")
def root_causes(spark, sf_dir):
    return M.root_causes(cases(spark, sf_dir))


@query("status_listing", "WITH " + CASE_SQL + " SELECT case_id, gid, wf AS wall_family, rf AS record_family, delta AS thickness_delta_m FROM CS WHERE observed='AMBIGUOUS'")
def status_listing(spark, sf_dir):
    return M.cases_by_status(cases(spark, sf_dir), "AMBIGUOUS").select("case_id", "gid", "wall_family", "record_family", "thickness_delta_m")


@query("scope_summary", "WITH " + CASE_SQL + """
SELECT (SELECT count(*) FROM CS)::BIGINT AS scenarios, (SELECT count(DISTINCT observed) FROM CS)::BIGINT AS statuses, (SELECT count(*) FROM W)::BIGINT AS walls,
  (SELECT count(DISTINCT family) FROM W)::BIGINT AS families, (SELECT (count(*) FILTER ((observed='AMBIGUOUS' AND overlap<0.3) OR observed='ACCEPTABLE')>0)::INT + (count(*) FILTER (observed='AMBIGUOUS' AND delta>0.105)>0)::INT
  + (count(*) FILTER (observed='INVALID')>0)::INT + (count(*) FILTER (observed='BROKEN')>0)::INT FROM CS)::BIGINT AS causes""")
def scope_summary(spark, sf_dir):
    return M.scope_summary(cases(spark, sf_dir), S.walls(spark, sf_dir))


@query("scenario_agreement", "WITH " + CASE_SQL + " SELECT case_kind, count(*)::BIGINT AS cases, count(*) FILTER (truth=observed)::BIGINT AS agree FROM CS GROUP BY ROLLUP(case_kind)")
def scenario_agreement(spark, sf_dir):
    return M.agreement(cases(spark, sf_dir))


@query("retrieval_scores", """
SELECT o_orderpriority AS approach, o_orderstatus AS scenario, sum(o_custkey%6)::BIGINT AS answered, sum(5)::BIGINT AS total, round(sum(o_custkey%6)/sum(5),6) AS share FROM orders GROUP BY ROLLUP(o_orderpriority, o_orderstatus)""")
def retrieval_scores(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("approach"), F.col("o_orderstatus").alias("scenario"), (F.col("o_custkey") % 6).alias("answered"), F.lit(5).cast("bigint").alias("total"))
    return M.retrieval_scores(o, "approach", "scenario").withColumn("share", F.round("share", 6))


@query("overhead_delta", """
SELECT s_suppkey, s_nationkey, s_acctbal AS bytes, round(s_acctbal - max(CASE WHEN s_suppkey%10=0 THEN s_acctbal END) OVER (PARTITION BY s_nationkey),2) AS bytes_delta FROM supplier""")
def overhead_delta(spark, sf_dir):
    s = S.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("bytes"), F.when(F.col("s_suppkey") % 10 == 0, "baseline").otherwise("other").alias("approach"))
    out = M.overhead(s, ["bytes"], "baseline", scope=["s_nationkey"])
    return out.select("s_suppkey", "s_nationkey", "bytes", F.round("bytes_delta", 2).alias("bytes_delta"))


@query("update_independence", """
SELECT o_orderpriority AS approach, bool_or(o_custkey%5=0) FILTER (o_orderstatus='F') AS F, bool_or(o_custkey%5=0) FILTER (o_orderstatus='O') AS O, bool_or(o_custkey%5=0) FILTER (o_orderstatus='P') AS P FROM orders GROUP BY 1""")
def update_independence(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("approach"), F.col("o_orderstatus").alias("scenario"), (F.col("o_custkey") % 5 == 0).alias("model_modified"))
    return M.independence_matrix(o, ["F", "O", "P"], "model_modified")
