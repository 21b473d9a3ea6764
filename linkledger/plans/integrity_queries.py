"""Queries on integrity reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkledger.operators import deltas as D
from linkledger.operators import integrity as I
from linkledger.plans import standins as S
from linkledger.plans.catalog import query
from linkledger.session import cut_lineage, scratch_path
from linkledger.streaming.inventory import inventory_deltas


@query("checksum_check", """
WITH D AS (SELECT doc_id, sha256(text) AS sha, CASE WHEN doc_id%5=0 THEN '.ifc' ELSE '.txt' END AS e FROM documents WHERE doc_id%19<>0),
E AS (SELECT *, CASE WHEN doc_id%13=0 THEN NULL WHEN doc_id%10=0 THEN reverse(sha) ELSE sha END AS rec FROM D)
SELECT doc_id::VARCHAR AS record_id, CASE WHEN e='.ifc' THEN 'IFC model' ELSE 'Measurement file' END AS role, doc_id || e AS file, coalesce(rec,'') AS recorded,
  CASE WHEN doc_id%17=0 THEN '' ELSE sha END AS actual,
  CASE WHEN doc_id%17=0 THEN 'file not found' WHEN rec=sha THEN 'match' ELSE 'MISMATCH' END AS status FROM E""")
def checksum_check(spark, sf_dir):
    return I.checksum_check(S.file_refs(spark, sf_dir), S.file_inventory_of_refs(spark, sf_dir))


@query("element_check", """
SELECT c_custkey::VARCHAR AS record_id, c_name AS gid, CASE WHEN c_custkey%17=0 THEN 'MISSING' WHEN c_custkey%19=0 THEN 'unchecked' WHEN c_custkey%10=0 THEN 'CHANGED' ELSE 'ok' END AS state FROM customer""")
def element_check(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer")
    k, mark = F.col("c_custkey"), F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256)
    bound = c.select(k.cast("string").alias("record_id"), F.col("c_name").alias("gid"), mark.alias("fingerprint"))
    current = c.select(F.when(k % 17 == 0, F.concat(F.lit("new-"), "c_name")).otherwise(F.col("c_name")).alias("gid"),
                       F.when(k % 19 == 0, F.lit(None)).when(k % 10 == 0, F.reverse(mark)).otherwise(mark).alias("fingerprint"))
    return I.element_check(bound, current)


def order_paths(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.concat(F.lit("data/"), F.col("o_orderkey").cast("string")).alias("path"), F.lit("orders").alias("origin"))
    i = S.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("data/"), F.col("l_orderkey").cast("string")).alias("path"))
    return o, i


@query("untracked_files", "SELECT 'data/' || o_orderkey AS path, 'orders' AS origin FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def untracked_files(spark, sf_dir):
    disk, named = order_paths(spark, sf_dir)
    return I.untracked_files(disk, I.known_set(named, named))


@query("known_set", "SELECT 'data/' || l_orderkey AS path FROM lineitem UNION SELECT 'data/' || (o_orderkey+1) FROM orders")
def known_set(spark, sf_dir):
    _, named = order_paths(spark, sf_dir)
    shifted = S.table(spark, sf_dir, "orders").select(F.concat(F.lit("data/"), (F.col("o_orderkey") + 1).cast("string")).alias("path"))
    return I.known_set(named, shifted)


@query("unrecorded_members", """
SELECT o_orderkey AS point, 'record without view' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey+3 FROM lineitem)
UNION ALL SELECT DISTINCT l_orderkey+3, 'view without record' FROM lineitem WHERE l_orderkey+3 NOT IN (SELECT o_orderkey FROM orders)""")
def unrecorded_members(spark, sf_dir):
    records = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point"))
    view = S.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 3).alias("point"))
    return I.reconcile_keys(records, view, "point")


@query("header_vs_record", """
SELECT o_orderkey AS point, NOT (o_orderkey%7=0 OR o_orderkey%11=0) AS agrees, CASE WHEN o_orderkey%7=0 THEN 0.5 ELSE 0.0 END::DOUBLE AS dx, 0.0::DOUBLE AS dy,
  CASE WHEN o_orderkey%11=0 THEN NULL ELSE 0.0 END::DOUBLE AS dz FROM orders""")
def header_vs_record(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    headers = o.select(k.alias("point"), (F.col("o_custkey") / 4.0).alias("x"), F.lit(2.0).alias("y"), F.lit(0.5).alias("z"))
    records = o.select(k.alias("point"), (F.col("o_custkey") / 4.0 - F.when(k % 7 == 0, 0.5).otherwise(0.0)).alias("x"), F.lit(2.0).alias("y"), F.when(k % 11 != 0, 0.5).alias("z"))
    return I.coordinate_check(headers, records)


@query("edited_after_build", """
SELECT CASE WHEN doc_id%2=0 THEN 'record' ELSE 'derived' END AS kind, 'docs/' || doc_id || '.txt' AS path,
  CASE WHEN doc_id%9=0 THEN 'not found' WHEN doc_id%7=0 THEN 'edited' ELSE 'unchanged' END AS state FROM documents""")
def edited_after_build(spark, sf_dir):
    f = S.files(spark, sf_dir)
    n, sha = F.col("doc_id"), F.sha2("content", 256)
    # Two builds: the earlier one registered other hashes and some files that are gone.
    builds = F.explode(F.array(F.struct(F.lit("2024-01").alias("build_id"), F.reverse(sha).alias("sha256")), F.struct(F.lit("2024-02").alias("build_id"), sha.alias("sha256")))).alias("b")
    manifest = f.select(F.when(n % 2 == 0, "record").otherwise("derived").alias("kind"), "path", builds).select("kind", "path", "b.*")
    disk = f.select(F.when(n % 9 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"), F.when(n % 7 == 0, F.reverse(sha)).otherwise(sha).alias("sha256"))
    return I.edited_after_build(manifest, disk)


@query("manifest_notes", f"""
SELECT c_custkey AS package, CASE WHEN c_custkey%5=0 THEN '{I.NO_MANIFEST}' ELSE '{I.BROKEN_MANIFEST}' END AS note FROM customer WHERE c_custkey%5=0 OR c_custkey%7 IN (1,2,3)""")
def manifest_notes(spark, sf_dir):
    # Customers as packages: some have no manifest, others a cut, an empty or a listed one; every sixth has a second, broken file.
    c = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("package"), F.to_json(F.struct("c_name", "c_acctbal")).alias("whole"))
    n = F.col("package") % 7
    text = F.when(n == 1, F.substring("whole", 1, 9)).when(n == 2, "").when(n == 3, F.concat(F.lit("["), "whole", F.lit("]"))).otherwise(F.col("whole"))
    files = F.array_compact(F.array(text, F.when(F.col("package") % 6 == 0, F.lit("{"))))
    return I.manifest_notes(c, c.where(F.col("package") % 5 != 0).select("package", F.explode(files).alias("text")))


# ------------------------------------------------------------------ three-layer assessment

CODES = 30


def assessment_tables(spark, sf_dir, changed=False):
    """Tables of a package with one point per document; ``doc_id % 30`` selects the damage.

    With ``changed`` a second look at the files: of seven documents one has another data file, one lost it, one has another
    record (that of damage 7 is as it was built), for one a moved file is back in its place; every 50th has a file nothing names.
    """
    d = S.table(spark, sf_dir, "documents")
    n, k = F.col("doc_id"), F.col("doc_id") % CODES
    sha, rec_sha = F.sha2("text", 256), F.sha2(F.concat(F.lit("rec"), F.col("doc_id").cast("string")), 256)
    path = F.concat(F.lit("data/"), n.cast("string"), F.lit(".txt"))
    rec_path = F.concat(F.lit("rec/"), n.cast("string"), F.lit(".json"))
    x, y = n / 8.0, (n % 100) / 4.0
    view = d.select(n.alias("point"), x.alias("x"), y.alias("y"), F.lit(0.5).alias("z"), F.when(k != 1, path).alias("file"))
    records = d.select(F.when(k == 2, -1 - n).otherwise(n).alias("point"), F.when(k != 1, path).alias("url"), F.when(k == 3, F.reverse(sha)).otherwise(sha).alias("sha256"),
                       F.when(k == 5, x + 0.25).when(k != 4, x).alias("x"), y.alias("y"), F.lit(0.5).alias("z"), rec_path.alias("record_path"))
    c = (n % 7) * int(changed)
    disk_path = F.when((k == 6) & (c != 4), F.concat(F.lit("data/moved-"), n.cast("string"))).otherwise(path)
    data_file = F.when(c != 2, F.struct(disk_path.alias("path"), F.when(c == 1, F.reverse(sha)).otherwise(sha).alias("sha256")))
    record_file = F.struct(rec_path.alias("path"), F.when((k == 7) != (c == 3), F.reverse(rec_sha)).otherwise(rec_sha).alias("sha256"))
    extra_file = F.when(F.lit(changed) & (n % 50 == 0), F.struct(F.concat(F.lit("data/extra-"), n.cast("string")).alias("path"), sha.alias("sha256")))
    inventory = d.select(F.inline(F.array_compact(F.array(data_file, record_file, extra_file))))
    headers = d.select(disk_path.alias("path"), F.when(k == 8, F.lit(None)).when(k == 9, n + 1).otherwise(n).alias("point"), F.when(k != 8, x).alias("x"),
                       F.when(k != 8, y).alias("y"), F.when(k == 10, 0.75).when(k != 8, 0.5).alias("z"), (k != 8).alias("readable"))
    entry = lambda kind, p, s, build="2024-02": F.struct(F.lit(kind).alias("kind"), p.alias("path"), s.alias("sha256"), n.alias("point"), F.lit(build).alias("build_id"))
    manifest = d.select(F.explode(F.array(
        entry("data", path, F.when(k == 11, F.reverse(sha)).otherwise(sha)), entry("record", rec_path, rec_sha),
        entry("cache", F.lit("view/cache"), F.when(k == 12, F.reverse(sha)).otherwise(sha)),
        entry("data", path, F.reverse(sha), "2024-01"), entry("record", rec_path, F.reverse(rec_sha), "2024-01"), entry("cache", F.lit("view/cache"), F.reverse(sha), "2024-01"))).alias("m")).select("m.*")
    elements = d.select(n.alias("point"), F.when(k == 13, "stale").when(k == 14, "unverified").otherwise("valid").alias("verdict"),
                        F.when(k == 13, "model element(s) changed or missing").when(k == 14, "record names no model file").alias("reason"))
    return view, records, inventory, headers, manifest, elements


def assessment(spark, sf_dir, changed=False):
    """Point states of :func:`assessment_tables`, and the tables that problem lines need."""
    view, records, inventory, *rest = assessment_tables(spark, sf_dir, changed)
    return I.assess_points(view, records, inventory, *rest), view, records, inventory


def stored_assessment(spark, sf_dir):
    """The same with the point states written once, for totals, layers and problem lines."""
    points, *rest = assessment(spark, sf_dir)
    return cut_lineage(points, "point-states"), *rest


STATE_SQL = f"""P AS (SELECT doc_id AS point, doc_id%{CODES} AS k FROM documents), ST AS (SELECT point, k,
  CASE WHEN k=6 THEN 'missing' WHEN k IN (1,3,8,9,10,11,12) THEN 'stale' ELSE 'valid' END AS data,
  CASE WHEN k=2 THEN 'missing' WHEN k IN (4,5,7) THEN 'stale' ELSE 'valid' END AS record,
  CASE WHEN k IN (2,14) THEN 'unverified' WHEN k=13 THEN 'stale' ELSE 'valid' END AS element FROM P)"""


@query("data_verdict", "WITH " + STATE_SQL + """
SELECT point, data AS state, CASE k WHEN 1 THEN 'no data file named' WHEN 3 THEN 'data file changed since the record was written' WHEN 6 THEN 'data file missing'
  WHEN 8 THEN 'data file header not readable' WHEN 9 THEN 'data file header differs from the view' WHEN 10 THEN 'data file header differs from the view'
  WHEN 11 THEN 'data file differs from the one registered at the last build' WHEN 12 THEN 'spectra cache was built from a different file' ELSE '' END AS reasons FROM ST""")
def data_verdict(spark, sf_dir):
    points, *_ = assessment(spark, sf_dir)
    return points.select("point", F.col("data").alias("state"), F.array_join("data_reasons", "; ").alias("reasons"))


@query("record_verdict", "WITH " + STATE_SQL + """
SELECT point, record AS state, CASE k WHEN 2 THEN 'no record for this point' WHEN 4 THEN 'record has no usable x/y/z' WHEN 5 THEN 'record x/y/z differ from the view'
  WHEN 7 THEN 'record edited after the build' ELSE '' END AS reasons FROM ST""")
def record_verdict(spark, sf_dir):
    points, *_ = assessment(spark, sf_dir)
    return points.select("point", F.col("record").alias("state"), F.array_join("record_reasons", "; ").alias("reasons"))


@query("point_verdict", "WITH " + STATE_SQL + """
SELECT point, data, record, element, data='valid' AND record='valid' AND element='valid' AS valid FROM ST""")
def point_verdict(spark, sf_dir):
    points, *_ = assessment(spark, sf_dir)
    return points.select("point", "data", "record", "element", "valid")


def all_problems(points, view, records, inventory):
    extra = I.reconcile_keys(records, view, "point").where(F.col("side") == "record without view")
    known = I.known_set(records.select(F.col("url").alias("path")).where("path IS NOT NULL"), view.select(F.col("file").alias("path")).where("path IS NOT NULL"))
    loose = I.untracked_files(inventory.where(F.col("path").startswith("data/")), known)
    return (I.problem_lines(points)
            .unionByName(extra.select(F.lit("record").alias("layer"), F.concat(F.lit("record not in the view: "), F.col("point").cast("string")).alias("line")))
            .unionByName(loose.select(F.lit("data").alias("layer"), F.concat(F.lit("file not in the records: "), F.col("path")).alias("line"))))


@query("problem_lines", "WITH " + STATE_SQL + """
SELECT layer, count(*)::BIGINT AS lines FROM (SELECT 'data' AS layer FROM ST WHERE data<>'valid' UNION ALL SELECT 'record' FROM ST WHERE record<>'valid'
  UNION ALL SELECT 'element' FROM ST WHERE k IN (13,14) UNION ALL SELECT 'record' FROM ST WHERE k=2 UNION ALL SELECT 'data' FROM ST WHERE k IN (1,6)) t GROUP BY 1""")
def problem_lines(spark, sf_dir):
    return all_problems(*assessment(spark, sf_dir)).groupBy("layer").agg(F.count(F.lit(1)).alias("lines"))


# Counts of points and problem lines per layer; a file nothing names and a record without a view are lines of no point.
LAYER_SQL = STATE_SQL + """, LI AS (SELECT 'data' AS layer FROM ST WHERE data<>'valid' UNION ALL SELECT 'record' FROM ST WHERE record<>'valid'
  UNION ALL SELECT 'element' FROM ST WHERE k IN (13,14) UNION ALL SELECT 'record' FROM ST WHERE k=2 UNION ALL SELECT 'data' FROM ST WHERE k IN (1,6)),
S3 AS (SELECT 'data' AS layer, data AS s, 1 AS pos FROM ST UNION ALL SELECT 'record', record, 2 FROM ST UNION ALL SELECT 'element', element, 3 FROM ST),
CO AS (SELECT layer, pos, count(*) FILTER (s='valid') AS valid, count(*) AS total, count(*) FILTER (s NOT IN ('valid','unverified')) AS bad, (SELECT count(*) FROM LI WHERE LI.layer=S3.layer) AS lines FROM S3 GROUP BY layer, pos),
LV AS (SELECT layer, pos, valid, total, CASE WHEN total>0 AND valid=total AND lines=0 THEN 'valid' WHEN bad>0 OR lines>0 THEN 'stale' ELSE 'unverified' END AS state FROM CO)"""
OVERALL_SQL = """V AS (SELECT count(*) AS n, count(*) FILTER (data='valid' AND record='valid' AND element='valid') AS v FROM ST),
B AS (SELECT count(*) FILTER (state='valid') AS ok, string_agg(layer || ' ' || state, '; ' ORDER BY pos) FILTER (state<>'valid') AS bits FROM LV),
OV AS (SELECT n, v, bits, CASE WHEN n=0 THEN 'INVALID' WHEN v=n AND ok=3 THEN 'VALID' WHEN v=0 THEN 'INVALID' ELSE 'PARTIAL' END AS overall FROM V, B)
SELECT overall, n::BIGINT AS points, v::BIGINT AS valid_points, CASE WHEN overall='VALID' THEN 'all ' || n || ' points valid: data, record and model agree'
  ELSE overall || ': ' || v || ' of ' || n || ' points valid (' || coalesce(bits, 'see problems') || ')' END AS headline FROM OV"""


@query("layer_verdict", "WITH " + LAYER_SQL + " SELECT layer, valid::BIGINT AS valid, total::BIGINT AS total, state FROM LV")
def layer_verdict(spark, sf_dir):
    parts = stored_assessment(spark, sf_dir)
    return I.layer_verdict(parts[0], all_problems(*parts))


@query("overall_verdict", "WITH " + LAYER_SQL + ", " + OVERALL_SQL)
def overall_verdict(spark, sf_dir):
    parts = stored_assessment(spark, sf_dir)
    return I.overall_verdict(parts[0], I.layer_verdict(parts[0], all_problems(*parts)))


# ------------------------------------------------------------------ verdicts kept up to date from changed files

def refreshed(spark, sf_dir):
    """Folder of verdicts that started with a full assessment and took in the changed files of a second look."""
    store = scratch_path(spark, "verdicts")
    parts = stored_assessment(spark, sf_dir)
    D.start_verdicts(parts[0], all_problems(*parts), store)
    tables = assessment_tables(spark, sf_dir, changed=True)
    deltas = cut_lineage(inventory_deltas(parts[3], tables[2]), "file-deltas")
    D.refresh_verdicts(store, 1, deltas, *tables)
    return store


# States after the second look (codes of the changes: c), and what differs.
SECOND_SQL = STATE_SQL + """, S2 AS (SELECT point, k, point%7 AS c, ST.data AS d1, ST.record AS r1, ST.element AS element FROM ST),
T2 AS (SELECT point, k, c, d1, r1, element, CASE WHEN k=1 THEN 'stale' WHEN c=2 THEN 'missing' WHEN k=6 AND c=4 THEN 'valid' WHEN k=6 THEN 'missing' WHEN c=1 THEN 'stale' ELSE d1 END AS data,
  CASE WHEN k=2 THEN 'missing' WHEN k IN (4,5) THEN 'stale' WHEN (k=7) <> (c=3) THEN 'stale' ELSE 'valid' END AS record FROM S2)"""


@query("verdict_deltas", "WITH " + SECOND_SQL + """
SELECT point, 'data' AS layer, d1 AS old, data AS new FROM T2 WHERE d1<>data UNION ALL SELECT point, 'record', r1, record FROM T2 WHERE r1<>record
UNION ALL SELECT point, 'point', CASE WHEN a THEN 'valid' ELSE 'unverified' END, CASE WHEN b THEN 'valid' ELSE 'unverified' END
FROM (SELECT point, d1='valid' AND r1='valid' AND element='valid' AS a, data='valid' AND record='valid' AND element='valid' AS b FROM T2) WHERE a<>b""")
def verdict_deltas(spark, sf_dir):
    rows = D.verdict_deltas(spark, refreshed(spark, sf_dir), 1)
    return rows.where(F.col("old") != F.col("new")).select("point", "layer", "old", "new")


@query("overall_verdict_by_deltas", "WITH " + SECOND_SQL + """, S3 AS (SELECT 'data' AS layer, data AS s, 1 AS pos FROM T2 UNION ALL SELECT 'record', record, 2 FROM T2 UNION ALL SELECT 'element', element, 3 FROM T2),
LV AS (SELECT layer, pos, CASE WHEN count(*) FILTER (s='valid')=count(*) THEN 'valid' ELSE 'stale' END AS state FROM S3 GROUP BY layer, pos)
, """ + OVERALL_SQL.replace("FROM ST)", "FROM T2)"))
def overall_verdict_by_deltas(spark, sf_dir):
    return D.current_overall(spark, refreshed(spark, sf_dir), 1)


@query("layer_verdict_by_deltas", "WITH " + SECOND_SQL + """, S3 AS (SELECT 'data' AS layer, data AS s FROM T2 UNION ALL SELECT 'record', record FROM T2 UNION ALL SELECT 'element', element FROM T2)
SELECT layer, count(*) FILTER (s='valid')::BIGINT AS valid, count(*)::BIGINT AS total, count(*) FILTER (s NOT IN ('valid','unverified'))::BIGINT AS bad,
  (CASE layer WHEN 'data' THEN (SELECT sum(CASE WHEN k<>1 AND c=2 THEN 1 WHEN data='valid' THEN 0 WHEN c=1 AND k IN (8,9,10) THEN 2 ELSE 1 END) FROM T2)
     + (SELECT count(*) FILTER (k=1 AND c<>2) + count(*) FILTER (k=6 AND c NOT IN (2,4)) + count(*) FILTER (point%50=0) FROM T2)
   WHEN 'record' THEN (SELECT sum(CASE WHEN record='valid' THEN 0 WHEN k IN (4,5) AND c=3 THEN 2 ELSE 1 END) + count(*) FILTER (k=2) FROM T2)
   ELSE (SELECT count(*) FILTER (k IN (13,14)) FROM T2) END)::BIGINT AS lines FROM S3 GROUP BY layer""")
def layer_verdict_by_deltas(spark, sf_dir):
    counts = spark.read.parquet(f"{refreshed(spark, sf_dir)}/totals").where("batch = 1 AND layer <> 'point'")
    return counts.select("layer", "valid", "total", "bad", "lines")


@query("element_verdict", """
WITH P AS (SELECT doc_id, doc_id%8 AS k FROM documents)
SELECT doc_id::VARCHAR AS record_id, CASE k WHEN 0 THEN 'unverified' WHEN 1 THEN 'stale' WHEN 2 THEN 'valid' WHEN 3 THEN 'unverified' WHEN 4 THEN 'stale' WHEN 5 THEN 'stale' WHEN 6 THEN 'unverified' ELSE 'valid' END AS verdict,
  CASE k WHEN 0 THEN 'record names no model file' WHEN 1 THEN 'model file not found' WHEN 3 THEN 'model file changed and no element fingerprints to compare'
    WHEN 4 THEN 'model element(s) changed or missing' WHEN 5 THEN 'model element(s) changed or missing' WHEN 6 THEN 'model file changed; element fingerprints could not be recomputed' END AS reason,
  CASE WHEN k=7 THEN 'model file changed, but every bound element has the same fingerprint' END AS note FROM P""")
def element_verdict(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    n, k, sha = F.col("doc_id"), F.col("doc_id") % 8, F.sha2("text", 256)
    rid = n.cast("string")
    path = F.concat(F.lit("data/"), rid, F.lit(".ifc"))
    bindings = d.select(rid.alias("record_id"), F.when(k != 0, path).alias("model_url"), F.when(k == 2, sha).otherwise(F.reverse(sha)).alias("model_sha256"))
    inventory = d.select(F.when(k == 1, F.concat(path, F.lit(".gone"))).otherwise(path).alias("path"), sha.alias("sha256"))
    cell = lambda g, state: F.struct(F.lit(g).alias("gid"), state.alias("state"))
    states = F.when(k == 3, F.array().cast("array<struct<gid:string,state:string>>")).otherwise(F.array(
        cell("a", F.when(k == 4, "CHANGED").when(k == 6, "unchecked").otherwise("ok")), cell("b", F.when(k == 5, "MISSING").otherwise("ok"))))
    checks = d.select(rid.alias("record_id"), states.alias("s")).select("record_id", F.explode("s").alias("s")).select("record_id", "s.*")
    return I.element_verdict(bindings, inventory, checks)


@query("cross_layer_issues", """
WITH P AS (SELECT doc_id, doc_id%12 AS k FROM documents)
SELECT doc_id::VARCHAR AS record_id, 'MEASUREMENT_HASH_MISMATCH' AS issue FROM P WHERE k IN (1,6) UNION ALL SELECT doc_id::VARCHAR, 'IFC_HASH_MISMATCH' FROM P WHERE k IN (2,6)
UNION ALL SELECT doc_id::VARCHAR, 'IFC_GLOBALID_UNRESOLVED' FROM P WHERE k=3 UNION ALL SELECT doc_id::VARCHAR, 'IFC_GLOBALID_MISMATCH' FROM P WHERE k=4 UNION ALL SELECT doc_id::VARCHAR, 'IFC_CLASS_MISMATCH' FROM P WHERE k=5""")
def cross_layer_issues(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    n, k, sha = F.col("doc_id"), F.col("doc_id") % 12, F.sha2("text", 256)
    rid = n.cast("string")
    model_sha = F.sha2(F.concat(F.lit("m"), rid), 256)
    txt, ifc = F.concat(F.lit("data/"), rid, F.lit(".txt")), F.concat(F.lit("data/"), rid, F.lit(".ifc"))
    records = d.select(rid.alias("record_id"), txt.alias("url"), F.when(k.isin(1, 6), F.reverse(sha)).otherwise(sha).alias("sha256"), ifc.alias("model_url"),
                       F.when(k.isin(2, 6), F.reverse(model_sha)).otherwise(model_sha).alias("model_sha256"), F.when(k == 4, F.concat(rid, F.lit("x"))).otherwise(rid).alias("gid"),
                       rid.alias("resolved_gid"), F.when(k == 5, "IfcSlab").otherwise("IfcWall").alias("cls"))
    inventory = d.select(F.explode(F.array(F.struct(txt.alias("path"), sha.alias("sha256")), F.struct(ifc.alias("path"), model_sha.alias("sha256")))).alias("f")).select("f.*")
    elements = d.select(F.when(k == 3, F.concat(F.lit("other-"), rid)).otherwise(rid).alias("gid"), F.lit("IfcWall").alias("cls"))
    return I.cross_layer_issues(records, inventory, elements)


@query("package_integrity", """
WITH P AS (SELECT doc_id, doc_id%10 AS k FROM documents)
SELECT (doc_id//100)::BIGINT AS package_id, doc_id::VARCHAR AS asset_id, CASE k WHEN 1 THEN 'UNSAFE_PATH' WHEN 2 THEN 'UNSAFE_PATH' WHEN 3 THEN 'ASSET_MISSING' WHEN 4 THEN 'CHECKSUM_MISMATCH' WHEN 5 THEN 'CHECKSUM_MISMATCH' ELSE 'FABRICATED_EXTERNAL_EVIDENCE' END AS issue
FROM P WHERE k IN (1,2,3,4,5,7) UNION ALL SELECT (page_id//100)::BIGINT, 'report-' || page_id, 'REPORT_IDENTITY' FROM pages WHERE page_id%6=0""")
def package_integrity(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    n, k, sha = F.col("doc_id"), F.col("doc_id") % 10, F.sha2("text", 256)
    rid = n.cast("string")
    path = F.concat(F.lit("data/"), rid, F.lit(".txt"))
    external = k >= 6
    assets = d.select(F.floor(n / 100).alias("package_id"), rid.alias("asset_id"),
                      F.when(k == 1, F.concat(F.lit("data/../"), rid)).when(k == 2, F.concat(F.lit("/etc/"), rid)).when(external, F.concat(F.lit("https://example.org/"), rid)).otherwise(path).alias("location"),
                      external.alias("external"), F.when(k == 4, F.reverse(sha)).when(external | (k == 5), F.lit(None)).otherwise(sha).alias("sha256"),
                      F.when(~external | (k == 7), F.octet_length("text")).cast("bigint").alias("bytes"))
    inventory = d.select(F.when(k == 3, F.concat(path, F.lit(".gone"))).otherwise(path).alias("path"), sha.alias("sha256"))
    p = S.table(spark, sf_dir, "pages")
    package = F.floor(F.col("page_id") / 100)
    reports = p.select(F.concat(F.lit("report-"), F.col("page_id").cast("string")).alias("report_id"), package.alias("package_id"),
                       F.when(F.col("page_id") % 6 == 0, package + 1).otherwise(package).alias("stated_id"))
    return I.package_integrity(assets, inventory, reports)


# ------------------------------------------------------------------ overview

def overview(spark, sf_dir):
    """Customers as records: order states as checksum states, priorities as severities, segments as registration."""
    c, o = S.table(spark, sf_dir, "customer"), S.table(spark, sf_dir, "orders")
    summary = c.select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("measurement_file"), F.lit("component").alias("association_level"),
                       F.when(F.col("c_mktsegment") == "BUILDING", "established").otherwise("not established").alias("registration"))
    validation = o.groupBy(F.col("o_custkey").alias("record_id")).agg(F.count_if(F.col("o_orderpriority").startswith("1")).alias("violations"), F.count_if(F.col("o_orderpriority").startswith("2")).alias("warnings"))
    checks = o.select(F.col("o_custkey").alias("record_id"), F.col("o_orderstatus").alias("status"))
    return I.record_overview(summary, validation, checks)


OVERVIEW_SQL = """O AS (SELECT c_custkey AS record_id, c_name AS measurement_file, 'component' AS association_level, CASE WHEN c_mktsegment='BUILDING' THEN 'established' ELSE 'not established' END AS registration,
  count(*) FILTER (o_orderpriority LIKE '1%')::BIGINT AS violations, count(*) FILTER (o_orderpriority LIKE '2%')::BIGINT AS warnings,
  coalesce(string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus), '-') AS checksums FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1,2,3,4)"""


@query("record_overview", "WITH " + OVERVIEW_SQL + " SELECT * FROM O")
def record_overview(spark, sf_dir):
    return overview(spark, sf_dir)


@query("catalog_totals", "WITH " + OVERVIEW_SQL + """
SELECT count(*)::BIGINT AS records, sum(violations)::BIGINT AS violations, sum(warnings)::BIGINT AS warnings, count(*) FILTER (registration<>'not established')::BIGINT AS registered FROM O""")
def catalog_totals(spark, sf_dir):
    return I.catalog_totals(overview(spark, sf_dir))
