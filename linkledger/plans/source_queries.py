"""Queries on sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkledger.model import RDF_TYPE, iri
from linkledger.operators.ordered import number_chunk
from linkledger.operators.spectra import dedupe_points, level_arrays, spectra_cache
from linkledger.plans import standins as S
from linkledger.plans.catalog import query
from linkledger.session import scratch_path
from linkledger.sinks import writers
from linkledger.sources import exports as X
from linkledger.sources import inventory as I
from linkledger.sources import ranges as R
from linkledger.sources.records import flatten_record, parse_records, record_rejects, records_to_triples
from linkledger.sources.registry import layers_from_triples, parse_ntriples, registry_from_triples, registry_provenance, scan_registry, to_ntriples
from linkledger.sources.results import parse_results
from linkledger.sources.tables import VOCAB, node_iri

PATH = S.EXPORT_PATH_SQL


@query("scan_exports", f"""
SELECT {PATH} AS path, CASE WHEN vec_id%16=10 THEN vec_id-10 ELSE vec_id END AS point, vec_id/8.0 AS x, (vec_id%100)/4.0 AS y, 0.5::DOUBLE AS z,
  5::BIGINT AS first_data_line, 10::BIGINT AS bins, round(list_sum(list_transform(embedding[1:10], lambda v: v::DOUBLE)), 6) AS sum_re_x,
  round(list_sum(list_transform(embedding[51:60], lambda v: v::DOUBLE)), 6) AS sum_im_z,
  CASE WHEN vec_id%16=11 THEN 30.0 ELSE 20.0 END::DOUBLE AS f_min
FROM embeddings WHERE vec_id%16 NOT IN (1,2,3,4,5,6,7,8)""")
def scan_exports(spark, sf_dir):
    good = X.parse_exports(S.exports(spark, sf_dir)).where(F.col("reason").isNull())
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 6)
    return good.select("path", "point", "x", "y", "z", F.col("first_data_line").cast("bigint").alias("first_data_line"),
                       F.size("freq").cast("bigint").alias("bins"), total("re_x").alias("sum_re_x"), total("im_z").alias("sum_im_z"),
                       F.element_at("freq", 1).alias("f_min"))


@query("rejects_with_reason", f"""
SELECT {PATH} AS path, CASE vec_id%16 WHEN 1 THEN 'no point header line' WHEN 2 THEN 'no point header line' WHEN 3 THEN 'no numeric data rows'
  WHEN 4 THEN 'non-numeric cell' WHEN 5 THEN 'ragged rows' WHEN 6 THEN 'not 7 columns' ELSE 'NaN or infinity' END AS reason
FROM embeddings WHERE vec_id%16 IN (1,2,3,4,5,6,7,8)""")
def rejects_with_reason(spark, sf_dir):
    return X.rejects_with_reason(X.parse_exports(S.exports(spark, sf_dir)))


@query("read_header_only", f"""
SELECT {PATH} AS path, vec_id%16<>1 AS readable, CASE WHEN vec_id%16=1 THEN NULL WHEN vec_id%16=10 THEN vec_id-10 ELSE vec_id END AS point,
  CASE WHEN vec_id%16<>1 THEN vec_id/8.0 END AS x, CASE WHEN vec_id%16<>1 THEN (vec_id%100)/4.0 END AS y, CASE WHEN vec_id%16<>1 THEN 0.5::DOUBLE END AS z
FROM embeddings""")
def read_header_only(spark, sf_dir):
    return X.scan_headers(S.exports(spark, sf_dir)).select("path", "readable", "point", "x", "y", "z")


_folders: dict[tuple, str] = {}


def export_files(spark, sf_dir):
    """Folder of the exports as real files, written once per session."""
    slot = (spark.sparkContext.applicationId, sf_dir)
    if slot not in _folders:
        folder = scratch_path(spark, "export_files")
        writers.write_files(S.exports(spark, sf_dir), folder)
        _folders[slot] = folder
    return _folders[slot]


def relative(path):
    return F.concat(F.lit("data/"), F.substring_index(path, "/", -1)).alias("path")


@query("read_header_ranges", f"""
SELECT {PATH} AS path, vec_id%16<>1 AS readable, CASE WHEN vec_id%16=1 THEN NULL WHEN vec_id%16=10 THEN vec_id-10 ELSE vec_id END AS point,
  CASE WHEN vec_id%16<>1 THEN vec_id/8.0 END AS x, CASE WHEN vec_id%16<>1 THEN (vec_id%100)/4.0 END AS y, CASE WHEN vec_id%16<>1 THEN 0.5::DOUBLE END AS z
FROM embeddings""")
def read_header_ranges(spark, sf_dir):
    return R.read_headers(spark, export_files(spark, sf_dir)).select(relative("path"), "readable", "point", "x", "y", "z")


@query("scan_export_ranges", "WITH " + S.SPEC_SQL + f""", P AS (SELECT vec_id, {PATH} AS path FROM embeddings)
SELECT path, CASE WHEN vec_id%16=10 THEN vec_id-10 ELSE vec_id END AS point, vec_id/8.0 AS x, freq + CASE WHEN vec_id%16=11 THEN 10 ELSE 0 END + CASE WHEN vec_id%16=12 AND bin=9 THEN 0.5 ELSE 0 END AS freq,
  re_x, re_y, re_z, im_x, im_y, im_z FROM SPEC JOIN P ON vec_id=point WHERE vec_id%16 NOT IN (1,2,3,4,5,6,7,8)""")
def scan_export_ranges(spark, sf_dir):
    # Ranges far smaller than a file, so that lines are cut everywhere.
    rows, _ = R.scan_export_rows(spark, export_files(spark, sf_dir), range_bytes=300)
    return rows.select(relative("path"), "point", "x", "freq", "re_x", "re_y", "re_z", "im_x", "im_y", "im_z")


@query("export_range_rejects", f"""
SELECT {PATH} AS path, CASE vec_id%16 WHEN 1 THEN 'no point header line' WHEN 2 THEN 'no point header line' WHEN 3 THEN 'no numeric data rows'
  WHEN 4 THEN 'non-numeric cell' WHEN 5 THEN 'ragged rows' WHEN 6 THEN 'not 7 columns' ELSE 'NaN or infinity' END AS reason
FROM embeddings WHERE vec_id%16 IN (1,2,3,4,5,6,7,8)""")
def export_range_rejects(spark, sf_dir):
    return R.scan_export_rows(spark, export_files(spark, sf_dir))[1].select(relative("path"), "reason")


@query("file_inventory", """
SELECT 'docs/' || doc_id || '.txt' AS path, doc_id || '.txt' AS name, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS sha256 FROM documents""")
def file_inventory(spark, sf_dir):
    return I.hash_files(S.files(spark, sf_dir)).select("path", "name", "bytes", "sha256")


@query("incremental_inventory", """
SELECT 'docs/' || doc_id || '.txt' AS path, CASE WHEN doc_id%4=0 OR doc_id%6=1 THEN sha256(text) ELSE reverse(sha256(text)) END AS sha256,
  NOT (doc_id%4=0 OR doc_id%6=1) AS reused FROM documents""")
def incremental_inventory(spark, sf_dir):
    # The earlier inventory has other hashes, so a taken-over hash can be told from a fresh one; some files are newer, some unknown.
    files = S.files(spark, sf_dir)
    n = F.col("doc_id")
    previous = files.select(F.when(n % 6 == 1, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"),
                            F.when(n % 4 == 0, F.timestamp_seconds(F.lit(0))).otherwise(F.col("mtime")).alias("mtime"), "bytes",
                            F.reverse(F.sha2("content", 256)).alias("sha256"))
    return I.incremental_inventory(previous, files).select("path", "sha256", "reused")


@query("duplicate_names", """
SELECT sha256(text) AS name, count(*)::BIGINT AS paths, min('docs/' || doc_id || '.txt') AS first_path FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_names(spark, sf_dir):
    named = S.files(spark, sf_dir).select("path", F.sha2("content", 256).alias("name"))
    return I.duplicate_names(named)


FLAT_SQL = "WITH " + S.RECORD_SQL + """
SELECT record_id, doc_id AS point, doc_id || '.txt' AS title, CASE WHEN k=1 THEN NULL ELSE 'https://www.iana.org/assignments/media-types/text/csv' END AS media_type,
  CASE WHEN k=2 THEN -1 ELSE octet_length(encode(text)) END::BIGINT AS bytes, CASE WHEN k=3 THEN upper(sha256(text)) ELSE sha256(text) END AS sha256,
  CASE WHEN k=4 THEN 'processed' WHEN k=5 THEN 'derived' ELSE 'raw' END AS status,
  CASE WHEN k<>10 THEN doc_id/8.0 END AS x, CASE WHEN k<>10 THEN (doc_id%100)/4.0 END AS y, CASE WHEN k<>10 THEN 0.5::DOUBLE END AS z,
  CASE WHEN k=7 THEN 11 ELSE 10 END::BIGINT AS bins, CASE WHEN k<>6 THEN 'unit:HZ' END AS unit,
  CASE WHEN k IN (8,9) THEN 'unresolved' ELSE 'stated in the lab form' END AS procedure_status,
  CASE WHEN k<>11 THEN 'Lab ' || lang END AS location, CASE WHEN k<>13 THEN 20.25::DOUBLE END AS temperature,
  CASE WHEN k=20 THEN 'surface' WHEN k=21 THEN 'point' WHEN k=22 THEN 'room' ELSE 'component' END AS level,
  (1 + doc_id%2)::BIGINT AS targets, CASE WHEN k<>15 THEN sha256('fp' || doc_id) END AS fingerprint,
  CASE WHEN k=18 THEN 0.005 ELSE 0.105 END::DOUBLE AS thickness, CASE WHEN k=24 THEN 'fine' WHEN k<>23 THEN 'valid' END AS binding_status,
  CASE WHEN k NOT IN (30,31) THEN 'persistentIdentifier,accessURL,field_' || lang END AS absent,
  CASE WHEN k=31 THEN NULL WHEN k=9 THEN 'coordinateUnit' ELSE 'excitationType,coordinateUnit' END AS unresolved FROM R"""


def flat_columns(flat):
    return flat.select(
        "record_id", "measurement.point", "integrity.title", "integrity.media_type", "integrity.bytes", "integrity.sha256", "integrity.status",
        "measurement.x", "measurement.y", "measurement.z", F.col("measurement.bins").cast("bigint").alias("bins"), "measurement.unit",
        "measurement.procedure_status", "lineage.location", F.col("lineage.environment")[0]["value"].alias("temperature"), "binding.level",
        F.size("binding.targets").cast("bigint").alias("targets"), F.col("binding.targets")[0]["fingerprint"].alias("fingerprint"),
        F.round(F.aggregate("binding.layers", F.lit(0.0), lambda a, x: a + F.coalesce(x["thickness_m"], F.lit(0.0))), 6).alias("thickness"),
        F.col("binding.status").alias("binding_status"), F.array_join("completeness.absent", ",").alias("absent"),
        F.array_join("completeness.unresolved", ",").alias("unresolved"))


@query("flatten_record", FLAT_SQL)
def flatten(spark, sf_dir):
    return flat_columns(flatten_record(parse_records(S.record_texts(spark, sf_dir))))


@query("nest_record", "WITH " + S.RECORD_SQL + """
SELECT record_id, 'ex:record/' || record_id AS id, 'data/' || doc_id || '.txt' AS url, CASE WHEN k<>26 THEN '2025-02-01T00:00:00+00:00' END AS verified,
  CASE WHEN k=20 THEN NULL ELSE 'IFC_X=Acoustic_X; IFC_Y=Acoustic_Z; IFC_Z=Acoustic_Y' END AS transform,
  CASE WHEN k<>10 THEN '<https://example.org/ldv/id/frame/scan> POINT Z (' || (doc_id/8.0)::DOUBLE || ' ' || ((doc_id%100)/4.0)::DOUBLE || ' 0.5)' END AS wkt FROM R""")
def nest(spark, sf_dir):
    # Cells of the nested document read back by their JSON path.
    texts = S.rendered_records(spark, sf_dir)
    cell = lambda path: F.get_json_object("text", path)
    topic, link = "$['foaf:primaryTopic']", "$['dcterms:relation']"
    return texts.select(
        "record_id", cell("$['@id']").alias("id"), cell(topic + "['sosa:hasResult']['dcat:downloadURL']['@id']").alias("url"),
        cell(link + "['prov:wasGeneratedBy']['prov:endedAtTime']['@value']").alias("verified"),
        cell(link + "['prov:wasInfluencedBy']['ldv:transform']").alias("transform"),
        cell(topic + "['sosa:hasFeatureOfInterest']['geo:hasGeometry']['geo:asWKT']['@value']").alias("wkt"))


@query("scan_records", "WITH " + S.RECORD_SQL + """
SELECT record_id, CASE WHEN doc_id%9=4 THEN 'not valid JSON' WHEN doc_id%9=5 THEN 'no record layout' END AS reason FROM R WHERE doc_id%9 IN (4,5)""")
def scan_records(spark, sf_dir):
    # The parsing gate: some documents are cut short, some are no records.
    texts = S.record_texts(spark, sf_dir)
    n = F.substring_index("record_id", "-", -1).cast("bigint") % 9
    broken = F.when(n == 4, F.expr("left(text, length(text) - 1)")).when(n == 5, F.lit('{"a": 1}')).otherwise(F.col("text"))
    return record_rejects(parse_records(texts.withColumn("text", broken)))


@query("records_to_triples", "WITH " + S.RECORD_SQL + """
SELECT p, n FROM (
  SELECT 'csvw#first' AS p, count(*)*4 AS n FROM R
  UNION ALL SELECT 'csvw#column', count(*) FROM R
  UNION ALL SELECT 'dqv#value', sum(2 + CASE WHEN k=28 THEN 0 ELSE 0 END + CASE WHEN k=21 THEN 1 ELSE 0 END + CASE WHEN k=23 THEN 0 ELSE 1 END
     + CASE WHEN k IN (30,31) THEN 0 ELSE 3 END + CASE WHEN k=31 THEN 0 WHEN k=9 THEN 1 ELSE 2 END)+ count(*) FROM R
  UNION ALL SELECT 'numericValue', count(*) FILTER (k<>13) FROM R
  UNION ALL SELECT 'hasSubElement', count(*) FILTER (doc_id%2=1) FROM R
  UNION ALL SELECT 'identifier', sum(CASE WHEN doc_id%2=1 AND k<>17 THEN 2 ELSE 1 END) + sum(1 + 1 + doc_id%2) FROM R) t""".replace("SELECT p, n FROM", "SELECT p, n::BIGINT AS n FROM"))
def to_triples(spark, sf_dir):
    # Statement counts of predicates that depend on the defects, converted anew from the stored texts.
    t = records_to_triples(S.record_texts(spark, sf_dir))
    names = {iri("rdf:first"): "csvw#first", iri("csvw:column"): "csvw#column", iri("dqv:value"): "dqv#value", iri("qudt:numericValue"): "numericValue",
             iri("bot:hasSubElement"): "hasSubElement", iri("dcterms:identifier"): "identifier", iri("ls:identifier"): "identifier"}
    lookup = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    counts = t.where(F.col("p").isin(list(names))).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(F.element_at(lookup, F.col("p")).alias("p")).agg(F.sum("n").alias("n"))


@query("tables_to_triples", """
SELECT p, o_kind, n::BIGINT AS n, objects::BIGINT AS objects FROM (
  SELECT 'type' AS p, 'iri' AS o_kind, (SELECT count(*) FROM region)+(SELECT count(*) FROM nation)+(SELECT count(*) FROM customer)+(SELECT count(*) FROM orders) AS n, 4 AS objects
  UNION ALL SELECT 'o_custkey','iri',count(o_custkey),count(DISTINCT o_custkey) FROM orders
  UNION ALL SELECT 'c_nationkey','iri',count(c_nationkey),count(DISTINCT c_nationkey) FROM customer
  UNION ALL SELECT 'n_regionkey','iri',count(n_regionkey),count(DISTINCT n_regionkey) FROM nation
  UNION ALL SELECT 'r_name','literal',count(r_name),count(DISTINCT r_name) FROM region UNION ALL SELECT 'n_name','literal',count(n_name),count(DISTINCT n_name) FROM nation
  UNION ALL SELECT 'c_name','literal',count(c_name),count(DISTINCT c_name) FROM customer UNION ALL SELECT 'c_acctbal','literal',count(c_acctbal),count(DISTINCT c_acctbal) FROM customer
  UNION ALL SELECT 'c_mktsegment','literal',count(c_mktsegment),count(DISTINCT c_mktsegment) FROM customer
  UNION ALL SELECT 'o_orderstatus','literal',count(o_orderstatus),count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_totalprice','literal',count(o_totalprice),count(DISTINCT o_totalprice) FROM orders
  UNION ALL SELECT 'o_orderdate','literal',count(o_orderdate),count(DISTINCT o_orderdate) FROM orders UNION ALL SELECT 'o_orderpriority','literal',count(o_orderpriority),count(DISTINCT o_orderpriority) FROM orders) t""")
def tables_to_triples(spark, sf_dir):
    t = S.table_graph(spark, sf_dir)
    p = F.when(F.col("p") == RDF_TYPE, "type").otherwise(F.substring_index("p", "/", -1))
    return t.groupBy(p.alias("p"), "o_kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o").alias("objects"))


@query("scan_registry", """
SELECT 'https://example.org/tables/id/customer/' || c_custkey AS s, 'c_name' AS p, c_name AS o, 'literal' AS o_kind FROM customer
UNION ALL SELECT 'https://example.org/tables/id/customer/' || c_custkey, 'c_mktsegment', c_mktsegment, 'literal' FROM customer
UNION ALL SELECT 'https://example.org/tables/id/customer/' || c_custkey, 'c_nationkey', 'https://example.org/tables/id/nation/' || c_nationkey, 'iri' FROM customer""")
def registry_lines(spark, sf_dir):
    # Statements written as N-Triples lines and parsed back.
    lines = to_ntriples(S.table_graph(spark, sf_dir))
    back = parse_ntriples(lines, "line", F.lit("registry"))
    p = F.substring_index("p", "/", -1)
    return back.select("s", p.alias("p"), "o", "o_kind").where(F.col("p").isin("c_name", "c_mktsegment", "c_nationkey"))


@query("pivot_registry", """
SELECT 'https://example.org/tables/id/customer/' || c_custkey AS record_uri, c_name AS name, c_mktsegment AS segment, n_name AS nation, n_nationkey::VARCHAR AS component
FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey OR c_custkey%4=0 AND n_nationkey=(c_nationkey+1)%25""")
def pivot_registry(spark, sf_dir):
    # Every fourth customer points to a second nation.
    t = S.table_graph(spark, sf_dir)
    c = S.table(spark, sf_dir, "customer").where(F.col("c_custkey") % 4 == 0)
    second = c.select(node_iri("customer", "c_custkey").alias("s"), F.lit(VOCAB + "c_nationkey").alias("p"), node_iri("nation", (F.col("c_nationkey") + 1) % 25).alias("o"))
    t = t.select("s", "p", "o").unionByName(second)
    return registry_from_triples(t, VOCAB + "Customer", VOCAB + "c_nationkey", {"name": VOCAB + "c_name", "segment": VOCAB + "c_mktsegment"}, {"nation": VOCAB + "n_name"})


@query("scan_registry_statements", """
WITH N AS (SELECT unnest([{'t':'region','c':'Region'},{'t':'nation','c':'Nation'},{'t':'customer','c':'Customer'},{'t':'orders','c':'Orders'}], recursive := true)),
L AS (SELECT 'region/' || r_regionkey AS s, unnest([{'p':'r_name','v':r_name,'n':NULL::DOUBLE,'k':'literal','t':'string'}], recursive := true) FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, unnest([{'p':'n_name','v':n_name,'n':NULL::DOUBLE,'k':'literal','t':'string'}, {'p':'n_regionkey','v':'region/' || n_regionkey,'n':NULL::DOUBLE,'k':'iri','t':NULL}], recursive := true) FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, unnest([{'p':'c_name','v':c_name,'n':NULL::DOUBLE,'k':'literal','t':'string'}, {'p':'c_mktsegment','v':c_mktsegment,'n':NULL::DOUBLE,'k':'literal','t':'string'},
    {'p':'c_nationkey','v':'nation/' || c_nationkey,'n':NULL::DOUBLE,'k':'iri','t':NULL}, {'p':'c_acctbal','v':NULL,'n':c_acctbal,'k':'literal','t':'double'}], recursive := true) FROM customer
  UNION ALL SELECT 'orders/' || o_orderkey, unnest([{'p':'o_custkey','v':'customer/' || o_custkey,'n':NULL::DOUBLE,'k':'iri','t':NULL}, {'p':'o_orderstatus','v':o_orderstatus,'n':NULL::DOUBLE,'k':'literal','t':'string'},
    {'p':'o_totalprice','v':NULL,'n':o_totalprice,'k':'literal','t':'double'}, {'p':'o_orderdate','v':o_orderdate::VARCHAR,'n':NULL::DOUBLE,'k':'literal','t':'dateTime'},
    {'p':'o_orderpriority','v':o_orderpriority,'n':NULL::DOUBLE,'k':'literal','t':'string'}], recursive := true) FROM orders),
S AS (SELECT s, p, v, n, k, t FROM L UNION ALL SELECT DISTINCT s, 'type', c, NULL, 'iri', NULL FROM L JOIN N ON split_part(s,'/',1)=N.t)
SELECT s, p, v AS o, n AS number, k AS o_kind, t AS o_type FROM S WHERE v IS NOT NULL OR n IS NOT NULL""")
def scan_registry_statements(spark, sf_dir):
    # All statements of all predicates, written as N-Triples lines and parsed back; IRIs by their own part.
    back = parse_ntriples(to_ntriples(S.table_graph(spark, sf_dir)), "line", F.lit("registry"))
    number = F.col("o_type") == iri("xsd:double")
    after = lambda c, start: F.when(F.col(c).startswith(start), F.substr(F.col(c), F.lit(len(start) + 1)))
    ids, terms = "https://example.org/tables/id/", "https://example.org/tables/v/"
    node = F.coalesce(after("o", ids), after("o", terms), F.col("o"))
    return back.select(
        F.coalesce(after("s", ids), F.col("s")).alias("s"), F.substring_index(F.substring_index("p", "/", -1), "#", -1).alias("p"),
        F.when(F.col("o_kind") == "iri", node).when(~number, F.col("o")).alias("o"), F.when(number, F.col("o").cast("double")).alias("number"),
        "o_kind", F.substring_index("o_type", "#", -1).alias("o_type"))


@query("scan_registry_json", """
SELECT 'https://example.org/record/' || s_suppkey AS record_uri, 's-' || s_suppkey AS RecordIdentifier, 'Rw' AS AcousticMetric, s_acctbal::DOUBLE AS AcousticValue,
  CASE WHEN s_suppkey%3<>0 THEN 'dB' END AS AcousticUnit, s_name || '||"q"' AS AssemblyDescription, n_name AS ConstructionType, s_suppkey/1000.0::DOUBLE AS TotalThickness_m,
  CASE WHEN s_suppkey%4<>0 THEN s_suppkey/8.0 END::DOUBLE AS TestArea_m2, s_suppkey/16.0::DOUBLE AS SpecimenLengthX_m, s_suppkey/32.0::DOUBLE AS SpecimenLengthY_m,
  s_nationkey::DOUBLE AS SurfaceMass_kg_m2, 'method' AS MethodType, 'report' AS SourceType, 'Anhang ' || s_suppkey AS SourceReference, '2022' AS DataYear, 'v' || s_suppkey%5 AS RecordVersion,
  'agent é' AS ResponsibleAgent, 'https://example.org/source/' || s_suppkey AS SourceURI FROM supplier JOIN nation ON s_nationkey=n_nationkey""")
def scan_registry_json(spark, sf_dir):
    # Suppliers as registry objects, one indented JSON file each, read back by the declared schema.
    key = F.col("s_suppkey")
    record = {
        "RecordIdentifier": F.concat(F.lit("s-"), key), "AcousticMetric": F.lit("Rw"), "AcousticValue": F.col("s_acctbal").cast("double"), "AcousticUnit": F.when(key % 3 != 0, "dB"),
        "AssemblyDescription": F.concat("s_name", F.lit('||"q"')), "ConstructionType": F.col("n_name"), "TotalThickness_m": key / 1000.0, "TestArea_m2": F.when(key % 4 != 0, key / 8.0),
        "SpecimenLengthX_m": key / 16.0, "SpecimenLengthY_m": key / 32.0, "SurfaceMass_kg_m2": F.col("s_nationkey").cast("double"), "MethodType": F.lit("method"),
        "SourceType": F.lit("report"), "SourceReference": F.concat(F.lit("Anhang "), key), "DataYear": F.lit("2022"), "RecordVersion": F.concat(F.lit("v"), key % 5),
        "ResponsibleAgent": F.lit("agent é"), "SourceURI": F.concat(F.lit("https://example.org/source/"), key)}
    whole = F.struct(F.concat(F.lit("https://example.org/record/"), key).alias("record_uri"), F.struct(*[c.alias(n) for n, c in record.items()]).alias("record"))

    def build():
        joined = S.table(spark, sf_dir, "supplier").join(S.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return joined.select(F.format_string("%d.json", key).alias("path"), F.encode(F.to_json(whole, {"pretty": "true"}), "UTF-8").alias("content"))

    # All in one folder and under their final names: no folder, listing or renaming per file in the driver.
    folder = scratch_path(spark, "registry_json")
    writers.write_files(S.spread(build(), "path", 1024), folder)
    return scan_registry(spark, folder, "json")


@query("registry_provenance", """
WITH C AS (SELECT *, 'https://example.org/tables/id/customer/' || c_custkey AS record_uri FROM customer),
P AS (SELECT record_uri, 'agent' AS role, 'https://example.org/tables/id/nation/' || c_nationkey AS node, n_name AS label FROM C LEFT JOIN nation ON c_nationkey=n_nationkey WHERE c_custkey%11<>0
  UNION ALL SELECT record_uri, 'source', 'https://example.org/source/' || unnest([c_nationkey, (c_nationkey+1)%25]), NULL FROM C WHERE c_custkey%3=0 AND c_custkey%11<>0
  UNION ALL SELECT 'https://example.org/tables/id/customer/' || o_custkey, 'activity', 'https://example.org/tables/id/orders/' || o_orderkey, o_orderstatus FROM orders JOIN C ON o_custkey=c_custkey)
SELECT C.record_uri, role, node, label FROM C LEFT JOIN P ON C.record_uri=P.record_uri""")
def provenance(spark, sf_dir):
    # A customer is attributed to its nation (every eleventh to none), comes from two sources (every third) and was made by its orders.
    t = S.table_graph(spark, sf_dir).select("s", "p", "o")
    number = F.substring_index("s", "/", -1).cast("bigint")
    own = t.where(~((F.col("p") == VOCAB + "c_nationkey") & (number % 11 == 0)))
    made = t.where(F.col("p") == VOCAB + "o_custkey").select(F.col("o").alias("s"), F.lit("made").alias("p"), F.col("s").alias("o"))
    c = S.table(spark, sf_dir, "customer").where((F.col("c_custkey") % 3 == 0) & (F.col("c_custkey") % 11 != 0))
    source = F.explode(F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25))
    derived = c.select(node_iri("customer", "c_custkey").alias("s"), F.lit("derived").alias("p"), source.alias("n")).select("s", "p", F.concat(F.lit("https://example.org/source/"), "n").alias("o"))
    return registry_provenance(own.unionByName(made).unionByName(derived), VOCAB + "Customer", VOCAB + "c_nationkey", VOCAB + "n_name", "derived", "made", VOCAB + "o_orderstatus")


@query("registry_layers", """
SELECT 'https://example.org/tables/id/nation/' || c_nationkey AS component, 'https://example.org/tables/id/customer/' || c_custkey AS layer, c_name AS layer_name, c_mktsegment AS category FROM customer""")
def registry_layers(spark, sf_dir):
    t = S.table_graph(spark, sf_dir)
    # A nation's customers stand for a component's layers: the link is read from its far end.
    links = t.where(F.col("p") == VOCAB + "c_nationkey").select("record_id", F.col("o").alias("s"), F.lit(VOCAB + "hasLayer").alias("p"), F.col("s").alias("o"))
    both = t.select("record_id", "s", "p", "o").unionByName(links)
    return layers_from_triples(both, VOCAB + "hasLayer", {"layer_name": VOCAB + "c_name", "category": VOCAB + "c_mktsegment"}).select("component", "layer", "layer_name", "category")


@query("scan_results", """
SELECT o_orderpriority AS approach, CASE WHEN o_orderkey%3=0 THEN NULL ELSE o_orderstatus END AS link_status, count(*)::BIGINT AS n, sum(o_custkey)::BIGINT AS answered
FROM orders GROUP BY 1, 2""")
def scan_results(spark, sf_dir):
    # Orders as CSV lines with N/A cells, read with a declared schema.
    o = S.table(spark, sf_dir, "orders")
    line = F.concat_ws(",", "o_orderpriority", F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "N/A").otherwise(F.col("o_orderstatus")))
    rows = parse_results(o.select(line.alias("line")), "line", "approach STRING, answered BIGINT, link_status STRING")
    return rows.groupBy("approach", "link_status").agg(F.count(F.lit(1)).alias("n"), F.sum("answered").alias("answered"))


# ------------------------------------------------------------------ sinks

@query("write_records", "SELECT source, count(*)::BIGINT AS records, sum(doc_id)::BIGINT AS points FROM documents GROUP BY 1")
def write_records(spark, sf_dir):
    # Written twice to the same place: the second write replaces the first.
    texts = S.record_texts(spark, sf_dir).join(S.table(spark, sf_dir, "documents").select(
        F.format_string("rec-%07d", "doc_id").alias("record_id"), "source"), "record_id")
    path = scratch_path(spark, "records")
    for _ in range(2):
        writers.write_records(texts, path, "source")
    back = spark.read.schema("value STRING, source STRING").text(path)
    point = F.get_json_object("value", "$['foaf:primaryTopic']['sosa:hasFeatureOfInterest']['dcterms:identifier']").cast("bigint")
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(point).alias("points"))


@query("scan_index", """
SELECT o_custkey AS scan, o_orderkey AS member, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS position FROM orders""")
def scan_index(spark, sf_dir):
    points = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scan"), F.col("o_orderkey").alias("member"))
    return writers.scan_index(points, "scan", ["member"], number_chunk("member")).select("scan", "member", "position")


@query("scan_index_header", """
SELECT o_custkey AS scan, count(*)::BIGINT AS n_points, 'Index of the ' || count(*) || ' point records' AS description FROM orders GROUP BY 1""")
def scan_index_header(spark, sf_dir):
    return writers.scan_index_header(S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scan")), "scan")


@query("write_spectra_cache", "WITH " + S.LEVELS_SQL + """, L AS (SELECT point, 'X' AS channel, X AS db FROM LEVELS UNION ALL SELECT point, 'Y', Y FROM LEVELS
  UNION ALL SELECT point, 'Z', Z FROM LEVELS UNION ALL SELECT point, 'NORM', NORM FROM LEVELS)
SELECT point, channel, 20.0::DOUBLE AS freq0, 1.0::DOUBLE AS step, count(*)::BIGINT AS bins, round(max(db),2) AS max_db, round(min(db),2) AS min_db, round(avg(round(db,2)),4) AS avg_db
FROM L GROUP BY 1, 2""")
def write_spectra_cache(spark, sf_dir):
    path = scratch_path(spark, "spectra_cache")
    writers.write_spectra_cache(spectra_cache(level_arrays(S.spectra(spark, sf_dir))), path)
    back = spark.read.parquet(path)
    mean = F.aggregate("db", F.lit(0.0), lambda a, v: a + v) / F.size("db")
    return back.select("point", "channel", "freq0", "step", F.col("count").cast("bigint").alias("bins"), F.array_max("db").alias("max_db"),
                       F.array_min("db").alias("min_db"), F.round(mean, 4).alias("avg_db"))


@query("write_manifest", """
SELECT 'data' AS kind, 'docs/' || doc_id || '.txt' AS path, sha256(text) AS sha256, doc_id AS point, octet_length(encode(text))::BIGINT AS bytes, NULL::VARCHAR AS reason FROM documents
UNION ALL SELECT 'record', 'page/' || page_id, sha256(html), NULL, octet_length(encode(html))::BIGINT, NULL FROM pages
UNION ALL SELECT 'derived', 'turn/' || conv_id || '/' || turn, sha256(text), NULL, octet_length(encode(text))::BIGINT, NULL FROM conversations
UNION ALL SELECT 'excluded', 'benchmark/' || item_id, NULL, NULL, NULL, 'no numeric data rows' FROM benchmark""")
def write_manifest(spark, sf_dir):
    text = lambda path, c: [path.alias("path"), F.sha2(c, 256).alias("sha256"), F.octet_length(c).cast("bigint").alias("bytes")]
    docs = S.table(spark, sf_dir, "documents").select(*text(F.format_string("docs/%d.txt", "doc_id"), "text"), F.col("doc_id").alias("point"))
    pages = S.table(spark, sf_dir, "pages").select(*text(F.format_string("page/%d", "page_id"), "html"))
    turns = S.table(spark, sf_dir, "conversations").select(*text(F.format_string("turn/%d/%d", "conv_id", "turn"), "text"))
    rejects = S.table(spark, sf_dir, "benchmark").select(F.format_string("benchmark/%d", "item_id").alias("path"), F.lit("no numeric data rows").alias("reason"))
    path = scratch_path(spark, "manifest")
    writers.write_manifest(writers.build_manifest("build-1", {"data": docs, "record": pages, "derived": turns}, rejects), path)
    return spark.read.parquet(path).select("kind", "path", "sha256", "point", "bytes", "reason")


@query("write_report_csv", "SELECT c_mktsegment AS segment, count(*)::BIGINT AS customers, round(sum(c_acctbal),2) AS balance FROM customer GROUP BY 1")
def write_report_csv(spark, sf_dir):
    report = S.table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    path = scratch_path(spark, "report")
    writers.write_report_csv(report, path)
    return spark.read.csv(path, header=True, schema="segment STRING, customers BIGINT, balance DOUBLE")


@query("first_wins", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice,2) AS price, kept_partkey, rn=1 AS kept FROM (
  SELECT *, row_number() OVER w AS rn, first_value(l_partkey) OVER w AS kept_partkey FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice)) t""")
def first_wins(spark, sf_dir):
    items = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    kept, listed = dedupe_points(items, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("price")]
    return (kept.select(*columns, F.col("l_partkey").alias("kept_partkey"), F.lit(True).alias("kept"))
            .unionByName(listed.select(*columns, F.col("kept_l_partkey").alias("kept_partkey"), F.lit(False).alias("kept"))))
