"""Queries on projections, scalar functions and form facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkledger.functions import geometry as G
from linkledger.functions import text as TX
from linkledger.functions.hashing import fingerprint, material_label
from linkledger.operators import facts as FA
from linkledger.plans import standins as S
from linkledger.plans.catalog import query
from linkledger.sources.records import parse_records, quality_value

PART_TEMPLATE = "Scan of {point} ({point})"


@query("fill_template", """
SELECT p_partkey, replace('Scan of {point} ({point})', '{point}', 'point-' || lpad(p_partkey::VARCHAR, 9, '0')) AS title,
  'ex:file/point-' || lpad(p_partkey::VARCHAR, 9, '0') AS file_id, p_name || '/point-' || lpad(p_partkey::VARCHAR, 9, '0') AS tag FROM part""")
def fill_template(spark, sf_dir):
    # A nested template struct per part; every string below it is filled.
    parts = S.table(spark, sf_dir, "part")
    template = parts.select("p_partkey", F.struct(F.lit(PART_TEMPLATE).alias("title"), F.struct(F.lit("ex:file/{point}").alias("id")).alias("file"),
                                                  F.array(F.concat("p_name", F.lit("/{point}"))).alias("tags")).alias("t"))
    tag = F.concat(F.lit("point-"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    filled = template.select("p_partkey", TX.fill_placeholder("t", template.schema["t"].dataType, tag).alias("t"))
    return filled.select("p_partkey", "t.title", F.col("t.file.id").alias("file_id"), F.col("t.tags")[0].alias("tag"))


@query("local_name", """
SELECT page_id, CASE WHEN contains(url,'#') THEN split_part(url, '#', -1) ELSE split_part(rtrim(url,'/'), '/', -1) END AS tail FROM pages""")
def local_name(spark, sf_dir):
    return S.table(spark, sf_dir, "pages").select("page_id", TX.local_name("url").alias("tail"))


@query("vocabulary_of", """
SELECT page_id, CASE WHEN url LIKE 'http://m.%' OR url LIKE 'https://m.%' THEN CASE WHEN url LIKE 'http://m.%' THEN 'mobile' ELSE 'mobile-s' END
  WHEN url LIKE 'https://%' THEN 'web-s' WHEN url LIKE 'http://%' THEN 'web' ELSE 'other' END AS prefix,
  CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'steward' ELSE 'unknown' END AS steward FROM pages""")
def vocabulary_of(spark, sf_dir):
    table = {"mobile": ("http://m.", "steward"), "mobile-s": ("https://m.", "steward"), "web-s": ("https://", "steward"), "web": ("http://", "steward")}
    return S.table(spark, sf_dir, "pages").select("page_id", TX.vocabulary("url", table).alias("v")).select("page_id", "v.prefix", "v.steward")


@query("parse_point_wkt", """
SELECT s_suppkey, CASE WHEN s_suppkey%5<>0 AND s_suppkey%3<>0 THEN 'https://example.org/frame/' || s_nationkey END AS frame,
  CASE WHEN s_suppkey%5<>0 THEN s_acctbal END AS x, CASE WHEN s_suppkey%5<>0 THEN s_nationkey/4.0 END AS y, CASE WHEN s_suppkey%5<>0 THEN -0.5::DOUBLE END AS z FROM supplier""")
def parse_point_wkt(spark, sf_dir):
    s = S.table(spark, sf_dir, "supplier")
    body = F.concat(F.lit("point z ( "), F.col("s_acctbal").cast("string"), F.lit(" "), (F.col("s_nationkey") / 4.0).cast("string"), F.lit(" -0.5 )"))
    frame = F.concat(F.lit("<https://example.org/frame/"), F.col("s_nationkey").cast("string"), F.lit("> "))
    wkt = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("LINE"), body)).when(F.col("s_suppkey") % 3 == 0, body).otherwise(F.concat(frame, body))
    return s.select("s_suppkey", TX.parse_point(wkt).alias("p")).select("s_suppkey", "p.*")


@query("format_point_wkt", """
SELECT s_suppkey, '<https://example.org/frame/1> POINT Z (' || (s_nationkey/4.0)::DOUBLE || ' ' || (s_suppkey/8.0)::DOUBLE || ' -0.5)' AS wkt FROM supplier""")
def format_point_wkt(spark, sf_dir):
    s = S.table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", TX.format_point(F.lit("https://example.org/frame/1"), F.col("s_nationkey") / 4.0, F.col("s_suppkey") / 8.0, F.lit(-0.5)).alias("wkt"))


@query("quantity_to_metres", """
SELECT p_partkey, CASE WHEN p_partkey%7=0 THEN NULL WHEN p_partkey%2=0 THEN p_size/1000.0 ELSE p_size::DOUBLE END AS metres FROM part""")
def quantity_to_metres(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    value = F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    return p.select("p_partkey", TX.to_metres(value, F.when(F.col("p_partkey") % 2 == 0, "MMT").otherwise("MTR")).alias("metres"))


@query("quality_value", """
SELECT doc_id, CASE WHEN quality=1 THEN 'q' || (doc_id%7) || ',x' END AS status, CASE WHEN toxic=0 THEN 't' || (doc_id%5) END AS unit_status FROM labels""")
def quality_values(spark, sf_dir):
    # Nodes with a list of measurements, a single measurement and list or single values.
    cell = lambda metric, value: F.struct(F.struct(F.lit(f"https://example.org/ldv/metric/{metric}").alias("@id")).alias("dqv:isMeasurementOf"), value.alias("dqv:value"))
    q = F.concat(F.lit("q"), (F.col("doc_id") % 7).cast("string"))
    t = F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string"))
    nodes = S.table(spark, sf_dir, "labels").select("doc_id", F.to_json(F.struct(F.array_compact(F.array(
        F.when(F.col("quality") == 1, F.to_json(cell("status", F.array(q, F.lit("x"))))), F.when(F.col("toxic") == 0, F.to_json(cell("unitStatus", t)))))
        .alias("m"))).alias("raw"))
    # The inner objects were serialised on their own, so that both value shapes fit one array.
    items = F.array_join(F.from_json(F.get_json_object("raw", "$.m"), "array<string>"), ",")
    text = F.concat(F.lit('{"dqv:hasQualityMeasurement":['), items, F.lit("]}"))
    parsed = parse_records(nodes.select("doc_id", text.alias("text")))
    return parsed.select("doc_id", F.array_join(quality_value("doc", "status"), ",").alias("status"), F.array_join(quality_value("doc", "unitStatus"), ",").alias("unit_status"))


@query("fingerprint", """
WITH B AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey%9<>0 THEN 'mat' || s_nationkey END AS mat, (s_suppkey*2+1)/2000::DOUBLE AS a, CASE WHEN s_suppkey%11=0 THEN NULL WHEN s_suppkey%13=0 THEN 'nan'::DOUBLE ELSE s_nationkey/16::DOUBLE END AS b FROM supplier)
SELECT s_suppkey, CASE WHEN NOT isnan(b) THEN sha256(s_name || '|IfcWall|' || coalesce(mat,'None') || '|' || printf('%.3f', a) || ',' || printf('%.3f', b) || ',0.000|' || printf('%.3f', -a) || ',' || printf('%.3f', b+2) || ',0.500') END AS fingerprint FROM B""")
def fingerprints(spark, sf_dir):
    s = S.table(spark, sf_dir, "supplier")
    # Half millimetres: ties in decimal text, a little more or less than that in binary; sixteenths are true ties.
    k = F.col("s_suppkey")
    a, b = (k * 2 + 1) / 2000.0, F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, float("nan")).otherwise(F.col("s_nationkey") / 16.0)
    material = F.when(F.col("s_suppkey") % 9 != 0, F.concat(F.lit("mat"), F.col("s_nationkey").cast("string")))
    return s.select("s_suppkey", fingerprint("s_name", F.lit("IfcWall"), material, [a, b, F.lit(-0.0)], [-a, b + 2, F.lit(0.5)]).alias("fingerprint"))


@query("material_label", """
SELECT p_partkey, CASE WHEN p_partkey%6=0 THEN p_type ELSE p_brand || '[' || split_part(p_name,' ',1) || '@' || (p_size/4.0)::DOUBLE || '/' || split_part(p_name,' ',2) || '@' || (p_size/8.0)::DOUBLE || ']' END AS label FROM part""")
def material_labels(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    layer = lambda i, d: F.struct(words[i].alias("name"), (F.col("p_size") / d).alias("thickness"))
    return p.select("p_partkey", "p_brand", "p_type", F.when(F.col("p_partkey") % 6 != 0, F.array(layer(0, 4.0), layer(1, 8.0))).alias("layers")).select(
        "p_partkey", material_label("p_brand", "layers", "p_type").alias("label"))


@query("display_name", """
SELECT p_partkey, CASE WHEN p_partkey%4=0 AND p_partkey%3=0 THEN 'Part:' || p_partkey WHEN p_partkey%4=0 THEN p_type WHEN p_partkey%4=1 AND p_partkey%8=1 THEN 'id-' || p_partkey WHEN p_partkey%4=1 THEN 'Wall 12' ELSE p_name END AS shown FROM part""")
def display_name(spark, sf_dir):
    # Generic names with a material label, generic or missing names without one, and proper names.
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Part:"), k.cast("string"))).when(k % 8 == 1, F.lit(None)).when(k % 4 == 1, "Wall 12").otherwise(F.col("p_name"))
    material = F.when(k % 4 == 0, F.col("p_type"))
    return S.table(spark, sf_dir, "part").select("p_partkey", TX.display_name(name, material, F.concat(F.lit("id-"), k.cast("string")), F.when(k % 3 == 0, "single").otherwise("parts")).alias("shown"))


@query("apply_frame", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity + 1.5, 6) AS x, round(-l_tax + 2, 6) AS y, round(l_discount, 6) AS z FROM lineitem""")
def apply_frame(spark, sf_dir):
    matrix = [[1.0, 0.0, 0.0, 1.5], [0.0, 0.0, -1.0, 2.0], [0.0, 1.0, 0.0]]
    moved = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.apply_frame(matrix, "l_quantity", "l_discount", "l_tax").alias("m"))
    return moved.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(f"m.{a}", 6).alias(a) for a in "xyz"])


@query("frame_from_mapping", """
SELECT c_custkey, CASE c_custkey%5 WHEN 0 THEN 'PSET' WHEN 1 THEN 'PSET' WHEN 2 THEN 'UNREADABLE' WHEN 3 THEN 'EXPLICIT' ELSE 'DEFAULT' END AS kind,
  CASE c_custkey%5 WHEN 0 THEN 'declared by model; not confirmed by lab' WHEN 1 THEN 'declared by model; not confirmed by lab' WHEN 2 THEN 'mapping cannot be read'
    WHEN 3 THEN 'declared in project.json; not confirmed by lab' ELSE 'ASSUMED default; nobody declared it' END AS status,
  CASE c_custkey%5 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN NULL WHEN 3 THEN -2 ELSE 1 END::INTEGER AS normal_sign,
  CASE c_custkey%5 WHEN 0 THEN '1,0,0,0,0,0,1,0,0,1,0,0,0,0,0,1' WHEN 1 THEN '1,0,0,0,0,0,-1,0,0,1,0,0,0,0,0,1' WHEN 2 THEN NULL WHEN 3 THEN '1,0,0,4,0,-2,0,5,0,0,1,6,0,0,0,1'
    ELSE '1,0,0,0,0,0,1,0,0,1,0,0,0,0,0,1' END AS cells,
  CASE c_custkey%5 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN false WHEN 4 THEN true END AS low_face FROM customer""")
def frame_from_mapping(spark, sf_dir):
    k = F.col("c_custkey") % 5
    mapping = F.when(k.isin(0, 1), G.DEFAULT_MAPPING).when(k == 2, "IFC_X=Acoustic_X; IFC_Y=Acoustic_Z")
    note = F.when(k == 0, "perpendicular, directed into the wall").otherwise("out of the wall")
    explicit = F.when(k == 3, F.array(*[F.lit(float(v)) for v in (1, 0, 0, 4, 0, -2, 0, 5, 0, 0, 1, 6, 0, 0, 0, 1)]))
    f = G.with_frame(S.table(spark, sf_dir, "customer"), mapping, note, explicit, "f")
    return f.select("c_custkey", "f.kind", "f.status", "f.normal_sign", "f.low_face",
                    F.array_join(F.transform("f.matrix", lambda v: v.cast("int").cast("string")), ",").alias("cells"))


@query("inside_extent", """
SELECT o_orderkey, o_totalprice BETWEEN 50000 AND 250000 AND o_custkey BETWEEN 100 AND 900 AS inside FROM orders""")
def inside_extent(spark, sf_dir):
    lit = lambda v: F.lit(float(v))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", G.inside_extent("o_totalprice", "o_custkey", lit(50000), lit(250000), lit(100), lit(900)).alias("inside"))


@query("to_display", """
SELECT s_suppkey, s_acctbal AS x, round(CASE WHEN s_suppkey%2=0 THEN s_nationkey - 0.001 ELSE s_nationkey + 3 + 0.001 END, 6)::DOUBLE AS y, s_suppkey/4.0 AS z FROM supplier""")
def to_display(spark, sf_dir):
    s = S.table(spark, sf_dir, "supplier")
    low = F.col("s_suppkey") % 2 == 0
    face = G.face_position(low, F.col("s_nationkey").cast("double"), F.col("s_nationkey") + 3.0)
    shown = s.select("s_suppkey", G.display_position("s_acctbal", F.col("s_suppkey") / 4.0, face, F.when(low, 1).otherwise(-1)).alias("d"))
    return shown.select("s_suppkey", "d.x", F.round("d.y", 6).alias("y"), "d.z")


@query("keyword_class", """
SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%widget%' THEN 'W' WHEN lower(p_name) LIKE '%small%' THEN 'S' WHEN lower(p_name) LIKE '%red%' THEN 'R' WHEN lower(p_name) LIKE '%ed%' THEN 'E' ELSE 'none' END AS cls FROM part""")
def keyword_class(spark, sf_dir):
    return S.table(spark, sf_dir, "part").select("p_partkey", TX.keyword_value("p_name", {"ed": "E", "RED": "R", "Widget": "W", "small": "S"}, "none").alias("cls"))


@query("year_range", """
SELECT o_orderkey, year(o_orderdate)::INTEGER AS first_year, CASE WHEN o_orderkey%2=0 THEN year(o_orderdate)+1 ELSE year(o_orderdate) END::INTEGER AS last_year FROM orders""")
def year_range(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    y = F.year("o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(y.cast("string"), F.lit("/"), (y + 1).cast("string"))).otherwise(y.cast("string"))
    return o.select("o_orderkey", TX.year_range(text).alias("r")).select("o_orderkey", "r.*")


@query("file_gate", """
SELECT page_id, CASE page_id%5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected: file type' WHEN 3 THEN 'rejected: media type' ELSE 'rejected: file type' END AS gate FROM pages""")
def file_gate(spark, sf_dir):
    k = F.col("page_id") % 5
    ending = F.when(k == 0, ".txt").when(k == 1, ".CSV").when(k == 2, ".h5").when(k == 3, ".txt").otherwise("/")
    media = F.when(k == 1, "https://www.iana.org/assignments/media-types/text/csv").when(k == 3, "application/json").otherwise(
        "https://www.iana.org/assignments/media-types/text/tab-separated-values")
    name = F.concat(F.regexp_replace("url", r"[?#].*$", ""), ending)
    return S.table(spark, sf_dir, "pages").select("page_id", TX.file_gate(name, media).alias("gate"))


@query("identifier_kind", """
SELECT page_id, CASE page_id%6 WHEN 0 THEN 'DOI' WHEN 1 THEN 'URN' WHEN 2 THEN 'LOCAL' WHEN 3 THEN 'NONE' WHEN 4 THEN
  CASE WHEN regexp_matches(lower(url), '^https?://([^/ ]*\\.)?example\\.com([/:?#]|$)') THEN 'PROTOTYPE' WHEN regexp_matches(lower(url), '^https?://[^/ ]+') THEN 'HTTP' ELSE 'LOCAL' END
  ELSE CASE WHEN regexp_matches(lower(url), '^https?://[^/ ]+') THEN 'PROTOTYPE' ELSE 'LOCAL' END END AS kind FROM pages""")
def identifier_kind(spark, sf_dir):
    k = F.col("page_id") % 6
    value = (F.when(k == 0, F.concat(F.lit("https://doi.org/10.1234/"), F.col("page_id").cast("string"))).when(k == 1, F.concat(F.lit("urn:uuid:"), F.col("page_id").cast("string")))
             .when(k == 2, F.concat(F.lit("ACP-"), F.col("page_id").cast("string"))).when(k == 3, " ").when(k == 4, F.col("url"))
             .otherwise(F.regexp_replace("url", r"^(https?://)[^/]*", "$1data.example.com")))
    return S.table(spark, sf_dir, "pages").select("page_id", TX.identifier_kind(value, "example.com").alias("kind"))


# ------------------------------------------------------------------ facts

def forms(spark, sf_dir):
    """FORM: one lab form per conversation turn; some labels are missing, some values stand on the next line."""
    c = S.table(spark, sf_dir, "conversations")
    k = F.col("turn") % 4
    temperature = F.concat(F.lit("Raumtemperatur -> "), (F.col("conv_id") % 30).cast("string"), F.lit(",5 °C"))
    lines = F.concat_ws(
        "\n", F.lit("Metadatensatz"), F.lit(""), F.when(k != 3, "Datum der Messung, Jahr -> 2024/2025").otherwise("Datum der Messung, Jahr -> 2023"),
        F.when(k != 1, F.concat(F.lit("Ort der Messung -> Lab "), "role")).otherwise("Ort der Messung"), F.when(k == 1, F.concat(F.lit("-> Hall "), "role")),
        F.when(k != 2, temperature), F.lit("Art der Anregung"), F.concat(F.lit("Lautsprecher "), "role", F.lit(" – Position der Anregung links")),
        F.lit("Maße der Wand -> B*H = 4,13 m * 2,75 m = 11,4 m2; Dicke = 416 mm"), F.concat(F.lit("Text: "), F.regexp_replace("text", r"\s+", " ")))
    return c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), FA.form_lines(lines).alias("lines"), "role", "turn")


FORM_SQL = "D AS (SELECT conv_id || '/' || turn AS doc_id, conv_id, turn%4 AS k, role FROM conversations)"


@query("extract_facts", "WITH " + FORM_SQL + """
SELECT doc_id, 'year' AS key, CASE WHEN k=3 THEN '2023' ELSE '2024/2025' END AS value, 'stored in the record' AS status FROM D
UNION ALL SELECT doc_id, 'location', CASE WHEN k=1 THEN 'Hall ' ELSE 'Lab ' END || role, 'stored in the record' FROM D
UNION ALL SELECT doc_id, 'temperature', CASE WHEN k<>2 THEN ((conv_id%30)+0.5)::DOUBLE::VARCHAR END, CASE WHEN k<>2 THEN 'stored in the record' ELSE 'not found in the form' END FROM D
UNION ALL SELECT doc_id, 'excitation', 'Lautsprecher ' || role, 'stored in the record' FROM D
UNION ALL SELECT doc_id, 'wall_size', '{"width_m":4.13,"height_m":2.75,"depth_mm":416.0}', 'stored in the record' FROM D
UNION ALL SELECT doc_id, unnest(['test_rig','data_origin','source','responsible','humidity','pressure','sketch','layers','area_mass','room_volumes']), NULL, 'not found in the form' FROM D""")
def extract_facts(spark, sf_dir):
    return FA.extract_facts(forms(spark, sf_dir)).select("doc_id", "key", "value", "status")


@query("fact_status", "WITH " + S.QUALITY_SQL + """, C AS (SELECT unnest(['absentFields','unresolvedFields','unitStatus','status','other']) AS key),
P AS (SELECT record_id, metric, max(value) AS value FROM Q GROUP BY 1, 2)
SELECT d.record_id AS doc_id, C.key, p.value, CASE WHEN p.value IS NULL THEN 'not found in the form' WHEN C.key='status' THEN 'read, not stored yet' ELSE 'stored in the record' END AS status
FROM (SELECT DISTINCT record_id FROM Q) d CROSS JOIN C LEFT JOIN P p ON p.record_id=d.record_id AND p.metric=C.key""")
def fact_status(spark, sf_dir):
    catalog = {"absentFields": ("A", FA.STORED), "unresolvedFields": ("U", FA.STORED), "unitStatus": ("N", FA.STORED), "status": ("S", FA.READ_ONLY), "other": ("O", FA.STORED)}
    # The catalog is fixed, so one conditional aggregate per key builds the map of a document.
    cells = [F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("metric") == k, F.col("value")))), "; "), F.lit("")).alias(k) for k in catalog]
    wide = S.quality(spark, sf_dir).groupBy("record_id").agg(*cells)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in catalog])
    found = wide.select(F.col("record_id").alias("doc_id"), F.map_from_entries(entries).alias("facts"))
    return FA.with_fact_status(found, catalog).select("doc_id", "key", "value", "status")


@query("merge_facts", "WITH " + S.RECORD_SQL + """
SELECT record_id, CASE WHEN doc_id%3<>0 THEN 'Lab new' END AS location, NULL::VARCHAR AS rig, CASE WHEN doc_id%2=0 THEN 21.5::DOUBLE END AS temperature,
  CASE WHEN doc_id%2=0 THEN 'stated in the lab form' ELSE 'unresolved' END AS procedure_status, 'unknown' AS agent, CASE WHEN doc_id%5=0 THEN 4.13 END::DOUBLE AS width, CASE WHEN doc_id%5=0 THEN 416.0 END::DOUBLE AS depth,
  CASE WHEN doc_id%7=0 THEN 'Reported as 2024/2025 in the lab form; exact date unknown' END AS period_note,
  CASE WHEN k NOT IN (30,31) THEN 'persistentIdentifier,accessURL,field_' || lang || ',' ELSE '' END || CASE WHEN doc_id%5=0 THEN '' ELSE 'wallDimensions,' END || 'testRig' || CASE WHEN doc_id%3=0 THEN ',location' ELSE '' END
  || ',responsiblePerson' || CASE WHEN doc_id%2=1 THEN ',temperature' ELSE '' END || ',humidity,pressure' || CASE WHEN doc_id%2=1 THEN ',excitation' ELSE '' END || ',setupSketch,dataOrigin' AS absent FROM R""")
def merge_facts(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    lines = F.array_compact(F.array(F.when(n % 3 != 0, "Ort der Messung -> Lab new"), F.when(n % 2 == 0, "Raumtemperatur -> 21,5 °C"), F.when(n % 2 == 0, "Art der Anregung -> Hammer"),
        F.when(n % 5 == 0, "Maße der Wand -> B*H = 4,13 m * 2,75 m = 11,4 m2; Dicke = 416 mm"), F.when(n % 7 == 0, "Datum der Messung -> 2024/2025"), F.lit("Ende")))
    facts = FA.wide_facts(d.select(F.format_string("rec-%07d", "doc_id").alias("doc_id"), lines.alias("lines")))
    merged = FA.merge_facts(S.flat_records(spark, sf_dir), facts)
    return merged.select("record_id", "lineage.location", "lineage.rig", F.try_element_at("lineage.environment", F.lit(1))["value"].alias("temperature"),
                         "measurement.procedure_status", "lineage.agent", F.col("lineage.wall_width_m").alias("width"), F.col("lineage.wall_depth_mm").alias("depth"), "lineage.period_note", F.array_join("completeness.absent", ",").alias("absent"))


@query("missing_field_union", """
SELECT user_id, event_id, CASE WHEN event_type='view' THEN 'view,base' WHEN event_type='error' THEN 'base,error' ELSE 'base,' || event_type END AS names,
  CASE WHEN event_type='error' THEN 'error' ELSE CASE WHEN event_type='view' THEN 'view' ELSE event_type END END AS open_names FROM events""")
def missing_field_union(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    first = F.when(F.col("event_type") == "view", F.array(F.col("event_type"), F.lit("base"))).when(F.col("event_type") != "error", F.array(F.lit("base")))
    second = F.when(F.col("event_type") == "error", F.array(F.lit("base"), F.lit("error"))).otherwise(F.array(F.col("event_type"), F.lit("base")))
    names = FA.missing_field_union(first, second)
    return e.select("user_id", "event_id", F.array_join(names, ",").alias("names"), F.array_join(F.array_remove(names, "base"), ",").alias("open_names"))


@query("source_conflict", """
SELECT l.doc_id, CASE WHEN l.doc_id%5=0 THEN 'unresolved' WHEN d.source LIKE '%1%' AND l.quality=1 THEN 'unresolved' ELSE 'stated in the lab form' END AS status
FROM labels l JOIN documents d USING (doc_id)""")
def source_conflict(spark, sf_dir):
    both = S.table(spark, sf_dir, "labels").join(S.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    names = F.array(F.lit("scan_1.txt"), F.when(F.col("source").contains("1"), "scan_SHAKER_2.txt").otherwise("scan_2.txt"))
    said = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("quality") == 1, "Luftschall").otherwise("Hammer")
    return both.select("doc_id", FA.source_conflict(names, said).alias("status"))


@query("metadata_override", """
SELECT d.doc_id, CASE WHEN d.doc_id%11=0 THEN 'ui' WHEN l.quality IS NOT NULL AND l.quality=1 THEN 'file' ELSE 'shared' END AS operator,
  CASE WHEN d.doc_id%13=0 THEN 'ui2' WHEN l.toxic=1 THEN 'toxic' ELSE 'unknown' END AS instrument FROM documents d LEFT JOIN labels l USING (doc_id)""")
def metadata_override(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select("doc_id")
    per_file = S.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "file").otherwise("").alias("operator"), F.when(F.col("toxic") == 1, "toxic").alias("instrument"))
    overrides = d.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "ui").otherwise("  ").alias("operator"), F.when(F.col("doc_id") % 13 == 0, "ui2").alias("instrument"))
    return FA.resolve_context(d, {"operator": "shared"}, per_file, overrides, ["operator", "instrument"], key="doc_id")
