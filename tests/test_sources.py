"""Files on disk: exports, records, registry, results, inventories and writers."""

import hashlib
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkledger.functions.hashing import fingerprint, fixed3
from linkledger.model import RDF_TYPE, iri
from linkledger.operators import graph as G
from linkledger.operators import rules as R
from linkledger.operators import spectra as SP
from linkledger.plans import standins as S
from linkledger.sinks import writers
from linkledger.sources import exports as X
from linkledger.sources.inventory import file_inventory, incremental_inventory
from linkledger.sources.records import document_triples, flatten_record, nest_record, parse_records, record_rejects, records_to_triples, scan_records
from linkledger.sources.registry import parse_ntriples, scan_registry
from linkledger.sources.results import scan_results

from conftest import SF_DIR

HEAD = "Point Index:\t{i}\t[x = 1.5\ty = -2.25e0\tz = 0.005]"


def export(i=1, rows=3, lines=None, header=None, before=1):
    body = lines if lines is not None else ["\t".join(str(v) for v in (20 + n, .1, .2, .3, .4, .5, .6)) for n in range(rows)]
    return "\n".join(["Größe"] * before + [HEAD.format(i=i) if header is None else header, "Frequenz\tReal X", "[ Hz ]\t[ m/s / N ]", *body]) + "\n"


CASES = {
    "a_good": (export(), None), "b_dup": (export(1), None), "c_other_axis": (export(3, lines=["30\t" + "\t".join("123456")] + ["31\t" + "\t".join("123456")]), None),
    "d_header_line_7": (export(4, before=6), X.NO_HEADER), "e_no_header": (export(5, header="Point Index: 5"), X.NO_HEADER), "f_no_rows": (export(6, lines=["text\tonly"]), X.NO_ROWS),
    "g_text_cell": (export(7, lines=["20\t1\t2\t3\t4\t5\t6", "21\t1\t2\tx\t4\t5\t6"]), X.NOT_NUMERIC), "h_ragged": (export(8, lines=["20\t1\t2\t3\t4\t5\t6", "21\t1\t2"]), X.RAGGED),
    "i_eight": (export(9, lines=["20\t1\t2\t3\t4\t5\t6\t7"]), X.NOT_SEVEN), "j_nan": (export(10, lines=["20\t1\t2\tnan\t4\t5\t6"]), X.NOT_FINITE),
    "k_inf": (export(11, lines=["20\t1\t2\t-Inf\t4\t5\t6"]), X.NOT_FINITE), "l_overflow": (export(12, lines=["20\t1\t2\t1e999\t4\t5\t6"]), X.NOT_FINITE),
    "m_java_number": (export(13, lines=["20\t1\t2\t1.0d\t4\t5\t6"]), X.NOT_NUMERIC), "n_six": (export(14, lines=["20\t1\t2\t3\t4\t5"]), X.NO_ROWS),
}


@pytest.fixture(scope="module")
def export_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    for name, (text, _) in CASES.items():
        (folder / f"{name}.txt").write_bytes(text.encode("latin-1"))
    return str(folder)


def test_exports_and_reasons(spark, export_dir):
    spectra, points, rejects = X.scan_exports(spark, export_dir)
    stem = lambda p: Path(p).stem
    assert {stem(r.path): r.reason for r in rejects.collect()} == {n: why for n, (_, why) in CASES.items() if why}
    first = points.where(F.col("path").endswith("a_good.txt")).first()
    assert (first.point, first.x, first.y, first.z, first.first_data_line) == (1, 1.5, -2.25, 0.005, 4)
    kept, listed = SP.dedupe_points(points)
    assert [stem(r.path) for r in listed.collect()] == ["b_dup"]
    ok = SP.axis_consistency(spectra.join(kept.select("path"), "path", "left_semi"))
    assert {stem(r.path): r.axis_ok for r in ok.collect()} == {"a_good": True, "c_other_axis": False}
    heads = {stem(r.path): r.readable for r in X.scan_headers(X.read_files(spark, export_dir)).collect()}
    assert heads["d_header_line_7"] and not heads["e_no_header"]


def test_one_bin_and_silent_spectra(spark):
    df = spark.createDataFrame([(1, "a", [20.0], *[[0.0]] * 6), (2, "b", [20.0], *[[1.0]] * 6)],
                               "point INT, path STRING, freq ARRAY<DOUBLE>, re_x ARRAY<DOUBLE>, re_y ARRAY<DOUBLE>, re_z ARRAY<DOUBLE>, im_x ARRAY<DOUBLE>, im_y ARRAY<DOUBLE>, im_z ARRAY<DOUBLE>")
    assert [r.axis_ok for r in SP.axis_consistency(df).collect()] == [True, True]
    quiet = SP.spectral_levels(df).where("point = 1").first()
    assert quiet.X == quiet.NORM == pytest.approx(-600.0)


def test_inventory_reuses_hashes(spark, export_dir, tmp_path):
    before = file_inventory(spark, export_dir)
    saved = str(tmp_path / "inv")
    before.withColumn("sha256", F.lit("known")).write.parquet(saved)
    again = incremental_inventory(spark.read.parquet(saved), X.read_files(spark, export_dir))
    assert {r.sha256 for r in again.collect()} == {"known"} and before.count() == len(CASES)


def test_record_round_trip_and_files(spark, tmp_path):
    flat = S.flat_records(spark, SF_DIR)
    texts = nest_record(flat)
    back = flatten_record(parse_records(texts))
    a = {r.record_id: r for r in flat.drop("layout").collect()}
    for r in back.collect():
        want = a[r.record_id].asDict(True)
        got = r.asDict(True)
        assert got["binding"].pop("model_url") in (None, "data/model.ifc")
        assert got == want, r.record_id
    folder = tmp_path / "records"
    folder.mkdir()
    for r in texts.limit(3).collect():
        (folder / f"point_{r.record_id}.jsonld").write_text(r.text, encoding="utf-8")
    (folder / "other.jsonld").write_text("{}")
    assert scan_records(spark, str(folder)).count() == 3


def test_older_layout_is_read(spark):
    old = {"ldv:tier2Measurement": {"@id": "o", "ldv:point": {"ldv:index": 4, "ldv:x": 1.5, "ldv:y": 2.0, "ldv:z": 0.5}}, "ldv:tier1Integrity": {"dcterms:title": "f.txt"}}
    row = flatten_record(parse_records(spark.createDataFrame([("r", json.dumps(old))], "record_id STRING, text STRING"))).first()
    assert (row.measurement.point, row.measurement.x, row.integrity.title) == (4, 1.5, "f.txt")


def test_document_triples():
    doc = {"@context": {"a": "http://a/", "@base": "http://b/x/"}, "@id": "a:1", "@type": ["a:T", "a:T"], "a:n": [1, 1, 416.0, True, None],
           "a:l": {"@list": [{"@id": "f.txt"}, "s"]}, "a:e": {"@list": []}, "a:t": {"@value": "Größe", "@language": "de"}, "a:d": {"@value": "5", "@type": "a:k"}, "a:b": {"a:v": "x"}}
    t = document_triples("r", json.dumps(doc))
    spo = {(s, p, o) for _, s, p, o, *_ in t}
    assert len(t) == len(set(t)) == 1 + 3 + 1 + 4 + 1 + 1 + 1 + 1 + 1
    assert ("http://a/1", "http://a/e", iri("rdf:nil")) in spo and ("_:r/a:l/@list0", iri("rdf:first"), "http://b/x/f.txt") in spo
    kinds = {(o, k) for _, _, p, o, _, k, *_ in t if p == "http://a/n"}
    assert kinds == {("1", iri("xsd:integer")), ("416.0", iri("xsd:double")), ("true", iri("xsd:boolean"))}
    assert document_triples("r", "{broken") == [] == document_triples("r", "[1]")


def test_class_graph_hides_quality(spark):
    t = records_to_triples(S.record_texts(spark, SF_DIR).limit(1))
    core, full = G.class_graph(t), G.class_graph(t, include_quality=True)
    quality = iri("dqv:QualityMeasurement")
    assert core.where((F.col("target_class") == quality) | (F.col("source_class") == quality)).count() == 0
    assert full.where(F.col("target_class") == quality).count() > 0
    own = G.class_counts(t, include_quality=False).where(F.col("cls").startswith(iri("ldv:"))).collect()
    assert [r.cls for r in own] == [iri("ldv:RegistrationHypothesis")]


def test_validation_summary_of_sound_record(spark):
    t = S.record_triples(spark, SF_DIR).where(F.col("record_id") == "rec-0000000")
    results = R.validate(t)
    found = sorted((r.severity, r.path) for r in results.collect())
    assert found == [("Violation", "identifier"), ("Violation", "license"), ("Warning", "accessURL"), ("Warning", "resultTime")]
    s = R.validation_summary(results, t).first()
    assert (s.violations, s.warnings, s.conforms, s.conforms_mandatory) == (2, 2, False, False)


def test_registry_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"record_uri": "https://example.org/r/1", "record": {"RecordIdentifier": "r1", "AcousticValue": 44.5, "TotalThickness_m": 0.1}}))
    row = scan_registry(spark, str(tmp_path / "r.json")).first()
    assert (row.record_uri, row.AcousticValue, row.TotalThickness_m, row.SourceURI) == ("https://example.org/r/1", 44.5, 0.1, None)
    lines = ['<http://a/s> <http://a/p> "a \\"q\\" \\\\n" .', "# note", "", '<http://a/s> <http://a/p> "1"^^<http://a/int> .', '_:b1 <http://a/p> <http://a/o> .', '<http://a/s> <http://a/p> "x"@de .', "broken"]
    (tmp_path / "r.nt").write_text("\n".join(lines))
    t = scan_registry(spark, str(tmp_path / "r.nt"), "ntriples").collect()
    assert {(r.s, r.o, r.o_kind, r.o_lang) for r in t} == {
        ("http://a/s", 'a "q" \\n', "literal", None), ("http://a/s", "1", "literal", None), ("_:b1", "http://a/o", "iri", None), ("http://a/s", "x", "literal", "de"), (None, "broken", None, None)}


def test_results_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("approach,scenario,a,b,c,d,status,note\nE,S,True,False,5,5,N/A,x\n")
    row = scan_results(spark, str(tmp_path / "r.csv")).first()
    assert (row.model_modified, row.answered, row.link_status) == (True, 5, None)


def test_writers_replace_and_append(spark, tmp_path):
    path = str(tmp_path / "records")
    for texts in (["a", "b"], ["c"]):
        writers.write_records(spark.createDataFrame([(t,) for t in texts], "text STRING"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["c"]
    m = lambda b: writers.build_manifest(b, {"data": spark.createDataFrame([("p", "s")], "path STRING, sha256 STRING")})
    for b in ("b1", "b2"):
        writers.write_manifest(m(b), str(tmp_path / "manifest"))
    assert spark.read.parquet(str(tmp_path / "manifest")).count() == 2


def test_fingerprint_rounding(spark):
    random = np.random.default_rng(3)
    values = [1.0005, -0.0001, -0.0005, 0.0005, 0.0625, -0.0625, 0.1875, 2.5, 1e-9, 123456.0005, -98765.4325, 1e12 + 0.5, 0.00050000000000000001, 0.0015000000000000002]
    values += [sign * (k * 2 + 1) / 2000 for k in random.integers(0, 10**7, 3000) for sign in (1, -1)] + random.normal(0, 50, 2000).tolist()
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE")
    assert [r[0] for r in df.select(fixed3("v")).collect()] == [f"{round(float(v), 3) + 0.0:.3f}" for v in values]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1e30,)], "v DOUBLE")
    assert [r[0] for r in odd.select(fixed3("v")).collect()] == [None] * 4
    assert spark.createDataFrame([(1.0005,)], "v DOUBLE").select(fixed3("v", "text")).first()[0] == "1.001"


def test_fingerprint_of_missing_coordinates(spark):
    df = spark.createDataFrame([("g", 1.0, None), ("g", None, 1.0), ("g", float("nan"), 1.0), ("g", 1.0, 1.0), (None, 1.0, 1.0)], "g STRING, a DOUBLE, b DOUBLE")
    side = [F.col("a"), F.col("b"), F.lit(0.0)]
    got = [r[0] for r in df.select(fingerprint("g", F.lit("IfcWall"), F.lit(None).cast("string"), side, side)).collect()]
    assert got == [None, None, None, hashlib.sha256(b"g|IfcWall|None|1.000,1.000,0.000|1.000,1.000,0.000").hexdigest(), None]


def test_ragged_documents_stop_nothing(spark):
    texts = [
        None, "", "[]", "{", '{"@context": "https://x.example/c", "dcterms:title": "t"}', '{"@context": ["https://x.example/c", null, {"q": "http://q/"}], "q:p": 1}',
        '{"@graph": [{"@id": "http://a", "@type": null, "dcterms:title": {"@value": null}}, {"@id": "http://b", "@type": ["dcat:Dataset", 3], "dcterms:title": [["x"], {"@set": ["y", null]}]}, 7]}',
        '{"@id": 5, "dcterms:title": {"@value": {"a": 1}}, "dcterms:hasPart": {"@list": null}}', "[" * 3000 + "]" * 3000,
        '{"foaf:primaryTopic": {"sosa:hasFeatureOfInterest": {"geo:hasGeometry": {"dqv:hasQualityMeasurement": {"dqv:isMeasurementOf": {"@id": "ldvm:definitionStatus"}}}}}}',
    ]
    docs = parse_records(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "record_id STRING, text STRING"))
    assert flatten_record(docs).count() == len(texts)
    known = {"https://x.example/c": {"z": "http://z/"}}
    found = {}
    for r in records_to_triples(docs, contexts=known).collect():
        found.setdefault(r.record_id, []).append((r.s, r.p, r.o))
    assert set(found) == {"4", "5", "6", "7", "9"} and found["5"] == [("_:5", "http://q/p", "1")]
    assert sorted(o for s, _, o in found["6"] if s == "http://b") == [iri("dcat:Dataset"), "x", "y"]
    reasons = {r.record_id: r.reason for r in record_rejects(docs).collect()}
    assert {k for k, v in reasons.items() if v == "not valid JSON"} >= {"0", "1", "3"}
    assert reasons["4"] == reasons["5"] == "unknown context" and "9" not in reasons
    assert record_rejects(docs, list(known)).where("reason = 'unknown context'").count() == 0
    empty = flatten_record(docs.where("record_id = '9'")).withColumn("binding", F.col("binding").withField("targets", F.array().cast("array<struct<gid:string,cls:string,label:string,fingerprint:string>>")))
    assert nest_record(empty).count() == 1


def test_older_layout_is_read_whole(spark):
    old = {
        "ldv:tier1Integrity": {"dcterms:title": "f.txt"}, "ldv:tier2Measurement": {"ldv:point": {"ldv:index": 4, "ldv:scanFrame": {"@id": "ex:f", "ldv:definitionStatus": "absent"}}},
        "ldv:tier4Binding": {
            "ldv:ifcFile": {"dcat:downloadURL": {"@id": "m.ifc"}, "dcterms:modified": {"@value": "2024"}},
            "ldv:target": {"ldv:ifcGlobalId": "G1", "ldv:ifcClass": "IfcWall", "ldv:elementFingerprint": "aa", "bot:hasSubElement": [{"ldv:ifcGlobalId": "G2"}],
                           "ldv:layerStack": {"@list": [{"ldv:materialName": "wood", "ldv:thicknessM": 0.1}]}},
            "ldv:registrationHypothesis": {"ldv:mapping": "map", "ldv:status": "guess"}, "ldv:bindingStatus": "valid", "ldv:verifiedAt": "2025", "ldv:fingerprintMethod": "how"},
        "ldv:completeness": {"ldv:absent": ["a", "b"], "ldv:unresolved": []},
    }
    row = flatten_record(parse_records(spark.createDataFrame([("1", json.dumps(old))], "record_id STRING, text STRING"))).first()
    b = row.binding
    assert [(t.gid, t.cls, t.fingerprint) for t in b.targets] == [("G1", "IfcWall", "aa"), ("G2", None, None)]
    assert [(x.name, x.thickness_m) for x in b.layers] == [("wood", 0.1)] and (b.hypothesis.mapping, b.hypothesis.status) == ("map", "guess")
    assert (b.status, b.verified_at, b.method, b.model_url, b.model_modified) == ("valid", "2025", "how", "m.ifc", "2024")
    assert row.completeness.absent == ["a", "b"] and row.completeness.unresolved == [] and row.measurement.frame_status == "absent"


def test_rows_are_dealt_to_tasks_in_bounded_numbers(spark):
    one = spark.range(0, 20_000, 1, 1).withColumn("text", F.lit("x"))
    sizes = S.spread(one, "id", 1000).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 20_000 and max(r["count"] for r in sizes) < 1500


def test_ntriples_lines_meet_their_grammar_once(spark):
    lines = ['<a> <p> <b> .', '_:x <p> "q\\"\\\\n\\t"@de .', '<a> <p> "1"^^<int> .', '<a> <p> "two\nlines" .', 'bad\nline', '<a> <p> _:y .  ', 'bad', '# no', ' ']
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    back = parse_ntriples(rows, "line", F.lit("r")).select("s", "p", "o", "o_kind", "o_lang")
    assert [tuple(r) for r in back.collect()] == [
        ("a", "p", "b", "iri", None), ("_:x", "p", 'q"\\n\t', "literal", "de"), ("a", "p", "1", "literal", None), ("a", "p", "two\nlines", "literal", None),
        (None, None, "bad\nline", None, None), ("a", "p", "_:y", "bnode", None), (None, None, "bad", None, None)]
    plan = back.where("p = 'p'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 1


def test_documents_of_one_row_group_are_unfolded_in_bounded_tasks(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(3).alias("n_chars"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = S.record_triples(spark, str(tmp_path)).groupBy(F.input_file_name()).agg(F.count_distinct("record_id").alias("n"), F.max("record_id")).collect()
    assert sum(r.n for r in sizes) == 5000 and max(r.n for r in sizes) <= S.DOCUMENTS_PER_TASK


def test_ntriples_literals_may_be_long(spark):
    """A literal of many characters is matched without a call a character; blank nodes may touch the final dot."""
    long = 'x' * 200_000 + r'\"' + 'y' * 200_000
    rows = spark.createDataFrame([(f'<a> <p> "{long}"@de .',), ("_:s> <p> _:o.",), ('<a> <p> "open .',)], "line string")
    back = parse_ntriples(rows, "line", F.lit("r")).select("s", "p", "o", "o_kind", "o_lang").collect()
    assert [tuple(r) for r in back] == [("a", "p", long.replace("\\", ""), "literal", "de"), ("_:s>", "p", "_:o", "bnode", None), (None, None, '<a> <p> "open .', None, None)]


def test_statements_of_named_predicates_are_those_of_a_filter(spark):
    """Other statements are not made, whole documents are read; a written table that holds the predicates serves again."""
    texts = S.rendered_records(spark, SF_DIR)
    wanted = [iri("csvw:column"), iri("rdf:first"), iri("csvw:name"), iri("ls:identifier")]
    some = records_to_triples(texts, predicates=wanted)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(some) == rows(records_to_triples(texts).where(F.col("p").isin(wanted))) and some.count() > 0
    doc = json.dumps({"@id": "r", "@type": "ex:T", "ex:l": {"@list": [{"ex:n": 1}, "x"]}, "ex:m": {"ex:n": "two"}})
    for only in ({iri("ex:n")}, {iri("rdf:type"), iri("rdf:rest")}, {iri("rdf:first")}, set()):
        assert document_triples("r", doc, predicates=frozenset(only)) == [r for r in document_triples("r", doc) if r[2] in only]
