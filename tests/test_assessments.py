"""Golden outcomes: matching scenarios, form facts, package mutations, streams."""

import hashlib
import os
from datetime import datetime, timedelta
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkledger.operators import elements as E
from linkledger.operators import facts as FA
from linkledger.operators import integrity as I
from linkledger.operators import lifecycle as LC
from linkledger.operators import matching as M
from linkledger.operators.ordered import number_chunk
from linkledger.operators import deltas as D
from linkledger.streaming import inventory as IV
from linkledger.streaming import triggers as ST

# Two equal layer sets of five tokens; the record adds two category words.
MATERIALS = ["Gipsplatte Alpha", "Ständer CW 75 mit 60mm Faserfilz Beta", "Gipsplatte Alpha"]
CATEGORIES = ["boards (b)", "framework (fr)", "boards (b)"]


def scenario_tables(spark):
    walls = spark.createDataFrame([
        ("same", 0, "metal_frame", 0.1, MATERIALS), ("stud", 0, "metal_frame", 0.285, ["Metal Stud Layer"]), ("conc", 0, "concrete", 0.15, ["Concrete"]),
        ("same", 1, "concrete", 0.1, ["Concrete"])], "gid STRING, version INT, family STRING, thickness_m DOUBLE, materials ARRAY<STRING>")
    registry = spark.createDataFrame([("rec", "metal_frame", 0.1, MATERIALS, CATEGORIES)],
                                     "record_uri STRING, family STRING, thickness_m DOUBLE, layer_names ARRAY<STRING>, layer_categories ARRAY<STRING>")
    return walls, registry


def test_seven_scenarios(spark):
    walls, registry = scenario_tables(spark)
    now = walls.where("version = 0")
    links = spark.createDataFrame([("acceptable", "same", "rec"), ("ambiguous", "stud", "rec"), ("wrong", "conc", "rec"), ("gone", "stud", "missing")], "link_id STRING, gid STRING, record_uri STRING")
    got = {r.link_id: r for r in M.match_status(links, now, registry).collect()}
    assert {k: r.status for k, r in got.items()} == {"acceptable": "ACCEPTABLE", "ambiguous": "AMBIGUOUS", "wrong": "INVALID", "gone": "BROKEN"}
    assert got["acceptable"].overlap == pytest.approx(5 / 7) and got["wrong"].thickness_delta_m is None and got["ambiguous"].thickness_delta_m == pytest.approx(0.185)
    assert got["ambiguous"].rationale.startswith("total-thickness difference is 0.185 m (> 0.020 m tolerance); ")
    two = registry.unionByName(registry.withColumn("record_uri", F.lit("rec2")))
    assert {r.gid: r.status for r in M.find_candidates(now, two).collect()} == {"same": "MULTIPLE_CANDIDATES", "stud": "MULTIPLE_CANDIDATES", "conc": "UNMATCHED"}
    link = links.where("link_id = 'acceptable'")
    history = M.match_status(link, now, registry).withColumn("version", F.lit(0)).unionByName(
        M.match_status(link, walls.where("version = 1"), registry).withColumn("version", F.lit(1)))
    stale = M.staleness(history, number_chunk("version", 1)).orderBy("version").collect()
    assert [r.observed for r in stale] == ["ACCEPTABLE", "SEMANTICALLY_STALE"]
    # Sweep and causes over the seven cases.
    rows = [(r.status, r.wall_family, r.record_family, r.thickness_delta_m, r.rationale) for r in got.values()]
    rows += [("UNMATCHED", "concrete", None, None, "No external record."), ("MULTIPLE_CANDIDATES", "metal_frame", None, None, "More than one."), ("SEMANTICALLY_STALE", "concrete", "metal_frame", None, "was acceptable")]
    cases = spark.createDataFrame(rows, "observed STRING, wall_family STRING, record_family STRING, thickness_delta_m DOUBLE, rationale STRING")
    sweep = [(r.tolerance_m, r.acceptable, r.ambiguous, r.acceptable_pct, r.ambiguous_pct) for r in M.tolerance_sweep(cases).orderBy("tolerance_m").collect()]
    assert sweep == [(t, 1, 1, 50.0, 50.0) for t in (0.01, 0.02, 0.05, 0.1, 0.15)] + [(0.2, 2, 0, 100.0, 0.0)]
    assert {r.cause: r.cases for r in M.root_causes(cases).collect()} == {
        "insufficient_ifc_detail": 2, "thickness_mismatch": 1, "family_mismatch": 1, "no_candidates": 1, "multiple_candidates": 1, "resource_unavailable": 1, "semantic_staleness": 1}


FORM = ["Metadatensatz", "Quelle -> Eigene Erhebung", "Datum der Messung, Jahr -> 2021 / 2022", "Ort der Messung -> Halle 3", "Prüfstand", "-> Stand A",
        "Maße der Wand -> B*H = 4,25 m * 2,5 m = 10,6 m2; Dicke = 300 mm", "Raumtemperatur -> 21,25 °C", "Luftdruck -> 980,5 hPa", "Art der Anregung",
        "Lautsprecher (Rauschen) – Position der Anregung links", "Skizze: plan.png", "Schichten: A, B ", "m = 45,5 kg/m2", "Senderaum: 50 m3", "Empfangsraum: 60 m3"]


def facts_of(spark, lines):
    df = spark.createDataFrame([("f", lines)], "doc_id STRING, lines ARRAY<STRING>")
    return {r.key: (r.value, r.status) for r in FA.extract_facts(df).collect()}


def test_form_facts(spark):
    facts = facts_of(spark, FORM)
    assert len(facts) == 15
    values = {k: v for k, (v, _) in facts.items()}
    assert values["year"] == "2021/2022" and values["location"] == "Halle 3" and values["test_rig"] == "Stand A"
    assert values["wall_size"] == '{"width_m":4.25,"height_m":2.5,"depth_mm":300.0}' and values["temperature"] == "21.25" and values["pressure"] == "980.5"
    assert values["excitation"] == "Lautsprecher (Rauschen)" and values["sketch"] == "plan.png" and values["layers"] == "A, B"
    assert values["area_mass"] == "45,5 kg/m²" and values["room_volumes"] == "Senderaum: 50 m3; Empfangsraum: 60 m3"
    assert facts["humidity"] == (None, FA.NOT_FOUND) and facts["source"][1] == FA.READ_ONLY


def test_missing_facts_are_cleared(spark):
    from conftest import SF_DIR
    from linkledger.plans import standins as S

    flat = S.flat_records(spark, SF_DIR).where("record_id = 'rec-0000000'")
    wide = FA.wide_facts(spark.createDataFrame([("rec-0000000", ["Luftdruck -> 980,5 hPa"])], "doc_id STRING, lines ARRAY<STRING>"))
    row = FA.merge_facts(flat, wide).first()
    assert row.lineage.location is None and row.lineage.rig is None and row.lineage.agent == "unknown"
    assert [(e.label, e.value) for e in row.lineage.environment] == [("air pressure", 980.5)]
    assert {"location", "testRig", "temperature", "humidity", "wallDimensions", "excitation"} <= set(row.completeness.absent) and "pressure" not in row.completeness.absent
    assert row.measurement.procedure_status == "unresolved"


def test_conflict(spark):
    said = spark.range(1).select(FA.source_conflict(F.array(F.lit("a_Shaker_1.txt")), F.lit("Lautsprecher")).alias("a"), FA.source_conflict(F.array(F.lit("a_1.txt")), F.lit("Lautsprecher")).alias("b"),
                                 FA.source_conflict(F.array(F.lit("a_Shaker_1.txt")), F.lit("Hammer")).alias("c"), FA.source_conflict(F.array(F.lit("a")), F.lit("")).alias("d")).first()
    assert tuple(said) == ("unresolved", "stated in the lab form", "stated in the lab form", "unresolved")


# ------------------------------------------------------------------ package mutations: each gives exactly one reason

def package(spark, **change):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    get = lambda k, default: change.get(k, default)
    view = one([(1, 1.0, 2.0, 0.5, "d.txt")], "point INT, x DOUBLE, y DOUBLE, z DOUBLE, file STRING")
    records = one([] if change.get("no_record") else [(1, "d.txt", get("recorded", "H"), get("rec_x", 1.0), 2.0, 0.5, "r.json")],
                  "point INT, url STRING, sha256 STRING, x DOUBLE, y DOUBLE, z DOUBLE, record_path STRING")
    inventory = one(([] if change.get("no_file") else [("d.txt", get("file", "H"))]) + [("r.json", get("record_file", "R"))], "path STRING, sha256 STRING")
    headers = one([("d.txt", 1, get("head_x", 1.0), 2.0, 0.5, get("readable", True))], "path STRING, point INT, x DOUBLE, y DOUBLE, z DOUBLE, readable BOOLEAN")
    manifest = one([("data", "d.txt", get("built", "H"), 1), ("record", "r.json", "R", 1), ("cache", "c", get("cache", "H"), 1)], "kind STRING, path STRING, sha256 STRING, point INT")
    elements = one([(1, get("verdict", "valid"), get("why", None))], "point INT, verdict STRING, reason STRING")
    return I.assess_points(view, records, inventory, headers, manifest, elements, view_edited=get("view_edited", False), cache_edited=get("cache_edited", False))


MUTATIONS = [
    ({}, ("valid", "valid", "valid"), None),
    ({"recorded": "X"}, ("stale", "valid", "valid"), "data file changed since the record was written"),
    ({"no_file": True}, ("missing", "valid", "valid"), "data file missing"),
    ({"head_x": 1.5}, ("stale", "valid", "valid"), "data file header differs from the view"),
    ({"readable": False}, ("stale", "valid", "valid"), "data file header not readable"),
    ({"cache": "X"}, ("stale", "valid", "valid"), "spectra cache was built from a different file"),
    ({"built": "X"}, ("stale", "valid", "valid"), "data file differs from the one registered at the last build"),
    ({"cache_edited": True}, ("stale", "valid", "valid"), "spectra cache edited after the build"),
    ({"no_record": True}, ("valid", "missing", "unverified"), "no record for this point"),
    ({"record_file": "X"}, ("valid", "stale", "valid"), "record edited after the build"),
    ({"rec_x": 1.5}, ("valid", "stale", "valid"), "record x/y/z differ from the view"),
    ({"view_edited": True}, ("valid", "stale", "valid"), "view edited after the build"),
    ({"verdict": "unverified", "why": "w"}, ("valid", "valid", "unverified"), "w"),
]


@pytest.mark.parametrize("change,states,reason", MUTATIONS, ids=[str(sorted(m[0])) for m in MUTATIONS])
def test_one_mutation_one_reason(spark, change, states, reason):
    r = package(spark, **change).first()
    assert (r.data, r.record, r.element) == states and r.valid == (reason is None)
    assert r.data_reasons + r.record_reasons + r.element_reasons == ([reason] if reason else [])


def test_verdicts(spark):
    good = package(spark)
    none = spark.createDataFrame([], "layer STRING, line STRING")
    overall = lambda p, lines: I.overall_verdict(p, I.layer_verdict(p, lines)).first()
    assert overall(good, none).headline == "all 1 points valid: data, record and model agree"
    extra = spark.createDataFrame([("data", "untracked")], "layer STRING, line STRING")
    assert overall(good, extra).overall == "PARTIAL"
    # An unverified element that states a reason makes its layer stale.
    odd = package(spark, verdict="unverified", why="w")
    assert {r.layer: r.state for r in I.layer_verdict(odd, I.problem_lines(odd)).collect()} == {"data": "valid", "record": "valid", "element": "stale"}
    assert overall(odd, I.problem_lines(odd)).overall == "INVALID"
    assert overall(good.where("false"), none).overall == "INVALID"
    assert I.overall_verdict(good, I.layer_verdict(good, none), package_found=False).first().overall == "INVALID"


def test_targets(spark):
    elements = spark.createDataFrame([("a",), ("b",), ("c",)], "gid STRING")
    edges = spark.createDataFrame([("a", "b")], "parent STRING, child STRING")
    shown = lambda df: {(r.gid, r.role, r.kind) for r in df.collect()}
    assert shown(E.select_targets(elements, edges)) == {("a", "target", "parts"), ("b", "part", "parts")}
    assert shown(E.select_targets(elements, edges, gid="c")) == {("c", "target", "single")}
    assert shown(E.select_targets(elements, edges.where("false"))) == {(g, "part", "all") for g in "abc"}
    assert shown(E.select_targets(elements.where("gid = 'c'"), edges)) == {("c", "target", "single")}
    assert shown(E.select_targets(elements, edges, mode="all")) == {(g, "part", "all") for g in "abc"}


@pytest.mark.parametrize("slices", [1, 3, 7])
def test_stream_results_do_not_depend_on_slices(spark, tmp_path, slices):
    """The same versions, out of order, cut in different ways: the triggers and first rows are those of the batch."""
    random = np.random.default_rng(4)
    rows = [(f"e{i % 5}", datetime(2024, 1, 1) + timedelta(minutes=7 * i), i, "abc"[random.integers(3)], int(random.integers(3))) for i in range(70)]
    schema = "entity STRING, ts TIMESTAMP, version LONG, material STRING, thickness LONG"
    shuffled = [rows[i] for i in random.permutation(len(rows))]
    attrs, base = ["material", "thickness"], str(tmp_path)
    end = ("zz", datetime(2999, 1, 1), -1, None, None)
    for wave in [*(shuffled[i::slices] for i in range(slices)), [end]]:
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        ST.stream_triggers(stream, f"{base}/out", f"{base}/c1", attrs, delay="1 day").awaitTermination()
        ST.stream_first_wins(stream, f"{base}/first", f"{base}/c2", ["entity", "material"], ["ts", "version"]).awaitTermination()
    stored = ST.stored_schema(spark.createDataFrame([], schema))
    got = sorted(map(str, ST.stored_triggers(spark, f"{base}/out", stored).select("entity", "version", "attribute", "old", "new").collect()))
    assert ST.late_versions(spark, f"{base}/out", stored, attrs).count() == 0
    batch = LC.reassessment_triggers(spark.createDataFrame(rows, schema), attrs)
    assert got == sorted(map(str, batch.select("entity", "version", "attribute", "old", "new").collect()))
    first = {(r.entity, r.material): r.version for r in ST.current_first(spark, f"{base}/first", ["entity", "material"], ["ts", "version"]).collect() if r.entity != "zz"}
    expected = {}
    for e, _, v, m, _ in rows:
        expected.setdefault((e, m), v)
    assert first == expected


def test_late_versions_correct_open_neighbours_or_are_set_aside(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    schema, base = "entity STRING, ts TIMESTAMP, version LONG, material STRING", str(tmp_path)
    waves = [
        [("a", at(0), 1, "wood"), ("a", at(60), 2, "steel"), ("b", at(0), 1, None), ("clock", at(65), 0, "")],
        [("a", at(30), 3, "brick"), ("b", at(0), 2, "clay"), (None, at(10), 9, "x"), ("c", None, 1, "lost"), ("clock", at(300), 0, "")],
        [("a", at(40), 4, "late"), ("a", at(60), 2, "steel"), ("b", at(20), 3, "late but nothing later is closed"), ("clock", at(900), 0, "")],
        [("clock", at(2000), 0, "")],
    ]
    for wave in waves:
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        ST.stream_triggers(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/c", ["material"], delay="1 hour").awaitTermination()
    stored = ST.stored_schema(spark.createDataFrame([], schema))
    triggers = ST.stored_triggers(spark, f"{base}/out", stored).where("entity <> 'clock'")
    assert sorted((r.entity, r.version, r.old, r.new) for r in triggers.collect()) == [
        ("a", 2, "brick", "steel"), ("a", 3, "wood", "brick"), ("b", 2, None, "clay"), ("b", 3, "clay", "late but nothing later is closed")]
    late = ST.late_versions(spark, f"{base}/out", stored, ["material"])
    assert sorted((r.entity, r.version, r.material) for r in late.collect()) == [("a", 2, "steel"), ("a", 4, "late"), ("c", 1, "lost")]


def test_inventory_sees_changed_and_gone_files(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    (folder / "sub").mkdir(parents=True)
    for name in ("a", "b", "sub/c"):
        (folder / f"{name}.txt").write_text(name)
    assert IV.refresh_inventory(spark, str(folder), table, "*.txt") == 0
    (folder / "a.txt").write_text("another")
    os.utime(folder / "a.txt", (2_000_000_000, 2_000_000_000))
    (folder / "b.txt").unlink()
    (folder / "d.txt").write_text("d")
    assert IV.refresh_inventory(spark, str(folder), table, "*.txt") == 1
    now = {r.name: r.sha256 for r in IV.current_inventory(spark, table).collect()}
    assert now == {"a.txt": hashlib.sha256(b"another").hexdigest(), "b.txt": None, "c.txt": hashlib.sha256(b"sub/c").hexdigest(), "d.txt": hashlib.sha256(b"d").hexdigest()}
    deltas = IV.inventory_deltas(IV.current_inventory(spark, table, 0), IV.current_inventory(spark, table, 1))
    assert sorted((r.path[-5:], r.delta) for r in deltas.collect()) == [("a.txt", "changed"), ("b.txt", "gone"), ("d.txt", "new")]
    IV.refresh_inventory(spark, str(folder), table, "*.txt")
    assert spark.read.parquet(table).count() == 6


def test_delta_verdicts_equal_a_full_assessment(spark, tmp_path):
    """Several batches of changed, new and gone files, with one touching nothing: the kept verdicts stay those of a full recomputation."""
    store = str(tmp_path / "verdicts")
    points = range(8)
    view = spark.createDataFrame([(p, 1.0 * p, 2.0, 3.0, f"data/{p}" if p != 7 else None) for p in points], "point LONG, x DOUBLE, y DOUBLE, z DOUBLE, file STRING")
    records = spark.createDataFrame([(p, f"data/{p}", f"h{p}", 1.0 * p, 2.0, 3.0, f"rec/{p}") for p in points if p != 6] + [(99, "data/99", "h99", 0.0, 0.0, 0.0, "rec/99")],
                                    "point LONG, url STRING, sha256 STRING, x DOUBLE, y DOUBLE, z DOUBLE, record_path STRING")
    manifest = spark.createDataFrame([("2024-02", k, f"{f}/{p}", h + str(p), p) for p in points for k, f, h in (("data", "data", "h"), ("record", "rec", "r"), ("cache", "c", "h"))],
                                     "build_id STRING, kind STRING, path STRING, sha256 STRING, point LONG")
    elements = spark.createDataFrame([(p, "stale" if p == 5 else "valid", "moved" if p == 5 else None) for p in points], "point LONG, verdict STRING, reason STRING")
    waves = [{**{f"data/{p}": f"h{p}" for p in points}, **{f"rec/{p}": f"r{p}" for p in points}}]
    waves.append({**waves[0], "data/0": "other", "rec/1": "edited", "data/extra": "e", "x/unrelated": "u"})
    waves.append({k: v for k, v in waves[1].items() if k not in ("data/2", "data/extra")})
    waves.append(waves[2])
    waves.append({**waves[3], "data/0": "h0", "data/2": "h2", "rec/1": "r1"})

    def full(inventory, headers):
        states = I.assess_points(view, records, inventory, headers, manifest, elements)
        known = I.known_set(records.select(F.col("url").alias("path")), view.select(F.col("file").alias("path")).where("path IS NOT NULL"))
        loose = I.untracked_files(inventory.where("path LIKE 'data/%'"), known)
        lone = I.reconcile_keys(records, view, "point").where("side = 'record without view'")
        lines = I.problem_lines(states).unionByName(loose.select(F.lit("data").alias("layer"), F.col("path").alias("line"))).unionByName(
            lone.select(F.lit("record").alias("layer"), F.col("point").cast("string").alias("line")))
        return states, lines

    shown = lambda df: sorted(map(str, df.collect()))
    before = None
    for batch, files in enumerate(waves):
        inventory = spark.createDataFrame(list(files.items()), "path STRING, sha256 STRING")
        headers = spark.createDataFrame([(p, int(p.split("/")[1]), float(p.split("/")[1]), 2.0, 3.0, True) for p in files if p[5:].isdigit()],
                                        "path STRING, point LONG, x DOUBLE, y DOUBLE, z DOUBLE, readable BOOLEAN")
        states, lines = full(inventory, headers)
        if before is None:
            D.start_verdicts(states, lines, store)
        else:
            deltas = IV.inventory_deltas(before, inventory)
            D.refresh_verdicts(store, batch, deltas, view, records, inventory, headers, manifest, elements)
            touched = spark.read.parquet(f"{store}/states/batch={batch}").count()
            assert touched == [None, 2, 1, 0, 3][batch]
        columns = states.columns
        assert shown(D.current_states(spark, store).select(*columns)) == shown(states.select(*columns))
        layers = I.layer_verdict(states, lines)
        assert shown(D.current_layers(spark, store, batch).select(*layers.columns)) == shown(layers)
        assert shown(D.current_overall(spark, store, batch)) == shown(I.overall_verdict(states, layers))
        before = inventory
    assert D.verdict_deltas(spark, store, 3).count() == 0
    assert {(r.point, r.layer, r.old, r.new) for r in D.verdict_deltas(spark, store, 2).collect()} == {(2, "data", "valid", "missing"), (2, "point", "valid", "unverified")}


def test_trigger_state_is_one_closed_version_an_entity_and_the_open_ones(spark, tmp_path):
    """However long the history, a batch meets one closed row an entity; a batch that is repeated gives the same rows."""
    schema, base = "entity STRING, ts TIMESTAMP, version LONG, material STRING", str(tmp_path)
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    stored = ST.stored_schema(spark.createDataFrame([], schema))

    def run():
        ST.stream_triggers(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/c", ["material"], delay="1 hour").awaitTermination()
        state = spark.read.parquet(f"{base}/c/steps/{wave % 2}").where("kept <> 'gone'")
        return sorted((r.entity, r.version, r.kept) for r in state.collect()), ST.stored_triggers(spark, f"{base}/out", stored).count()

    for wave in range(2):
        rows = [(e, at(1000 * wave + 10 * i), 100 * wave + i, "ab"[i % 2]) for e in "xy" for i in range(100)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        state, told = run()
        # Times run to 990 minutes; 930 is the last that is an hour old.
        assert state == [(e, 100 * wave + i, "closed" if i == 93 else "open") for e in "xy" for i in range(93, 100)]
    for name in (f"{wave}", f".{wave}.crc"):
        os.remove(f"{base}/c/commits/{name}")
    assert run() == (state, told)


def test_value_rules_need_only_the_statements_they_name(spark):
    """Faulty values are found among the statements of the rules' own predicates; the others change nothing."""
    from conftest import SF_DIR
    from linkledger.operators import rules as R
    from linkledger.plans import standins as S

    triples = S.record_triples(spark, SF_DIR)
    for kind in ("datatype", "pattern", "in"):
        rules = [r for r in R.profile_rules() if r.kind == kind]
        targets = [t for t in R.profile_targets() if t[0] in {r.shape for r in rules}]
        some = triples.where(F.col("p").isin(sorted(R.named_predicates(rules, targets))))
        found = [sorted(map(repr, R.check_values(t, R.rule_targets(t, of), R.profile_rules(), (kind,)).collect())) for t, of in ((triples, R.profile_targets()), (some, targets))]
        assert found[0] == found[1] != []


def test_cross_field_rules_need_only_the_statements_they_name(spark):
    """Each rule finds the same among the statements of its own predicates as among all."""
    from conftest import SF_DIR
    from linkledger.operators import rules as R
    from linkledger.plans import standins as S

    triples = S.record_triples(spark, SF_DIR)
    found = {True: [], False: []}
    for rule in R.FACT_RULES + R.STATEMENT_RULES:
        some = triples.where(F.col("p").isin(sorted(R.cross_predicates(rule))))
        for named, t in ((True, some), (False, triples)):
            found[named].append(rule(t))
    rows = [sorted(map(repr, reduce(lambda a, b: a.unionByName(b), found[named]).collect())) for named in (True, False)]
    assert rows[0] == rows[1] and len({r.rule_id for r in found[False][0].collect()}) == 1
