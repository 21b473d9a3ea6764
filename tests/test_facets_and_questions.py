"""Bitmap facets, retrieval questions, origins and deep documents against plain versions."""

import collections
import json
import random

import pytest

from linkledger.model import RDF_TYPE
from linkledger.operators import facets as FA
from linkledger.operators import graph as G
from linkledger.operators import integrity as I
from linkledger.sources.records import document_triples, parse_records, record_rejects
from linkledger.sources.registry import registry_provenance


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(2)
    ids = [-70_000, -1, 0, 1, 2, 32_768, 32_769, 65_536, 10**12, *rng.sample(range(3, 200_000), 600)]
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([True, False]), rng.choice([1, 1, 1, 2, 3]), "x") for i in ids]
    return spark.createDataFrame(rows, "n long, kind string, open boolean, level int, bucket string").repartition(3), rows


@pytest.mark.parametrize("filters", [{}, {"kind": ["a"]}, {"kind": [None, "b"], "level": ["1", "3"]}, {"kind": ["a"], "open": ["true"], "level": ["2"]}, {"kind": ["none"]}, {"kind": []},
                                     {"kind": ["a", "none"], "open": ["false"]}])
def test_facets_equal_a_filter(catalog, filters):
    frame, rows = catalog
    index = FA.facet_index(frame, "n", ["kind", "open", "level"])
    hits = FA.facet_hits(index, filters)
    texts = [(r, {"kind": r[1], "open": str(r[2]).lower(), "level": str(r[3])}) for r in rows]
    want = [(r, t) for r, t in texts if all(t[f] in values for f, values in filters.items())]
    got = FA.hit_rows(frame, "n", hits)
    assert got.columns == frame.columns and sorted(map(tuple, got.collect()), key=str) == sorted((r for r, _ in want), key=str)
    counts = collections.Counter((f, t[f]) for _, t in want for f in t)
    assert {(r["facet"], r["value"]): r["n"] for r in FA.facet_counts(index, hits).collect()} == counts


def test_facets_of_an_empty_table(catalog):
    index = FA.facet_index(catalog[0].limit(0), "n", ["kind"])
    hits = FA.facet_hits(index, {"kind": ["a"]})
    assert index.count() == hits.count() == FA.facet_counts(index, hits).count() == 0


TRIPLES = [
    ("r1", RDF_TYPE, "Record"), ("r1", RDF_TYPE, "Other"), ("r1", "value", "44.1"), ("r1", "value", "45"), ("r1", "part", "c1"), ("r1", "part", "c2"), ("c1", "title", "one"), ("c2", "title", "two"),
    ("c1", "part", "c2"), ("e1", "about", "r1"), ("e2", "about", "r1"), ("e1", "gid", "G1"), ("e2", "gid", "G2"), ("e2", "gid", "G2"), ("e1", "state", "ok"), ("r2", RDF_TYPE, "Record"),
    ("r3", "value", "no record"), ("e3", "about", "r3"), ("e3", "gid", "G3"), ("r2", "part", "r2"), ("r2", "by", "a1"), ("a1", "name", "B"), ("a1", "name", "A"), ("r1", "from", "s"), ("r1", "from", "s"),
    ("r1", "made", "act"), ("act", "ended", "2026"), ("r1", "by", "a2")]


def test_questions_and_origins(spark):
    t = spark.createDataFrame(TRIPLES, "s string, p string, o string")
    questions = {"Q1": {"value": ["value"]}, "Q2": {"title": ["part", "title"], "deep": ["part", "part", "title"]}, "Q5": {"gid": ["^about", "gid"], "state": ["^about", "state"], "again": ["^about", "about", "value"]}}
    got = {tuple(r) for r in G.answer_questions(t, "Record", questions).collect()}
    assert got == {
        ("r1", "Q1", "r1", "value", "44.1"), ("r1", "Q1", "r1", "value", "45"), ("r1", "Q2", "c1", "title", "one"), ("r1", "Q2", "c2", "title", "two"), ("r1", "Q2", "c2", "deep", "two"),
        ("r1", "Q5", "e1", "gid", "G1"), ("r1", "Q5", "e2", "gid", "G2"), ("r1", "Q5", "e1", "state", "ok"), ("r1", "Q5", "r1", "again", "44.1"), ("r1", "Q5", "r1", "again", "45")}
    scoped = G.answer_questions(t.selectExpr("explode(array('x', 'y')) AS record_id", "*"), "Record", questions, ["record_id"])
    assert scoped.count() == 2 * len(got)
    for path in ([], ["^about"]):
        with pytest.raises(ValueError):
            G.answer_questions(t, "Record", {"Q": {"f": path}})
    origins = sorted(map(str, (tuple(r) for r in registry_provenance(t, "Record", "by", "name", "from", "made", "ended").collect())))
    assert origins == sorted(map(str, [("r1", "agent", "a2", None), ("r1", "source", "s", None), ("r1", "activity", "act", "2026"), ("r2", "agent", "a1", "A")]))
    assert {tuple(r) for r in registry_provenance(t, "Other", "x", "name", "y", "z", "ended").collect()} == {("r1", None, None, None)}


def test_notes_on_manifests(spark):
    packages = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), (None,)], "package string")
    manifests = spark.createDataFrame([("a", "{}"), ("a", "{"), ("b", "[1]"), ("c", None), (None, "{}"), ("e", "{}")], "package string, text string")
    assert {tuple(r) for r in I.manifest_notes(packages, manifests).collect()} == {("b", I.BROKEN_MANIFEST), ("c", I.BROKEN_MANIFEST), ("d", I.NO_MANIFEST), (None, I.NO_MANIFEST)}


def test_deep_documents_are_unfolded_or_listed(spark):
    def nested(levels):
        doc = {"end": 1}
        for _ in range(levels):
            doc = {"ldv:in": doc}
        return '{"foaf:primaryTopic": ' + json_of(doc) + "}"

    def json_of(doc):
        text, depth = "", 0
        while "ldv:in" in doc:
            text, doc, depth = text + '{"ldv:in": ', doc["ldv:in"], depth + 1
        return text + json.dumps(doc) + "}" * depth

    assert len(document_triples("r", nested(900))) == 902
    texts = [("deep", nested(900)), ("deeper", nested(3000)), ("plain", nested(1))]
    rejects = record_rejects(parse_records(spark.createDataFrame([(r, "p", t) for r, t in texts], "record_id string, path string, text string")))
    listed = {r["record_id"] for r in rejects.collect()}
    unfolded = {r for r, t in texts if document_triples(r, t)}
    assert listed | unfolded == {"deep", "deeper", "plain"} and "deep" not in listed
