"""Prefix-filter join and pointer following against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from linkledger.operators import chains as C
from linkledger.operators import overlap as O

WORDS = ["timber", "steel", "clay", "gypsum", "mortar", "glass", "wool", "board", "stone", "lime", "cork", "sand"]


def plain_best(walls, records, least):
    out = {}
    for gid, a in walls.items():
        scored = [(len(a & b) / len(a | b), rid) for rid, b in records.items() if a and b]
        near = [(-o, rid) for o, rid in scored if o >= least - 1e-9]
        out[gid] = (len(near), min(near)[1] if near else None, round(-min(near)[0], 9) if near else None)
    return out


@pytest.mark.parametrize("least", [0.25, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("part", [3, 4096])
def test_best_overlaps_equal_brute_force(spark, least, part):
    r = random.Random(5)
    # One word is held by half of all rows; some sets repeat, some are empty.
    draw = lambda: sorted({*r.sample(WORDS, r.randint(0, 5)), *(["common"] if r.random() < 0.5 else [])})
    walls, records = {i: draw() for i in range(60)}, {f"r{i:03d}": draw() for i in range(150)}
    w = spark.createDataFrame([(k, v) for k, v in walls.items()] + [(99, None)], "gid LONG, materials ARRAY<STRING>")
    c = spark.createDataFrame(list(records.items()) + [(None, [])], "record_uri STRING, layer_names ARRAY<STRING>")
    got = O.best_overlaps(w, c, least, part).collect()
    expected = plain_best({k: set(v) for k, v in walls.items()} | {99: set()}, {k: set(v) for k, v in records.items()}, least)
    assert {x.gid: (x.matches, x.best, None if x.overlap is None else round(x.overlap, 9)) for x in got} == expected
    sets = len({tuple(v) for v in records.values() if v})
    assert all(x.compared <= sets for x in got)
    if least >= 0.8:
        assert sum(x.compared for x in got) < 0.3 * sets * len(walls)


def test_pointers_reach_the_ends_of_long_chains_and_find_cycles(spark):
    n = 10_000
    links = [(i, i + 1 if i + 1 < n else None) for i in range(n)] + [(20_000, 20_001), (20_001, 20_002), (20_002, 20_000), (20_010, 20_001), (30_000, 40_000), (7_000_000, None)]
    got = {x.node: (x.end, x.steps, x.cyclic) for x in C.follow_pointers(spark.createDataFrame(links, "node LONG, next LONG")).collect()}
    assert len(got) == len(links) + 1  # the end without a row has one
    assert all(got[i] == (n - 1, n - 1 - i, False) for i in range(n))
    assert all(got[i] == (None, None, True) for i in (20_000, 20_001, 20_002, 20_010))
    assert got[30_000] == (40_000, 1, False) and got[40_000] == (40_000, 0, False) and got[7_000_000] == (7_000_000, 0, False)
    assert C.follow_pointers(spark.createDataFrame([], "node LONG, next LONG")).collect() == []


def test_lists_without_positions(spark):
    cells = [(f"a{i}", f"a{i + 1}" if i < 9_999 else "nil") for i in range(10_000)] + [("lone", "nil"), ("x", "y"), ("y", "x")]
    got = {x.cell: (x.head, x.place) for x in C.list_places(spark.createDataFrame(cells, "s STRING, o STRING"), nil="nil").collect()}
    assert all(got[f"a{i}"] == ("a0", i) for i in range(10_000))
    assert got["lone"] == ("lone", 0) and got["x"] == got["y"] == (None, None)


def test_heads_of_branched_histories(spark):
    rows = [("a1", "a2"), ("a2", "a3"), ("a3", None), ("b1", "b2"), ("b1", "a3"), ("b2", None), ("b0", "b1"), ("c1", "gone"), ("d1", "d2"), ("d2", "d1"), ("d0", "d1"), ("e", None), ("e", None), (None, "e"), ("m", "a2")]
    got = {x.assertion: (x.head, x.steps, x.reason) for x in C.assertion_heads(spark.createDataFrame(rows, "assertion STRING, superseded_by STRING")).collect()}
    assert got == {
        "a1": ("a3", 2, None), "a2": ("a3", 1, None), "a3": ("a3", 0, None), "m": ("a3", 2, None), "b0": ("a3", 2, "fork"), "b1": ("a3", 1, "fork"), "b2": ("b2", 0, None),
        "c1": ("gone", 1, "unknown successor"), "d0": (None, None, "cycle"), "d1": (None, None, "cycle"), "d2": (None, None, "cycle"), "e": ("e", 0, None)}


def test_cycles_end_the_rounds_however_many_nodes_there_are(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(C, "cut_lineage", lambda df, name, write=C.cut_lineage: rounds.append(name) or write(df, name))
    # Many short chains; some run into cycles of two, three and one nodes.
    pointers = [(10 * n + i, 10 * n + i + 1 if i < 4 else {0: None, 1: 10 * n + 3, 2: 10 * n + 2, 3: 10 * n + 4}[n % 4], i == 1) for n in range(500) for i in range(5)]
    found = {r["node"]: r for r in C.follow_pointers(spark.createDataFrame(pointers, "node long, next long, forked boolean"), flag="forked").collect()}
    assert len(found) == 2500
    for n in range(500):
        for i in range(5):
            r = found[10 * n + i]
            assert (r["end"], r["steps"], r["cyclic"]) == ((10 * n + 4, 4 - i, False) if n % 4 == 0 else (None, None, True))
            assert r["cyclic"] or r["flagged"] == (i <= 1)
    assert len(rounds) <= 7
