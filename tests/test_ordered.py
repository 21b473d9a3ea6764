"""Chunked windows give what plain windows give, also when one key holds most rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from linkledger.operators.matching import band_candidates
from linkledger.operators.ordered import number_chunk, ordered
from linkledger.operators.spectra import dedupe_points


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.sampled_from([None, 1, 1, 1, 2]), st.integers(-40, 40), st.one_of(st.none(), st.integers(0, 9))), max_size=60),
       width=st.sampled_from([1, 7, 1000]))
def test_ordered_equals_window(spark, data, width):
    df = spark.createDataFrame([(k, t, i, v) for i, (k, t, v) in enumerate(data)], "k INT, t INT, i INT, v INT")
    got = ordered(df, ["k"], ["t", "i"], number_chunk("t", width), lag={"p": "v"}, running_sum={"s": "v"}, running_max={"m": "v"}, rank="r", last_flag="z")
    w = Window.partitionBy("k").orderBy("t", "i")
    want = df.select("*", F.lag("v").over(w).alias("p"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
                     F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"), F.row_number().over(w).cast("bigint").alias("r"),
                     F.lead("i").over(w).isNull().alias("z"))
    key = lambda r: r["i"]
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_ordered_before_only(spark):
    df = spark.createDataFrame([(1, t, t) for t in range(6)], "k INT, t INT, v INT")
    got = ordered(df, ["k"], ["t"], number_chunk("t", 2), running_sum={"s": "v"}, before_only=True)
    assert [(r.t, r.s) for r in got.orderBy("t").collect()] == [(0, None), (1, 0), (2, 1), (3, 3), (4, 6), (5, 10)]


@pytest.mark.parametrize("hot", [0, 400])
def test_dedupe_with_hot_key(spark, hot):
    data = [(7, f"p{i:04d}") for i in range(hot)] + [(1, "b"), (1, "a"), (2, "c")]
    kept, listed = dedupe_points(spark.createDataFrame(data, "point INT, path STRING"))
    assert {r.point: r.path for r in kept.collect()} == ({7: "p0000"} if hot else {}) | {1: "a", 2: "c"}
    assert listed.count() == len(data) - kept.count()
    assert listed.where("point = 1").first().reason == "point index 1 already read from a"


def test_band_counts_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    walls = [(i, rng.choice("ab"), rng.randint(0, 60) / 100) for i in range(60)] + [(99, "c", 0.3), (98, "a", None)]
    records = [(f"u{i:03d}", rng.choice("aab"), rng.randint(0, 60) / 100) for i in range(80)]
    out = band_candidates(spark.createDataFrame(walls, "gid INT, family STRING, thickness_m DOUBLE"),
                          spark.createDataFrame(records, "record_uri STRING, family STRING, thickness_m DOUBLE"), tol=0.02, width=0.1)
    got = {r.gid: (r.in_band, r.nearest) for r in out.collect()}
    for gid, family, t in walls:
        mine = [(abs(t - rt), rt, u) for u, f, rt in records if f == family] if t is not None else []
        assert got[gid] == (sum(d <= 0.02 + 1e-12 for d, _, _ in mine), min(mine)[2] if mine else None)
