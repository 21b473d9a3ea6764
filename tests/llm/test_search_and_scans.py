"""Vector search, decontamination and licence scan on ragged input, against plain Python."""

import math
import re

import numpy as np
import pytest
from ragged import make_docs, ragged_pairs  # noqa: F401
from linkledger.llm import decontamination, license_scan, vector_search
from pyspark.sql import functions as F


def plain_top(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault(i, [math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for q in usable:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_with_ties_and_unusable_vectors(spark):
    random = np.random.default_rng(4)
    rows = [(i, random.normal(0, 0.1, 24).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(5)] + [(450, rows[50][1]), (500, None), (550, [0.1, None]), (600, [float("nan")] * 24), (601, [float("inf")] * 24), (650, [0.5] * 8), (None, rows[0][1]), (700, []), (750, [0.0] * 24)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    vectors = vector_search.integer_vectors(table)
    queries = vectors.where(F.col("vec_id") % 50 == 0)
    for block in (4096, 3):
        got = vector_search.top_k(vectors, queries, 5, query_block=block).collect()
        assert sorted(map(tuple, got)) == plain_top(rows, 5)
    few = vector_search.integer_vectors(spark.createDataFrame(rows[50:52], "vec_id long, embedding array<float>"))
    assert [tuple(r)[:3] for r in vector_search.top_k(few, few.where("vec_id = 50")).collect()] == [(50, 1, 51)]
    none = vectors.limit(0)
    assert vector_search.top_k(none, none).collect() == [] and vector_search.top_k(vectors, none).collect() == [] and vector_search.top_k(none, queries).collect() == []


def test_top_k_of_large_components(spark):
    random = np.random.default_rng(4)
    rows = [(i, random.normal(0, 0.1, 24).astype(np.float32).tolist()) for i in range(100)]
    rows += [(101, [3e12] + [0.0] * 23), (102, [-3e12] + [0.0] * 23), (103, [6e5] * 24), (104, [7e5] * 24), (150, [0.0] + [5e6] * 23)]
    vectors = vector_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = vector_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, 5)
    for large in (3e12, 1e20):
        vectors = vector_search.integer_vectors(spark.createDataFrame([(0, [large]), (1, [large])], "vec_id long, embedding array<float>"))
        with pytest.raises(Exception, match="does not fit a long"):
            vector_search.top_k(vectors, vectors).collect()


def test_bounds_never_undercut_the_product():
    random = np.random.default_rng(8)
    a, b = random.integers(-300, 300, (40, 50)), random.integers(-300, 300, (60, 50))
    exact, before = a @ b.T, np.full((40, 60), np.inf)
    for x, y in zip(vector_search.segment_levels(a.astype(float)), vector_search.segment_levels(b.astype(float))):
        bound = x @ y.T
        assert (bound >= exact - 1e-6).all() and (bound <= before + 1e-6).all()
        before = bound


def plain_hits(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        n = min(window, len(w))
        runs = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if runs and tuple(words[i:i + n]) in runs:
                hit.update(range(i, i + n))
                found.add("null" if name is None else str(name))
    return len(words), len(hit), sorted(found)


def test_benchmark_passages_of_ragged_documents(spark, make_docs, ragged_pairs):
    long_item = " ".join(f"q{i}" for i in range(25))
    items = [(1, long_item), (2, "Short, item!"), (3, None), (4, "..."), (5, "short item"), (None, "beta gamma"), (6, long_item), (7, " ".join(f"q{i}" for i in range(12, 30)))]
    pairs = [*ragged_pairs, (30, "q9 " + long_item.upper().replace(" ", ", ") + " q25 q26"), (31, "a SHORT--item b short item"), (32, "xshort item"), (33, " ".join(f"q{i}" for i in range(9)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(str((i, *plain_hits(t, items))) for i, t in pairs)
    for size in (1 << 24, 3000):  # one automaton, and one per block of items
        got = decontamination.find_items(make_docs(pairs), bench, automaton_bytes=size).select("id", "n_words", decontamination.hit_words().alias("n"), "items").collect()
        assert sorted(str((r["id"], r["n_words"], r["n"], r["items"])) for r in got) == expected
    clean = decontamination.drop_contaminated(make_docs(pairs), bench)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, t in pairs if not plain_hits(t, items)[2])
    assert decontamination.find_items(make_docs([]), bench).collect() == []
    assert all(r["items"] == [] for r in decontamination.find_items(make_docs(pairs), bench.limit(0)).collect())


def test_licences_of_ragged_documents(make_docs, ragged_pairs):
    texts = dict(license_scan.TEMPLATES)
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 300)
    cut = mit.split()
    noise = " ".join(f"noise{i}" for i in range(500))
    pairs = [
        *ragged_pairs, (40, f"{noise} {mit.upper()} {noise}"), (41, f"{noise}\nReleased under the MIT License.\n{noise} {texts['ISC']}"), (42, "released under the mit licence"),
        (43, " ".join(cut[:40]) + " " + noise), (44, noise + " " + " ".join([*cut[:80], "changed", *cut[81:]])), (45, "Licensed under CC BY-NC 4.0. " * 300), (46, "x " * 7 + "Released under the MIT License."),
    ]
    got = {str(r["id"]): r["licenses"] for r in license_scan.scan_licenses(make_docs(pairs)).select("id", "licenses").collect() if r["id"] is not None and r["id"] >= 14}
    assert got == {"40": ["MIT"], "41": ["ISC", "MIT"], "42": [], "43": [], "44": ["MIT"], "45": ["CC-BY-NC-4.0"], "46": ["MIT"]}
    rest = license_scan.scan_licenses(make_docs(ragged_pairs)).collect()
    assert len(rest) == len(ragged_pairs) and all(r["licenses"] == [] for r in rest)
    assert license_scan.scan_licenses(make_docs([])).collect() == []
    assert all(r["licenses"] == [] for r in license_scan.scan_licenses(make_docs(ragged_pairs), templates=[("none", " - ")]).collect())


def test_licence_scan_runs_no_python(make_docs, ragged_pairs):
    plan = license_scan.scan_licenses(make_docs(ragged_pairs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_notices_in_repetitive_and_long_texts(make_docs):
    """Verbatim notices before two alternating words, and templates of thousands of words inside longer texts."""
    notices = [t for _, t in license_scan.TEMPLATES if len(t.split()) > 40]
    pairs = [(100 + i, f"{notices[i % len(notices)]} " + f"foo{i} bar{i} " * (150 + i)) for i in range(120)]
    rows = license_scan.scan_licenses(make_docs(pairs)).select("id", "licenses").collect()
    names = {t: n for n, t in license_scan.TEMPLATES}
    assert [r["id"] for r in rows if names[notices[(r["id"] - 100) % len(notices)]] not in r["licenses"]] == []
    long = {n: " ".join(f"{n}{i * i % 4999}" for i in range(n)) for n in (600, 3000, 8000)}
    texts = [(n, f"{'intro words here ' * 700}{text}{' and an end' * 900}") for n, text in long.items()]
    found = license_scan.scan_licenses(make_docs(texts), templates=[(str(n), t) for n, t in long.items()])
    assert {r["id"]: r["licenses"] for r in found.collect()} == {n: [str(n)] for n in long}


def test_blocks_that_bounds_hardly_prune_are_not_scored_pair_by_pair(monkeypatch):
    """Gaussian vectors leave nearly all pairs: only the first thresholds are single products, and scores stay exact."""
    import linkledger.llm.vector_search as V

    single, products = [], V.exact_products
    monkeypatch.setattr(V, "exact_products", lambda a, b: single.append(len(a)) or products(a, b))
    vectors = np.floor(np.random.default_rng(7).normal(size=(1500, 64)) * 256).astype(np.int64)
    vectors[700] = vectors[3]
    for scale in (1, 1 << 20, 1 << 40):  # the last is beyond what doubles hold
        single.clear()
        search = V.Search(np.arange(0, 1500, 10), vectors[::10] * scale, 5)
        for at in range(0, 1500, 500):
            search.add(np.arange(at, at + 500), vectors[at:at + 500])
        scores = (vectors[::10] @ vectors.T) * scale
        expected = []
        for i, row in enumerate(scores):
            best = [c for c in np.lexsort((np.arange(1500), -row)) if c != i * 10][:5]
            expected += [(i, c, row[c]) for c in best]
        assert list(map(tuple, search.best.tolist())) == expected
        assert scale > 1 or sum(single) < 0.1 * scores.size
