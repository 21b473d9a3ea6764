"""Source divergence against plain Python, on ragged rows and with stripes spilled early."""

import re
from collections import Counter

import numpy as np
from linkledger.llm import divergence

RUNS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, Counter(RUNS.findall(t.translate(LOWER)))) for la, s, t in rows if la == lang]
        docs = Counter(t for _, c in mine for t in c)
        kept = [t for t in docs if docs[t] >= least]
        counts = {s: Counter() for s, _ in mine}
        for s, c in mine:
            counts[s].update({t: n for t, n in c.items() if docs[t] >= least})
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 1000000000 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s, c in counts.items():
            pairs = [(o, sum((p(c, t) - p(d, t)) ** 2 // p(d, t) for t in kept)) for o, d in counts.items() if o != s]
            terms = [(t, (p(c, t) - p(whole, t)) ** 2 // p(whole, t)) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def ragged():
    rows = [("en", f"s{i % 4}", f"the Word{i % 7} of of é{i % 3}ü {'x' * (i % 5)}-y1z THE") for i in range(60)]
    rows += [("en", "s0", None), ("en", "quiet", "\x00 12 !?"), ("", None, "alone"), (None, "", "Alone alone"), (None, "b", None), ("de", "s1", "Straße straße ÄÖ äö"), ("de", "s1", "Straße")]
    rows += [("de", "s2", "Straße straße" * 3000), ("fr", "a", "rare"), ("fr", "b", "rare"), ("en", "s1", "long " * 40_000), *[("en", "s2", "same same text")] * 3, ("en", "S2", "ꜱame 𝔘nder 𝔘nder")]
    return rows


def test_ragged_rows_equal_the_plain_version(spark, monkeypatch):
    rows = ragged()
    frame = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], "lang string, source string, text string, docs long, term string, n long, stripe string").repartition(5)
    expected = plain(rows)
    assert sorted(map(tuple, divergence.audit_divergence(frame).collect())) == expected
    assert sorted(map(tuple, divergence.audit_divergence(frame, least_docs=1, top_terms=3).collect())) == plain(rows, 1, 3)
    assert divergence.audit_divergence(frame.limit(0)).collect() == []


def test_spilled_stripes_hold_the_same_cells():
    rows = [(r[0] or "", r[1] or "", (r[2] or "").encode()) for r in ragged()]

    def cells(limit):
        total, docs, folds = Counter(), Counter(), 0
        for fold in divergence.fold_stripes(iter(rows), limit):
            folds += 1
            for lang, term, source, n, k in zip(*(c.to_pylist() for c in divergence.stripe_cells(*fold).columns)):
                total[lang, term, source] += n
                docs[lang, term] += k
        return total, docs, folds

    whole, spilled = cells(10**9), cells(5)
    assert whole[:2] == spilled[:2] and spilled[2] > whole[2]


def test_counts_of_any_size_are_exact():
    counts = np.array([[10**12, 0], [3, 10**15]])
    totals = np.array([10**12 + 5, 10**15 + 5])
    expected = [[1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(row, totals)] for row in counts]
    assert divergence.probabilities(counts, totals[None, :]).tolist() == expected
    small = np.array([[4, 0, 9], [1, 2, 3]])
    p = divergence.probabilities(small, np.array([[20, 30, 40]])).tolist()
    sums = divergence.stripe_sums(small, np.array([20, 30, 40]))
    assert sums.tolist() == [[sum((r[i] - r[j]) ** 2 // r[j] for r in p) for j in range(3)] for i in range(3)]
