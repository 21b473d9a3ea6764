"""Toxicity: the kernel against plain counting, the machine against its own expansion, held-out labels, ragged rows."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from linkledger.llm import toxicity
from linkledger.llm.common import fold, read_table
from ragged import make_docs, ragged_pairs  # noqa: F401


def plain_features(word):
    marked = "^" + word + "$"
    out = Counter()
    for places in combinations(range(len(marked)), toxicity.ORDER):
        span = places[-1] - places[0] + 1
        if span <= toxicity.SPAN:
            out["".join(marked[p] for p in places)] += toxicity.DECAY ** (span - toxicity.ORDER)
    return out


WORDS = ["idiot", "idxiot", "i", "ab", "straße", "banana", "𝔘nder", "pathetic", "worthless", "toil"]


def test_kernel_counts_common_subsequences():
    got = toxicity.Landmarks(WORDS).kernel(WORDS)
    for i, a in enumerate(WORDS):
        for j, b in enumerate(WORDS):
            fa, fb = plain_features(a), plain_features(b)
            norm = toxicity._norm(len(a) + 2) * toxicity._norm(len(b) + 2)
            assert got[i, j] == pytest.approx(sum(fa[u] * fb[u] for u in fa) / norm, abs=1e-5)
    assert got[0, 1] > 0.5 > got[0, 9]  # a strange character inside does less than other letters


def test_folded_table_is_the_expansion_over_landmarks():
    marks = toxicity.Landmarks(WORDS[:6])
    normal = np.linspace(-1, 1, marks.map.shape[1])
    assert np.allclose(toxicity.word_margins(WORDS, marks.folded(normal), 0.25), marks.features(WORDS)[:, :-1] @ normal + 0.25, atol=1e-4)


def test_words_and_runs():
    assert list(toxicity.words("You s.c.u.m, x y of !".split())) == ["You", "scum", "of"]
    assert list(toxicity.words(["i", "d", "i,", "o", "t", "end"])) == ["idiot", "end"]
    long = "".join(chr(97 + i % 26) for i in range(1000)) + "idiot"
    assert any("idiot" in w for w in toxicity.windows(long)) and max(map(len, toxicity.windows(long))) <= toxicity.LONGEST


def accuracy(scored, labels):
    rows = scored.join(labels.withColumnRenamed("doc_id", "id"), "id").where(fold("id", 5) == 0).select("score", "toxic").collect()
    return sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows) / len(rows), [r for r in rows if r["toxic"] == 1]


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    scored = toxicity.score_toxicity(docs, labels, trains=fold("doc_id", 5) != 0)
    right, toxic = accuracy(scored, labels)
    assert right >= 0.93 and sum(r["score"] >= 0.5 for r in toxic) >= 0.6 * len(toxic)


def test_ragged_rows_and_strange_characters(spark, make_docs, ragged_pairs):
    syllables = ["ta", "ro", "min", "el", "ou", "sha", "ver", "ing", "po", "da"]

    def clean(i):
        return " ".join(syllables[(i * 7 + k * k) % 10] + syllables[(i + 3 * k) % 10] + syllables[(k * i) % 10 if k % 2 else k % 10] for k in range(30)) + "."

    insults = ["blokhead", "numskul", "dimwitz"]
    taught = [(100 + i, clean(i)) for i in range(240)] + [(400 + i, f"{clean(i)} {insults[i % 3]} tamin, {insults[(i + 1) % 3]}!") for i in range(60)]
    asked = [(1000, f"{clean(5)} b.l.o.k.h.e.a.d {clean(6)} n u m s k u l"), (1001, f"{clean(7)} blokrhead numrskul dimrwitz"), (1002, clean(300)), (1003, clean(301))]
    docs = make_docs([*ragged_pairs, *taught, *asked])
    labels = spark.createDataFrame([(i, int(i >= 400), "x") for i, _ in taught] + [(None, 1, "x"), (1, 0, None), (400, 0, "x"), (5, 7, "x")], "doc_id long, toxic int, score string")
    from pyspark.sql import functions as F
    rows = toxicity.score_toxicity(docs, labels, trains=F.lit(True)).select("id", "score", "margins").collect()
    assert len(rows) == len(ragged_pairs) + len(taught) + len(asked) and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["id"]: r["score"] for r in rows}
    assert by_id[1000] >= 0.5 and by_id[1001] >= 0.5 and by_id[1002] < 0.5 and by_id[1003] < 0.5
    assert by_id[2] == by_id[3] == by_id[4] < 0.5
    assert len({r["score"] for r in rows if r["id"] == 5}) == 1
    none = toxicity.score_toxicity(docs, labels.limit(0), trains=F.lit(True))
    assert {r["score"] for r in none.select("score").collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), labels, trains=F.lit(True)).collect() == []
