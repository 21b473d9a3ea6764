"""Where benchmark passages stand in the original texts, against plain Python."""

import re

from ragged import make_docs, ragged_pairs  # noqa: F401
from linkledger.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [(1, " ".join(f"q{i}" for i in range(25))), (2, "Ünïcode ßtraße"), (3, None), (4, "beta gamma"), (5, "q3 q4"), (6, "gamma delta")]


def plain_spans(text, items, window=10):
    # A-Z alone change case, so places stay.
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = list(WORD.finditer(lower))
    hit = set()
    for _, item in items:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        n = min(window, len(w))
        runs = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(found) - n + 1):
            if runs and tuple(m[0] for m in found[i:i + n]) in runs:
                hit.update((j, j + 1 < i + n) for j in range(i, i + n))
    words = sorted({j for j, _ in hit})
    spans = []
    for j in words:
        if spans and spans[-1][0] == j - 1:
            spans[-1] = (j, spans[-1][1], found[j].end())
        else:
            spans.append((j, found[j].start(), found[j].end()))
    return [(a, b) for _, a, b in spans]


def test_spans_of_ragged_documents(spark, make_docs, ragged_pairs):
    pairs = [*ragged_pairs, (30, "é\n\tq9 -- " + ITEMS[0][1].upper().replace(" ", ", ") + "!é"), (31, "😀 " + ITEMS[0][1].upper().replace(" ", " ;\n") + " 😀 q3--Q4.. "), (32, "Q3 Q4")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = sorted(str((i, plain_spans(t, ITEMS))) for i, t in pairs)
    assert sum("(" in e[1:] for e in expected) == 7
    for size in (1 << 24, 3000):
        got = decontamination.with_spans(decontamination.find_items(make_docs(pairs), bench, automaton_bytes=size)).collect()
        assert sorted(str((r["id"], [tuple(s) for s in r["spans"]])) for r in got) == expected
    assert decontamination.with_spans(decontamination.find_items(make_docs([]), bench)).collect() == []


def test_word_spans_count_characters():
    text = "¿Qué? 😀😀 ÄB-c"
    assert decontamination.word_spans(text.encode(), [(0, 1)]) == [(0, 4)]
    assert [text[a:b] for a, b in decontamination.word_spans(text.encode(), [(1, 2), (2, 3), (3, 4)])] == ["😀😀 ÄB-c"[:len("😀😀 ÄB-c")]]
    assert decontamination.word_spans(b"", []) == []
