"""Conversation repair against a plain search over all edits."""

import hashlib
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from linkledger.llm import conversations
from linkledger.llm.common import read_table
from linkledger.llm.queries import QUERIES
from conftest import SF_DIR

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """(cost, audit) over rows of (initial, must go, truncated), one edit at a time; more than two inserts in a row never pay."""
    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            found += [(3 + c, "I" + a) for x in NEXT[state] if x != "s" for c, a in [best(i, NEXT[state][x], inserts + 1)]]
        if i < len(rows):
            initial, gone, truncated = rows[i]
            found += [(4 + c, "D" + a) for c, a in [best(i + 1, state, 0)]]
            for x in NEXT[state] if not gone else ():
                edit = "K" if x == initial else "R" if x != "s" else None
                if edit:
                    c, a = best(i + 1, NEXT[state][x], 0)
                    found.append((c + 3 * (edit == "R") + 3 * truncated, edit + a))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


def plain_report(rows):
    """rows: (turn, role, text) of one conversation after damage."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = cheapest(marked)
    out, state, at = [], "", 0
    for e in audit:
        role, text = (None, "") if e == "I" else rows[at][1:]
        at += e != "I"
        if e in "IR":
            role = "assistant" if state == "u" else "user"
        if e != "D":
            out.append(f"{role}:{text}")
            state = role[:1]
    initials = [r[1][:1] for r in rows]
    turns = {t for t, _, _ in rows if t is not None}
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(conv, turn, role, text):
    show = lambda v: " " if v is None else str(v)
    fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
    role, text = show(role), show(text)
    if fault == 0:
        return []
    text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
    return [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def plain_query(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).extend(plain_damage(conv, turn, role, text))
    return {conv: plain_report(left) for conv, left in convs.items()}


def run(turns, piece):
    repair = conversations.Repair(True, piece)
    for turn, role, text in turns:
        repair.add(turn, role, text)
    return repair.finish(), repair.out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["a.", "b!", "c", "", " \n", "d?"])), max_size=12))
@pytest.mark.parametrize("piece", [2, 64])
def test_equals_a_search_over_all_edits(piece, turns):
    rows = [(0, *r) for r in sorted(turns, key=lambda r: (r[0].encode(), r[1].encode()))] + [(i, role, text) for i, (role, text) in enumerate(turns, 1)]
    assert run(rows, piece)[0] == plain_report(rows)


def test_pieces_change_nothing_in_long_conversations():
    roles = ["user", "assistant", "user", "user", "system", "tool", "assistant"]
    rows = [(i, roles[(i * i + i // 7) % 7], f"text {i % 50}" + ".!? "[i % 4]) for i in range(400)]
    whole = plain_report(rows[:150])
    for piece in (3, 64, 1000):
        assert run(rows[:150], piece)[0] == whole
    repair = conversations.Repair(False)
    for i in range(200_000):  # texts are not kept
        repair.add(i, "user" if i % 2 == 0 else "assistant", f"turn {i}.")
        assert len(repair.open) <= 2
    assert repair.finish()[5:7] == (0, "K" * 200_000)


def test_bands_are_sound():
    for turns in ("uaua", "aauu", "xSuA-u", "uuuuuuu", "----", "aUaUaU"):
        for m in range(9):
            target = ("ua" * 5)[:m]
            free = conversations.align(turns, target, 10**6)
            assert free is not None and conversations.align(turns, target, free[0]) == free
            assert conversations.align(turns, target, free[0] - 1) is None


def test_query_equals_the_plain_version(spark):
    got = QUERIES["op12_conversation_repair"](spark, SF_DIR)
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert [c for c, k in got.dtypes if k == "bigint"] == ["conv_id", *columns[:6]]
    rows = [tuple(r) for r in read_table(spark, SF_DIR, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r[c] for c in columns) for r in got.collect()} == plain_query(rows)


def test_ragged_conversations(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, conv long, step string, copy int, fault string"
    odd = [(c, t, r, x) for c in (None, 1, 2, 3) for t in (None, 0, 0, 5) for r in (None, "user", "") for x in (None, "", "é　", "ends.", "ends")]
    odd += [(i, 0, "user", "only one.") for i in range(10, 60)] + [(70, -(2**63), "user", "a."), (70, 2**63 - 1, "assistant", "b.")]
    odd += [(80, i, "assistant" if i % 2 else "user", "x" * 300_000 + f" {i}.") for i in range(6)]
    frame = spark.createDataFrame([(*r, 1, None, 2, "x") for r in odd], schema).repartition(3)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    expected = plain_query(odd)
    expected[70] = (min(expected[70][0], 2**63 - 1), *expected[70][1:])
    assert got == expected
    assert any(not plain_damage(i, 0, "user", "x") for i in range(10, 60))  # some have no turn left
    edits = conversations.repaired_turns(conversations.damage(frame)).where("conv = 80").orderBy("step").collect()
    assert "".join(e["edit"][0].upper() for e in edits) == expected[80][6]
    assert hashlib.sha256("\n".join(f"{e['role']}:{e['text']}" for e in edits if e["edit"] != "delete").encode()).hexdigest() == expected[80][7]
    none = spark.createDataFrame([], schema)
    assert conversations.repair_reports(none).collect() == [] and conversations.repaired_turns(none).collect() == []
