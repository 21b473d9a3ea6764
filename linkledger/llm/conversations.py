"""Repair conversations into an optional system turn and alternating user and assistant turns, by cheapest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkledger.llm.common import ASCII_SPACE, bounded_batches

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns that are aligned at once; longer conversations are aligned piece by piece, with the same result.
PIECE = 64
LARGEST = (1 << 63) - 1
#: States of the grammar `(s?(ua)+)?`: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"u": "user", "a": "assistant"}
EDITS = {"K": "keep", "R": "rerole", "D": "delete", "I": "insert"}
REPORT_SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDIT_SCHEMA = "step long, edit string, fault string, role string, text string"


def _least(apart: int) -> int:
    """The least cost of ``apart`` more (or fewer) target letters than turns."""
    return INSERT * apart if apart > 0 else -DELETE * apart


def align(turns: str, target: str, bound: int) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of ``turns`` into ``target``, if no dearer than ``bound``; ties to the ASCII-least audit.

    A turn is the initial of its role (``x`` for others), a capital if the text is truncated, or ``-`` if it must go.
    Wagner-Fischer from the end, in the band of cells that a path within ``bound`` can pass.
    """
    n, m = len(turns), len(target)
    free = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        free[i] = free[i + 1] + (turns[i] != "-")
    left = bound - DELETE * (n - free[0])
    endless = bound + 1
    below: list[int] = []
    table: list[list[int]] = [[]] * (n + 1)
    for i in range(n, -1, -1):
        row = [endless] * (m + 2)
        done, turn = free[0] - free[i], turns[i] if i < n else ""
        truncated = TRUNCATED if "A" <= turn <= "Z" else 0
        initial = turn.lower()
        for j in range(m, -1, -1):
            if _least(j - done) + _least(m - j - free[i]) > left:
                continue
            best = 0 if i == n and j == m else endless
            if i < n:
                best = min(best, DELETE + below[j])
            if j < m:
                if target[j] != "s":
                    best = min(best, INSERT + row[j + 1])
                if i < n and turn != "-":
                    if initial == target[j]:
                        best = min(best, truncated + below[j + 1])
                    elif target[j] != "s":
                        best = min(best, REROLE + truncated + below[j + 1])
            row[j] = best
        table[i] = below = row
    if table[0][0] > bound:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:  # letters in ASCII order: the first that lies on a cheapest path
        cost = table[i][j]
        if i < n and cost == DELETE + table[i + 1][j]:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and cost == INSERT + table[i][j + 1]:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return table[0][0], "".join(audit)


def _after(state: int, letter: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}[letter] if letter else state


@lru_cache(maxsize=1 << 16)
def piece_edits(turns: str, state: int) -> dict[int, tuple[int, str]]:
    """From a state of the grammar: the cheapest (cost, audit) for every state that the turns can end in.

    The turns are aligned to every feasible length of the grammar's strings, from the nearest length on, until lengths
    differ so much that their edits alone cost more than what was found.
    """
    free = sum(t != "-" for t in turns)
    forced = DELETE * (len(turns) - free)
    found: dict[int, tuple[int, str]] = {}
    letters = "au" if state == USER else "ua"
    forms = [("", letters)] + ([("s", "ua")] if state == START and "s" in turns.lower() else [])
    for first, pair in forms:
        seen: set[int] = set()

        def attempt(m: int) -> None:
            if m < len(first) or m in seen:
                return
            seen.add(m)
            target = first + pair[0:1] * (m > len(first)) + "".join(pair[k % 2] for k in range(1, m - len(first)))
            end = _after(state, target[-1:])
            known = found.get(end)
            if known and forced + _least(m - free) > known[0]:
                return
            got = align(turns, target, known[0] if known else DELETE * len(turns) + INSERT * m)
            if got and (known is None or got < known):
                found[end] = got

        for m in (0, 1):  # the only lengths that end in the first two states
            attempt(m)
        k = 0
        while k < 3 or forced + INSERT * k <= max(found[end][0] for end in (USER, ASSISTANT)):
            attempt(free + k)
            attempt(free - k)
            k += 1
    return found


class Repair:
    """The turns of one conversation in order, piece by piece; what no later turn can change is given out at once."""

    def __init__(self, wants_edits: bool, piece: int = PIECE):
        self.wants_edits, self.size = wants_edits, piece
        self.out: list[tuple] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.steps = 0
        self.seen: set[bytes] = set()
        self.turns: set[int] = set()
        self.last: str | None = None
        self.piece: list[tuple[str, str, str, str]] = []
        self.open: list[tuple[list, dict[int, tuple[int, str]]]] = []  # pieces, and for each end state (start state, audit)
        self.paths: dict[int, tuple[int, str]] = {START: (0, "")}
        self.state, self.audit = START, []
        self.digest, self.started = hashlib.sha256(), False

    def add(self, turn: int | None, role: str, text: str) -> None:
        key = hashlib.blake2b(f"{len(role)} {role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        shown = text.rstrip(ASCII_SPACE)
        fault = "blank" if not shown else "duplicate" if key in self.seen else "truncated" if shown[-1] not in ".!?" else ""
        self.seen.add(key)
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            self.turns.add(turn)
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        self.piece.append(("-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial, fault, role, text))
        if len(self.piece) == self.size:
            self._close_piece()

    def _close_piece(self) -> None:
        rows, self.piece = self.piece, []
        turns = "".join(r[0] for r in rows)
        paths: dict[int, tuple[int, str]] = {}
        back: dict[int, tuple[int, str]] = {}
        for start, (cost, audit) in self.paths.items():
            for end, (more, letters) in piece_edits(turns, start).items():
                if end not in paths or (cost + more, audit + letters) < paths[end]:
                    paths[end], back[end] = (cost + more, audit + letters), (start, letters)
        # From any state two inserts, or an insert and a deletion, do for the turns to come what another state could do.
        enough = min(cost for cost, _ in paths.values()) + INSERT + max(INSERT, DELETE)
        self.paths = paths = {state: path for state, path in paths.items() if path[0] <= enough}
        self.open.append((rows, back))
        live = set(paths)
        for at in range(len(self.open) - 1, 0, -1):
            live = {self.open[at][1][end][0] for end in live}
            if len(live) == 1:  # all cheapest paths agree up to here
                self._give_out(at, live.pop())
                break

    def _give_out(self, pieces: int, end: int) -> None:
        chosen = []
        for rows, back in reversed(self.open[:pieces]):
            start, letters = back[end]
            chosen.append((rows, letters))
            end = start
        self.open = self.open[pieces:]
        length = sum(len(letters) for _, letters in chosen)
        self.paths = {state: (cost, audit[length:]) for state, (cost, audit) in self.paths.items()}
        for rows, letters in reversed(chosen):
            self.audit.append(letters)
            given = iter(rows)
            for letter in letters:
                _, fault, role, text = next(given) if letter != "I" else ("", "", "", "")
                if letter in "RI":
                    role = ROLES["a" if self.state == USER else "u"]
                if letter != "D":
                    self.state = _after(self.state, role[:1])
                    self.digest.update((("\n" if self.started else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    self.started = True
                if self.wants_edits:
                    self.out.append((self.steps, EDITS[letter], fault, role, text))
                self.steps += 1

    def finish(self) -> tuple:
        if self.piece:
            self._close_piece()
        end = min((s for s in self.paths if s in (START, ASSISTANT)), key=lambda s: self.paths[s])
        cost = self.paths[end][0]
        self._give_out(len(self.open), end)
        gaps = min(max(self.turns) - min(self.turns) + 1 - len(self.turns), LARGEST) if self.turns else 0
        return (gaps, *self.counts.values(), self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


def _repair(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, wants_edits: bool) -> DataFrame:
    bounded_batches(turns.sparkSession)
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (role_col, text_col)}
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), filled[role_col].alias("role"), filled[text_col].alias("text"))
    sorted_rows = rows.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, " + (EDIT_SCHEMA if wants_edits else REPORT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = names = None
        out: list[tuple] = []
        current: Repair | None = None
        conv, size = None, 0

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out))
            kinds = [kind, *([pa.int64(), *[pa.string()] * 4] if wants_edits else [*[pa.int64()] * 6, pa.string(), pa.string()])]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            out.clear()
            return batch

        def gather(last: bool) -> None:
            nonlocal size
            report = current.finish() if last else None
            if wants_edits:
                size += sum(len(row[4]) for row in current.out)
                out.extend((conv, *row) for row in current.out)
                current.out.clear()
            elif last:
                size += len(report[6])
                out.append((conv, *report))

        for batch in batches:
            kind = batch.schema.field("conv").type
            names = ["conv", *(x.split()[0] for x in (EDIT_SCHEMA if wants_edits else REPORT_SCHEMA).split(", "))]
            for of, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text"))):
                if current is None or of != conv:
                    if current is not None:
                        gather(True)
                    current, conv = Repair(wants_edits), of
                current.add(turn, role, text)
                if len(current.out) >= PIECE:
                    gather(False)
                if len(out) >= 4096 or size >= 4 << 20:
                    if out:
                        yield packed()
                    size = 0
        if current is not None:
            gather(True)
        if out:
            yield packed()

    return sorted_rows.mapInArrow(run, schema)


def repair_reports(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row per conversation.

    Turns are taken by turn number, null first; equal numbers by role and text in UTF-8. The first fault of a turn
    counts: blank (white space only), duplicate (role and text stood before in the conversation), truncated (the last
    visible character is none of ``.!?``). Keep costs 0, a new role 3, deletion 4 (blank and duplicate turns must go), an
    inserted empty turn 3, a truncated turn that stays 3 more. ``audit`` has the initials of the cheapest edits after which
    the initials of the roles read ``(s?(ua)+)?``, the ASCII-least where several are cheapest.

    A null role or text counts as one space; null conversation numbers are one conversation. All turn numbers null: no gaps; a number
    of gaps beyond a long is held at the largest long. An empty table gives no rows; other columns are not looked at.

    A conversation is read in order by one task, since its digest must be; that task keeps 64 turns at a time, one hash and
    number per turn, and texts only until the cheapest paths of all states agree. Alignments go piece by piece: paths to one state with equal costs
    have used the same turns, so none of their audits is the beginning of another, and the least stays least whatever follows.
    """
    return _repair(turns, conv_col, turn_col, role_col, text_col, wants_edits=False)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, step, edit, fault, role, text): the edits of :func:`repair_reports` in order, with roles as repaired; deleted turns are listed too."""
    return _repair(turns, conv_col, turn_col, role_col, text_col, wants_edits=True)


def damage(turns: DataFrame) -> DataFrame:
    """The conversations table with faults planted by crc32 of ``conv_id:turn`` modulo 20, to try the repair on; null role and text become one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1)))
    return rows.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
