"""A class-based bigram model of words, its classes found by exchange clustering, and its scores of texts."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.llm.common import bounded_batches, cut_lineage, drop_stored, scratch_path, text_bytes

END = b"\n"  # no word holds it
VOCABULARY = 1 << 18
VOCABULARY_WORD_BYTES = 64
CLASSES = 64
ENDING_CLASSES = 32
MOVING = 3  # a round lets every third word move
SETTLED = 0.05  # rounds end when a smaller share of the words would move
CLASS_WEIGHT = 0.8
PRIOR = 5.0
DISCOUNT = 0.6
HELD_COUNTS = 500_000
HELD_PAIRS = 2_000_000
HELD_RARE = 200_000
JUDGED_ENTRIES = 1024


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, and one end."""
    return [*text.lower().split(), END]


def ending_class(word: bytes) -> int:
    """Where a word that no class holds belongs: by its last three bytes."""
    return zlib.crc32(word[-3:]) % ENDING_CLASSES


def ending_of(word: str) -> Column:
    return F.crc32(F.substring(word, -3, 3)) % ENDING_CLASSES


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens; each task adds up its own before they are shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(tokens(text))
            if len(held) > HELD_COUNTS:
                yield rows()
                held = Counter()
        yield rows()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` of the most frequent words, all those above a count, from frequent to rare.

    The count is read off a histogram of about 1,000 bins at most, so no task sorts the vocabulary.
    """
    short = counts.where(F.length("word") <= VOCABULARY_WORD_BYTES)
    bin_ = F.floor(F.log2("n") * 16)
    sizes = sorted(((r["bin"], r["count"]) for r in short.groupBy(bin_.alias("bin")).count().collect()), reverse=True)
    least, total = None, 0
    for b, size in sizes:
        if total + size > most:
            break
        least, total = b, total + size
    if least is None:
        return []
    found = short.where(bin_ >= least).select("word", "n").toArrow()
    return sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and their sums; runs that are in order already are merged fast."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def _listed(of: np.ndarray, others: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """Columns word, others, counts: a row for each run of ``of``."""
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    offsets = pa.array(np.append(starts, len(of)).astype(np.int32))
    return [pa.array(of[starts].astype(np.int32)), *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(t))) for x, t in ((others, np.int32), (n, np.int64)))]


PAIRS = "word int, others array<int>, counts array<long>, a int, b int, n long, a_word binary, b_word binary"


def count_pairs(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """Neighbouring symbols, added up by task: (word, others to its right, counts) where both have a number, else (a, b, n, a_word, b_word).

    Symbols are the numbers of ``words``, then one for each ending, then one for the start, which counts as a number. Words
    without a number count by their ending and are named in ``a_word`` and ``b_word``; these are null for the others.
    """
    shared = texts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    m = len(words)
    start, symbols = m + ENDING_CLASSES, m + ENDING_CLASSES + 1
    names = [c.split()[0] for c in PAIRS.split(", ")]

    def lists(of: np.ndarray, others: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        listed = _listed(of, others, n)
        nothing = [pa.nulls(len(listed[0]), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([*listed, *nothing], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        rare: Counter = Counter()

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _added(np.concatenate(held), np.concatenate(counts))

        def rows() -> Iterator[pa.RecordBatch]:
            codes, n = merged()
            a, b = codes // symbols, codes % symbols
            yield lists(a, b, n)

        def rare_rows() -> pa.RecordBatch:
            a, b, a_word, b_word = zip(*rare) if rare else [()] * 4
            nothing = [pa.nulls(len(rare), t) for t in (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*nothing, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(rare.values()), pa.int64()),
                                               pa.array(a_word, pa.binary()), pa.array(b_word, pa.binary())], names=names)

        for batch in batches:
            line, unnumbered = [start], {}
            for text in batch.column("text").to_pylist():
                for w in tokens(text):
                    if (x := number(w)) is None:
                        x = m + ending_class(w)
                        unnumbered[len(line)] = w
                    line.append(x)
                line.append(start)
            found = np.array(line, np.int64)
            codes = found[:-1] * symbols + found[1:]
            used = found[1:] != start
            at = np.array(list(unnumbered), np.int64)
            used[at - 1] = False
            used[at] = False
            for i in np.unique(np.concatenate([at - 1, at])).tolist():
                if line[i + 1] != start:
                    rare[line[i], line[i + 1], unnumbered.get(i), unnumbered.get(i + 1)] += 1
            codes, n = np.unique(codes[used], return_counts=True)
            held.append(codes)
            counts.append(n)
            if sum(map(len, held)) > HELD_PAIRS:
                held, counts = [[x] for x in merged()]
                if len(held[0]) > HELD_PAIRS // 2:
                    yield from rows()
                    held, counts = [], []
            if len(rare) > HELD_RARE:
                yield rare_rows()
                rare.clear()
        if held:
            yield from rows()
        yield rare_rows()

    return texts.mapInArrow(count, PAIRS)


def add_up(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def lists_of(pairs: DataFrame) -> DataFrame:
    """(word, others, counts) of (a, b, n), right and left."""
    added = add_up(pairs)
    right = added.select(F.col("a").alias("word"), F.col("b").alias("other"), "n")
    left = added.select(F.col("b").alias("word"), (-1 - F.col("a")).alias("other"), "n")
    grouped = right.union(left).groupBy("word").agg(F.collect_list(F.struct("other", "n")).alias("seen"))
    return grouped.select("word", F.col("seen.other").alias("others"), F.col("seen.n").alias("counts"))


def contexts(counted: DataFrame) -> DataFrame:
    """(word, others, counts, turn) of :func:`count_pairs`: per symbol all its neighbours, each once, the left ones as -1 - number. A row is bounded by the number of symbols."""
    def both_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, others, counts = _entries(batch)
            words = batch.column("word").to_numpy()[row]
            order = np.argsort(others, kind="stable")
            for columns in ((words, others, counts), (others[order], -1 - words[order], counts[order])):
                yield pa.RecordBatch.from_arrays(_listed(*columns), names=["word", "others", "counts"])

    numbered = counted.where(F.col("word").isNotNull()).select("word", "others", "counts")
    listed = numbered.mapInArrow(both_sides, "word int, others array<int>, counts array<long>")
    return merge_lists(listed.union(lists_of(counted.where(F.col("word").isNull()))))


def merge_lists(lists: DataFrame) -> DataFrame:
    """(word, others, counts, turn): one row for each word, each neighbour once in it."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, others, counts = _entries(batch)
            low, high = (int(others.min()), int(others.max())) if len(others) else (0, 0)
            keys, n = _added(row * (high - low + 1) + (others.astype(np.int64) - low), counts)
            row, others = keys // (high - low + 1), keys % (high - low + 1) + low
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in (others.astype(np.int32), n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("word"), *lists, pa.array((batch.column("word").to_numpy() % MOVING).astype(np.int32))], names=["word", "others", "counts", "turn"])

    grouped = lists.groupBy("word").agg(F.collect_list(F.struct("others", "counts")).alias("lists"))
    flat = grouped.select("word", F.flatten("lists.others").alias("others"), F.flatten("lists.counts").alias("counts"))
    return flat.mapInArrow(merge, "word int, others array<int>, counts array<long>, turn int")


def store_contexts(seen: DataFrame) -> DataFrame:
    """Stored with the words of one turn beside each other, so that a round reads no others."""
    path = scratch_path(seen.sparkSession, "contexts")
    seen.write.partitionBy("turn").parquet(path)
    return seen.sparkSession.read.schema(seen.schema).parquet(path)


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, count) of all neighbours in a batch of :func:`contexts`."""
    offsets = batch.column("others").offsets.to_numpy()
    others, counts = (batch.column(c).values.to_numpy()[offsets[0]:offsets[-1]] for c in ("others", "counts"))
    return np.repeat(np.arange(batch.num_rows), np.diff(offsets)), others, counts


def _sums(batch: pa.RecordBatch, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): per row how often each class stands before and after its word."""
    row, others, counts = _entries(batch)
    is_left = others < 0
    at = row * n_classes + classes[np.where(is_left, -1 - others, others)]
    left, right = (np.bincount(at[of], counts[of], batch.num_rows * n_classes).reshape(-1, n_classes) for of in (is_left, ~is_left))
    return left, right


def _information(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def worth(table: np.ndarray) -> float:
    """The sum of n ln n over class pairs less that over classes, twice; classes are better if it is larger."""
    return float(_information(table).sum() - _information(table.sum(axis=0)).sum() - _information(table.sum(axis=1)).sum())


def _gains(table: np.ndarray, here: np.ndarray, one: np.ndarray, two: np.ndarray, own: np.ndarray, n_free: int) -> np.ndarray:
    """What neighbours on one side, of classes ``one``, add to each free class, those of the class itself left out.

    ``table`` has the classes of that side as its rows; words are first taken out of the class they are in, so what they and
    their neighbours on the other side, ``two``, add to it is taken off.
    """
    gains = np.zeros((len(here), n_free))
    words, of = np.nonzero(one)
    known = _information(table[:, :n_free])
    for first in range(0, len(words), JUDGED_ENTRIES):
        w, c = words[first:first + JUDGED_ENTRIES], of[first:first + JUDGED_ENTRIES]
        n, at = one[w, c], here[w]
        rest, before = table[c, :n_free], known[c]
        inner = np.flatnonzero(at < n_free)
        rest[inner, at[inner]] -= n[inner]
        same = np.flatnonzero(c == at)
        rest[same] -= two[w[same], :n_free]
        both = same[at[same] < n_free]
        rest[both, at[both]] -= own[w[both]]
        before[inner, at[inner]] = _information(rest[inner, at[inner]])
        before[same] = _information(rest[same])
        more = _information(rest + n[:, None]) - before
        free = np.flatnonzero(c < n_free)
        more[free, c[free]] = 0
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        gains[w[starts]] += np.add.reduceat(more, starts, axis=0)
    return gains


def best_classes(table: np.ndarray, here: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, n_free: int) -> np.ndarray:
    """For each word the class among the first ``n_free`` in which it adds most to the :func:`worth` of the other words.

    ``left`` and ``right`` count the classes of its neighbours (a row for each word), without itself: it follows itself
    ``own`` times. ``table`` counts class pairs with every word in its class ``here``. A tie keeps a word where it is.
    """
    free = np.arange(n_free)
    gains = _gains(table, here, left, right, own, n_free) + _gains(np.ascontiguousarray(table.T), here, right, left, own, n_free)
    at = here[:, None] == free
    near_left, near_right, own = left[:, :n_free], right[:, :n_free], own[:, None]
    diagonal = table[free, free] - at * (near_left + near_right + own)
    gains += _information(diagonal + near_left + near_right + own) - _information(diagonal)
    for total, side in ((table.sum(axis=0)[free], left), (table.sum(axis=1)[free], right)):
        more = side.sum(axis=1, keepdims=True) + own
        rest = total - at * more
        gains -= _information(rest + more) - _information(rest)
    best = gains.argmax(axis=1)
    rows, inner = np.arange(len(here)), here < n_free
    stays = inner & (gains[rows, best] <= gains[rows, np.where(inner, here, 0)] + 1e-9)
    return np.where(stays, here, best)


def class_table(seen: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """Counts of neighbouring classes; tasks send one table each batch of words, whose number is bounded by the symbols."""
    shared = seen.sparkSession.sparkContext.broadcast(classes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, table = shared.value, np.zeros(n_classes * n_classes)
        for batch in batches:
            row, others, counts = _entries(batch)
            right = others >= 0
            of = classes[batch.column("word").to_numpy()] * n_classes
            table += np.bincount(of[row[right]] + classes[others[right]], counts[right], len(table))
        yield _table_rows(table, n_classes)

    return _gathered(seen.mapInArrow(add, "a long, b long, n long"), n_classes)


def symbol_classes(classes: np.ndarray, n_free: int) -> np.ndarray:
    """Classes of all symbols: of the numbered words, the endings and the start, then one symbol for each free class."""
    return np.concatenate([classes, n_free + np.arange(ENDING_CLASSES + 1), np.arange(n_free)]).astype(np.int64)


def exchange(seen: DataFrame, m: int, n_free: int, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(class of every symbol, table of class pairs) after rounds in which each third of the words moves at a time.

    The words of a round judge the same table, each in the task that holds its neighbours; the driver gets one class per
    moving word, and sees to it that no round makes the table worse: then the moves are taken back. Without ``rounds`` they
    go on until fewer than ``SETTLED`` of the words have moved since each had its turn.
    """
    n_classes = n_free + ENDING_CLASSES + 1
    classes = symbol_classes(np.arange(m) % n_free, n_free)
    table = class_table(seen, classes, n_classes)
    latest = deque([m] * MOVING, MOVING)
    for turn in (itertools.count() if rounds is None else range(rounds)) if m else ():
        if rounds is None and sum(latest) < SETTLED * m:
            break
        shared = seen.sparkSession.sparkContext.broadcast((classes, table))

        def move(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            classes, table = shared.value
            for batch in batches:
                words, (row, others, counts), (left, right) = batch.column("word").to_numpy(), _entries(batch), _sums(batch, classes, n_classes)
                here, rows, itself = classes[words], np.arange(len(words)), others == words[row]
                own = np.bincount(row[itself], counts[itself], len(words))
                left[rows, here] -= own
                right[rows, here] -= own
                best = best_classes(table, here, left, right, own, n_free)
                moves = best != here
                yield pa.RecordBatch.from_arrays([pa.array(words[moves].astype(np.int64)), pa.array(best[moves].astype(np.int64))], names=["word", "class"])

        moving = seen.where((F.col("word") < m) & (F.col("turn") == turn % MOVING))
        moved = moving.mapInArrow(move, "word long, class long").toArrow()
        changed = classes.copy()
        changed[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
        new = table + moved_table(moving, classes, changed, n_classes)
        better = worth(new) > worth(table)
        if better:
            classes, table = changed, new
        latest.append(len(moved) if better else 0)
    return classes, table


@dataclass
class RareWords:
    """Words without a number and their neighbours: ``contexts(word, seen, own)`` with numbered neighbours, and
    ``links(word, other, after, n)`` with words that have none either. ``m`` words are numbered."""

    contexts: DataFrame
    links: DataFrame
    m: int

    @classmethod
    def of(cls, pairs: DataFrame, m: int) -> RareWords:
        right = pairs.where("a_word IS NOT NULL").select(F.col("a_word").alias("word"), F.lit(True).alias("after"), F.col("b").alias("other"), F.col("b_word").alias("other_word"), "n")
        left = pairs.where("b_word IS NOT NULL").select(F.col("b_word").alias("word"), F.lit(False).alias("after"), (-1 - F.col("a")).alias("other"), F.col("a_word").alias("other_word"), "n")
        rows = right.union(left)
        own = F.col("after") & (F.col("other_word") == F.col("word"))
        contexts = rows.groupBy("word").agg(
            F.collect_list(F.when(F.col("other_word").isNull(), F.struct("other", "n"))).alias("seen"), F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("own"))
        links = rows.where(F.col("other_word") != F.col("word")).groupBy("word", F.col("other_word").alias("other"), "after").agg(F.sum("n").alias("n"))
        return cls(cut_lineage(contexts, "rare_contexts"), cut_lineage(links, "rare_links"), m)

    def endings(self) -> DataFrame:
        """(word, symbol): where they are before they have a class."""
        return self.contexts.select("word", (self.m + ending_of("word")).cast("int").alias("symbol"))

    def placed(self, symbols: DataFrame) -> DataFrame:
        """(word, symbol, own, others, counts) with the symbols that stand for the words now, stored."""
        other = symbols.select(F.col("word").alias("other"), F.col("symbol").alias("with"))
        linked = self.links.join(other, "other").groupBy("word").agg(
            F.collect_list(F.struct(F.when(F.col("after"), F.col("with")).otherwise(-1 - F.col("with")).alias("other"), "n")).alias("more"))
        both = self.contexts.join(symbols, "word").join(linked, "word", "left")
        every = F.when(F.col("more").isNull(), F.col("seen")).otherwise(F.concat("seen", "more"))
        return cut_lineage(both.select("word", "symbol", "own", every.alias("seen")).select("word", "symbol", "own", F.col("seen.other").alias("others"), F.col("seen.n").alias("counts")), "rare_placed")

    def table(self, placed: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
        """Counts of neighbouring classes where one has no number; neighbours that both have none are met twice, and counted once."""
        shared = placed.sparkSession.sparkContext.broadcast(classes)
        m = self.m

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classes, table = shared.value, np.zeros(n_classes * n_classes)
            for batch in batches:
                row, others, counts = _entries(batch)
                here, right = classes[batch.column("symbol").to_numpy()], others >= 0
                left = ~right & ((others >= -m) | (others == -1 - m - ENDING_CLASSES))
                table += np.bincount(here[row[right]] * n_classes + classes[others[right]], counts[right], len(table))
                table += np.bincount(classes[-1 - others[left]] * n_classes + here[row[left]], counts[left], len(table))
                table += np.bincount(here * n_classes + here, batch.column("own").to_numpy(), len(table))
            yield _table_rows(table, n_classes)

        return _gathered(placed.mapInArrow(add, "a long, b long, n long"), n_classes)

    def exchange(self, classes: np.ndarray, table: np.ndarray, n_free: int) -> tuple[DataFrame, np.ndarray]:
        """(symbols, table) after rounds in which all these words move at once, judged in tasks, until few do.

        They take a class each first. ``table`` counts all pairs with these words by their endings.
        """
        n_classes = n_free + ENDING_CLASSES + 1
        first_free = self.m + ENDING_CLASSES + 1
        symbols, has_classes = self.endings(), False
        placed = self.placed(symbols)
        fixed = table - self.table(placed, classes, n_classes)
        while True:
            shared = placed.sparkSession.sparkContext.broadcast((classes, table))

            def move(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                classes, table = shared.value
                for batch in batches:
                    left, right = _sums(batch, classes, n_classes)
                    here = classes[batch.column("symbol").to_numpy()]
                    best = best_classes(table, here, left, right, batch.column("own").to_numpy().astype(float), n_free)
                    yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array((first_free + best).astype(np.int32)), pa.array(best != here)], names=["word", "symbol", "moved"])

            moved = cut_lineage(placed.mapInArrow(move, "word binary, symbol int, moved boolean"), "rare_symbols")
            share = moved.agg(F.avg(F.col("moved").cast("int"))).first()[0]
            if share < SETTLED:
                break
            changed = moved.drop("moved")
            new_placed = self.placed(changed)
            new = fixed + self.table(new_placed, classes, n_classes)
            if has_classes and worth(new) <= worth(table):
                drop_stored(new_placed)
                break
            drop_stored(placed)
            if has_classes:
                drop_stored(symbols)
            symbols, placed, table, has_classes = changed, new_placed, new, True
        drop_stored(placed)
        return symbols, table


def moved_table(moving: DataFrame, classes: np.ndarray, changed: np.ndarray, n_classes: int) -> np.ndarray:
    """What the counts of class pairs gain when words move that are all among those given: pairs of two such words count once."""
    shared = moving.sparkSession.sparkContext.broadcast((classes, changed))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = shared.value
        table = np.zeros(n_classes * n_classes)
        for batch in batches:
            row, others, counts = _entries(batch)
            words = batch.column("word").to_numpy()
            moves = (old[words] != new[words])[row]
            word, others, counts = words[row[moves]], others[moves], counts[moves]
            right = others >= 0
            before = np.where(right, 0, -1 - others)
            left = ~right & (old[before] == new[before])
            for sign, of in ((1, new), (-1, old)):
                table += sign * np.bincount(of[word[right]] * n_classes + of[others[right]], counts[right], len(table))
                table += sign * np.bincount(of[-1 - others[left]] * n_classes + of[word[left]], counts[left], len(table))
        yield _table_rows(table, n_classes)

    return _gathered(moving.mapInArrow(add, "a long, b long, n long"), n_classes)


def _table_rows(table: np.ndarray, n_classes: int) -> pa.RecordBatch:
    at = np.flatnonzero(table)
    return pa.RecordBatch.from_arrays([pa.array(at // n_classes), pa.array(at % n_classes), pa.array(table[at].astype(np.int64))], names=["a", "b", "n"])


def _gathered(parts: DataFrame, n_classes: int) -> np.ndarray:
    table = np.zeros((n_classes, n_classes))
    for r in add_up(parts).collect():
        table[r["a"], r["b"]] = r["n"]
    return table


@dataclass
class Model:
    """Word classes, transitions between classes, and what the words of the vocabulary need for their scores."""

    numbers: dict[bytes, int]
    counts: np.ndarray  # of the vocabulary's words
    classes: np.ndarray  # of the vocabulary's words, then for each ending the one that a word without a class counts as
    transitions: np.ndarray  # from a class to a class, over the tokens of the latter
    spread: np.ndarray  # per class and ending, the counts set aside for unknown words: DISCOUNT for each of its distinct words
    tokens: int
    distinct: int
    start: int

    @property
    def unknown(self) -> np.ndarray:
        """Per class, the counts set aside for unknown words."""
        return self.spread.sum(axis=1)

    def base(self, count: np.ndarray | float) -> np.ndarray | float:
        return (count + 1) / (self.tokens + self.distinct + 1)

    def word(self, transition: np.ndarray, count: np.ndarray, of_class: np.ndarray, unknown: np.ndarray | None = None) -> np.ndarray:
        """Probability of a known token: class transition times emission, mixed with the smoothed share of the token."""
        kept = (self.unknown if unknown is None else unknown)[of_class] > 0
        return CLASS_WEIGHT * transition * (count - DISCOUNT * kept) + (1 - CLASS_WEIGHT) * self.base(count)


def train(texts: DataFrame, vocabulary: int = VOCABULARY, clustered: int | None = None, n_free: int = CLASSES, rounds: int | None = None) -> tuple[Model, DataFrame]:
    """(model, counts) of all texts; ``counts(word, n, class)`` has all tokens, their class where the model doesn't hold it.

    Every word takes part in the exchange: those of the vocabulary by number, their classes in a bounded array, and then all
    others, their classes in a joined table. Both end when few words move. With ``clustered`` only so many words of the vocabulary do, and all others belong to a class by their ending.
    """
    counts = cut_lineage(count_tokens(texts), "tokens")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    words = frequent(counts, vocabulary)
    m = len(words) if clustered is None else min(clustered, len(words))
    numbered = [w for w, _ in words[:m]]
    pairs = cut_lineage(count_pairs(texts, numbered), "pairs")
    seen = store_contexts(contexts(pairs))
    classes, table = exchange(seen, m, n_free, rounds)
    drop_stored(seen)
    if clustered is None and total["v"] > m:
        symbols, table = RareWords.of(pairs, m).exchange(classes, table, n_free)
        counts = cut_lineage(counts.join(symbols.select("word", (F.col("symbol") - m - ENDING_CLASSES - 1).alias("class")), "word", "left"), "classes")
    else:
        counts = counts.withColumn("class", F.lit(None).cast("int"))
    of_class = table.sum(axis=0)
    share = (of_class + 1) / (of_class.sum() + len(of_class))
    transitions = (table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR) / np.maximum(of_class, 1)
    endings = np.array([ending_class(w) for w, _ in words], np.int64)
    held = np.concatenate([classes[:m], n_free + endings[m:]])
    distinct = np.zeros((len(of_class), ENDING_CLASSES))
    np.add.at(distinct, (held, endings), 1)
    others = counts.groupBy(F.coalesce("class", F.lit(-1)).alias("class"), ending_of("word").alias("ending")).agg(F.count("*").alias("v")).collect()
    for r in others:
        distinct[r["class"] if r["class"] >= 0 else n_free + r["ending"], r["ending"]] += r["v"]
    each, numbered_endings = np.arange(ENDING_CLASSES), np.bincount(endings, minlength=ENDING_CLASSES)
    distinct[n_free + each, each] -= numbered_endings  # counted as without a class just now, but the vocabulary holds them
    stays = (distinct[n_free + each, each] > 0) | (distinct[:n_free].sum(axis=0) == 0)
    counts_as = np.where(stays, n_free + each, distinct[:n_free].argmax(axis=0))
    model = Model({w: i for i, (w, _) in enumerate(words)}, np.array([n for _, n in words], float), np.concatenate([held, counts_as]), transitions,
                  DISCOUNT * distinct, total["n"], total["v"], n_free + ENDING_CLASSES)
    return model, counts


SCORED = ("slot long, n_tokens long, n_known long, base double, score double, "
          "rare array<binary>, before array<int>, next array<int>, next_n array<double>")


def score_texts(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """(id, trained, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of every whole text.

    ``trains`` picks the rows to learn from. A token's probability is CLASS_WEIGHT * P(class | class before) *
    P(word | class) plus the rest times (count + 1) / (tokens + distinct + 1); ``base_score`` is the latter alone.
    In every class DISCOUNT of each word's count is set aside for unknown words of that word's ending.
    The vocabulary of bounded size is broadcast; tokens outside it are joined with their counts and classes, so that every
    count is exact, and scored together with the tokens that follow them.

    Null text is empty: the end only. Ids may be null or repeated; every row is scored. Without training rows the counts
    are 0 and every token is unknown.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model, counts = train(docs.where(trains).select(text_bytes(text_col).alias("text")), **sizes)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        number, v, kept = model.numbers.get, len(model.counts), model.unknown
        counts, held = np.append(model.counts, 0), np.append(model.classes[:v], -1)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = tokens(text)
                at = np.array([number(w, v) for w in words])
                n, classes, known = counts[at], held[at], at < v
                before = np.concatenate([[model.start], classes[:-1]])
                rare = np.flatnonzero(~known)
                after = np.minimum(rare + 1, len(words) - 1)
                c, b = classes[known & (before >= 0)], before[known & (before >= 0)]
                rows.append((len(words), int(known.sum()), float(np.log10(model.base(n[known])).sum()),
                             float(np.log10(model.word(model.transitions[b, c], n[known & (before >= 0)], c, kept)).sum()),
                             [words[i] for i in rare.tolist()], before[rare].astype(np.int32), np.where(after > rare, classes[after], -1).astype(np.int32), n[after]))
            columns = list(zip(*rows)) or [[]] * 8
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("trained"), batch.column("slot"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["id", "trained", "slot", "n_tokens", "n_known", "base", "score", "rare", "before", "next", "next_n"])

    def score_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        v, kept, unknown = len(model.counts), model.unknown, model.transitions @ model.spread
        for batch in batches:
            found, offsets = batch.column("found"), batch.column("found").offsets.to_numpy()
            flat = found.values.slice(offsets[0], offsets[-1] - offsets[0])
            before, after, next_n, n, given, ending = (flat.field(c).fill_null(-1).to_numpy() for c in ("before", "next", "next_n", "n", "class", "ending"))
            classes = np.where(given >= 0, given, model.classes[v + ending])
            before = np.where(before >= 0, before, np.concatenate([[-1], classes])[:-1])
            known, n = n > 0, np.maximum(n, 0)
            base = model.base(n)
            p = np.where(known, model.word(model.transitions[before, classes], n, classes, kept), CLASS_WEIGHT * unknown[before, ending] + (1 - CLASS_WEIGHT) * base)
            p_next = np.where(after >= 0, model.word(model.transitions[classes, after], next_n, after, kept), 1)
            row = np.repeat(np.arange(len(found)), np.diff(offsets))
            sums = [np.bincount(row, x, len(found)) for x in (known, np.log10(base), np.log10(p) + np.log10(p_next))]
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["slot", "known", "rare_base", "rare_score"])

    rows = docs.select(F.col(id_col).alias("id"), trains.alias("trained"), F.monotonically_increasing_id().alias("slot"), text_bytes(text_col).alias("text"))
    scored = cut_lineage(rows.mapInArrow(score, f"id {kind}, trained boolean, {SCORED}"), "scores")
    rare = scored.select("slot", F.posexplode(F.arrays_zip("rare", "before", "next", "next_n")).alias("at", "x")).select("slot", "at", "x.*")
    joined = rare.join(counts.withColumnRenamed("word", "rare"), "rare", "left").withColumn("ending", ending_of("rare"))
    found = joined.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("at", "before", "next", "next_n", "n", "class", "ending"))).alias("found"))
    added = found.mapInArrow(score_rare, "slot long, known long, rare_base double, rare_score double")
    return scored.join(added, "slot", "left").select(
        "id", "trained", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))


def perplexity(score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)
