"""Passages that an earlier document holds: found by an FM-index per shard, removed from later documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkledger.llm.common import bounded_batches, cut_lineage, text_bytes
from linkledger.llm.fm_index import FMIndex

GRAM = 8
SHARD_WORDS = 200_000
PART_SEGMENTS = 2048
REMEMBERED_WORDS = 500_000
NO_ID = (1 << 63) - 1
_hashes: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = _hashes
    if len(known) > REMEMBERED_WORDS:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, 7)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def anchors(words: list[bytes], window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, first windows, last windows): every window of ``window`` words is assigned to one gram inside it.

    It is the leftmost gram with the least mixed hash, so equal windows get equal grams, wherever they stand.
    """
    n = len(words)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = word_hashes(words)
    factor, grams = np.uint64(0x9E3779B97F4A7C15), np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        grams = grams * factor + hashes[i:n - gram + 1 + i]
    mixed = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    span = window - gram + 1
    chosen = np.lib.stride_tricks.sliding_window_view(mixed, span).argmin(axis=1) + np.arange(n - window + 1)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [len(chosen)]]) - 1
    return grams[chosen[first]].view(np.int64), first, last


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, text): ids without null (a null is largest) and a hash that tells texts of one id apart."""
    data = text_bytes(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(data).alias("t"), data.alias("text"))


def _anchored(texts: DataFrame, window: int) -> DataFrame:
    """Per row: words, digest of all words, and its anchors."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, found = [], [], []
            for text in batch.column("text").to_pylist():
                words = text.split()
                counts.append(len(words))
                digests.append(digest(words))
                found.append(anchors(words, window))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(g) for g, _, _ in found])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[i] for f in found]).astype(kind)))
                     for i, kind in enumerate((np.int64, np.int32, np.int32))] if found else [pa.array([], pa.list_(k)) for k in (pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), *lists],
                                             names=["id", "t", "n_words", "digest", "grams", "first", "last"])

    return texts.mapInArrow(read, "id long, t long, n_words long, digest string, grams array<long>, first array<int>, last array<int>")


def _segments(candidates: DataFrame, window: int) -> DataFrame:
    """(gram, s1, s2, id, t, first, words): the words that an anchor's windows cover, in rows of candidate documents."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, t, text, places in zip(*(batch.column(c).to_pylist() for c in ("id", "t", "text", "places"))):
                words = text.split()
                for p in places:
                    covered = b" ".join(words[p["first"]:p["last"] + window])
                    rows.append((p["gram"], xxhash.xxh64_intdigest(covered, 1) - (1 << 63), xxhash.xxh64_intdigest(covered, 2) - (1 << 63), id_, t, p["first"], covered))
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.int32()), pa.array(columns[6], pa.binary())],
                names=["gram", "s1", "s2", "id", "t", "first", "words"])

    return candidates.mapInArrow(cut, "gram long, s1 long, s2 long, id long, t long, first int, words binary")


class Shard:
    """Segments of whole groups, until they are many enough for an index."""

    def __init__(self, window: int):
        self.window, self.held, self.asked, self.words = window, [], [], 0

    def add(self, held: list[tuple[int, bytes]], asked: list[tuple[int, int, int, bytes]]) -> None:
        self.held += held
        self.asked += asked
        self.words += sum(s.count(b" ") + 1 for _, s in held)

    def answers(self) -> list[tuple[int, int, int, list[int]]]:
        """(gram, s1, s2, least ids): per window of each asked segment the least id that holds it (NO_ID: none)."""
        if not self.asked or not self.held:
            return []
        symbols: dict[bytes, int] = {}
        sequences = [np.array([symbols.setdefault(w, len(symbols) + 1) for w in s.split()], np.int64) for _, s in self.held]
        index = FMIndex(sequences, [i for i, _ in self.held], len(symbols) + 1, self.window)
        _, owners = index.matching_statistics([np.array([symbols.get(w, 0) for w in s.split()], np.int64) for *_, s in self.asked])
        least = [np.where(o < 0, NO_ID, o)[:len(o) - self.window + 1].tolist() for o in owners]
        return [(gram, s1, s2, found) for (gram, s1, s2, _), found in zip(self.asked, least)]


def _least_ids(segments: DataFrame, window: int, shard_words: int, part_segments: int) -> DataFrame:
    """(gram, s1, s2, least): of each distinct segment, the least id that holds each of its windows.

    Segments of one gram meet in one shard, small groups together. A large group is dealt in parts by its least ids, and
    each part is streamed against the indexes of the parts up to it, each pair in a shard of its own.
    """
    distinct = segments.groupBy("gram", "s1", "s2").agg(F.min("id").alias("owner"), F.min("words").alias("words"))
    place = F.row_number().over(Window.partitionBy("gram").orderBy("owner", "s1", "s2"))
    parted = distinct.withColumn("part", F.floor((place - 1) / part_segments).cast("int"))
    last = parted.groupBy("gram").agg(F.max("part").alias("last")).where(F.col("last") > 0)
    both = parted.join(last, "gram", "left").withColumn("last", F.coalesce("last", F.lit(0)))
    # In the pair (p, q) with p <= q, part p is indexed and part q asked; a part is on either side of its own pair.
    pairs = both.select("gram", "s1", "s2", "owner", "words", "part", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")).select(
        "gram", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "owner", "s1", "s2", "words")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, group, rows = Shard(window), None, []

        def found(shard: Shard) -> pa.RecordBatch:
            columns = list(zip(*shard.answers())) or [[]] * 4
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.list_(pa.int64()))], names=["gram", "s1", "s2", "least"])

        def close() -> Iterator[pa.RecordBatch]:
            """Put the group that has ended into the shard, or into one of its own."""
            nonlocal shard
            if group is None:
                return
            gram, p, q = group
            held = [(owner, words) for part, owner, _, _, words in rows if part == p]
            asked = [(gram, s1, s2, words) for part, _, s1, s2, words in rows if part == q]
            if p != q:
                alone = Shard(window)
                alone.add(held, asked)
                yield found(alone)
                return
            shard.add(held, asked)
            if shard.words >= shard_words:
                yield found(shard)
                shard = Shard(window)

        for batch in batches:
            for gram, p, q, *row in zip(*(batch.column(c).to_pylist() for c in ("gram", "p", "q", "part", "owner", "s1", "s2", "words"))):
                if (gram, p, q) != group:
                    yield from close()
                    group, rows = (gram, p, q), []
                rows.append(row)
        yield from close()
        yield found(shard)

    dealt = pairs.repartition("gram", "p", "q").sortWithinPartitions("gram", "p", "q", "owner")
    answers = dealt.mapInArrow(search, "gram long, s1 long, s2 long, least array<long>")
    # A segment has an answer from every part up to its own.
    merged = F.reduce(F.collect_list("least"), F.first("least"), lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y)))
    return answers.groupBy("gram", "s1", "s2").agg(merged.alias("least"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, shard_words: int = SHARD_WORDS,
                   part_segments: int = PART_SEGMENTS) -> DataFrame:
    """(id, t, n_words, n_removed, digest, kept): texts without the words that a window of an earlier document covers.

    A window is ``window`` consecutive words of one row. Its words go if the same window is in a row with a smaller id;
    all windows are judged on the input. ``kept`` is null where nothing is removed (the text stays as it is), else the
    kept words joined by one space; ``digest`` is the SHA-256 of the kept words in either case.

    Each window is assigned to a gram of its words, chosen by its content, and only grams of several ids go on: their
    windows' words are indexed and searched in shards, by gram. So every equal pair of windows meets, in one shard, and
    no document is streamed against shards that cannot hold its windows. Matches are compared word by word.

    Null and empty texts have no words. Null ids come after all others and are no source for each other. Rows that
    repeat an id are no source for each other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = _texts(docs, id_col, text_col)
    anchored = cut_lineage(_anchored(texts, window), "anchors")
    places = anchored.select("id", "t", F.inline(F.arrays_zip("grams", "first", "last"))).withColumnRenamed("grams", "gram")
    shared = places.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high")).where(F.col("low") < F.col("high")).select("gram")
    wanted = places.join(shared, "gram").groupBy("id", "t").agg(F.collect_set(F.struct("gram", "first", "last")).alias("places"))
    candidates = cut_lineage(texts.join(wanted, ["id", "t"]), "candidates")
    segments = _segments(candidates, window)
    least = _least_ids(segments, window, shard_words, part_segments)
    early = (
        segments.drop("words").join(least, ["gram", "s1", "s2"])
        .where(F.array_min("least") < F.col("id"))
        .select("id", "t", F.filter(F.transform("least", lambda x, i: F.when(x < F.col("id"), F.col("first") + i)), lambda x: x.isNotNull()).alias("starts"))
        .groupBy("id", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, texts = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, np.asarray(starts) + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                removed.append(int(gone.sum()))
                digests.append(digest(kept))
                texts.append(b" ".join(kept).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                                             names=["id", "t", "n_removed", "new_digest", "kept"])

    changed = candidates.select("id", "t", "text").join(early, ["id", "t"]).mapInArrow(remove, "id long, t long, n_removed long, new_digest string, kept string")
    changed = changed.groupBy("id", "t").agg(F.max("n_removed").alias("n_removed"), F.max("new_digest").alias("new_digest"), F.max("kept").alias("kept"))
    whole = anchored.select("id", "t", "n_words", "digest")
    return whole.join(changed, ["id", "t"], "left").select(
        F.nullif("id", F.lit(NO_ID)).alias("id"), "t", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("new_digest", "digest").alias("digest"), "kept")
