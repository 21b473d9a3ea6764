"""Words of documents that repeat benchmark items, found by one Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.llm.common import bounded_batches, cut_lineage, keyed, text_bytes

#: Bytes kept in words: digits, letters and all beyond ASCII; A-Z become a-z, everything else a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
AUTOMATON_BYTES = 16 << 20
_built: dict[int, tuple[ahocorasick.Automaton, list[list[int]]]] = {}


def normalised(text: bytes) -> bytes:
    """Words separated and surrounded by single spaces; empty without words."""
    words = text.translate(WORD_BYTES).split()
    return b" " + b" ".join(words) + b" " if words else b""


def item_windows(text: bytes, window: int) -> set[bytes]:
    """Every run of ``window`` words, or the whole text if it has fewer."""
    words = text.translate(WORD_BYTES).split()
    if not words:
        return set()
    return {b" " + b" ".join(words[i:i + window]) + b" " for i in range(max(1, len(words) - window + 1))}


def build_automaton(windows: dict[bytes, list[int]]) -> ahocorasick.Automaton:
    """Finds windows in Latin-1 views of normalised bytes; a hit gives (number of words, item numbers)."""
    automaton = ahocorasick.Automaton()
    for window, items in windows.items():
        automaton.add_word(window.decode("latin-1"), (window.count(b" ") - 1, items))
    automaton.make_automaton()
    return automaton


def scan(text: bytes, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words, hit word ranges from-to merged and in order, items) of one whole text, read once."""
    view = normalised(text)
    if not view:
        return 0, [], set()
    n_words = view.count(b" ") - 1
    found = list(automaton.iter(view.decode("latin-1"))) if len(automaton) else []
    if not found:
        return n_words, [], set()
    spaces = np.flatnonzero(np.frombuffer(view, np.uint8) == 32)
    stops = np.searchsorted(spaces, [end for end, _ in found]).tolist()
    items = {i for _, (_, numbers) in found for i in numbers}
    ranges: list[tuple[int, int]] = []
    for start, stop in sorted((stop - n, stop) for stop, (_, (n, _)) in zip(stops, found)):
        if ranges and start <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(stop, ranges[-1][1]))
        else:
            ranges.append((start, stop))
    return n_words, ranges, items


def _blocks(items: DataFrame, budget: int) -> list[DataFrame]:
    """The items in blocks whose windows take about ``budget`` bytes: one block unless the item table is large."""
    size = items.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0] * 12
    blocks = max(1, -(-size // budget))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    return [items.where(block == i) for i in range(blocks)] if blocks > 1 else [items]


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", window: int = 10, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(row, id, text, n_words, hits, items): word ranges ``hits`` (start, stop) and the item ids whose windows occur.

    The windows of all items make one automaton, which is broadcast; its size is bounded by ``automaton_bytes``. A larger
    item table is taken in blocks of that size, one pass over the documents each, so no item is left out. Documents are
    scanned where they are read, without a shuffle. A single item text above the bound makes a block of its own.

    Null or empty texts have no words and no hits; an item without words has no window; a null item id is listed as
    ``null``. An item of fewer words than ``window`` is one window. Rows that repeat a document or an item change nothing.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), text_bytes(item_text_col).alias("text"))
    out = keyed(docs, id_col, text_col).withColumns({
        "n_words": F.lit(0).cast("long"), "hits": F.lit(None).cast("array<struct<start:int,stop:int>>"), "items": F.lit(None).cast("array<string>")})
    blocks = _blocks(known, automaton_bytes)
    for block in blocks:
        names: list[str] = []
        windows: dict[bytes, list[int]] = {}
        for row in block.distinct().toLocalIterator():
            for w in item_windows(bytes(row["text"]), window):
                windows.setdefault(w, []).append(len(names))
            names.append(row["item"])
        shared = spark.sparkContext.broadcast((names, windows))
        schema = out.schema

        def scan_batches(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, windows = shared.value
            if id(windows) not in _built:
                _built.clear()
                _built[id(windows)] = (build_automaton(windows), windows)
            automaton = _built[id(windows)][0]
            for batch in batches:
                at = batch.schema.get_field_index
                counts, hits, found = [], [], []
                for text, old, old_items in zip(batch.column("text").cast(pa.binary()), batch.column("hits"), batch.column("items")):
                    n, ranges, items = scan(text.as_py() or b"", automaton)
                    counts.append(n)
                    hits.append([*(old.as_py() or ()), *({"start": a, "stop": b} for a, b in ranges)])
                    found.append(sorted({*(old_items.as_py() or ()), *(names[i] for i in items)}))
                batch = batch.set_column(at("n_words"), batch.schema.field("n_words"), pa.array(counts, pa.int64()))
                batch = batch.set_column(at("hits"), batch.schema.field("hits"), pa.array(hits, batch.schema.field("hits").type))
                yield batch.set_column(at("items"), batch.schema.field("items"), pa.array(found, pa.string()) if not found else pa.array(found, batch.schema.field("items").type))

        out = out.mapInArrow(scan_batches, schema)
        if len(blocks) > 1:
            out = cut_lineage(out, "decontamination")
    return out


def word_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places (start, stop) of ranges of words in the original text, counted in characters; overlapping ranges are one."""
    merged: list[list[int]] = []
    for start, stop in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(stop, merged[-1][1])
        else:
            merged.append([start, stop])
    if not merged:
        return []
    word = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    # Bytes that begin a character, counted before each byte.
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    begins, ends = before[edges[::2]], before[edges[1::2]]
    return [(int(begins[a]), int(ends[b - 1])) for a, b in merged]


def with_spans(found: DataFrame) -> DataFrame:
    """The rows of :func:`find_items` with ``spans``, an array of (start, stop): where hit passages stand in the original text.

    Offsets count characters (code points) from 0, ``stop`` behind the last one, from the first letter of a passage's first
    word to the last of its last; passages that overlap or touch word by word are one span. Only texts with hits are looked at.
    Null and empty texts, and texts without hits, have an empty array.
    """
    bounded_batches(found.sparkSession)
    schema = found.withColumn("spans", F.lit(None).cast("array<struct<start:bigint,stop:bigint>>")).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for text, hits in zip(batch.column("text").cast(pa.binary()), batch.column("hits")):
                ranges = [(h["start"], h["stop"]) for h in hits.as_py() or ()]
                spans.append([{"start": a, "stop": b} for a, b in word_spans(text.as_py(), ranges)] if ranges else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "spans"])

    return found.mapInArrow(place, schema)


def hit_words(hits: str | Column = "hits") -> Column:
    """Number of distinct words in the ranges; ranges of several blocks may overlap."""
    ranges = F.array_sort(F.coalesce(F.col(hits) if isinstance(hits, str) else hits, F.array().cast("array<struct<start:int,stop:int>>")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        ranges, start,
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["stop"] - F.greatest(r["start"], s["end"]))).alias("n"), F.greatest(s["end"], r["stop"]).alias("end")),
        lambda s: s["n"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of any benchmark item occurs, with their own columns."""
    text_col = options.get("text_col", "text")
    clean = find_items(docs, benchmark, **options).where(F.size("items") == 0)
    return clean.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
