"""Documents as tokens, cut and packed into sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkledger.llm.common import bounded_batches, cut_lineage, text_bytes

GROUP_PIECES = 1 << 17
END_ID = 2
TRIED_TEXTS = 8
#: Fixed value: how byte-level tokenizers of this family split text before merging.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies spell bytes: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def ranked(path: str) -> tiktoken.Encoding | None:
    """The same byte-level BPE in rank form, which is several times faster: ids must follow the order of merges. None for other kinds."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    splitter = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex") or spec.get("normalizer"):
        return None
    letters, special = byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    ids = [spec["model"]["vocab"].get(m.replace(" ", "")) for m in merges]
    if None in ids or ids != sorted(ids):
        return None
    ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Token ids of the tokenizer in a file, as 32-bit numbers.

    The rank form is used if it gives the same ids for the first texts; a text it cannot take goes to the tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer, self.fast, self.tried = Tokenizer.from_file(path), ranked(path), 0

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None:
            return self.plain(text)
        try:
            ids = np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), "<u4")
        except (ValueError, RuntimeError):
            return self.plain(text)
        if self.tried < TRIED_TEXTS:
            self.tried += 1
            if not np.array_equal(ids, self.plain(text)):
                raise ValueError("the rank form of the tokenizer gives other ids")
        return ids


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length): one piece, or for more than ``size`` tokens a shorter first piece and full ones after it."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(start, size) for start in range(first, n, size)]


PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, its ids closed by ``end_id``.

    Null text is empty: one piece with the end only. Ids may be null or repeated; every row is a document.
    ``tokenizer_path`` names a file that exists on every machine.
    """
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                ids = np.concatenate([encoder.encode(text.decode("utf-8", "replace")), end])
                for piece, (start, length) in enumerate(cut_pieces(len(ids), size)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start:start + length].tobytes())))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]],
                names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")).mapInArrow(cut, PIECES)


class SumOfSquares:
    """Open sequences by fill. A piece goes where the sum of squared counts per residual gap becomes smallest.

    A new sequence is opened only if the piece fits into no open one; ties go to the smallest gap.
    """

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)  # of open sequences, by fill; empty and full ones do not count
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to ``size`` tokens."""
        fits = self.size - length
        counts = self.counts
        # Moving a sequence from fill h to h + length changes the sum by 2 (1 + N(h + length) - N(h)); the full ones leave it.
        change = 2 * (counts[1 + length:] - counts[1:fits + 1]) + 2
        if fits >= 1:
            change[-1] = 1 - 2 * counts[fits]
            change[counts[1:fits + 1] == 0] = np.iinfo(np.int64).max
            best = int(change[::-1].argmin())
            fill = fits - best
            if counts[fill]:
                sequence = self.open[fill].pop()
                counts[fill] -= 1
                self._keep(sequence, fill + length)
                return sequence, fill
        sequence, self.made = self.made, self.made + 1
        self._keep(sequence, length)
        return sequence, 0

    def _keep(self, sequence: int, fill: int) -> None:
        if fill < self.size:
            self.open[fill].append(sequence)
            self.counts[fill] += 1


def pack(pieces: DataFrame, size: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: sequences of at most ``size`` tokens, without gaps.

    Full pieces are sequences of their own. The others are dealt at random into groups of about ``group_pieces``, one
    task each, which takes them from long to short; a group leaves a few sequences part filled, so large groups waste
    less. Rows are numbered before dealing, so equal rows spread like any others. An empty table gives an empty result.
    """
    stored = cut_lineage(pieces.withColumn("slot", F.monotonically_increasing_id()), "pieces")
    short = stored.where(F.col("length") < size)
    groups = max(1, -(-short.count() // group_pieces))
    schema = f"{PIECES}, sequence_id long, offset long"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, SumOfSquares(size)
        for batch in batches:
            sequences, offsets = [], []
            for g, length in zip(batch.column("group").to_pylist(), batch.column("length").to_pylist()):
                if g != group:
                    group, packer = g, SumOfSquares(size)
                sequence, offset = packer.place(length)
                sequences.append((g + 1) << 40 | sequence)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")], pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    dealt = short.withColumn("group", F.pmod(F.xxhash64("slot"), F.lit(groups))).repartition(groups, "group")
    packed = dealt.sortWithinPartitions("group", F.desc("length"), "slot").mapInArrow(fill, schema)
    full = stored.where(F.col("length") >= size).select(
        "id", "piece", "start", "length", "ids_crc32", (-F.col("slot") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = END_ID,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: its place in its document, the checksum of its ids, and its place in a sequence."""
    packed = pack(tokenised_pieces(docs, tokenizer_path, id_col, text_col, size, end_id), size, group_pieces)
    return packed.withColumnRenamed("id", "doc_id")
