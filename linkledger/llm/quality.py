"""Quality of documents by votes of their nearest labelled neighbours in a latent-semantic space."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.llm.common import bounded_batches, keyed, text_bytes

WORD_TERMS, SHAPE_TERMS, MEASURE_TERMS = 4096, 1024, 64
TERMS = WORD_TERMS + SHAPE_TERMS + MEASURE_TERMS
#: Bytes of a word's shape: letters become x or X, digits 9, signs stay themselves.
SHAPE = bytes(120 if b >= 128 or 97 <= b <= 122 else 88 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b for b in range(256))
NO_SIGNS = bytes(b for b in range(256) if SHAPE[b] in b"xX9 \n")
NO_CAPITALS = bytes(b for b in range(256) if SHAPE[b] != 88)
RUN = re.compile(rb"(.)\1+", re.S)
MEASURE_WEIGHT = 3.0
SAMPLE_PER_LABEL = 1000
SAMPLE_TEXT_BYTES = 1 << 16
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 4


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers, weights) of a whole text: hashed words, word shapes with runs shortened, and measured traits.

    A weight is 1 + ln(count), over the norm of its kind, so that long and short texts compare.
    """
    words = text.lower().split()
    counts = Counter(words)
    shapes: Counter = Counter()
    for shape, n in Counter(text.translate(SHAPE).split()).items():
        shapes[RUN.sub(rb"\1", shape[:64])] += n
    n = len(words)
    repeats = sum(map(eq, words, words[1:]))
    shares = (len(counts) / n, repeats / n, sum(map(len, words)) / n / 16) if n else (0.0, 0.0, 0.0)
    signs, capitals = (len(text.translate(None, others)) / max(1, len(text)) for others in (NO_SIGNS, NO_CAPITALS))
    measures = [min(7, int(8 * x)) + 8 * i for i, x in enumerate((*shares, 4 * signs, 2 * capitals))]
    measures.append(40 + min(15, n.bit_length()))
    numbers = [
        np.fromiter((zlib.crc32(w) % WORD_TERMS for w in counts), np.int64, len(counts)),
        np.fromiter((WORD_TERMS + zlib.crc32(s) % SHAPE_TERMS for s in shapes), np.int64, len(shapes)),
        np.array(measures) + WORD_TERMS + SHAPE_TERMS,
    ]
    weights = [1 + np.log(np.fromiter(c.values(), float, len(c))) for c in (counts, shapes)] + [np.full(len(measures), MEASURE_WEIGHT / np.sqrt(len(measures)))]
    for w in weights[:2]:
        w /= np.sqrt((w * w).sum()) or 1
    return np.concatenate(numbers), np.concatenate(weights)


class Space:
    """A latent-semantic space of labelled rows, and the rows' unit vectors and labels."""

    def __init__(self, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.axes, self.vectors, self.labels = axes, vectors, labels

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], dimensions: int) -> Space:
        """Terms weighted by rarity, and the largest singular directions of the rows' matrix."""
        matrix = np.zeros((len(rows), TERMS), np.float32)
        for i, (number, weight) in enumerate(rows):
            np.add.at(matrix[i], number, weight)
        held = np.count_nonzero(matrix, axis=0)
        idf = np.log((1 + len(rows)) / (1 + held)).astype(np.float32) + np.float32(0.1)
        matrix *= idf
        values, vectors = np.linalg.eigh((matrix @ matrix.T).astype(float))
        top = np.argsort(values)[::-1][:dimensions]
        top = top[values[top] > 1e-6 * max(values.max(initial=0), 1e-12)]
        axes = (matrix.T @ vectors[:, top].astype(np.float32)) / np.sqrt(values[top]).astype(np.float32)
        return cls(axes * idf[:, None], cls.unit(matrix @ axes), np.array(labels, float))

    @staticmethod
    def unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return self.unit(np.stack([w.astype(np.float32) @ self.axes[n] for n, w in rows]))

    def vote(self, rows: list[tuple[np.ndarray, np.ndarray]], neighbours: int, sharpness: int) -> np.ndarray:
        """Mean label of the nearest rows, weighted by a power of the cosine; the mean of all labels where no row is near."""
        cosines = self.project(rows) @ self.vectors.T
        k = min(neighbours, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(float) ** sharpness
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 0, votes / np.maximum(total, 1e-12), self.labels.mean()).clip(0, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, trains: Column, label: str, id_col: str = "doc_id", text_col: str = "text",
                    per_label: int = SAMPLE_PER_LABEL, text_bytes_bound: int = SAMPLE_TEXT_BYTES) -> DataFrame:
    """(id, text, label): up to ``per_label`` rows of each label, the same rows for the same input.

    The bound is a parameter, and the sample fits the model only; texts above ``text_bytes_bound`` are passed over here.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & trains).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label).alias("label"))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).where(F.length("text") <= text_bytes_bound)
    # Rank by a hash of the id before texts are fetched: only about the sample is joined with texts.
    ranked = [known.where(F.col("label") == v).orderBy(F.xxhash64("label_id"), "label_id").limit(2 * per_label) for v in (0, 1)]
    found = texts.join(F.broadcast(ranked[0].union(ranked[1])), F.col("id") == F.col("label_id")).select("id", "text", "label")
    # A row that repeats an id could crowd out others: one text per id.
    found = found.groupBy("id", "label").agg(F.max("text").alias("text"))
    picked = [found.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(per_label) for v in (0, 1)]
    return picked[0].union(picked[1])


def fit(sample: DataFrame, dimensions: int = DIMENSIONS) -> Space | None:
    """The space of a bounded sample, made in one task, which sends its axes and vectors; None without labelled rows."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("label"), pa.array([n for n, _ in rows], pa.list_(pa.int64())), pa.array([w for _, w in rows], pa.list_(pa.float64()))],
                names=["place", "label", "numbers", "weights"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            rows += [(n.values.to_numpy(), w.values.to_numpy()) for n, w in zip(batch.column("numbers"), batch.column("weights"))]
            labels += batch.column("label").to_pylist()
        if rows:
            space = Space.of(rows, labels, dimensions)
            parts = (space.axes, space.vectors, space.labels)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in parts], names=["axes", "vectors", "labels"])

    given = sample.select(F.xxhash64("id").alias("place"), F.col("label").cast("int").alias("label"), "text")
    rows = given.mapInArrow(read, "place long, label int, numbers array<long>, weights array<double>")
    found = rows.repartition(1).sortWithinPartitions("place", "label").mapInArrow(make, "axes binary, vectors binary, labels binary").first()
    if found is None:
        return None
    axes, vectors, labels = (np.frombuffer(bytes(x), "<f4") for x in found)
    return Space(axes.reshape(TERMS, -1), vectors.reshape(len(labels), -1), labels.astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, trains: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                  per_label: int = SAMPLE_PER_LABEL, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS, sharpness: int = SHARPNESS) -> DataFrame:
    """(row, id, text, score): for each whole text the share of label 1 among its nearest labelled rows, by similarity.

    ``trains`` picks the label rows to learn from. The labelled vectors are a bounded sample (``per_label`` of each
    label) and are broadcast; every document is compared with all of them in blocks of one matrix product, where it is
    read, so nothing is shuffled.

    Null text is empty; an empty text is scored by its measured traits like any other. Without labelled rows every
    score is 0.5. Label rows with null id or another label than 0 and 1 teach nothing; of repeated ids the larger label holds.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, trains, label, id_col, text_col, per_label), dimensions))
    packed = keyed(docs, id_col, text_col).withColumn("score", F.lit(0.5))
    schema = packed.schema

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            if space is not None and batch.num_rows:
                scores = space.vote([terms(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()], neighbours, sharpness)
                batch = batch.set_column(batch.schema.get_field_index("score"), batch.schema.field("score"), pa.array(scores, pa.float64()))
            yield batch

    return packed.mapInArrow(vote, schema)
