"""Exact largest inner products, pruned by segment means and deviations from coarse to fine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkledger.llm.common import bounded_batches, cut_lineage

SCALE = 256
LONGEST = (1 << 63) - 1  # stands for every score of that size or more until the end
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 1024
DENSE = 1 / 16  # of a block's pairs; where more are left, one product of matrices is cheaper than the pairs one by one
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): every component as floor(256 * x); vectors that are null or hold null, NaN or infinity are left out.

    A component that does not fit a long after scaling is an error.
    """
    x = F.col(vector_col)
    usable = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    beyond = F.raise_error(F.lit(f"a component times {SCALE} does not fit a long")).cast("long")
    scaled = F.transform(x, lambda e: F.when(F.abs(e.cast("double") * SCALE) < float(1 << 63), F.floor(e.cast("double") * SCALE).cast("long")).otherwise(beyond))
    return rows.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"))


def segment_levels(matrix: np.ndarray) -> list[np.ndarray]:
    """Per level (1, 2, 4, ... segments) means and deviations, scaled so that a product of two rows is an upper bound
    of the inner product: over a segment of width w it is at most w * (mean * mean + deviation * deviation)."""
    levels, segments, width = [], 1, matrix.shape[1]
    while segments * 4 <= max(width, 4):
        edges = np.linspace(0, width, segments + 1).astype(int)
        w = np.diff(edges).astype(float)
        means = np.add.reduceat(matrix, edges[:-1], axis=1) / w if width else np.zeros((len(matrix), 1))
        centred = matrix - np.repeat(means, np.diff(edges), axis=1)
        deviations = np.sqrt(np.add.reduceat(centred * centred, edges[:-1], axis=1) / w) if width else means
        levels.append(np.hstack([means * np.sqrt(w), deviations * np.sqrt(w)]))
        segments *= 2
    return levels


def with_slack(vectors: np.ndarray) -> list[np.ndarray]:
    """The levels with a column more, by which a product of two rows grows by 1e-9 of both lengths, for rounding."""
    matrix = vectors.astype(float)
    more = np.sqrt(1e-9) * np.linalg.norm(matrix, axis=1, keepdims=True)
    return [np.hstack([level, more]) for level in segment_levels(matrix)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products as whole numbers; those beyond a long are ``LONGEST`` or its negative."""
    out = np.einsum("ij,ij->i", a, b)
    most = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] >= 1 << 62:
        for i in np.flatnonzero(np.einsum("ij,ij->i", np.abs(a).astype(float), np.abs(b).astype(float)) >= float(1 << 62)):
            product = sum(x * y for x, y in zip(a[i].tolist(), b[i].tolist()))
            out[i] = max(-LONGEST, min(LONGEST, product))
    return out


def exact_as_doubles(a: np.ndarray, b: np.ndarray) -> bool:
    """Are the inner products of all rows, and every sum on the way, whole numbers that a double holds exactly."""
    most = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (a, b)]
    return most[0] * most[1] * a.shape[1] <= 1 << 53


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    return np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), -np.inf)


class Search:
    """The best ``k`` candidates so far of every query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = with_slack(vectors)
        self.best = np.empty((0, 3), np.int64)
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take a block of candidates: lower bounds of the distance prune pairs level by level, survivors get exact scores.

        The squared distance is |q|^2 + |c|^2 - 2 q.c, so its lower bound and an upper bound of q.c prune alike; the
        latter is compared with the k-th best score, with slack for rounding by the lengths of both. Equal scores survive, for ties.
        While many pairs of a block are left, bounds and exact scores are taken as products of matrices; what is pruned is the same.
        """
        candidates = with_slack(vectors)
        bound = self.levels[0] @ candidates[0].T
        slack = 1e-3
        floor = self.least
        if not np.isfinite(floor).all() and len(ids) >= self.k + 1:  # a first threshold: exact scores of the k + 1 most promising
            top = np.argpartition(-bound, self.k, axis=1)[:, :self.k + 1]
            q = np.repeat(np.arange(len(self.ids)), self.k + 1)
            scores = exact_products(self.vectors[q], vectors[top.ravel()]).astype(float)
            scores[self.ids[q] == ids[top.ravel()]] = -np.inf
            floor = np.maximum(floor, kth_best(scores.reshape(len(self.ids), -1), self.k))
        left = (bound >= floor[:, None] - slack) & (self.ids[:, None] != ids[None, :])
        for mine, theirs in zip(self.levels[1:], candidates[1:]):
            if np.count_nonzero(left) > left.size * DENSE:
                left &= mine @ theirs.T >= floor[:, None] - slack
            else:
                q, c = np.nonzero(left)
                left[q, c] = np.einsum("ij,ij->i", mine[q], theirs[c]) >= floor[q] - slack
        q, c = np.nonzero(left)
        if len(q) > left.size * DENSE and exact_as_doubles(self.vectors, vectors):
            block = self.vectors.astype(float) @ vectors.astype(float).T
            q, c = np.nonzero(left & (block >= floor[:, None]))
            scores = block[q, c].astype(np.int64)
        else:
            scores = exact_products(self.vectors[q], vectors[c])
        keep = scores >= floor[q]
        found = np.column_stack([q[keep], ids[c[keep]], scores[keep]])
        self.best = np.vstack([self.best, found])
        order = np.lexsort((self.best[:, 1], -self.best[:, 2], self.best[:, 0]))
        self.best = self.best[order]
        first = np.searchsorted(self.best[:, 0], self.best[:, 0])
        self.best = self.best[np.arange(len(self.best)) - first < self.k]
        last = self.best[np.arange(len(self.best)) - np.searchsorted(self.best[:, 0], self.best[:, 0]) == self.k - 1]
        self.least[last[:, 0]] = last[:, 2]


def _matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` largest inner products among all other candidates.

    Both frames have (vec_id, v) of :func:`integer_vectors`. Queries go in blocks of ``query_block``, each broadcast and
    searched against all candidates where they are read; a task keeps ``k`` rows per query and the last step ranks
    those. Ties go to the smaller vec_id. A row with the query's own id is no candidate; rows that repeat an id are
    ranked each. Vectors of different length compare as if the shorter were filled up with zeros. Without candidates or
    queries the result is empty. Scores are exact; one among the results that does not fit a long is an error.
    """
    spark = candidates.sparkSession
    bounded_batches(spark)
    n = queries.count()
    blocks = max(1, -(-n // query_block))
    numbered = queries.distinct() if blocks == 1 else cut_lineage(queries.distinct(), "queries")
    parts = []
    for block in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        width = max(len(r["v"]) for r in rows)
        shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], np.int64), _matrix([r["v"] for r in rows], width)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            state: Search | None = None
            for batch in batches:
                for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
                    part = batch.slice(at, CANDIDATE_BLOCK)
                    theirs = part.column("v").to_pylist()
                    width = max([vectors.shape[1], *map(len, theirs)])
                    if state is None or state.vectors.shape[1] < width:
                        wider = Search(ids, _matrix(vectors.tolist(), width), k)
                        if state is not None:
                            wider.best, wider.least = state.best, state.least
                        state = wider
                    state.add(part.column("vec_id").to_numpy(), _matrix(theirs, state.vectors.shape[1]))
            if state is not None:
                best = state.best
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[:, 0]]), pa.array(best[:, 1]), pa.array(best[:, 2])], names=["query_id", "vec_id", "score"])

        parts.append(candidates.mapInArrow(search, FOUND))
    found = parts[0] if parts else spark.createDataFrame([], FOUND)
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    beyond = F.raise_error(F.lit("a score does not fit a long")).cast("long")
    score = F.when(F.col("score").between(-LONGEST + 1, LONGEST - 1), F.col("score")).otherwise(beyond)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
