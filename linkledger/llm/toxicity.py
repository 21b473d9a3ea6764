"""Toxicity of documents: a support vector machine over words, with a subsequence string kernel and Nyström landmarks."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.llm.common import bounded_batches, cut_lineage, keyed

#: Subsequences of ORDER characters that span at most SPAN; each character passed over weighs DECAY.
ORDER, SPAN, DECAY = 3, 5, 0.7
BUCKETS = 1 << 20
#: Longest piece that the kernel compares; longer words are read in overlapping windows of this many characters.
LONGEST, STEP = 24, 8
LANDMARKS = 448
#: Words of which copies with a strange character inside are learnt, too.
GAPPED, GAPPED_WEIGHT = 200, 1.0
SAMPLE_PER_LABEL = 4000
SAMPLE_SUSPECTS = 4096
SAMPLE_WORDS = 30_000
SAMPLE_FREQUENT = 5000
SAMPLE_HARD = 10_000
ROUNDS = 2
#: What a margin's shortfall costs against the length of the normal.
COST = 10.0
#: A word is taken for toxic at first if the logarithm of its odds, less one standard error, is this high.
CERTAIN = 3.0
CACHED_WORDS = 1 << 18
#: Words that decide about a text.
WITNESSES = 3
SENTENCE = re.compile(r"[.!?\n]+")
EDGES = (2, 3)
SPREAD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
GAPS = [(0, *inner) for inner in combinations(range(1, SPAN), ORDER - 1)]


def letters(token: str) -> str:
    """A token without its signs, so that marks set between letters do not hide a word."""
    return token if token.isalnum() else "".join(filter(str.isalnum, token))


def words(tokens: list[str]) -> Iterator[str]:
    """The words of a token: itself without signs, in overlapping windows if it is very long; and runs of single letters as one word."""
    run: list[str] = []
    for token in [*tokens, "--"]:
        word = letters(token)
        if len(word) == 1:
            run.append(word)
            continue
        if len(run) >= 3 and (word or token == "--"):
            yield from windows("".join(run))
        if word or token == "--":
            run = []
        if word:
            yield from windows(word)


def windows(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i:i + LONGEST] for i in range(0, len(word) - STEP, STEP)]


def _by_length(given: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, characters) of the words of each length, with a mark at both ends; characters as mixed 32-bit numbers."""
    places: dict[int, list[int]] = {}
    for i, word in enumerate(given):
        places.setdefault(len(word), []).append(i)
    for length, at in places.items():
        joined = "".join(given[i] for i in at).encode("utf-32-le", "surrogatepass")
        codes = np.empty((len(at), length + 2), np.uint32)
        codes[:, 0], codes[:, -1] = EDGES
        codes[:, 1:-1] = np.frombuffer(joined, "<u4").reshape(len(at), length)
        codes *= np.uint32(0x2545F491)
        codes ^= codes >> np.uint32(15)
        yield np.array(at), codes


def _subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(buckets, weight) of all subsequences of one shape."""
    mixed = [codes * m for m in SPREAD]
    length = codes.shape[1]
    for gaps in GAPS:
        n = length - gaps[-1]
        if n > 0:
            total = mixed[0][:, gaps[0]:gaps[0] + n]
            for m, g in zip(mixed[1:], gaps[1:]):
                total = total + m[:, g:g + n]
            total ^= total >> np.uint32(16)
            yield (total * np.uint32(0x27D4EB2F)) >> np.uint32(12), DECAY ** (gaps[-1] + 1 - ORDER)


def _norm(length: int) -> float:
    return float(np.sqrt(sum(max(0, length - g[-1]) * DECAY ** (2 * (g[-1] + 1 - ORDER)) for g in GAPS))) or 1.0


def word_margins(given: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """Margins of words: the landmarks' expansion, folded into one weight per subsequence, over the length's norm."""
    out = np.empty(len(given))
    for at, codes in _by_length(given):
        total = np.zeros(len(at))
        for buckets, weight in _subsequences(codes):
            total += weight * table[buckets].sum(axis=1)
        out[at] = total / _norm(codes.shape[1]) + bias
    return out


class Landmarks:
    """Kernel values against landmark words, and the Nyström map that they give."""

    def __init__(self, chosen: list[str]):
        numbers: dict[int, int] = {}
        rows, columns, weights = [], [], []
        for at, codes in _by_length(chosen):
            for buckets, weight in _subsequences(codes):
                rows += [numbers.setdefault(b, len(numbers) + 1) for b in buckets.ravel().tolist()]
                columns += np.repeat(at, buckets.shape[1]).tolist()
                weights += [weight / _norm(codes.shape[1])] * buckets.size
        self.number = np.zeros(BUCKETS, np.int32)
        self.number[list(numbers)] = list(numbers.values())
        self.held = np.zeros((len(numbers) + 1, len(chosen)), np.float32)
        np.add.at(self.held, (rows, columns), weights)
        values, vectors = np.linalg.eigh(self.kernel(chosen).astype(float))
        kept = values > 1e-4 * max(values.max(initial=0), 1e-12)
        self.map = vectors[:, kept] / np.sqrt(values[kept])

    def kernel(self, given: list[str]) -> np.ndarray:
        out = np.zeros((len(given), self.held.shape[1]), np.float32)
        for at, codes in _by_length(given):
            for buckets, weight in _subsequences(codes):
                numbers = self.number[buckets]
                for column in numbers.T:
                    met = np.flatnonzero(column)
                    out[at[met]] += np.float32(weight / _norm(codes.shape[1])) * self.held[column[met]]
        return out

    def features(self, given: list[str]) -> np.ndarray:
        return np.hstack([self.kernel(given) @ self.map, np.ones((len(given), 1))]).astype(np.float32)

    def folded(self, normal: np.ndarray) -> np.ndarray:
        """One weight per bucket: the sum over landmarks of their coefficient times their part of the subsequence."""
        return (self.held @ (self.map @ normal)).astype(np.float32)[self.number]


def support_vector_machine(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """The normal of least squared hinge loss, by Newton steps with halving; ``toxic`` and ``clean`` weigh the rows."""
    normal, at = np.zeros(z.shape[1]), np.zeros(len(z))

    def loss(f: np.ndarray, w: np.ndarray) -> float:
        return 0.5 * w @ w + 0.5 * ((toxic * np.maximum(0, 1 - f) ** 2).sum() + (clean * np.maximum(0, 1 + f) ** 2).sum())

    toxic, clean = toxic * COST, clean * COST
    least = loss(at, normal)
    for _ in range(60):
        up, down = toxic * (at < 1), clean * (at > -1)
        active = np.flatnonzero(up + down)
        part, weight = z[active], (up + down)[active].astype(np.float32)
        step = np.linalg.solve(((part.T * weight) @ part).astype(float) + np.eye(z.shape[1]), part.T.astype(float) @ (up - down)[active]) - normal
        along, size = z @ step, 1.0
        while (found := loss(at + size * along, normal + size * step)) >= least and size > 1e-3:
            size /= 2
        if least - found < 1e-5 * least:
            break
        normal, at, least = normal + size * step, at + size * along, found
    return normal


def gapped(word: str, pool: str) -> list[str]:
    """The word with one character more at each place inside: one from ``pool``, as common there as in clean texts, so that no character itself means anything, or a doubled one."""
    if not 4 <= len(word) < LONGEST or not pool:
        return []
    strange = [pool[zlib.crc32(f"{i} {word}".encode()) % len(pool)] for i in range(len(word))]
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in (strange[i], word[i - 1])]


def fit_words(given: list[str], toxic: np.ndarray, clean: np.ndarray, landmarks: int = LANDMARKS) -> tuple[np.ndarray, float]:
    """(table, bias) from words and how many sentences of toxic and of clean texts hold them; the last word is '' with all sentences.

    Which words make a toxic text toxic is not labelled. Words far too frequent in toxic texts start as toxic, words of
    clean texts as clean; others teach nothing. After each fit words hardly known from clean texts join the toxic ones if they lie
    far on their side, and leave them if they no longer do, until none moves.
    """
    every = given.index("")
    totals = toxic[every], clean[every]
    order = [i for i in range(len(given)) if i != every]
    given, toxic, clean = [given[i] for i in order], toxic[order].astype(float), clean[order].astype(float)
    if not given or not totals[0] or not totals[1]:
        return np.zeros(BUCKETS, np.float32), 0.0
    odds = np.log((toxic + 0.5) / totals[0]) - np.log((clean + 0.5) / totals[1])
    sure = odds - np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    certain = suspects = sure >= min(CERTAIN, 0.6 * sure.max())
    by_odds, rest = np.argsort(-sure, kind="stable"), np.flatnonzero(clean > 0)
    chosen = np.unique(np.concatenate([by_odds[:landmarks], rest[np.linspace(0, len(rest) - 1, landmarks).astype(int)] if len(rest) else rest]))
    pool = "".join(given[i] for i in rest)
    strange = [g for i in by_odds[:GAPPED // 2] if suspects[i] for g in gapped(given[i], pool)[::4]]
    marks = Landmarks([given[i] for i in chosen] + strange[:landmarks // 2])
    z = marks.features(given)
    may = (odds > 0) & (clean <= 0.1 * toxic)
    for _ in range(ROUNDS):
        made = [g for i in by_odds[:GAPPED] if suspects[i] for g in gapped(given[i], pool)]
        of = np.concatenate([z, marks.features(made)]) if made else z
        up = np.concatenate([np.where(suspects, 3 + 3 * np.log1p(toxic), 0), np.full(len(made), GAPPED_WEIGHT)])
        down = np.concatenate([np.where(suspects, 0, np.log1p(clean)), np.zeros(len(made))])
        normal = support_vector_machine(of, up, down)
        f = z @ normal
        now = certain | may & (f > 0.5)
        if (now == suspects).all():
            break
        suspects = now
    return marks.folded(normal[:-1]), float(normal[-1])


class Scorer:
    """The largest margins among the words of a text; margins of words met before are kept, a bounded number of them."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias, self.known, self.kind = table, bias, {}, {}

    def margins(self, texts: list[str]) -> list[list[float]]:
        """The ``WITNESSES`` largest of each text, falling; a missing word has the margin of no common subsequence, less one."""
        split = [text.lower().split() for text in texts]
        fresh = set().union(*split).difference(self.known)
        if fresh and len(self.known) > CACHED_WORDS:
            self.known.clear()
            self.kind.clear()
            fresh = set().union(*split)
        self._learn(sorted(fresh))
        return [self._largest(tokens) for tokens in split]

    def _largest(self, tokens: list[str]) -> list[float]:
        found = heapq.nlargest(WITNESSES, map(self.known.__getitem__, tokens))
        if "lll" in "".join(map(self.kind.__getitem__, tokens)):
            runs = list(self._runs(tokens))
            found = heapq.nlargest(WITNESSES, found + word_margins(runs, self.table, self.bias).tolist())
        return found + [self.bias - 1] * (WITNESSES - len(found))

    def _learn(self, tokens: list[str]) -> None:
        parts, of = [], []
        for i, token in enumerate(tokens):
            word = letters(token)
            self.kind[token] = "w" if len(word) > 1 else "l" if word else ""
            if word:
                found = windows(word)
                parts += found
                of += [i] * len(found)
        margins = np.full(len(tokens), self.bias - 1)
        if parts:
            np.maximum.at(margins, of, word_margins(parts, self.table, self.bias))
        self.known.update(zip(tokens, margins.tolist()))

    def _runs(self, tokens: list[str]) -> Iterator[str]:
        """Three or more single letters in a row as one word; signs between them do not count."""
        run: list[str] = []
        for token in tokens:
            if self.kind[token] == "w":
                if len(run) >= 3:
                    yield from windows("".join(run))
                run.clear()
            elif self.kind[token]:
                run.append(letters(token))
        if len(run) >= 3:
            yield from windows("".join(run))


def portions(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in order, in lists of about ``most`` characters, so that tokens of few texts are held at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def labelled_texts(docs: DataFrame, labels: DataFrame, trains: Column, label: str, id_col: str, text_col: str, per_label: int) -> DataFrame:
    """(text, label) of up to ``per_label`` documents of each label, the same for the same input, whole texts of any length."""
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).where("id IS NOT NULL").distinct()
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & trains).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    known = known.join(ids, "id", "left_semi")
    picked = [known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(per_label) for v in (0, 1)]
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked[0].union(picked[1])), "id").select("text", "label")


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many sentences of texts with label 1 and 0 a word stands; the empty word has all sentences."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[dict[str, int], dict[str, int]] = ({}, {})

        def spilled() -> Iterator[pa.RecordBatch]:
            for value, held in enumerate(counts):
                zeros = np.zeros(len(held), np.int64)
                n = np.fromiter(held.values(), np.int64, len(held))
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(n if value else zeros), pa.array(zeros if value else n)], names=["word", "toxic", "clean"])
                held.clear()

        for batch in batches:
            for text, value in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                held = counts[value]
                for sentence in SENTENCE.split(text.lower()):
                    tokens = sentence.split()
                    if tokens:
                        for word in {"", *words(tokens)}:
                            held[word] = held.get(word, 0) + 1
                if len(held) > CACHED_WORDS:
                    yield from spilled()
        yield from spilled()

    return sample.mapInArrow(fold, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(sample: DataFrame, landmarks: int = LANDMARKS) -> tuple[np.ndarray, float]:
    """The machine of a bounded sample: counts of all its words in Spark, a bounded choice of words in one task."""
    counts = cut_lineage(word_counts(sample), "words")
    suspicion = F.col("toxic") / (F.col("clean") + 1) * F.log1p("toxic")
    suspects = counts.where("toxic > 0 AND word <> ''").orderBy(F.desc(suspicion), "word").limit(SAMPLE_SUSPECTS)
    clean = counts.where("clean > 0 AND word <> ''").orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS)
    chosen = suspects.union(clean).union(counts.where("word = ''")).distinct()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        if any(row[0] == "" for row in rows):
            given, toxic, clean = zip(*rows)
            table, bias = fit_words(list(given), np.array(toxic), np.array(clean), landmarks)
            yield pa.RecordBatch.from_arrays([pa.array([table.astype("<f4").tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["table", "bias"])

    def fitted(rows: DataFrame) -> tuple[np.ndarray, float]:
        found = rows.repartition(1).sortWithinPartitions("word").mapInArrow(make, "table binary, bias double").first()
        return (np.frombuffer(bytes(found["table"]), "<f4"), found["bias"]) if found else (np.zeros(BUCKETS, np.float32), 0.0)

    shared = sample.sparkSession.sparkContext.broadcast(fitted(chosen))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("margin", pa.array(word_margins(batch.column("word").to_pylist(), *shared.value)))

    # Words of clean texts that the first machine takes for toxic teach the second.
    judged = counts.where("clean > 0 AND clean > toxic AND word <> ''").mapInArrow(judge, "word string, toxic long, clean long, margin double")
    hard = judged.orderBy(F.desc("margin"), "word").limit(SAMPLE_HARD).drop("margin")
    return fitted(chosen.union(hard).distinct())


def with_margins(texts: DataFrame, machine: tuple[np.ndarray, float]) -> DataFrame:
    """Fills the column ``margins`` from the column ``text``, where the rows are read."""
    shared = texts.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            found = [m for part in portions([t or "" for t in batch.column("text").to_pylist()]) for m in scorer.margins(part)]
            yield batch.set_column(batch.schema.get_field_index("margins"), batch.schema.field("margins"), pa.array(found, batch.schema.field("margins").type))

    return texts.mapInArrow(run, texts.schema)


def calibrate(rows: Iterable[tuple[list[float], int]]) -> list[float]:
    """Coefficients of a logistic curve over the margins, and its shift; zeros without both labels.

    Targets are Platt's. No coefficient is negative: a more toxic word never lowers a score.
    """
    given = list(rows)
    ones = np.array([label == 1 for _, label in given], bool)
    up, down = ones.sum(), (~ones).sum()
    if not up or not down:
        return [0.0] * (WITNESSES + 1)
    target, weight = np.where(ones, (up + 1) / (up + 2), 1 / (down + 2)), 1 / len(given)
    x = np.column_stack([[m for m, _ in given], np.ones(len(given))])
    w, fixed = np.zeros(WITNESSES + 1), np.zeros(WITNESSES + 1, bool)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        free = ~fixed
        xf = x[:, free]
        step = np.linalg.solve((xf.T * (weight * p * (1 - p))) @ xf + 1e-3 * np.eye(free.sum()), xf.T @ (weight * (p - target)) + 1e-3 * w[free])
        w[free] -= step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        below = np.append(w[:-1] < 0, False)
        fixed |= below
        w[below] = 0
        if not below.any() and np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def score_toxicity(docs: DataFrame, labels: DataFrame, trains: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
                   per_label: int = SAMPLE_PER_LABEL, landmarks: int = LANDMARKS) -> DataFrame:
    """(row, id, text, margins, score): how toxic each whole text is, between 0 and 1.

    Words, without signs inside, runs of single letters and windows of very long words are compared by their common
    subsequences of three characters within five, so that an insult with strange characters between its letters stays
    close to itself. A machine in the space that landmark words span tells toxic words from clean ones; it learns from
    sentences of labelled texts. A text is judged by
    its three most toxic words: a logistic curve turns their margins into a score.

    ``trains`` picks the label rows to learn from; the fit sees ``per_label`` documents of each label. The machine is one
    table of 4 MB, which is broadcast; texts are scored where they are read.

    Null text is empty; empty texts get the least margin. Without labelled rows of both kinds all scores are 0.5. Label rows with
    null id or another label than 0 and 1 teach nothing; of repeated ids the larger label holds. Repeated rows are scored alike.
    """
    bounded_batches(docs.sparkSession)
    sample = labelled_texts(docs, labels, trains, label, id_col, text_col, per_label)
    machine = fit(sample, landmarks)
    none = F.lit(None).cast("array<double>")
    weights = calibrate(map(tuple, with_margins(sample.withColumn("margins", none), machine).select("margins", "label").collect()))
    scored = with_margins(keyed(docs, id_col, text_col).withColumn("margins", none), machine)
    logit = sum((F.col("margins")[i] * w for i, w in enumerate(weights[:-1])), F.lit(weights[-1]))
    return scored.withColumn("score", 1 / (1 + F.exp(-logit)))
