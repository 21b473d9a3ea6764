"""SimHash fingerprints and groups of documents whose fingerprints differ in few bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.llm.common import bounded_batches, cut_lineage, keyed, text_bytes
from linkledger.llm.components import components

SEED = 42
SHINGLES_AT_ONCE = 1 << 13
SEGMENTS, SEGMENT_BITS = 8, 8
BUCKET_PART = 4096
WIDE_WORDS = 8
BANDS, BAND_ROWS = 16, 4
#: Of 512 bits, chosen for candidates only: at a similarity of 0.8 the mean distance is 77 (96 for texts of 4 and 5
#: shingles), the standard deviation 9.
WIDE_DISTANCE = 128
SIMILAR = (4, 5)  # texts are near copies if they share four fifths of their shingles or more
TEXT_PART, TEXT_PART_BYTES = 1024, 1 << 24
ODD = np.random.default_rng(SEED).integers(1 << 62, (1 << 63) - 1, (2, BANDS * BAND_ROWS), np.uint64) | np.uint64(1)


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``shingle`` lower-cased words (of all words, if there are fewer), repeats included, in parts."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    hashed, seed = xxhash.xxh64_intdigest, SEED
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = words[at:min(n, at + SHINGLES_AT_ONCE) + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(part) >= shingle else [b" ".join(part)]
        yield np.array([hashed(s, seed) for s in joined], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: bytes, shingle: int) -> int:
    """64 bits, each set if it is set in more than half of the hashes of all shingles; 0 without words."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        counts += bit_counts(hashes)
        n += len(hashes)
    return majority(counts, n)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, shingle)]))


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of ``SIMILAR`` or more; two empty ones have."""
    share, of = SIMILAR
    few, many = sorted((len(one), len(other)))
    if few * of < many * share:
        return False
    common = few + many - len(np.union1d(one, other))
    return common * of >= (few + many - common) * share


def sketch(shingles: np.ndarray) -> tuple[list[int], list[int]]:
    """(words, bands) of a shingle set: a fingerprint of ``WIDE_WORDS`` 64-bit words, and one key per band of least hashes."""
    counts = np.zeros((WIDE_WORDS, 64), np.int64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(shingles), SHINGLES_AT_ONCE):
        hashes = shingles[start:start + SHINGLES_AT_ONCE]
        for i in range(WIDE_WORDS):
            mixed = (hashes ^ (hashes >> np.uint64(29 + i))) * ODD[0, i]
            counts[i] += bit_counts(mixed ^ (mixed >> np.uint64(32)))
        scrambled = hashes ^ (hashes >> np.uint64(33))
        for at in range(0, len(hashes), 1024):
            products = scrambled[at:at + 1024, None] * ODD[0] + ODD[1]
            least = np.minimum(least, (products ^ (products >> np.uint64(31))).min(axis=0))
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = keys * ODD[0, 0] + row
    return [majority(c, len(shingles)) for c in counts], keys.tolist()


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as a long."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).mapInArrow(read, f"id {kind}, fp long")


def with_sketches(docs: DataFrame, id_col: str, slot_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, slot, size, node, words, bands) of every row's whole text; ``node`` stands for its set of shingles, ``size`` is in bytes."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            nodes, found = [], []
            for t in texts:
                shingles = shingle_set(t, shingle)
                nodes.append(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))
                found.append(sketch(shingles))
            lists = [pa.array([np.array(f[i], np.uint64).view(np.int64) for f in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("slot"), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.array(nodes, np.uint64).view(np.int64)), *lists],
                names=["id", "slot", "size", "node", "words", "bands"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(slot_col).cast("long").alias("slot"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(read, f"id {kind}, slot long, size long, node long, words array<long>, bands array<long>")


def ring_mask(start: int, length: int) -> int:
    """Bits of ``length`` consecutive segments on the ring, from ``start``."""
    segment = (1 << SEGMENT_BITS) - 1
    return sum(segment << (SEGMENT_BITS * ((start + i) % SEGMENTS)) for i in range(length))


def chain_keys(max_distance: int) -> list[tuple[int, int]]:
    """(start, mask) of the bits that two fingerprints of a chain from ``start`` have in common, one entry per choice.

    If the distances of all segments add up to at most d, there is a start from which every chain of l segments has at
    most d * l / 8 of them. For d = 3 the chain's first two segments are equal and its next three differ in one bit at
    most, so two of the three are equal: 32 equal bits, in three choices per start. Smaller d keep that; for larger d no
    two segments need be equal and the keys would not find all pairs.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("the chain keys are complete for distances up to 3")
    keys = []
    for start in range(SEGMENTS):
        for left_out in (2, 3, 4):
            keys.append((start, ring_mask(start, 5) & ~ring_mask(start + left_out, 1)))
    return keys


def chain_holds(distances: np.ndarray, start: int, most: int) -> np.ndarray:
    """Rows of per-segment distances of which every chain from ``start`` keeps its share of ``most``; the last chain is the whole ring."""
    rows, total, segments = np.arange(len(distances)), np.zeros(len(distances), np.int64), distances.shape[1]
    for n in range(segments):
        total = total + distances[rows, (start + n) % segments]
        keep = total * segments <= most * (n + 1)
        rows, total = rows[keep], total[keep]
    return rows


def near(one: np.ndarray, others: np.ndarray, start: int | None, most: int) -> np.ndarray:
    """Rows of ``others`` within ``most`` bits of ``one``, by a chain from ``start`` or, if that is None, from anywhere.

    A segment is a byte of a 64-bit fingerprint, a word of a wide one.
    """
    difference = others ^ one
    distances = np.bitwise_count(difference if difference.shape[1] > 1 else np.ascontiguousarray(difference).view(np.uint8)).astype(np.int64)
    if start is not None:
        return chain_holds(distances, start, most)
    left, found = np.arange(len(others)), []
    for start in range(distances.shape[1]):
        holds = chain_holds(distances[left], start, most)
        found.append(left[holds])
        left = np.delete(left, holds)
    return np.sort(np.concatenate(found))


def spanning_links(members: np.ndarray, n_left: int, start: int | None, most: int, labels: np.ndarray | None = None,
                   confirmed: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Index pairs that connect all that near pairs connect: fewer than members.

    With ``n_left`` only the first so many rows are compared with the others (two parts of a bucket), else all with all.
    Members that are connected already, or have one label from the start, are not compared again, so a group of near copies
    takes about linear time. With ``confirmed`` near pairs are candidates, and those it does not hold for link nothing.
    """
    labels, out = np.arange(len(members)) if labels is None else labels.copy(), []
    for i in range(n_left or len(members)):
        others = np.flatnonzero(labels != labels[i])
        others = others[others >= (n_left or i)]
        if not len(others):
            continue
        found = others[near(members[i], members[others], start, most)]
        if confirmed:
            links, met = [], set()
            for x, label in zip(found.tolist(), labels[found].tolist()):
                if label not in met and confirmed(i, x):
                    met.add(label)
                    links.append((i, x))
            if links:
                out += links
                labels[np.isin(labels, list(met))] = labels[i]
        elif len(found):
            met, first = np.unique(labels[found], return_index=True)
            out += [(i, int(found[x])) for x in first]
            labels[np.isin(labels, met)] = labels[i]
    return out


def meeting_links(meeting: DataFrame, starts: list[int | None], most: int, shingle: int | None = None) -> DataFrame:
    """(a, b): links of the rows (choice, bits, p, q, part, node, words) that meet under one (choice, bits, p, q).

    With ``shingle`` the rows have their ``text`` and the ``root`` they are linked to already, and a pair is linked only if
    its shingle sets are similar.
    """
    columns = ["choice", "bits", "p", "q", "part", "node", "words"] + (["root", "text"] if shingle else [])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def flush() -> list[tuple[int, int]]:
            if len(rows) < 2:
                return []
            choice, _, p, q = group
            parts, nodes, words, *rest = zip(*rows)
            members, labels, confirmed = np.array(words, np.int64).view(np.uint64), None, None
            if shingle:
                labels, sets = np.unique(rest[0], return_inverse=True)[1], {}

                def shingles(i: int) -> np.ndarray:
                    if i not in sets:
                        sets[i] = shingle_set(rest[1][i], shingle)
                    return sets[i]

                def confirmed(i: int, j: int) -> bool:
                    return similar(shingles(i), shingles(j))

            return [(nodes[i], nodes[j]) for i, j in spanning_links(members, 0 if p == q else parts.count(p), starts[choice], most, labels, confirmed)]

        def links(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if row[:4] != group:
                    found += flush()
                    group, rows = row[:4], []
                rows.append(row[4:])
            yield links(found)
        yield links(flush())

    dealt = meeting.select(*columns).repartition("choice", "bits", "p", "q").sortWithinPartitions("choice", "bits", "p", "q", "part", "node")
    return dealt.mapInArrow(link, "a long, b long").distinct()


def bucket_links(bucketed: DataFrame, starts: list[int | None], most: int, bucket_part: int = BUCKET_PART) -> DataFrame:
    """(a, b): links between nodes that share a bucket and are within ``most`` bits, as many as connect them.

    ``bucketed`` has (choice, bits, node, words): ``choice`` numbers the way of bucketing, ``starts`` gives the start of its
    chains. Buckets of one are dropped. A larger one is dealt by hash in parts of about ``bucket_part``, and every two parts
    meet in a task of their own, so no group grows with the data; a task gives fewer links than members, never all pairs.
    Bucket sizes are added up before they are shuffled and stored, so that the join that brings them back can split a
    bucket with very many members.
    """
    bounded_batches(bucketed.sparkSession)
    sizes = bucketed.groupBy("choice", "bits").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    crowded = cut_lineage(sizes.select("choice", "bits", F.ceil(F.col("members") / bucket_part).cast("int").alias("parts")), "buckets")
    placed = bucketed.join(crowded, ["choice", "bits"]).withColumn("part", F.pmod(F.xxhash64("node", "choice"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    meeting = placed.select("choice", "bits", "node", "words", "part", other.alias("other")).select(
        "choice", "bits", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "words")
    return meeting_links(meeting, starts, most)


def fingerprint_links(fingerprints: DataFrame, max_distance: int = 3, bucket_part: int = BUCKET_PART) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints ``fp`` exactly as all pairs within ``max_distance`` (up to 3) do.

    Every fingerprint goes to the 24 buckets of its chain keys, 32 equal bits each.
    """
    choices = chain_keys(max_distance)
    signed = [mask - (1 << 64) if mask >> 63 else mask for _, mask in choices]
    keys = F.array(*[F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")) for n, mask in enumerate(signed)])
    bucketed = fingerprints.select(F.col("fp").alias("node"), F.array("fp").alias("words"), F.inline(keys))
    return bucket_links(bucketed, [start for start, _ in choices], max_distance, bucket_part)


def _components_of(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (with id and node) and their ``root`` node and ``component``, the least id of the nodes linked to theirs."""
    roots = components(links)
    placed = nodes.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    groups = cut_lineage(placed.groupBy("root").agg(F.min("least").alias("component")), "groups")
    return rows.join(placed.join(groups, "root").select("node", "root", "component"), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """(id, fp, component): every row's fingerprint and the least id of all rows it reaches over links.

    Only distinct fingerprints are compared; equal ones, and whole groups of copies with them, are one node. Two texts
    are linked if their fingerprints differ in at most ``max_distance`` bits, and a group is what links connect.

    Null and empty texts, and texts without words, have fingerprint 0 and are linked like any other. Rows with null id
    keep a row and take part; the least id is taken over the others (null if there is none). Rows that repeat an id keep
    one row each. An empty table gives an empty result.
    """
    stored = cut_lineage(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints").withColumn("node", F.col("fp"))
    nodes = stored.groupBy("node").agg(F.min("id").alias("least"))
    links = fingerprint_links(nodes.select(F.col("node").alias("fp")), max_distance)
    return _components_of(stored, nodes, links).select("id", "fp", "component")


def hex_digits(fp: str | Column) -> Column:
    """16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(fp) if isinstance(fp, str) else fp), 16, "0"))


def similar_links(sketches: DataFrame, texts: DataFrame, shingle: int, most: int = WIDE_DISTANCE, part: int = TEXT_PART, part_bytes: int = TEXT_PART_BYTES) -> DataFrame:
    """(a, b): links between nodes of similar shingle sets that share a band, as many as connect them.

    ``sketches`` has (node, slot, size, words, bands), one row per node, ``texts`` the text of every slot. Members of a bucket
    are candidates within ``most`` bits; the task that holds both texts compares their shingle sets. Of small buckets with the
    same members one is compared. Larger ones are dealt by hash in parts of ``part`` texts and ``part_bytes`` at most about,
    another way for each band, and first the members of each part are linked. Then a bucket's parts meet, without the pairs
    that are linked by now: members outside its largest group meet all others, that group's own do not, so a bucket full
    of near copies is not sent again.
    """
    bounded_batches(sketches.sparkSession)
    starts: list[int | None] = [None] * BANDS
    bucketed = sketches.select("node", "slot", "size", "words", F.posexplode("bands").alias("choice", "bits"))
    sizes = bucketed.groupBy("choice", "bits").agg(
        F.count("*").alias("members"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where(F.col("members") > 1)
    parts = F.greatest(F.ceil(F.col("members") / part), F.ceil(F.col("bytes") / part_bytes), F.lit(1)).cast("int")
    sized = sizes.withColumn("parts", parts).groupBy("members", "x", "y", "parts", F.when(F.col("parts") > 1, F.col("choice")).alias("own"))
    crowded = cut_lineage(sized.agg(F.min(F.struct("choice", "bits")).alias("first")).select("first.choice", "first.bits", "members", "parts"), "buckets")
    placed = cut_lineage(bucketed.join(crowded, ["choice", "bits"]).withColumn("part", F.pmod(F.xxhash64("node", "choice"), F.col("parts")).cast("int")), "members")
    own = placed.select("choice", "bits", F.col("part").alias("p"), F.col("part").alias("q"), "part", "slot", "node", "words", F.col("node").alias("root"))
    links = cut_lineage(meeting_links(own.join(texts, "slot"), starts, most, shingle), "part-links")
    several = crowded.where(F.col("parts") > 1)
    if several.isEmpty():
        return links
    rest = placed.where(F.col("parts") > 1).join(components(links).withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").drop("linked")
    rest = cut_lineage(rest.withColumn("root", F.coalesce("root", "node")), "linked-members")
    groups = rest.groupBy("choice", "bits", "root").agg(F.count("*").alias("n"))
    largest = groups.groupBy("choice", "bits").agg(F.max(F.struct("n", "root")).alias("top")).join(several, ["choice", "bits"]).where(F.col("members") > F.col("top.n"))
    few = F.ceil((F.col("members") - F.col("top.n")) * F.col("parts") / F.col("members")).cast("int")
    shapes = cut_lineage(largest.select("choice", "bits", F.col("top.root").alias("top"), few.alias("few")), "groups")
    met = rest.join(shapes, ["choice", "bits"])
    inside = F.col("root") == F.col("top")
    met = met.withColumn("part", F.when(inside, F.col("few") + F.col("part")).otherwise(F.pmod(F.xxhash64("node", "choice"), F.col("few")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(inside, 0).otherwise(F.col("parts"))))
    meeting = met.withColumn("other", other).select(
        "choice", "bits", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "slot", "node", "words", "root")
    return links.union(meeting_links(meeting.join(texts, "slot"), starts, most, shingle))


def similar_documents(docs: DataFrame, id_col: str, slot_col: str, text_col: str, shingle: int = 5, most: int = WIDE_DISTANCE, part: int = TEXT_PART) -> DataFrame:
    """(id, slot, node, root, component): rows grouped by links between texts that share 0.8 of their distinct shingles or more.

    Pairs are looked up by 16 bands of four least shingle hashes, which two texts of similarity 0.8 share with a probability
    of 0.9998, and which a passage that many texts hold does not fill. Pairs within ``most`` of 512 bits, by the chains of
    the 64-bit fingerprints, are candidates, and each is confirmed by the Jaccard similarity of its shingle sets. Rows of one
    shingle set are one node.

    Null and empty texts and texts without words are copies of each other; a null id counts as the largest.
    """
    stored = cut_lineage(with_sketches(docs, id_col, slot_col, text_col, shingle), "sketches")
    nodes = stored.groupBy("node").agg(F.min("id").alias("least"))
    distinct = stored.select("node", "slot", "size", "words", "bands").dropDuplicates(["node"])
    texts = docs.select(F.col(slot_col).cast("long").alias("slot"), text_bytes(text_col).alias("text"))
    return _components_of(stored, nodes, similar_links(distinct, texts, shingle, most, part)).select("id", "slot", "node", "root", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, most: int = WIDE_DISTANCE) -> DataFrame:
    """The documents without near copies: of each group the row with the least id stays, with its own columns.

    Of rows that repeat that id one stays; a null id counts as the largest. The rows are numbered in a written table, so
    that equal rows can be told apart.
    """
    numbered = cut_lineage(keyed(docs, id_col, text_col).withColumn("slot", F.monotonically_increasing_id()), "documents")
    groups = similar_documents(numbered, "id", "slot", "text", shingle, most)
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "slot")).alias("first")).select(F.col("first.slot").alias("slot"))
    joined = numbered.join(kept, "slot", "left_semi")
    return joined.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
