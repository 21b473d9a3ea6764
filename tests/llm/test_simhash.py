"""Fingerprints, links and groups against brute force over all pairs."""

import itertools

import numpy as np
import pytest
import xxhash
from ragged import make_docs, ragged_pairs  # noqa: F401
from linkledger.llm import simhash
from linkledger.llm.components import components


def plain_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(keys, near):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(keys)), 2):
        if near(keys[i], keys[j]):
            root[find(j)] = find(i)
    return [find(i) for i in range(len(keys))]


def close(a, b):
    return (a ^ b).bit_count() <= 3


def test_ragged_documents(make_docs, ragged_pairs):
    got = simhash.near_duplicates(make_docs(ragged_pairs)).select("id", simhash.hex_digits("fp").alias("fp"), "component").collect()
    prints = [plain_fingerprint(t) for _, t in ragged_pairs]
    groups = plain_groups(prints, close)
    expected = []
    for (i, _), fp, g in zip(ragged_pairs, prints, groups):
        members = [x for (x, _), h in zip(ragged_pairs, groups) if h == g and x is not None]
        expected.append((i, f"{fp:016x}", min(members, default=None)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []
    assert simhash.one_of_each(make_docs([])).collect() == []


@pytest.mark.parametrize("part", [4, 4096])
def test_links_connect_like_all_pairs(spark, part):
    random = np.random.default_rng(5)
    centres = random.integers(0, 1 << 63, 12, np.uint64)
    prints = {int(c) for c in centres}
    for c in centres[:6]:  # chains of near fingerprints, and a dense cloud around the first
        value = int(c)
        for _ in range(60 if c == centres[0] else 8):
            for bit in random.integers(0, 64, random.integers(1, 4)):
                value ^= 1 << int(bit)
            prints.add(value)
            value = int(c) if c == centres[0] else value
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), bucket_part=part)
    root = {r["node"]: r["root"] for r in components(links).collect()}
    groups = plain_groups(prints, close)
    for (s, g), (t, h) in itertools.combinations(zip(signed, groups), 2):
        assert (g == h) == (root.get(s, s) == root.get(t, t))


def test_chain_holds_is_the_pigeonring_principle():
    random = np.random.default_rng(1)
    distances = random.integers(0, 3, (2000, 8))
    for most in (0, 3, 7):
        somewhere = set()
        for start in range(8):
            somewhere |= set(simhash.chain_holds(distances, start, most).tolist())
        assert somewhere == set(np.flatnonzero(distances.sum(axis=1) <= most).tolist())


def test_too_wide_chain_keys_are_refused():
    with pytest.raises(ValueError):
        simhash.chain_keys(4)


def test_components_of_a_path_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 40)] + [(3, 3), (2, 1), (1, 2), (None, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 40)}, 1: 1, 2: 1}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_group_stays(make_docs):
    random = np.random.default_rng(3)
    words = [f"word{i}" for i in range(5000)]
    base = [" ".join(random.choice(words, 200)) for _ in range(30)]

    def changed(text, n):
        out = text.split()
        for i in random.choice(len(out), n, replace=False):
            out[i] = "other"
        return " ".join(out)

    pairs = list(enumerate(base))
    pairs += [(100 + i, t) for i, t in enumerate(base[:5])] + [(200 + i, changed(t, 2)) for i, t in enumerate(base[:10])]  # copies, and near ones of 0.9
    pairs += [(300 + i, " ".join(t.split()[:60]) + " " + " ".join(random.choice(words, 140))) for i, t in enumerate(base[:10])]  # a shared passage only
    pairs += [(0, base[0]), (None, base[1]), (900, None), (901, ""), (None, "  ")]
    docs = make_docs(pairs)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(30), *range(300, 310), 900]


def plain_shingles(text, shingle=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def shared_pairs():
    """Pairs of texts below, at and above a similarity of 0.8, with repeated lines, short ones, and a chain in one group."""
    random = np.random.default_rng(7)
    fresh = iter(f"w{i}" for i in random.permutation(200_000))
    texts = []
    for similarity in (0.66, 0.7, 0.74, 0.76, 0.78, 0.79, 0.8, 0.81, 0.83, 0.86, 0.9):
        for _ in range(6):
            words = [next(fresh) for _ in range(404)]
            tail = round(400 * (1 - similarity) / (1 + similarity))
            texts += [" ".join(words), " ".join(words[:404 - tail] + [next(fresh) for _ in range(tail)])]
    line = [next(fresh) for _ in range(20)]
    texts += [" ".join(line * 60 + [next(fresh) for _ in range(60)]) for _ in range(4)]  # one line makes most of the shingles, not of their set
    words = [next(fresh) for _ in range(304)]
    texts += [" ".join(words), " ".join(words + words[:40] * 20)]
    for n in (8, 9, 12):
        words = [next(fresh) for _ in range(n + 1)]
        texts += [" ".join(words[:n]), " ".join(words)]
    words = [next(fresh) for _ in range(404)]
    texts += [" ".join(words[:404 - i] + [next(fresh) for _ in range(i)]) for i in range(0, 60, 2)]
    return texts


@pytest.mark.parametrize("part", [4, 1024])
def test_near_copies_share_four_fifths_of_their_shingles(make_docs, part):
    texts = shared_pairs()
    docs = make_docs(list(enumerate(texts))).withColumn("slot", simhash.F.col("doc_id"))
    got = {r["id"]: r["component"] for r in simhash.similar_documents(docs, "doc_id", "slot", "text", part=part).collect()}
    groups = plain_groups([plain_shingles(t) for t in texts], alike)
    assert got == {i: groups.index(g) for i, g in enumerate(groups)}
