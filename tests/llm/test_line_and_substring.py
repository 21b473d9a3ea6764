"""Line and passage dedup on ragged input, against plain Python."""

import hashlib

import numpy as np
from ragged import make_docs, ragged_pairs  # noqa: F401
from linkledger.llm import line_dedup, substring_dedup
from linkledger.llm.fm_index import FMIndex


def plain_lines(pairs, min_docs=5, min_chars=40):
    def key(line):
        return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    shared = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in shared or (i is not None and i == shared[key(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_of_ragged_documents(make_docs, ragged_pairs):
    got = line_dedup.drop_repeated_lines(make_docs(ragged_pairs)).select("id", "text", "n_lines", "n_dropped").collect()
    expected = plain_lines(ragged_pairs)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert sum(e[3] for e in expected) >= 5
    assert line_dedup.drop_repeated_lines(make_docs([])).collect() == []


def plain_passages(pairs, window):
    words = [(t or "").encode().split() for _, t in pairs]
    ids = [float("inf") if i is None else i for i, _ in pairs]
    least = {}
    for i, w in zip(ids, words):
        for at in range(len(w) - window + 1):
            k = tuple(w[at:at + window])
            least[k] = min(i, least.get(k, i))
    out = []
    for (raw, _), i, w in zip(pairs, ids, words):
        gone = set()
        for at in range(len(w) - window + 1):
            if least[tuple(w[at:at + window])] < i:
                gone.update(range(at, at + window))
        kept = [x for n, x in enumerate(w) if n not in gone]
        out.append((raw, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_passages_of_ragged_documents(make_docs, ragged_pairs):
    passage = " ".join(f"p{i}" for i in range(70))
    pairs = [*ragged_pairs, (20, f"{passage} a b"), (21, f"c {passage}"), (22, f"{passage} {passage}"), (19, " ".join(passage.split()[5:58])), (None, passage)]
    got = substring_dedup.remove_repeats(make_docs(pairs)).select("id", "n_words", "n_removed", "digest").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_passages(pairs, 50)))
    assert substring_dedup.remove_repeats(make_docs([])).collect() == []


def test_passages_in_many_small_parts_and_shards(make_docs):
    """A few words only, so that grams tie and repeat; groups larger than a part meet in pairs."""
    random = np.random.default_rng(2)
    passages = [" ".join(random.choice(["a", "b", "c"], 40)) for _ in range(3)]
    pairs = [(int(i), " ".join(random.choice([*passages, "x", "y", "a b"], 6))) for i in random.permutation(60)]
    got = substring_dedup.remove_repeats(make_docs(pairs), window=20, shard_words=300, part_segments=3).select("id", "n_words", "n_removed", "digest").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_passages(pairs, 20)))


def test_index_gives_matching_statistics():
    random = np.random.default_rng(0)
    for _ in range(60):
        letters, depth = int(random.integers(2, 6)), int(random.integers(1, 7))
        held = [random.integers(1, letters, random.integers(0, 15)) for _ in range(random.integers(1, 6))]
        owners = random.integers(0, 100, len(held)).tolist()
        asked = [random.integers(0, letters + 1, random.integers(0, 15)) for _ in range(4)] + held
        index = FMIndex(held, owners, letters + 1, depth)
        for q, lengths, least in zip(asked, *index.matching_statistics(asked)):
            for i in range(len(q)):
                holders = [[o for s, o in zip(held, owners) for j in range(len(s) - d + 1) if i + d <= len(q) and q[i:i + d].tolist() == s[j:j + d].tolist()] for d in range(1, depth + 1)]
                assert lengths[i] == max([d for d in range(1, depth + 1) if holders[d - 1]], default=0)
                assert least[i] == min(holders[-1], default=-1)
