"""Classifier, language model, packing, WARC records and pipeline, against plain versions and held-out data."""

import collections
import html.parser
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest import SF_DIR
from ragged import make_docs, ragged_pairs  # noqa: F401
from linkledger.llm import brown, packing, quality, warc
from linkledger.llm.common import fold
from linkledger.llm.queries import QUERIES
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()}


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def test_quality_on_held_out_labels(spark):
    scores = {r["doc_id"]: r for r in QUERIES["op2_quality_classifier"](spark, LARGER).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in pq.read_table(f"{LARGER}/labels.parquet").to_pylist()]
    assert all(r["held_out"] == (crc(i) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in scores.items())
    held = [(scores[i]["predicted"], q) for i, q in labels if crc(i) % 5 == 0]
    assert len(held) > 40 and np.mean([p == q for p, q in held]) >= 0.95


def test_quality_votes_are_exact_neighbour_votes():
    random = np.random.default_rng(0)
    texts = [" ".join(random.choice(["good", "plain", "words", "here"] if i % 2 else ["BAD!!", "###", "$$$"], 30)).encode() for i in range(60)]
    rows = [quality.terms(t) for t in texts]
    space = quality.Space.of(rows[:40], [i % 2 for i in range(40)], 8)
    got = space.vote(rows[40:], 5, 4)
    for row, score in zip(space.project(rows[40:]), got):
        cosines = space.vectors @ row
        near = np.sort(np.argsort(-cosines)[:5])
        weight = np.maximum(cosines[near], 0).astype(float) ** 4
        assert score == pytest.approx((weight * space.labels[near]).sum() / weight.sum(), abs=1e-3)
    assert [round(x) for x in got] == [i % 2 for i in range(40, 60)]


def test_quality_of_ragged_documents(spark, make_docs, ragged_pairs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, None), (9, None, 1), (None, 1, 1), (9, 1, 0), (77, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(make_docs(ragged_pairs), labels, fold("doc_id", 5) != 0).collect()
    assert len(got) == len(ragged_pairs) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.score_quality(make_docs(ragged_pairs), labels.limit(0), F.lit(True)).collect()
    assert [r["score"] for r in none] == [0.5] * len(ragged_pairs)
    assert quality.score_quality(make_docs([]), labels, F.lit(True)).collect() == []


def plain_base(pairs, trained):
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for _, t in pairs]
    counts = collections.Counter(w for ws, u in zip(tokens, trained) if u for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for ws in tokens]


@pytest.mark.parametrize("sizes", [{}, {"vocabulary": 40, "clustered": 12, "n_free": 4, "rounds": 3}])
def test_language_model_of_ragged_documents(make_docs, ragged_pairs, sizes):
    trained = [crc(i) % 7 != 2 for i, _ in ragged_pairs]
    got = brown.score_texts(make_docs(ragged_pairs), fold("doc_id", 7) != 2, **sizes).collect()
    expected = plain_base(ragged_pairs, trained)
    assert sorted((str(r["id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted(
        (str(i), a, b, n, round(s, 4)) for (i, _), (a, b, n, s) in zip(ragged_pairs, expected))
    assert all(r["score"] < 0 for r in got)
    assert brown.score_texts(make_docs([]), F.lit(True)).collect() == []
    untaught = brown.score_texts(make_docs(ragged_pairs), F.lit(False)).collect()
    assert len(untaught) == len(ragged_pairs) and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in untaught)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in QUERIES["op8_brown_lm_scoring"](spark, SF_DIR).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_model_probabilities_add_up_to_one(make_docs):
    random = np.random.default_rng(1)
    docs = make_docs([(i, " ".join(random.choice([f"w{j}" for j in range(30)], 20))) for i in range(40)])
    model, counts = brown.train(docs.select(F.col("text").cast("binary").alias("text")), 20, 10, 4, 3)
    known = {bytes(r["word"]): r["n"] for r in counts.collect()}
    v = len(model.counts)
    for before in range(model.transitions.shape[0]):
        total, base, classes = 0.0, 0.0, set()
        for word, n in known.items():
            at = model.numbers.get(word, None)
            c = model.classes[at if at is not None else v + brown.ending_class(word)]
            classes.add(int(c))
            total += model.word(model.transitions[before, c], n, c)
            base += model.base(n)
        total += brown.CLASS_WEIGHT * sum(model.transitions[before, c] * model.unknown[c] for c in classes)
        # Classes that no word has been seen in, and the base's one unknown word, hold the rest.
        unseen = [c for c in range(model.transitions.shape[0]) if c not in classes]
        total += brown.CLASS_WEIGHT * model.transitions[before, unseen].sum() + (1 - brown.CLASS_WEIGHT) * model.base(0)
        assert total == pytest.approx(1)


def test_exchange_improves_mutual_information(make_docs):
    random = np.random.default_rng(9)
    docs = make_docs([(i, " ".join(f"{'ab'[k % 2]}{random.integers(9)}" for k in range(30))) for i in range(200)])
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    words = [w for w, _ in brown.frequent(brown.count_tokens(texts), 100)]
    seen = brown.contexts(brown.count_pairs(texts, words)).persist()
    classes, table = brown.exchange(seen, len(words), 3, 12)
    of = {w: int(classes[i]) for i, w in enumerate(words)}
    assert len({of[w] for w in words if w[:1] in (b"a", b"b")}) >= 2
    assert not {of[w] for w in words if w[:1] == b"a"} & {of[w] for w in words if w[:1] == b"b"}
    assert table.sum() == sum(len(r["text"].split()) + 1 for r in docs.collect())


def test_every_word_moves_to_the_class_that_is_worth_most():
    random = np.random.default_rng(3)
    n_free, n_classes, n_words = 5, 8, 12
    for _ in range(20):
        classes = random.integers(0, n_classes, n_words)
        pairs = random.integers(0, 4, (n_words, n_words)) * (random.random((n_words, n_words)) < 0.4)

        def table(of):
            found = np.zeros((n_classes, n_classes))
            np.add.at(found, (of[:, None].repeat(n_words, 1), of[None].repeat(n_words, 0)), pairs)
            return found

        others = pairs * (1 - np.eye(n_words, dtype=int))
        left, right = (np.stack([(side * (classes == c)[None]).sum(axis=1) for c in range(n_classes)], axis=1).astype(float) for side in (others.T, others))
        best = brown.best_classes(table(classes), classes, left, right, np.diag(pairs).astype(float), n_free)
        for word in range(n_words):
            worth = [brown.worth(table(np.where(np.arange(n_words) == word, c, classes))) for c in range(n_free)]
            assert worth[best[word]] == pytest.approx(max(worth))


def test_every_word_takes_part_in_the_exchange(make_docs):
    random = np.random.default_rng(5)
    docs = [(i, " ".join([*(f"w{x}" for x in random.zipf(1.4, 30) if x < 400), *(["zz"] * (i % 3)), "y" * 80])) for i in range(200)]
    texts = make_docs(docs).select(F.col("text").cast("binary").alias("text")).repartition(3)
    vocabulary, n_free = 20, 6
    model, counts = brown.train(texts, vocabulary, n_free=n_free)
    classes = {w: int(model.classes[i]) for w, i in model.numbers.items()}
    rare = {bytes(r["word"]): r["class"] for r in counts.collect() if bytes(r["word"]) not in classes}
    assert len(classes) <= vocabulary and len(rare) > 50 and b"y" * 80 in rare
    assert all(0 <= c < n_free for c in [*classes.values(), *rare.values()])

    # Tables of class pairs are those of the texts whenever words with and without a number have moved.
    words = [w for w, _ in brown.frequent(brown.count_tokens(texts), vocabulary)]
    pairs = brown.count_pairs(texts, words).persist()
    number = {w: i for i, w in enumerate(words)}

    def counted(of):
        table = np.zeros((n_free + brown.ENDING_CLASSES + 1,) * 2)
        for _, text in docs:
            line = [n_free + brown.ENDING_CLASSES, *map(of, brown.tokens(text.encode()))]
            np.add.at(table, (line[:-1], line[1:]), 1)
        return table

    found, table = brown.exchange(brown.contexts(pairs).persist(), len(words), n_free)
    assert (table == counted(lambda w: found[number[w]] if w in number else n_free + brown.ending_class(w))).all()
    others = brown.RareWords.of(pairs, len(words))
    symbols, table = others.exchange(found, table, n_free)
    given = {bytes(r["word"]): r["symbol"] - len(words) - brown.ENDING_CLASSES - 1 for r in symbols.collect()}
    assert (table == counted(lambda w: found[number[w]] if w in number else given[w])).all()


def test_scores_of_words_without_a_number_are_those_of_plain_sums(make_docs):
    random = np.random.default_rng(8)
    docs = [(i, " ".join(f"w{x}" for x in random.zipf(1.3, 25) if x < 300)) for i in range(90)]
    sizes = {"vocabulary": 15, "n_free": 4}
    trains = F.col("doc_id") % 3 != 0
    scores = {r["id"]: r["score"] for r in brown.score_texts(make_docs(docs), trains, **sizes).collect()}
    model, counts = brown.train(make_docs(docs).where(trains).select(F.col("text").cast("binary").alias("text")), **sizes)
    classes, v = {bytes(r["word"]): (r["n"], r["class"]) for r in counts.collect()}, len(model.counts)
    unknown = model.transitions @ model.spread
    close = 0
    for i, text in docs:
        before, total = model.start, 0.0
        for w in brown.tokens(text.encode()):
            n, c = classes.get(w, (0, None))
            c = int(model.classes[model.numbers[w]] if w in model.numbers else model.classes[v + brown.ending_class(w)] if c is None else c)
            total += math.log10(model.word(model.transitions[before, c], n, np.int64(c)) if n else brown.CLASS_WEIGHT * unknown[before, brown.ending_class(w)] + (1 - brown.CLASS_WEIGHT) * model.base(0))
            before = c
        close += math.isclose(total, scores[i], rel_tol=1e-9)
    assert close == len(docs)


def check_packing(rows, texts, size=1024):
    """Pieces rebuild every document's ids; sequences are gapless and no longer than ``size``."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = []
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % size if len(ids) > size else 0
        cuts = [0, *range(first or size, len(ids), size), len(ids)]
        expected += [(str(i), n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(sequences), -(-sum(r["length"] for r in rows) // size)


def test_packing_of_documents(spark, documents):
    made, least = check_packing(QUERIES["op10_best_fit_packing"](spark, SF_DIR).collect(), documents.items())
    assert made <= least * 1.02 + 2


def test_packing_of_ragged_documents(make_docs, ragged_pairs):
    special = [(50, "a <|endoftext|> b<|endoftext|>"), (51, "x" * 5000), (52, "tab\t\tand  spaces   \n\n it's")]
    check_packing(packing.pack_documents(make_docs([*ragged_pairs, *special]), TOKENIZER).collect(), [*ragged_pairs, *special])
    check_packing(packing.pack_documents(make_docs(ragged_pairs), TOKENIZER, group_pieces=3).collect(), ragged_pairs)
    assert packing.pack_documents(make_docs([]), TOKENIZER).collect() == []


def test_sum_of_squares_places_by_the_rule():
    random = np.random.default_rng(6)
    packer, fills = packing.SumOfSquares(20), []

    def cost(levels):
        return sum(n * n for n in collections.Counter(x for x in levels if x < 20).values())

    for length in random.integers(1, 20, 300).tolist():
        options = {cost([*fills[:s], f + length, *fills[s + 1:]]): 0 for s, f in enumerate(fills) if f + length <= 20}
        sequence, offset = packer.place(length)
        if sequence == len(fills):
            assert not options and offset == 0
            fills.append(length)
        else:
            assert offset == fills[sequence]
            fills[sequence] += length
            assert cost(fills) == min(options)


class Reader(html.parser.HTMLParser):
    BREAKS = set("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")
        self.out.append("\n" if tag in self.BREAKS else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")
        self.out.append("\n" if tag in self.BREAKS else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data.replace("\n", " "))


def test_warc_records_of_pages(spark, tmp_path):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    responses = {r["record_id"]: r for r in warc.responses_from_pages(pages).collect()}
    records = warc.build_derivatives(warc.responses_from_pages(pages))
    rows = records.collect()
    assert len(rows) == 2 * len(responses) and len({r["record_id"] for r in rows}) == len(rows)
    by_id = {r["record_id"]: r for r in rows}
    for r in rows:
        source = responses[r["refers_to"]]
        assert r["source_digest"] == warc.digest(bytes(source["payload"])) and r["source_header"] == source["http_header"] and r["target_uri"] == source["target_uri"]
        assert r["block_digest"] == warc.digest(bytes(r["block"])) and r["content_length"] == len(r["block"])
        other = by_id[warc.header_value(r["header"], "WARC-Concurrent-To")]
        assert other["refers_to"] == r["refers_to"] and other["record_type"] != r["record_type"]
        if r["record_type"] == "conversion":
            reader = Reader()
            reader.feed(bytes(source["payload"]).decode())
            lines = [" ".join(x.split()) for x in "".join(reader.out).split("\n")]
            assert bytes(r["block"]).decode() == "\n".join(x for x in lines if x)
    warc.write_warc(records, str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out")).collect()
    assert sorted((r["header"], bytes(r["block"])) for r in back) == sorted((r["header"], bytes(r["block"])) for r in rows)
    assert {r["record_id"]: r["refers_to"] for r in back} == {r["record_id"]: r["refers_to"] for r in rows}


def test_warc_records_of_ragged_pages(spark):
    rows = [(1, None, None, "x"), (None, "http://a/\r\nWARC-Type: response", "<p>one<br>two &amp; three</p>", "x"), (2, "u", "", None), (3, "u", "<p>" * 50_000, "x"), (3, "u", "<p>" * 50_000, "x"), (4, "u", "<script>x", "y"), (5, "u", "a < b <!-- c", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = warc.build_derivatives(warc.responses_from_pages(pages)).collect()
    texts = {r["source_id"]: bytes(r["block"]).decode() for r in got if r["record_type"] == "conversion"}
    assert texts == {1: "", None: "one\ntwo & three", 2: "", 3: "", 4: "", 5: "a < b"}
    assert len(got) == 14 and all(len(r["header"].split("\r\nWARC-Type:")) == 2 for r in got)
    assert warc.build_derivatives(warc.responses_from_pages(pages.limit(0))).collect() == []


def test_pipeline_against_plain_versions(spark, documents):
    docs, kept = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op2_quality_classifier"](spark, SF_DIR).collect()}
    first = kept["quality classifier"]
    assert set(first) == {i for i, p in scores.items() if p}

    from test_line_and_substring import plain_lines
    from test_search_and_scans import plain_hits

    assert kept["line dedup"] == {i: t for i, t, _, _ in plain_lines(list(first.items()))}
    before, after = kept["line dedup"], kept["near-dedup"]
    runs = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for i, t in before.items()}
    for i in before:
        alike = [(j, 1.0 if runs[i] == runs[j] else len(runs[i] & runs[j]) / len(runs[i] | runs[j])) for j in before if j != i]
        if i in after:
            assert not any(j in after and s >= 0.9 for j, s in alike)
        else:
            assert any(s >= 0.6 for _, s in alike)
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()]
    assert kept["decontamination"] == {i: t for i, t in after.items() if not plain_hits(t, items)[2]}
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    made, least = check_packing(rows, kept["decontamination"].items())
    assert made <= least * 1.02 + 2


def test_pipeline_drops_near_copies_of_four_fifths_only(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, corpus_pipeline.dedup_documents(spark, docs, SF_DIR)))
    runs = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for i, t in before.items()}
    for i in before:
        alike = [j for j in before if j != i and 5 * len(runs[i] & runs[j]) >= 4 * len(runs[i] | runs[j])]
        assert not any(j in after for j in alike) if i in after else alike


def test_pipeline_of_ragged_and_empty_tables(spark, tmp_path):
    rows = [(1, "one text here", "en", None, 3), (None, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "one text here", "de", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("some", rows), ("none", [])):
        for table, frame in (("documents", spark.createDataFrame(data, schema)), ("labels", spark.createDataFrame([(1, 1, 0)] if data else [], "doc_id long, quality int, toxic int")),
                             ("benchmark", spark.createDataFrame([(1, "something else")] if data else [], "item_id long, text string"))):
            frame.write.parquet(str(tmp_path / name / f"{table}.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert sorted(r["doc_id"] for r in got) == ([1, 2] if data else [])
