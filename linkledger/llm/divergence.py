"""How far the word use of each source departs from the other sources and from its whole language."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkledger.llm.common import bounded_batches, cut_lineage, text_bytes

LEAST_DOCS = 3
TOP_TERMS = 200
#: Cells (term, source) that a task holds before it spills them.
STRIPE_CELLS = 1 << 20
#: Key of a stripe that holds the number of documents.
DOCS = -1
SCALE = 1_000_000_000
#: Bytes of a term: letters, A-Z in lower case, and all of multi-byte characters; other bytes become spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Counts up to this make no 64-bit product overflow.
SAFE_COUNT = (1 << 63) // SCALE - 2
CELL_SCHEMA = "lang string, term binary, source string, n long, docs long"


def fold_stripes(rows: Iterator[tuple[str, str, bytes]], limit: int = STRIPE_CELLS) -> Iterator[tuple[str, list[bytes], list[dict[int, int]], list[str]]]:
    """Fold whole texts into stripes, term to documents (under ``DOCS``) and count per source number.

    Gives (language, terms, stripes, sources) whenever ``limit`` cells are held, so memory is bounded by that and one text.
    """
    languages: dict[str, dict[bytes, dict[int, int]]] = defaultdict(dict)
    numbers: dict[str, int] = {}
    held = 0

    def spilled() -> Iterator[tuple[str, list[bytes], list[dict[int, int]], list[str]]]:
        for lang, terms in languages.items():
            yield lang, list(terms), list(terms.values()), list(numbers)
        languages.clear()

    for lang, source, text in rows:
        terms, number = languages[lang], numbers.setdefault(source, len(numbers))
        for term, n in Counter(text.translate(TERM_BYTES).split()).items():
            stripe = terms.get(term)
            if stripe is None:
                terms[term] = {DOCS: 1, number: n}
                held += 1
                continue
            stripe[DOCS] += 1
            if number in stripe:
                stripe[number] += n
            else:
                stripe[number] = n
                held += 1
        if held >= limit:
            yield from spilled()
            numbers.clear()
            held = 0
    yield from spilled()


def stripe_cells(lang: str, terms: list[bytes], stripes: list[dict[int, int]], sources: list[str]) -> pa.RecordBatch:
    """One row per (term, source); the documents of a term stand on its first row, the others have 0."""
    numbers = np.fromiter(chain.from_iterable(stripes), np.int64)
    values = np.fromiter(chain.from_iterable(s.values() for s in stripes), np.int64)
    heads = numbers == DOCS
    of, cells = np.cumsum(heads) - 1, ~heads
    docs = np.where(heads[:-1], values[:-1], 0)[cells[1:]]
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(docs), pa.string()), pa.array(terms, pa.binary()).take(pa.array(of[cells])), pa.array(sources, pa.string()).take(pa.array(numbers[cells])),
         pa.array(values[cells]), pa.array(docs)], names=["lang", "term", "source", "n", "docs"])


def merged_stripes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, docs, stripe of (source, n)): the terms that at least ``least_docs`` documents of a language hold.

    Tasks fold their documents into stripes first; what they spill is merged by (lang, term) in one shuffle.
    """
    bounded_batches(docs.sparkSession)
    given = docs.select(_text(lang_col).alias("lang"), _text(source_col).alias("source"), text_bytes(F.col(f"`{text_col}`")).alias("text"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))))
        for lang, terms, stripes, sources in fold_stripes(rows):
            for at in range(0, len(terms), 1 << 14):
                yield stripe_cells(lang, terms[at:at + (1 << 14)], stripes[at:at + (1 << 14)], sources)

    cells = given.mapInArrow(fold, CELL_SCHEMA).withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    # Both groupings find their rows together already.
    summed = cells.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    stripes = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("stripe"))
    return stripes.where(F.col("docs") >= least_docs)


def probabilities(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact for counts of any size."""
    if counts.max(initial=0) > SAFE_COUNT:
        return (1 + SCALE * (counts.astype(object) + 1) // totals.astype(object)).astype(np.int64)
    return 1 + SCALE * (counts + 1) // totals


def stripe_sums(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Sums over terms of floor((p - q)^2 / q) for every two sources; ``counts`` is terms by sources."""
    p = probabilities(counts, totals[None, :])
    out = np.empty((len(totals), len(totals)), np.int64)
    for i in range(len(totals)):
        apart = p[:, i:i + 1] - p
        out[i] = (apart * apart // p).sum(axis=0)
    return out


def audit_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                     least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences between sources, and the terms a source uses more than its language.

    Terms are runs of letters and of characters beyond ASCII, with A-Z in lower case. Part ``pair`` has one row per other
    source of the language; part ``term`` the ``top_terms`` terms of largest value. Arithmetic is exact.

    Null text, language and source are empty strings. A source without terms, and a language without kept terms, still
    have their pairs (value 0 in the latter). Repeated rows are documents of their own; ties go to the lesser item in
    UTF-8. An empty table gives no rows. Other columns are not looked at.

    What tasks hold is bounded by ``STRIPE_CELLS``, one text, and the number of sources of one language; the pairs of
    the result are the square of that number, as asked for, and no other step makes pairs.
    """
    kept = cut_lineage(merged_stripes(docs, text_col, lang_col, source_col, least_docs), "stripes")
    groups = docs.select(_text(lang_col).alias("lang"), _text(source_col).alias("source")).distinct()
    used = kept.select("lang", F.explode("stripe").alias("cell")).groupBy("lang", F.col("cell.source").alias("source")).agg(F.sum("cell.n").alias("used"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    sources = groups.join(used, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["used", "terms"])
    sources = cut_lineage(sources, "sources")
    langs = sources.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "used"))).alias("sources"), F.max("terms").alias("terms"), F.sum("used").alias("lang_used"))
    langs = cut_lineage(langs, "languages")
    found = _pairs(kept, langs).unionByName(_terms(kept, sources, langs, top_terms))
    return found.select("lang", "source", "part", "item", "value", "rank")


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def _ranked(df: DataFrame, part: str) -> DataFrame:
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(by_value))


def _pairs(kept: DataFrame, langs: DataFrame) -> DataFrame:
    # Counts of all sources of the language in the order of their names, absent ones as 0.
    held = F.map_from_entries("stripe")
    dense = kept.join(langs, "lang").select(
        "lang", F.transform("sources", lambda s: s["used"] + F.col("terms")).alias("totals"),
        F.transform("sources", lambda s: F.coalesce(F.element_at(held, s["source"]), F.lit(0))).alias("counts"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang in batch.column("lang").unique():
                part = batch.filter(pc.equal(batch.column("lang"), lang))
                totals = part.column("totals")[0].values.to_numpy()
                counts = part.column("counts").flatten().to_numpy().reshape(-1, len(totals))
                sums[lang.as_py()] = sums.get(lang.as_py(), 0) + stripe_sums(counts, totals)
        for lang, matrix in sums.items():
            for i, row in enumerate(matrix):
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(row), "i": [i] * len(row), "j": range(len(row)), "value": row})

    value = dense.mapInArrow(emit, "lang string, i long, j long, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    every = langs.select("lang", F.posexplode("sources.source").alias("i", "source"), F.col("sources.source").alias("items"))
    every = every.select("lang", "i", "source", F.posexplode("items").alias("j", "item")).where("i <> j")
    return _ranked(every.join(value, ["lang", "i", "j"], "left").na.fill(0, ["value"]).drop("i", "j"), "pair")


def _terms(kept: DataFrame, sources: DataFrame, langs: DataFrame, top_terms: int) -> DataFrame:
    def probability(count: str, total: str) -> Column:
        exact = f"(CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(20, 0))) div CAST({total} + terms AS DECIMAL(20, 0))"
        return F.expr(f"1 + CASE WHEN {count} <= {SAFE_COUNT} THEN ({SCALE} * ({count} + 1)) div ({total} + terms) ELSE {exact} END")

    in_lang = F.aggregate("stripe", F.lit(0).cast("long"), lambda n, cell: n + cell["n"])
    cells = kept.select("lang", F.col("term").alias("item"), in_lang.alias("lang_n"), F.explode("stripe").alias("cell"))
    cells = cells.select("lang", "item", "lang_n", F.col("cell.source").alias("source"), F.col("cell.n").alias("n"))
    cells = cells.join(sources, ["lang", "source"]).join(langs.select("lang", "lang_used"), "lang")
    cells = cells.select("lang", "source", "item", probability("n", "used").alias("p"), probability("lang_n", "lang_used").alias("q")).where("p > q")
    valued = cells.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    return _ranked(valued, "term").where(F.col("rank") <= top_terms)
