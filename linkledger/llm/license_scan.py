"""Licence notices in texts: MinHash bands over overlapping windows find templates, exact shingles decide. DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.functions.staging import computed_once
from linkledger.llm.common import ASCII_LOWER, ASCII_UPPER, keyed
from linkledger.llm.license_templates import TEMPLATES

SHINGLE = 5
CONTAINMENT = 0.8
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (words of a window, least hashes kept of its shingles). A template goes with the smallest window at least twice its length.
WINDOWS = ((16, 12), (64, 48), (256, 80), (1024, 80), (4096, 80), (16384, 80))


def words_of(text: Column) -> Column:
    """Words of letters and digits, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER), NO_WORD), "")


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """Runs of ``size`` words joined by spaces; fewer words make one run, none make none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) >= size, runs).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """One hash per run of :func:`shingles`."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, runs).when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<long>"))


def window_bands(hashes: Column, width: int, kept: int, size: int = SHINGLE) -> Column:
    """Of all windows of ``width`` words, half overlapping: their ``kept`` least distinct shingle hashes, each a band of one row.

    A repeated shingle takes one place only. A template has more than an eighth of its window's words; if 80 % of its shingles stand in
    the window, at least a tenth of the window's distinct shingles are the template's, and all of ``kept`` = 80 least hashes miss them
    with a probability below 0.9 ** 80 = 0.0002.
    """
    inside = width - size + 1
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(hashes)), F.lit(width // 2))
    if kept >= inside:  # all are kept, and halves of windows need not be listed twice
        return hashes
    return F.flatten(F.transform(starts, lambda s: F.slice(F.array_sort(F.array_distinct(F.slice(hashes, s, inside))), 1, kept)))


def _width_of(n_words: int) -> int:
    for width, _ in WINDOWS:
        if n_words <= width // 2:
            return width
    raise ValueError(f"a template has {n_words} words; the largest window takes {WINDOWS[-1][0] // 2}")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
                  containment: float = CONTAINMENT) -> DataFrame:
    """(row, id, text, n_words, licenses): the licences of which a template stands in the whole text, sorted.

    A template stands in a text if some window of words holds at least ``containment`` of its distinct five-word
    shingles; windows are twice to eight times as long as the template and overlap by half. Band hashes only pick the
    templates to look at; shingles are compared as texts. ``templates`` are constants of the program and are part of the
    plan, so nothing is joined or shuffled.

    Null or empty texts have no words and no licences; ids may be null or repeated; a template without words is left out.
    """
    spark = docs.sparkSession
    usable = [(name, text) for name, text in templates if re.search(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", text)]
    packed = keyed(docs, id_col, text_col)
    if not usable:
        return packed.withColumns({"n_words": F.size(words_of(F.col("text"))).cast("long"), "licenses": F.array().cast("array<string>")})
    library = spark.createDataFrame([(n, name, text) for n, (name, text) in enumerate(usable)], "n int, license string, text string")
    prepared = library.select("n", "license", words_of(F.col("text")).alias("w")).select("n", "license", F.size("w").alias("size"), F.array_distinct(shingles(F.col("w"))).alias("parts"), F.array_distinct(shingle_hashes(F.col("w"))).alias("keys")).orderBy("n").collect()
    with_words = computed_once(packed, {"words": words_of(F.col("text"))})
    hashed = computed_once(with_words, {"hashes": shingle_hashes(F.col("words"))})
    bands = {}
    for width, kept in WINDOWS:
        known = sorted({k for r in prepared if _width_of(r["size"]) == width for k in r["keys"]})
        if known:
            bands[f"met{width}"] = F.array_intersect(window_bands(F.col("hashes"), width, kept), F.lit(known).cast("array<long>"))
    met = computed_once(hashed, bands)

    def holds(width: int, parts: list[str]) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words")), F.lit(width // 2))
        wanted = F.lit(parts).cast("array<string>")
        shares = F.transform(starts, lambda s: F.size(F.array_intersect(wanted, shingles(F.slice(F.col("words"), s, width)))))
        return F.array_max(shares) >= containment * len(parts)

    found = []
    for r in prepared:
        width = _width_of(r["size"])
        looked_at = F.arrays_overlap(F.col(f"met{width}"), F.lit(r["keys"]).cast("array<long>"))
        found.append(F.when((F.size(f"met{width}") > 0) & looked_at, F.when(holds(width, r["parts"]), F.lit(r["license"]))))
    licenses = F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    return met.select("row", "id", "text", F.size("words").cast("long").alias("n_words"), licenses.alias("licenses"))
