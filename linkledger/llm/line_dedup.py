"""Lines that many documents share: kept in one document, dropped from the others. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.functions.staging import computed_once
from linkledger.llm.common import ASCII_LOWER, ASCII_SPACE, ASCII_UPPER, cut_lineage, keyed, text_key


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), ASCII_UPPER, ASCII_LOWER)


def _lines(packed: DataFrame, min_chars: int) -> DataFrame:
    """(id, t1, t2, pos, k1, k2): one row per line that is long enough, with hashes of text and key."""
    first, second = text_key("text")
    lines = packed.select("id", first.alias("t1"), second.alias("t2"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = computed_once(lines.where(F.length("line") >= min_chars), {"key": line_key(F.col("line"))}).where(F.length("key") >= min_chars)
    return lines.select("id", "t1", "t2", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), F.col("key")).alias("k2"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(row, id, text, n_lines, n_dropped): whole texts without the lines that at least ``min_docs`` documents hold.

    A key counts once per id and needs ``min_chars`` code points. All its lines go, except those in the largest id
    that holds it. The pair (key, id) is grouped before the key, so a line in a third of all documents is counted
    from partial sums; the shared keys are stored, and the marking join, with one row per key on that side, can split
    a key that very many lines have.

    Null or empty text: one empty line, kept. Null id: its lines count for no document and are never the kept ones.
    Rows that repeat an id are one document; each gets the same answer for the same text. Keys are compared by 128
    hash bits. ``row`` holds the other input columns.
    """
    packed = keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    lines = _lines(packed, min_chars)
    shared = cut_lineage(
        lines.where(F.col("id").isNotNull())
        .groupBy("k1", "k2", "id").agg(F.lit(1).alias("one"))
        .groupBy("k1", "k2").agg(F.count("one").alias("n_docs"), F.max("id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("k1", "k2", "keeper"),
        "lines",
    )
    marked = (
        lines.join(shared, ["k1", "k2"])
        .where(F.col("id").isNull() | (F.col("id") < F.col("keeper")))
        .groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("dropped"))
        .withColumnRenamed("id", "marked_id")
    )
    first, second = text_key("text")
    whole = packed.withColumns({"p1": first, "p2": second})
    joined = whole.join(marked, (F.col("id").eqNullSafe(F.col("marked_id"))) & (F.col("p1") == F.col("t1")) & (F.col("p2") == F.col("t2")), "left")
    split = computed_once(joined.select("row", "id", "text", "dropped"), {"lines": F.split("text", "\n")})
    positions = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(positions, lambda i: F.get(F.col("lines"), i)), "\n")
    return split.select(
        "row", "id", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
