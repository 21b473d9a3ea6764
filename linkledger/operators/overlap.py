"""Set similarity join with a prefix filter: records whose tokens overlap with those of a wall, without pairing everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.operators.matching import tokens

#: Postings of a token that one task works on; a more frequent token is dealt in parts.
PART = 4096
SLACK = 1e-9


def token_sets(rows: DataFrame, ident: str, texts: str) -> DataFrame:
    """(tokens, members, least): the distinct token sets of a table, how many rows have each, and the least of their ids."""
    sets = rows.select(F.array_sort(tokens(texts)).alias("tokens"), F.col(ident).alias("id")).where(F.size("tokens") > 0)
    return sets.groupBy("tokens").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("least"))


def by_rarity(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``ranked``: the tokens of each set from rare to frequent, ties by name."""
    each = sets.select("tokens", F.explode("tokens").alias("token")).join(counts, "token")
    ranked = each.groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("r"))
    return sets.join(ranked.select("tokens", F.col("r.token").alias("ranked")), "tokens")


def _prefix(sets: DataFrame, least: float, side: str) -> DataFrame:
    """One row per set and token of its prefix: two sets with an overlap of ``least`` share a token of their prefixes."""
    length = F.size("ranked") - F.ceil(F.size("ranked") * least - SLACK).cast("int") + 1
    prefix = F.slice("ranked", 1, length)
    return sets.select(F.posexplode(prefix).alias(f"{side}_at", "token"), F.size("ranked").alias(f"{side}_size"), F.col("tokens").alias(f"{side}_tokens"))


def candidate_sets(walls: DataFrame, records: DataFrame, least: float, part: int = PART) -> DataFrame:
    """Distinct pairs (w_tokens, r_tokens) of sets that may overlap by ``least``.

    Sets meet at shared tokens of their prefixes, if their sizes allow the overlap and the tokens behind the meeting place
    suffice. The postings of a frequent token are dealt in parts of about ``part`` sets, each met by the walls on its own.
    """
    w, r = _prefix(walls, least, "w"), _prefix(records, least, "r")
    parts = r.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    asked = w.join(parts, "token").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")
    held = r.join(parts, "token").withColumn("part", F.pmod(F.xxhash64("r_tokens"), F.col("parts")).cast("int")).drop("parts")
    sizes = (F.col("r_size") >= F.col("w_size") * least - SLACK) & (F.col("w_size") >= F.col("r_size") * least - SLACK)
    needed = (F.col("w_size") + F.col("r_size")) * least / (1 + least) - SLACK
    left = 1 + F.least(F.col("w_size") - 1 - F.col("w_at"), F.col("r_size") - 1 - F.col("r_at"))
    # A pair that meets at several prefix tokens is wanted once.
    met = asked.join(held, ["token", "part"]).where(sizes)
    return met.groupBy("w_tokens", "r_tokens").agg(F.max((left >= needed).cast("int")).alias("enough"), F.min("w_at").alias("at")).where("enough = 1").select("w_tokens", "r_tokens")


def best_overlaps(walls: DataFrame, registry: DataFrame, least: float, part: int = PART, wall_id: str = "gid", wall_texts: str = "materials",
                  record_id: str = "record_uri", record_texts: str = "layer_names") -> DataFrame:
    """Per wall: how many records share at least ``least`` (over 0, up to 1) of all their tokens with it, how many token sets were compared for that, and the best record.

    Tokens and the overlap are those of :func:`linkledger.operators.matching.token_overlap`. Rows with equal token sets are compared once; of equally
    near records the least id wins. A wall without tokens, or without such a record, has none. No record is left out of the search.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    w, r = token_sets(walls, wall_id, wall_texts), token_sets(registry, record_id, record_texts)
    # A set counts once, so that many copies of one wall do not change which tokens are rare.
    counts = w.select("tokens").union(r.select("tokens")).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    pairs = candidate_sets(by_rarity(w, counts), by_rarity(r, counts), least, part)
    scored = pairs.withColumn("overlap", _overlap("w_tokens", "r_tokens")).join(r.select(F.col("tokens").alias("r_tokens"), "members", "least"), "r_tokens")
    near = F.col("overlap") >= least - SLACK
    found = scored.groupBy(F.col("w_tokens").alias("tokens")).agg(
        F.sum(F.when(near, F.col("members")).otherwise(0)).alias("matches"), F.count(F.lit(1)).alias("compared"),
        F.min(F.when(near, F.struct((-F.col("overlap")).alias("o"), F.col("least").alias("id")))).alias("best"))
    asked = walls.select(F.col(wall_id).alias("gid"), F.array_sort(tokens(wall_texts)).alias("tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return asked.join(found, "tokens", "left").select("gid", zero("matches"), zero("compared"), F.col("best.id").alias("best"), (-F.col("best.o")).alias("overlap"))


def _overlap(a: str, b: str) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)
