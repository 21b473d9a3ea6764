"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkledger.llm.common import cut_lineage

ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least node of its neighbourhood."""
    both = edges.union(edges.select("b", "a"))
    least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut_lineage(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the least node that can be reached.

    Each round halves the paths roughly; the table is written to the shared folder after each, so a lost executor costs
    one round. Minima are reduced before they are shuffled and stored too, so that the join with them can split a hub
    with very many links. Loops are ignored;
    links with a null end too; without links the result is empty.
    """
    edges = cut_lineage(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(ROUNDS):
        edges = cut_lineage(_small(_large(edges)), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"the components have not settled after {ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()
