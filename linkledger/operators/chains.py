"""Chains of pointers followed to their ends in rounds that double the reach: superseded assertions and linked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkledger.session import cut_lineage


def follow_pointers(links: DataFrame, node: str = "node", next_: str = "next", flag: str | None = None) -> DataFrame:
    """(node, end, steps, cyclic, flagged): where each node's chain ends and how far that is.

    ``links(node, next)`` has one row per node at most; a null ``next`` ends a chain, as does a node without a row (such ends
    have a row in the result, too). Each round replaces a pointer by that of its target, so a chain of n nodes takes log2 n rounds;
    each is one join on the node, written to the shared folder. Nodes that have reached their end are set aside and only looked up.
    Nodes on a cycle, or leading to one, are ``cyclic``, with null ``end`` and ``steps``: the least node among those passed so far
    is kept for every node, and the least node of a cycle meets itself as soon as the reach is as long as the cycle. So rounds
    depend on the longest chain, not on the number of nodes. ``flagged`` tells if the boolean column ``flag`` is set on the way.
    """
    own = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    given = links.select(F.col(node).alias("node"), F.col(next_).alias("at"), own.alias("flagged"))
    ends = given.where("at IS NOT NULL").select(F.col("at").alias("node")).join(given.where("node IS NOT NULL").select("node"), "node", "left_anti").distinct()
    start = given.unionByName(ends.select("node", F.lit(None).cast(given.schema["at"].dataType).alias("at"), F.lit(False).alias("flagged")))
    ended = F.col("at").isNull()
    start = cut_lineage(start.select("node", "at", F.when(ended, F.col("node")).alias("end"), F.when(ended, 0).otherwise(1).cast("long").alias("steps"),
                                     "flagged", F.lit(False).alias("cyclic"), F.col("at").alias("least")), "pointers")
    settled, active = start.where(ended), start.where(~ended)
    while True:
        left, met = active.agg(F.count(F.lit(1)), F.count_if(F.col("least") == F.col("node"))).first()
        if not left:
            return settled.select("node", "end", "steps", "cyclic", "flagged")
        if met:
            # All nodes of such a cycle have passed its least node by now.
            cycles = active.where(F.col("least") == F.col("node")).select("least", F.lit(True).alias("met"))
            found = F.coalesce("met", F.lit(False))
            marked = cut_lineage(active.join(cycles, "least", "left").select(
                "node", F.when(~found, F.col("at")).alias("at"), "end", F.when(~found, F.col("steps")).alias("steps"), "flagged", found.alias("cyclic"), "least"), "pointers")
            settled, active = settled.unionByName(marked.where(ended)), marked.where(~ended)
        ahead = settled.unionByName(active).select(
            F.col("node").alias("at"), F.col("at").alias("further"), F.col("end").alias("reached"), F.col("steps").alias("more"),
            F.col("flagged").alias("flagged_on"), F.col("cyclic").alias("cyclic_on"), F.col("least").alias("least_on"))
        stepped = cut_lineage(active.join(ahead, "at").select(
            "node", F.col("further").alias("at"), F.col("reached").alias("end"), (F.col("steps") + F.col("more")).alias("steps"),
            (F.col("flagged") | F.col("flagged_on")).alias("flagged"), F.col("cyclic_on").alias("cyclic"), F.least("least", "least_on").alias("least")), "pointers")
        settled, active = settled.unionByName(stepped.where(ended)), stepped.where(~ended)


def assertion_heads(assertions: DataFrame, ident: str = "assertion", superseded_by: str = "superseded_by") -> DataFrame:
    """(assertion, head, steps, reason): the assertion that is current now in place of each, by its superseded-by links.

    ``assertions`` may name an assertion several times with different successors: such a ``fork`` follows the least of them.
    Reasons: ``cycle`` (no head), ``unknown successor`` (the head is not an assertion of the table), ``fork`` (somewhere on the
    way), in that order; null otherwise. Nothing is overwritten or left out.
    """
    pairs = assertions.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("node")).agg(
        F.min(superseded_by).alias("next"), (F.count_distinct(superseded_by) > 1).alias("forked"))
    pairs = cut_lineage(pairs, "assertion-links")
    ways = follow_pointers(pairs, flag="forked")
    known = pairs.select(F.col("node").alias("end"), F.lit(True).alias("known"))
    joined = pairs.select("node").join(ways, "node").join(known, "end", "left")
    reason = F.when(F.col("cyclic"), "cycle").when(F.col("known").isNull(), "unknown successor").when(F.col("flagged"), "fork")
    return joined.select(F.col("node").alias("assertion"), F.col("end").alias("head"), "steps", reason.alias("reason"))


def list_places(cells: DataFrame, node: str = "s", next_: str = "o", nil: str | None = None) -> DataFrame:
    """(cell, head, place): the first cell of the list that each cell belongs to, and its place from 0.

    ``cells(s, o)`` are the links to the rest of the list; links to ``nil`` end it. Walks from each cell back to the cell that none
    points to. Cells that several cells point to follow the least; cells of a cycle have neither head nor place.
    """
    links = cells.select(F.col(node).alias("a"), F.col(next_).alias("b"))
    links = links.where(F.col("b") != nil) if nil is not None else links.where("b IS NOT NULL")
    back = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("next"))
    every = cells.select(F.col(node).alias("node")).distinct()
    found = follow_pointers(back)
    return every.join(found, "node", "left").select(
        F.col("node").alias("cell"), F.when(F.coalesce("cyclic", F.lit(False)), F.lit(None)).otherwise(F.coalesce("end", "node")).alias("head"),
        F.when(F.coalesce("cyclic", F.lit(False)), F.lit(None)).otherwise(F.coalesce("steps", F.lit(0))).cast("long").alias("place"))
