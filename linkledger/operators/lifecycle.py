"""How relations age: versions, reassessment triggers, histories, evidence and relation types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.operators.ordered import ordered, time_chunk

# ---- Fixed values: trigger category, severity, resulting state and action per changed attribute.
TRIGGERS = {
    "ifc_checksum": ("component-semantic", "HIGH", "SEMANTICALLY_STALE", "reassess relationship"),
    "ifc_schema": ("component-semantic", "MEDIUM", "MANUAL_REVIEW", "review mapping"),
    "global_id": ("relationship-target", "HIGH", "INVALID", "retarget relationship"),
    "entity_type": ("component-semantic", "HIGH", "SEMANTICALLY_STALE", "reassess relationship"),
    "material": ("component-semantic", "HIGH", "SEMANTICALLY_STALE", "reassess relationship"),
    "thickness": ("component-semantic", "HIGH", "SEMANTICALLY_STALE", "reassess relationship"),
    "data_checksum": ("measurement-content", "HIGH", "SEMANTICALLY_STALE", "reassess relationship"),
    "data_version": ("measurement-content", "MEDIUM", "SEMANTICALLY_STALE", "reassess relationship"),
    "data_uri": ("access", "MEDIUM", "MANUAL_REVIEW", "check resource"),
    "provenance": ("provenance", "MEDIUM", "MANUAL_REVIEW", "review provenance"),
    "licence": ("access", "LOW", "ACCEPTABLE", "reassess access"),
    "profile_version": ("profile", "LOW", "ACCEPTABLE", "reassess metadata"),
    "relation_type": ("review", "HIGH", "MANUAL_REVIEW", "review relationship"),
    "evidence": ("review", "MEDIUM", "MANUAL_REVIEW", "review evidence"),
    "title": ("editorial", "INFO", "ACCEPTABLE", "none"),
}
EVIDENCE_STATES = ("SUPPORTS", "CONTRADICTS", "MISSING", "NOT_APPLICABLE", "NOT_VERIFIED", "REQUIRES_REVIEW")
MEASUREMENT_ORIGINS = ("RAW_MEASUREMENT", "PROCESSED_MEASUREMENT")


def with_trigger_meaning(changes: DataFrame, table: Mapping[str, tuple] = TRIGGERS) -> DataFrame:
    """Add category, severity, resulting state and action to rows with ``attribute``; unknown ones go to review."""
    cell = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k, t in table.items() for v in (k, t[i])]), F.col("attribute")),
                                F.lit(("review", "MEDIUM", "MANUAL_REVIEW", "review change")[i]))
    return changes.withColumns({n: cell(i) for i, n in enumerate(("category", "severity", "resulting_state", "action"))})


def reassessment_triggers(versions: DataFrame, attrs: Sequence[str], key: str = "entity", order: Sequence[str] = ("ts", "version"),
                          chunk: Column | None = None, table: Mapping[str, tuple] = TRIGGERS) -> DataFrame:
    """One row per attribute that differs from the entity's previous version; a first version triggers nothing."""
    chunk = time_chunk(order[0]) if chunk is None else chunk
    base = versions.withColumn("__seen", F.lit(True))
    lagged = ordered(base, [key], list(order), chunk, lag={**{f"__old_{a}": a for a in attrs}, "__prev": "__seen"})
    changes = F.array_compact(F.array(*[
        F.when(~F.col(a).eqNullSafe(F.col(f"__old_{a}")), F.struct(F.lit(a).alias("attribute"), F.col(f"__old_{a}").cast("string").alias("old"),
                                                                    F.col(a).cast("string").alias("new"))) for a in attrs]))
    rows = lagged.where(F.col("__prev")).select(key, *order, F.explode(changes).alias("c")).select(key, *order, "c.*")
    identity = F.sha2(F.concat_ws("|", F.col(key).cast("string"), *[F.col(o).cast("string") for o in order], "attribute"), 256)
    return with_trigger_meaning(rows.withColumn("trigger_id", identity), table)


def assertion_history(assertions: DataFrame, key: str, order: Sequence[str], ident: str, chunk: Column | None = None) -> DataFrame:
    """Revision number, pointer to the previous assertion and ``is_current`` per relation; nothing is overwritten."""
    chunk = time_chunk(order[0]) if chunk is None else chunk
    return ordered(assertions, [key], list(order), chunk, lag={"previous": ident}, rank="revision", last_flag="is_current")


def asof_version(decisions: DataFrame, versions: DataFrame, key: str = "entity", ts: str = "ts", version: str = "version",
                 carry: Sequence[str] = (), ident: str = "decision_id", chunk: Column | None = None) -> DataFrame:
    """For each decision, the latest version of its entity at or before the decision time.

    Both sides are merged in time order and the last version is carried forward; no range join.
    """
    kinds = versions.select(key, ts, F.lit(0).alias("__kind"), F.lit(None).cast(decisions.schema[ident].dataType).alias(ident),
                            F.col(version).alias("__order"), F.struct(ts, version, *carry).alias("__seen"))
    asks = decisions.select(key, ts, F.lit(1).alias("__kind"), ident, F.lit(None).cast(versions.schema[version].dataType).alias("__order"),
                            F.lit(None).cast(kinds.schema["__seen"].dataType).alias("__seen"))
    chunk = time_chunk(ts) if chunk is None else chunk
    merged = ordered(kinds.unionByName(asks), [key], [ts, "__kind", "__order", ident], chunk, running_max={"__last": "__seen"})
    found = merged.where(F.col("__kind") == 1)
    return found.select(ident, key, ts, F.col(f"__last.{version}").alias(version), F.col(f"__last.{ts}").alias("version_ts"),
                        *[F.col(f"__last.{c}").alias(c) for c in carry])


def evidence_summary(evidence: DataFrame, key: str = "relation_id", states: Sequence[str] = EVIDENCE_STATES) -> DataFrame:
    """Evidence counts per relation and comparison status. Counts only, never a score."""
    pivoted = evidence.groupBy(key).pivot("comparison", list(states)).agg(F.count(F.lit(1)))
    return pivoted.na.fill(0, list(states))


def contradictions(evidence: DataFrame) -> DataFrame:
    return evidence.where(F.col("comparison") == "CONTRADICTS")


def relation_type_guard(relations: DataFrame, restricted: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Relations whose type their data origin does not allow."""
    restricted = {"measuredOn": MEASUREMENT_ORIGINS} if restricted is None else restricted
    bad = F.lit(False)
    for kind, origins in restricted.items():
        bad = bad | ((F.col("relation_type") == kind) & ~F.coalesce(F.col("origin").isin(list(origins)), F.lit(False)))
    return relations.where(bad)
