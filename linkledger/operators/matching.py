"""Evidence-based matching of model walls to reference records, and the scenario reports built on it.

Candidate search never lists wall-record pairs: a family can hold a large share of both sides. Counts and the
single or nearest candidate come from aggregates and running values, which answer for every wall exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.functions.text import keyword_value
from linkledger.operators.ordered import number_chunk, ordered

THICKNESS_TOLERANCE = 0.020
MIN_OVERLAP = 0.5
# A decimal tolerance is met by its own binary neighbours too.
SLACK = 1e-12

# ---- Fixed values: keywords that name a construction family.
FAMILY_KEYWORDS = {
    "metal frame": "metal_frame", "metal stud": "metal_frame", "metallständer": "metal_frame",
    "concrete": "concrete", "beton": "concrete",
    "wood": "wood", "timber": "wood", "madera": "wood", "holz": "wood",
}
# ---- Fixed values: letter runs that carry no material meaning.
STOP_TOKENS = ("mit",)


def construction_family(text: Column | str, keywords: Mapping[str, str] = FAMILY_KEYWORDS) -> Column:
    """Family of a free text by its longest keyword, ``unknown`` without one."""
    return keyword_value(text, keywords, "unknown")


def tokens(texts: Column | str) -> Column:
    """Distinct lower-case letter runs of three or more letters in an array of texts."""
    joined = F.lower(F.array_join(F.col(texts) if isinstance(texts, str) else texts, " "))
    runs = F.regexp_extract_all(joined, F.lit(r"(\p{L}+)"), F.lit(1))
    return F.array_distinct(F.filter(runs, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_TOKENS)))


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """Shared over all tokens of two arrays of texts; 0 when there is none."""
    left, right = tokens(a), tokens(b)
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)


def find_candidates(walls: DataFrame, registry: DataFrame) -> DataFrame:
    """Per wall: number of records of its family, the record when there is exactly one, and the status.

    The records of a family are the registry rows with that family; they are not repeated for each wall.
    """
    families = registry.groupBy("family").agg(F.count(F.lit(1)).alias("__n"), F.min("record_uri").alias("__only"))
    joined = walls.join(families, "family", "left")
    n = F.coalesce("__n", F.lit(0))
    status = F.when(n == 0, "UNMATCHED").when(n > 1, "MULTIPLE_CANDIDATES").otherwise("CANDIDATE")
    return joined.select("gid", "family", n.cast("bigint").alias("candidates"), F.when(n == 1, F.col("__only")).alias("candidate"), status.alias("status"))


def band_candidates(walls: DataFrame, registry: DataFrame, tol: float = THICKNESS_TOLERANCE, width: float | None = None) -> DataFrame:
    """Per wall: how many records of its family lie within ``tol`` of its thickness, and the nearest one.

    Records are first reduced to one row per (family, thickness). A sorted merge of records and wall bounds then
    turns each band into a difference of running counts; nothing grows with the number of pairs. Of equally near
    records the thinner wins, then the smaller URI.
    """
    distinct = registry.where(F.col("thickness_m").isNotNull()).groupBy("family", F.col("thickness_m").alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.min("record_uri").alias("uri"))
    spots = walls.where(F.col("thickness_m").isNotNull()).select("family", F.col("thickness_m").alias("at")).distinct()
    # Marks at equal value sort: lower bound, record, wall itself, upper bound.
    reach = tol + SLACK
    marks = F.array(F.struct((F.col("at") - reach).alias("t"), F.lit(0).alias("kind")), F.struct(F.col("at").alias("t"), F.lit(2).alias("kind")),
                    F.struct((F.col("at") + reach).alias("t"), F.lit(3).alias("kind")))
    queries = spots.select("family", "at", F.explode(marks).alias("m")).select(
        "family", "m.t", "m.kind", "at", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("uri"))
    points = distinct.select("family", "t", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("at"), "n", "uri")
    line = points.unionByName(queries)
    step = width or max(tol, 1e-9)
    seen = F.when(F.col("kind") == 1, F.struct("t", "uri"))
    up = ordered(line.withColumn("seen", seen), ["family"], ["t", "kind", "at"], number_chunk("t", step),
                 running_sum={"below": "n"}, running_max={"lower": "seen"})
    # The same walk from the other end, for the nearest record above.
    mirrored = line.select("family", (-F.col("t")).alias("t"), (3 - F.col("kind")).alias("kind"), "at", "n",
                           F.when(F.col("kind") == 1, F.struct((-F.col("t")).alias("t"), "uri")).alias("seen"))
    down = ordered(mirrored, ["family"], ["t", "kind", "at"], number_chunk("t", step), running_max={"upper": "seen"})
    counted = up.where(F.col("kind") != 1).groupBy("family", "at").agg(
        (F.max(F.when(F.col("kind") == 3, F.col("below"))) - F.max(F.when(F.col("kind") == 0, F.col("below")))).alias("in_band"),
        F.max(F.when(F.col("kind") == 2, F.col("lower"))).alias("lower"))
    above = down.where(F.col("kind") == 1).groupBy("family", "at").agg(F.max("upper").alias("upper"))
    merged = counted.join(above, ["family", "at"])
    gap_low, gap_up = F.col("at") - F.col("lower.t"), -F.col("upper.t") - F.col("at")
    take_low = F.col("upper").isNull() | (F.col("lower").isNotNull() & (gap_low <= gap_up))
    near = merged.select("family", "at", "in_band", F.when(take_low, F.col("lower.uri")).otherwise(F.col("upper.uri")).alias("nearest"),
                         F.when(take_low, gap_low).otherwise(gap_up).alias("nearest_delta"))
    return (walls.join(near.withColumnRenamed("at", "thickness_m"), ["family", "thickness_m"], "left")
            .select("gid", "family", "thickness_m", F.coalesce("in_band", F.lit(0)).alias("in_band"), "nearest", "nearest_delta"))


def match_status(links: DataFrame, walls: DataFrame, registry: DataFrame, tol: float = THICKNESS_TOLERANCE,
                 min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Status and rationale of each link ``(link_id, gid, record_uri)``.

    A record that cannot be resolved is BROKEN, a different family INVALID; equal family with thickness and
    material evidence ACCEPTABLE, otherwise AMBIGUOUS with every failed test named.
    """
    w = walls.select("gid", F.col("family").alias("wall_family"), F.col("thickness_m").alias("wall_thickness_m"), F.col("materials").alias("w_m"))
    r = registry.select("record_uri", F.col("family").alias("record_family"), F.col("thickness_m").alias("record_thickness_m"),
                        F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("layer_names", "layer_categories")]).alias("r_m"), F.lit(True).alias("resolved"))
    joined = links.join(w, "gid", "left").join(r, "record_uri", "left")
    resolved = F.coalesce("resolved", F.lit(False))
    same = F.col("wall_family").eqNullSafe(F.col("record_family"))
    delta = F.when(resolved & same, F.abs(F.col("wall_thickness_m") - F.col("record_thickness_m")))
    overlap = F.when(resolved, F.when(same, token_overlap("w_m", "r_m")).otherwise(0.0))
    scored = joined.withColumns({"resolved": resolved, "thickness_delta_m": delta, "overlap": overlap})
    thick_ok = F.coalesce(F.col("thickness_delta_m") <= tol + SLACK, F.lit(False))
    enough = F.coalesce(F.col("overlap") >= min_overlap, F.lit(False))
    status = F.when(~resolved, "BROKEN").when(~same, "INVALID").when(thick_ok & enough, "ACCEPTABLE").otherwise("AMBIGUOUS")
    failed = F.concat_ws("; ", F.when(F.col("thickness_delta_m").isNull(), "total thickness is not given on both sides")
                         .when(~thick_ok, F.format_string(f"total-thickness difference is %.3f m (> {tol:.3f} m tolerance)", "thickness_delta_m")),
                         F.when(~enough, "IFC material/layer evidence is insufficient to reproduce the tested assembly"))
    why = (F.when(status == "BROKEN", "The IFC/reference identifier is retained, but the referenced external record is unavailable in the registry.")
           .when(status == "INVALID", F.format_string("Construction-family mismatch: IFC wall=%s, external record=%s.", "wall_family", "record_family"))
           .when(status == "ACCEPTABLE", "Construction family agrees and both thickness and material/layer evidence are compatible within the controlled criteria.")
           .otherwise(F.concat(failed, F.lit("."))))
    return scored.select("link_id", "gid", "record_uri", "resolved", "wall_family", "record_family", "wall_thickness_m", "record_thickness_m",
                         "thickness_delta_m", "overlap", status.alias("status"), why.alias("rationale"))


def staleness(history: DataFrame, chunk: Column, order: Sequence[str] = ("version",)) -> DataFrame:
    """Add ``prior_status`` and turn ACCEPTABLE -> INVALID with a resolving record into SEMANTICALLY_STALE.

    ``history(link_id, version, status, resolved)``; ``chunk`` splits long histories without disturbing their order.
    """
    out = ordered(history, ["link_id"], list(order), chunk, lag={"prior_status": "status"})
    stale = (F.col("prior_status") == "ACCEPTABLE") & (F.col("status") == "INVALID") & F.col("resolved")
    return out.withColumn("observed", F.when(stale, "SEMANTICALLY_STALE").otherwise(F.col("status")))


# ------------------------------------------------------------------ reports over scenarios

def case_scope(cases: DataFrame) -> DataFrame:
    """Real and controlled cases and the total."""
    return cases.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("case_kind").contains("ACTUAL_IFC")).alias("real_cases"),
                     F.count_if(F.col("case_kind").contains("CONTROLLED")).alias("controlled_cases"))


def family_counts(walls: DataFrame) -> DataFrame:
    return walls.groupBy("family").agg(F.count(F.lit(1)).alias("walls"))


def tolerance_sweep(cases: DataFrame, tolerances: Sequence[float] = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20)) -> DataFrame:
    """Acceptable and ambiguous cases per tolerance, from one pass with one pair of counters per tolerance."""
    with_delta = cases.where(F.col("thickness_delta_m").isNotNull())
    same = F.col("wall_family") == F.col("record_family")
    counters = [F.count(F.lit(1)).alias("total")]
    for i, tol in enumerate(tolerances):
        counters += [F.count_if(same & (F.col("thickness_delta_m") <= tol + SLACK)).alias(f"a{i}"), F.count_if(same & (F.col("thickness_delta_m") > tol + SLACK)).alias(f"b{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("tolerance_m"), F.col(f"a{i}").alias("acceptable"), F.col(f"b{i}").alias("ambiguous"))
                               for i, t in enumerate(tolerances)]))
    out = with_delta.agg(*counters).select("total", rows.alias("r")).select("total", "r.*")

    def share(c: str) -> Column:
        return F.when(F.col("total") > 0, F.bround(F.try_divide(F.col(c), F.col("total")) * 100, 1)).otherwise(0.0)

    return out.select("tolerance_m", "acceptable", "ambiguous", share("acceptable").alias("acceptable_pct"), share("ambiguous").alias("ambiguous_pct"))


# ---- Fixed values: the seven counters and what they look at.
def _causes() -> dict[str, Column]:
    why, status = F.lower(F.coalesce("rationale", F.lit(""))), F.col("observed")
    return {
        "insufficient_ifc_detail": why.contains("insufficient") | why.contains("material/layer evidence"),
        "thickness_mismatch": why.contains("thickness") & (status == "AMBIGUOUS"),
        "family_mismatch": why.contains("family") & why.contains("mismatch"),
        "no_candidates": status == "UNMATCHED",
        "multiple_candidates": status == "MULTIPLE_CANDIDATES",
        "resource_unavailable": status == "BROKEN",
        "semantic_staleness": status == "SEMANTICALLY_STALE",
    }


def root_causes(cases: DataFrame) -> DataFrame:
    """Cases per cause; a case can count for several."""
    hits = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in _causes().items()]))
    return cases.select(F.explode(hits).alias("cause")).groupBy("cause").agg(F.count(F.lit(1)).alias("cases"))


def cases_by_status(cases: DataFrame, status: str) -> DataFrame:
    return cases.where(F.col("observed") == status)


def scope_summary(cases: DataFrame, walls: DataFrame) -> DataFrame:
    """One row: walls, scenarios, distinct families and statuses, causes that occur."""
    key = F.lit(1).alias("__k")
    per_case = cases.agg(F.count(F.lit(1)).alias("scenarios"), F.count_distinct("observed").alias("statuses"))
    per_wall = walls.agg(F.count(F.lit(1)).alias("walls"), F.count_distinct("family").alias("families"))
    causes = root_causes(cases).agg(F.count(F.lit(1)).alias("causes"))
    return per_case.select("*", key).join(per_wall.select("*", key), "__k").join(causes.select("*", key), "__k").drop("__k")


def agreement(cases: DataFrame) -> DataFrame:
    """Cases whose observed status equals the stated truth, by kind and in total (kind null)."""
    return cases.rollup("case_kind").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("truth") == F.col("observed")).alias("agree"))


def retrieval_scores(results: DataFrame, *dims: str) -> DataFrame:
    """Answered over asked questions with subtotals over the dimensions."""
    out = results.rollup(*dims).agg(F.sum("answered").alias("answered"), F.sum("total").alias("total"))
    return out.withColumn("share", F.try_divide(F.col("answered"), F.col("total")))


def overhead(results: DataFrame, measures: Sequence[str], baseline: str, key: str = "approach", scope: Sequence[str] = ()) -> DataFrame:
    """Difference of each measure to the baseline approach (one row per scope)."""
    base = results.where(F.col(key) == baseline).groupBy(*scope).agg(*[F.max(m).alias(f"__{m}") for m in measures])
    if scope:
        joined = results.join(base, list(scope), "left")
    else:
        joined = results.withColumn("__k", F.lit(1)).join(base.withColumn("__k", F.lit(1)), "__k", "left").drop("__k")
    return joined.select(*results.columns, *[(F.col(m) - F.col(f"__{m}")).alias(f"{m}_delta") for m in measures])


def independence_matrix(results: DataFrame, scenarios: Sequence[str], changed: str) -> DataFrame:
    """Per approach and scenario: did anything of the given kind change."""
    return results.groupBy("approach").pivot("scenario", list(scenarios)).agg(F.bool_or(F.col(changed)))
