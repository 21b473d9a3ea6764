"""Do files, records, manifest and model elements still agree: per point, per layer and overall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.functions.text import file_name

TOLERANCE = 1e-9


def _reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """Array of the texts whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(text) if isinstance(text, str) else text) for test, text in pairs]))


def checksum_check(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Recorded against actual hash of every referenced file: ``match``, ``MISMATCH`` or ``file not found``.

    ``refs(record_id, url, sha256)``; entries without a URL are skipped. A file without a recorded value is a mismatch.
    Where files of several folders have the name, one that has the recorded hash is a match; else the least hash is shown.
    """
    wanted = refs.where(F.col("url").isNotNull()).select("*", file_name("url").alias("file"))
    same = inventory.select(F.col("name").alias("file"), "sha256", F.col("sha256").alias("same")).distinct()
    any_ = inventory.groupBy(F.col("name").alias("file")).agg(F.min("sha256").alias("least"))
    joined = wanted.join(same, ["file", "sha256"], "left").join(any_, "file", "left").withColumn("actual", F.coalesce("same", "least"))
    status = (F.when(F.col("actual").isNull(), "file not found")
              .when(F.col("actual") == F.col("sha256"), "match").otherwise("MISMATCH"))
    role = F.when(F.lower("file").endswith(".ifc"), "IFC model").otherwise("Measurement file")
    return joined.select("record_id", role.alias("role"), "file", F.coalesce("sha256", F.lit("")).alias("recorded"),
                         F.coalesce("actual", F.lit("")).alias("actual"), status.alias("status"))


def element_check(bound: DataFrame, current: DataFrame) -> DataFrame:
    """``ok``, ``CHANGED``, ``MISSING`` or ``unchecked`` per bound element.

    ``bound(record_id, gid, fingerprint)`` against ``current(gid, fingerprint)``; a current row without a
    fingerprint is an element whose geometry could not be built. Of current rows that repeat an id, the least counts.
    """
    now = current.groupBy("gid").agg(F.min("fingerprint").alias("now")).withColumn("found", F.lit(True))
    joined = bound.join(now, "gid", "left")
    state = (F.when(F.col("found").isNull(), "MISSING").when(F.col("now").isNull(), "unchecked")
             .when(F.col("now") == F.col("fingerprint"), "ok").otherwise("CHANGED"))
    return joined.select("record_id", "gid", state.alias("state"))


def known_set(record_paths: DataFrame, view_paths: DataFrame) -> DataFrame:
    """Every path some record or view names."""
    return record_paths.select("path").union(view_paths.select("path")).distinct()


def untracked_files(inventory: DataFrame, known: DataFrame) -> DataFrame:
    """Files on disk that nothing names."""
    return inventory.join(known.select("path"), "path", "left_anti")


def reconcile_keys(records: DataFrame, view: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, flagged ``record without view`` or ``view without record``."""
    a, b = records.select(key).distinct(), view.select(key).distinct()
    return (a.join(b, key, "left_anti").withColumn("side", F.lit("record without view"))
            .unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("view without record"))))


def coordinates_differ(a: str, b: str, tol: float = TOLERANCE) -> Column:
    """Is any of the prefixed x, y, z further apart than ``tol``; a missing one differs."""
    apart = [~F.coalesce(F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) <= tol, F.lit(False)) for c in "xyz"]
    return reduce(lambda p, q: p | q, apart)


def coordinate_check(headers: DataFrame, records: DataFrame, key: str = "point", tol: float = TOLERANCE) -> DataFrame:
    """Header against record position per key, ``agrees`` within the tolerance."""
    h = headers.select(key, *[F.col(c).alias(f"h_{c}") for c in "xyz"])
    r = records.select(key, *[F.col(c).alias(f"r_{c}") for c in "xyz"])
    return h.join(r, key).select(key, (~coordinates_differ("h_", "r_", tol)).alias("agrees"),
                                 *[(F.col(f"h_{c}") - F.col(f"r_{c}")).alias(f"d{c}") for c in "xyz"])


def latest_build(manifest: DataFrame, package: str | None = None) -> DataFrame:
    """Entries of the last build, per ``package`` if that column is named; a manifest without ``build_id`` is one build.

    Build ids sort by time.
    """
    if "build_id" not in manifest.columns:
        return manifest
    if package is None:
        return manifest.where(F.col("build_id") == manifest.agg(F.max("build_id")).scalar())
    last = manifest.groupBy(package).agg(F.max("build_id").alias("build_id"))
    return manifest.join(last, [package, "build_id"], "left_semi")


def _one_per_key(lookup: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of a lookup table: of repeated keys the least row."""
    rest = [c for c in lookup.columns if c not in keys]
    return lookup.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, "__row.*") if rest else lookup.distinct()


def edited_after_build(manifest: DataFrame, inventory: DataFrame, kinds: tuple[str, ...] = ("record", "derived")) -> DataFrame:
    """Entries of the last build of the given kinds with ``state``: ``unchanged``, ``edited`` or ``not found``."""
    entries = latest_build(manifest).where(F.col("kind").isin(list(kinds))).select("kind", "path", F.col("sha256").alias("built"))
    joined = entries.join(_one_per_key(inventory.select("path", F.col("sha256").alias("now")), ["path"]), "path", "left")
    state = F.when(F.col("now").isNull(), "not found").when(F.col("now") == F.col("built"), "unchanged").otherwise("edited")
    return joined.select("kind", "path", state.alias("state"))


NO_MANIFEST = "no manifest: edits of records, view or cache cannot be detected"
BROKEN_MANIFEST = "manifest is not valid JSON"


def manifest_notes(packages: DataFrame, manifests: DataFrame, package: str = "package") -> DataFrame:
    """``(package, note)`` of every package whose edits cannot be detected: no manifest, or one that cannot be read.

    ``manifests(package, text)`` holds manifest files as found. Of several files of a package one readable is enough; an
    empty file, and a file that holds no JSON object, is unreadable.
    """
    doc = F.try_parse_json("text")
    readable = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    found = manifests.where(F.col(package).isNotNull()).groupBy(package).agg(F.bool_or(readable).alias("__readable"))
    joined = packages.select(package).distinct().join(found, package, "left")
    note = F.when(F.col("__readable").isNull(), NO_MANIFEST).when(~F.col("__readable"), BROKEN_MANIFEST)
    return joined.select(package, note.alias("note")).where(F.col("note").isNotNull())


def element_verdict(bindings: DataFrame, inventory: DataFrame, checks: DataFrame) -> DataFrame:
    """Model layer per record: ``valid``, ``stale`` or ``unverified`` with reason and note.

    ``bindings(record_id, model_url, model_sha256)``, ``checks`` from :func:`element_check`.
    """
    states = checks.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("elements"), F.count_if(F.col("state").isin("CHANGED", "MISSING")).alias("bad"),
        F.count_if(F.col("state") == "unchecked").alias("open"))
    files = inventory.select(F.col("path").alias("model_url"), F.col("sha256").alias("actual"))
    joined = bindings.join(files, "model_url", "left").join(states, "record_id", "left")
    elements, bad, unchecked = (F.coalesce(c, F.lit(0)) for c in ("elements", "bad", "open"))
    case = (F.when(F.col("model_url").isNull(), "no locator").when(F.col("actual").isNull(), "missing file")
            .when(F.col("actual") == F.col("model_sha256"), "same file").when(elements == 0, "no fingerprints")
            .when(bad > 0, "elements differ").when(unchecked > 0, "elements unchecked").otherwise("same elements"))
    verdicts = {"no locator": "unverified", "missing file": "stale", "same file": "valid", "no fingerprints": "unverified",
                "elements differ": "stale", "elements unchecked": "unverified", "same elements": "valid"}
    whys = {"no locator": "record names no model file", "missing file": "model file not found", "same file": None,
            "no fingerprints": "model file changed and no element fingerprints to compare",
            "elements differ": "model element(s) changed or missing",
            "elements unchecked": "model file changed; element fingerprints could not be recomputed", "same elements": None}

    def look(table: dict) -> Column:
        return F.element_at(F.create_map(*[F.lit(v).cast("string") for kv in table.items() for v in kv]), F.col("case"))

    return joined.withColumn("case", case).select(
        "record_id", look(verdicts).alias("verdict"), look(whys).alias("reason"),
        F.when(F.col("case") == "same elements", "model file changed, but every bound element has the same fingerprint").alias("note"))


def assess_points(view: DataFrame, records: DataFrame, inventory: DataFrame, headers: DataFrame, manifest: DataFrame,
                  elements: DataFrame, view_edited: bool | Column = False, cache_edited: bool | Column = False) -> DataFrame:
    """States and reasons of the three layers for each view point.

    ``view(point, x, y, z, file)``, ``records(point, url, sha256, x, y, z, record_path)``,
    ``inventory(path, sha256)``, ``headers(path, point, x, y, z, readable)``,
    ``manifest(kind, path, sha256, point)`` with kinds data, record and cache,
    ``elements(point, verdict, reason)``. Of a manifest with several builds (``build_id``) the last counts. Every view
    row gives one result: of lookup rows that repeat a point or path, the least counts.
    """
    manifest = latest_build(manifest)
    flag = lambda v: v if isinstance(v, Column) else F.lit(v)
    r = records.select("point", F.col("url").alias("r_url"), F.col("sha256").alias("r_sha"), "record_path",
                       *[F.col(c).alias(f"r_{c}") for c in "xyz"], F.lit(True).alias("has_record"))
    r = _one_per_key(r, ["point"])
    entries = {kind: manifest.where(F.col("kind") == kind) for kind in ("data", "record", "cache")}
    def one(lookup: DataFrame, key: dict[str, str], values: dict[str, str]) -> DataFrame:
        return _one_per_key(lookup.select(*[F.col(a).alias(b) for a, b in {**key, **values}.items()]), list(key.values()))

    joined = (
        view.join(r, "point", "left").withColumn("locator", F.coalesce("r_url", "file"))
        .join(one(inventory, {"path": "locator"}, {"sha256": "f_sha"}), "locator", "left")
        .join(one(headers, {"path": "locator"}, {"point": "h_point", "readable": "readable", **{c: f"h_{c}" for c in "xyz"}}), "locator", "left")
        .join(one(entries["data"], {"path": "locator"}, {"sha256": "m_sha"}), "locator", "left")
        .join(one(inventory, {"path": "record_path"}, {"sha256": "rec_sha"}), "record_path", "left")
        .join(one(entries["record"], {"path": "record_path"}, {"sha256": "m_rec"}), "record_path", "left")
        .join(one(entries["cache"], {"point": "point"}, {"sha256": "c_sha"}), "point", "left")
        .join(one(elements, {"point": "point"}, {"verdict": "verdict", "reason": "e_reason"}), "point", "left")
        .select("*", *[F.col(c).alias(f"v_{c}") for c in "xyz"])
    )
    recorded = F.coalesce("has_record", F.lit(False))
    present = F.col("f_sha").isNotNull()
    readable = F.coalesce("readable", F.lit(False))
    hash_differs = present & recorded & ~F.col("f_sha").eqNullSafe(F.col("r_sha"))
    header_bad = present & ~readable
    header_differs = present & readable & (~F.col("h_point").eqNullSafe(F.col("point")) | coordinates_differ("h_", "v_"))
    early = F.col("locator").isNull() | ~present | hash_differs | header_bad | header_differs
    cache_old = ~early & (F.col("c_sha") != F.col("f_sha"))
    manifest_differs = ~early & ~F.coalesce(cache_old, F.lit(False)) & (F.col("m_sha") != F.col("f_sha"))
    later = F.coalesce(cache_old, F.lit(False)) | F.coalesce(manifest_differs, F.lit(False))
    cache_touched = ~early & ~later & recorded & flag(cache_edited)
    data_state = (F.when(F.col("locator").isNull(), "stale").when(~present, "missing").when(early | later | cache_touched, "stale")
                  .otherwise("valid"))
    data_why = _reasons(
        (F.col("locator").isNull(), "no data file named"), (F.col("locator").isNotNull() & ~present, "data file missing"),
        (hash_differs, "data file changed since the record was written"), (header_bad, "data file header not readable"),
        (header_differs, "data file header differs from the view"), (cache_old, "spectra cache was built from a different file"),
        (manifest_differs, "data file differs from the one registered at the last build"), (cache_touched, "spectra cache edited after the build"))
    record_edited = recorded & (F.col("rec_sha") != F.col("m_rec"))
    unusable = recorded & reduce(lambda p, q: p | q, [F.col(f"r_{c}").isNull() for c in "xyz"])
    position_differs = recorded & ~unusable & coordinates_differ("r_", "v_")
    view_touched = recorded & flag(view_edited)
    record_bad = F.coalesce(record_edited, F.lit(False)) | unusable | position_differs | view_touched
    record_state = F.when(~recorded, "missing").when(record_bad, "stale").otherwise("valid")
    record_why = _reasons((~recorded, "no record for this point"), (record_edited, "record edited after the build"),
                          (unusable, "record has no usable x/y/z"), (position_differs, "record x/y/z differ from the view"),
                          (view_touched, "view edited after the build"))
    element_state = F.when(~recorded, "unverified").otherwise(F.coalesce("verdict", F.lit("unverified")))
    element_why = _reasons((recorded & (element_state != "valid"), F.coalesce("e_reason", F.lit("no binding"))))
    states = joined.select("point", data_state.alias("data"), record_state.alias("record"), element_state.alias("element"),
                           data_why.alias("data_reasons"), record_why.alias("record_reasons"), element_why.alias("element_reasons"))
    valid = (F.col("data") == "valid") & (F.col("record") == "valid") & (F.col("element") == "valid")
    return states.withColumn("valid", valid)


def problem_lines(points: DataFrame) -> DataFrame:
    """Distinct ``(layer, line)`` of all point reasons."""
    sides = F.array(*[F.struct(F.lit(k).alias("layer"), F.col(f"{k}_reasons").alias("why")) for k in ("data", "record", "element")])
    each = points.select("point", F.explode(sides).alias("s")).select("point", "s.layer", F.explode("s.why").alias("why"))
    return each.select("layer", F.concat(F.lit("point "), F.col("point").cast("string"), F.lit(": "), F.col("why")).alias("line")).distinct()


def layer_verdict(points: DataFrame, problems: DataFrame) -> DataFrame:
    """``(layer, valid, total, state)``; ``problems(layer, line)`` holds all problem lines, also those of no point.

    Any problem line makes a layer stale, so an unverified element that states a reason does too.
    """
    sides = F.array(*[F.struct(F.lit(k).alias("layer"), F.col(k).alias("state")) for k in ("data", "record", "element")])
    counts = points.select(F.explode(sides).alias("s")).groupBy(F.col("s.layer").alias("layer")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("s.state") == "valid").alias("valid"),
        F.count_if(~F.col("s.state").isin("valid", "unverified")).alias("bad"))
    lines = problems.groupBy("layer").agg(F.count(F.lit(1)).alias("lines"))
    names = points.sparkSession.createDataFrame([("data",), ("record",), ("element",)], "layer STRING")
    joined = names.join(counts, "layer", "left").join(lines, "layer", "left").na.fill(0, ["total", "valid", "bad", "lines"])
    return layer_states(joined)


def layer_states(counts: DataFrame) -> DataFrame:
    """State of each layer from its counts of points (``valid``, ``total``, ``bad``) and of problem ``lines``."""
    state = (F.when((F.col("total") > 0) & (F.col("valid") == F.col("total")) & (F.col("lines") == 0), "valid")
             .when((F.col("bad") > 0) | (F.col("lines") > 0), "stale").otherwise("unverified"))
    return counts.select("layer", "valid", "total", state.alias("state"))


def overall_verdict(points: DataFrame, layers: DataFrame, package_found: bool = True) -> DataFrame:
    """One row: VALID, PARTIAL or INVALID with a headline."""
    return overall_from_totals(points.agg(F.count(F.lit(1)).alias("points"), F.count_if("valid").alias("valid_points")), layers, package_found)


def overall_from_totals(totals: DataFrame, layers: DataFrame, package_found: bool = True) -> DataFrame:
    """:func:`overall_verdict` from one row ``(points, valid_points)``."""
    rank = {"data": 0, "record": 1, "element": 2}
    position = F.element_at(F.create_map(*[F.lit(v) for kv in rank.items() for v in kv]), F.col("layer"))
    # Three rows, one per layer.
    states = layers.agg(F.count_if(F.col("state") == "valid").alias("ok"), F.array_join(F.transform(F.sort_array(F.collect_list(
        F.when(F.col("state") != "valid", F.struct(position.alias("k"), F.concat_ws(" ", "layer", "state").alias("t"))))),
        lambda x: x["t"]), "; ").alias("bits"))
    one = totals.select("*", F.lit(1).alias("__k")).join(states.select("*", F.lit(1).alias("__k")), "__k").drop("__k")
    overall = (F.when(~F.lit(package_found) | (F.col("points") == 0), "INVALID")
               .when((F.col("valid_points") == F.col("points")) & (F.col("ok") == 3), "VALID")
               .when(F.col("valid_points") == 0, "INVALID").otherwise("PARTIAL"))
    partial = F.format_string("%s: %d of %d points valid (%s)", overall, "valid_points", "points",
                              F.when(F.col("bits") == "", "see problems").otherwise(F.col("bits")))
    headline = (F.when(~F.lit(package_found), "no package folder found")
                .when(overall == "VALID", F.format_string("all %d points valid: data, record and model agree", "points")).otherwise(partial))
    return one.select(overall.alias("overall"), "points", "valid_points", headline.alias("headline"))


def cross_layer_issues(records: DataFrame, inventory: DataFrame, elements: DataFrame) -> DataFrame:
    """One row per record and issue code.

    ``records(record_id, url, sha256, model_url, model_sha256, gid, resolved_gid, cls)``,
    ``elements(gid, cls)`` of the supplied model. Missing files give no hash code.
    """
    files = inventory.select("path", F.col("sha256").alias("sha"))
    joined = (records.join(files.select(F.col("path").alias("url"), F.col("sha").alias("d_sha")), "url", "left")
              .join(files.select(F.col("path").alias("model_url"), F.col("sha").alias("x_sha")), "model_url", "left")
              .join(elements.select(F.col("gid").alias("resolved_gid"), F.col("cls").alias("x_cls"), F.lit(True).alias("resolved")), "resolved_gid", "left"))
    resolved = F.coalesce("resolved", F.lit(False))
    codes = _reasons(
        (F.col("d_sha") != F.col("sha256"), "MEASUREMENT_HASH_MISMATCH"), (F.col("x_sha") != F.col("model_sha256"), "IFC_HASH_MISMATCH"),
        (~resolved, "IFC_GLOBALID_UNRESOLVED"), (resolved & (F.col("gid") != F.col("resolved_gid")), "IFC_GLOBALID_MISMATCH"),
        (resolved & (F.col("cls") != F.col("x_cls")), "IFC_CLASS_MISMATCH"))
    return joined.select("record_id", F.explode(codes).alias("issue"))


def package_integrity(assets: DataFrame, inventory: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """One row per asset and issue of a package.

    ``assets(package_id, asset_id, location, external, sha256, bytes)``; external assets must not state a size or
    checksum nobody can have computed. ``reports(report_id, package_id, stated_id)`` must name their package.
    """
    files = inventory.select(F.col("path").alias("location"), F.col("sha256").alias("actual"))
    joined = assets.join(files, "location", "left")
    local = ~F.col("external")
    unsafe = F.col("location").rlike(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:")
    codes = _reasons(
        (local & unsafe, "UNSAFE_PATH"), (local & ~unsafe & F.col("actual").isNull(), "ASSET_MISSING"),
        (local & ~unsafe & F.col("actual").isNotNull() & ~F.col("actual").eqNullSafe(F.col("sha256")), "CHECKSUM_MISMATCH"),
        (F.col("external") & (F.col("sha256").isNotNull() | F.col("bytes").isNotNull()), "FABRICATED_EXTERNAL_EVIDENCE"))
    issues = joined.select("package_id", "asset_id", F.explode(codes).alias("issue"))
    if reports is None:
        return issues
    odd = reports.where(~F.col("stated_id").eqNullSafe(F.col("package_id")))
    return issues.unionByName(odd.select("package_id", F.col("report_id").alias("asset_id"), F.lit("REPORT_IDENTITY").alias("issue")))


def record_overview(summary: DataFrame, validation: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per record: counts, association, registration and its distinct checksum states.

    The states come from a vocabulary of three, so the set per record stays that small.
    """
    states = checks.groupBy("record_id").agg(F.array_join(F.sort_array(F.collect_set("status")), ", ").alias("checksums"))
    return (summary.select("record_id", "measurement_file", "association_level", "registration")
            .join(validation.select("record_id", "violations", "warnings"), "record_id", "left")
            .join(states, "record_id", "left").withColumn("checksums", F.coalesce("checksums", F.lit("-")))
            .na.fill(0, ["violations", "warnings"]))


def catalog_totals(overview: DataFrame) -> DataFrame:
    """Totals over all records."""
    return overview.agg(F.count(F.lit(1)).alias("records"), F.sum("violations").alias("violations"), F.sum("warnings").alias("warnings"),
                        F.count_if(F.col("registration") != "not established").alias("registered"))
