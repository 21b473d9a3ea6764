"""Record documents: reading, nesting, flattening and conversion to triples."""

from __future__ import annotations

import gc
import json
import sys
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import lru_cache
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkledger.functions.staging import computed_once
from linkledger.functions.text import format_point, local_name, parse_point, to_metres
from linkledger.model import (BASE_IRI, PREFIXES, PROFILE_IRI, PROFILE_VERSION, RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE,
                              TRIPLES, iri)

RECORD_GLOB = "point_*.jsonld"
#: Levels of nesting that Spark's JSON reader takes, and calls per level when a document is unfolded.
MAX_DEPTH, CALLS_PER_LEVEL = 1000, 8
XSD_STRING, XSD_INTEGER, XSD_DOUBLE, XSD_BOOLEAN = (iri(f"xsd:{t}") for t in ("string", "integer", "double", "boolean"))
LANG_STRING = iri("rdf:langString")


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """``records(record_id, path, text, doc)`` of every record file below ``path``."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=RECORD_GLOB)
    paths = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse_records(paths.select(F.regexp_replace(local_name("path"), r"\.jsonld$", "").alias("record_id"), "path", "text"))


def parse_records(texts: DataFrame) -> DataFrame:
    """Add the parsed ``doc`` (VARIANT, null for broken JSON) to a table with ``text``."""
    return computed_once(texts, {"doc": F.try_parse_json("text")})


def record_rejects(records: DataFrame, contexts: Sequence[str] = ()) -> DataFrame:
    """Documents that cannot be used, with a reason; they give no triples and no flat row of their own.

    ``contexts`` names the context addresses that are known.
    """
    addresses = F.transform(_list("doc", "$['@context']"), lambda c: F.when(F.schema_of_variant(c) == "STRING", _get(c, "$")))
    unknown = F.exists(addresses, lambda a: a.isNotNull() & ~a.isin(list(contexts)))
    reason = F.when(F.col("doc").isNull(), "not valid JSON").when(unknown, "unknown context").when(~is_record("doc"), "no record layout")
    return records.select("record_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def is_record(doc: Column | str) -> Column:
    """Does the document have the nested or the older flat layout."""
    keys = ("$['foaf:primaryTopic']", "$['ldv:tier2Measurement']")
    return F.coalesce(F.try_variant_get(doc, keys[0], "variant"), F.try_variant_get(doc, keys[1], "variant")).isNotNull()


# ------------------------------------------------------------------ flat row -> nested document

def _ref(value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(value.alias("@id")))


def _typed(value: Column, kind: str) -> Column:
    return F.when(value.isNotNull(), F.struct(value.alias("@value"), F.lit(kind).alias("@type")))


def _measurement(metric: str, value: Column) -> Column:
    return F.struct(F.lit("dqv:QualityMeasurement").alias("@type"),
                    F.struct(F.lit(f"ldvm:{metric}").alias("@id")).alias("dqv:isMeasurementOf"), value.alias("dqv:value"))


def _status(metric: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(_measurement(metric, value)))


def _checksum(value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(
        F.lit("spdx:Checksum").alias("@type"),
        F.struct(F.lit("spdx:checksumAlgorithm_sha256").alias("@id")).alias("spdx:algorithm"), value.alias("spdx:checksumValue")))


def _quantity(value: Column, unit: str) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit("schema:QuantitativeValue").alias("@type"),
                                              value.cast("double").alias("schema:value"), F.lit(unit).alias("schema:unitCode")))


def _element(t: Column, *more: Column) -> Column:
    return F.struct(
        F.concat(F.lit("ex:ifc/"), t["gid"]).alias("@id"),
        F.array_compact(F.array(F.lit("bot:Element"), F.concat(F.lit("ifc:"), t["cls"]))).alias("@type"),
        t["label"].alias("rdfs:label"), t["gid"].alias("dcterms:identifier"),
        _checksum(t["fingerprint"]).alias("spdx:checksum"), *more)


def _table_layout(flat: DataFrame) -> list[Column]:
    """Dialect and ordered column list, where the flat rows carry a ``layout`` struct."""
    if "layout" not in flat.columns:
        return []
    layout = F.col("layout")
    dialect = F.struct(F.lit("csvw:Dialect").alias("@type"), F.lit("\t").alias("csvw:delimiter"), F.lit("ISO-8859-1").alias("csvw:encoding"),
                       layout["skip_rows"].alias("csvw:skipRows"), layout["header_rows"].alias("csvw:headerRowCount"))
    columns = F.transform(layout["columns"], lambda c, n: F.struct(
        F.lit("csvw:Column").alias("@type"), (n + 1).alias("csvw:number"), c["name"].alias("csvw:name"),
        F.when(c["title"].isNotNull(), F.struct(c["title"].alias("@value"), F.lit("de").alias("@language"))).alias("csvw:titles"),
        _ref(c["unit"]).alias("qudt:hasUnit"), c["unit_text"].alias("schema:unitText"),
        _status("unitStatus", c["unit_status"]).alias("dqv:hasQualityMeasurement")))
    schema = F.struct(F.lit("csvw:Schema").alias("@type"), F.struct(columns.alias("@list")).alias("csvw:column"))
    return [dialect.alias("csvw:dialect"), schema.alias("csvw:tableSchema")]


def nest_record(flat: DataFrame) -> DataFrame:
    """Flat rows (``record_id`` and the five part structs) to ``(record_id, text)`` with one JSON document each.

    Null fields leave no key behind. The first target is the specimen, further targets are its parts.
    """
    i, m, g, b, c = (F.col(x) for x in ("integrity", "measurement", "lineage", "binding", "completeness"))
    rid = F.col("record_id")
    result = F.struct(
        F.concat(F.lit("ex:file/"), rid).alias("@id"), F.array(F.lit("dcat:Distribution"), F.lit("prov:Entity")).alias("@type"),
        i["title"].alias("dcterms:title"), _ref(i["media_type"]).alias("dcat:mediaType"),
        _typed(i["bytes"], "xsd:nonNegativeInteger").alias("dcat:byteSize"), _checksum(i["sha256"]).alias("spdx:checksum"),
        _ref(i["url"]).alias("dcat:downloadURL"), _ref(F.concat(F.lit("ldvc:"), i["status"])).alias("dcterms:type"), *_table_layout(flat))
    geometry = F.struct(
        F.lit("geo:Geometry").alias("@type"),
        _typed(format_point(m["frame"], m["x"], m["y"], m["z"]), "geo:wktLiteral").alias("geo:asWKT"),
        _status("definitionStatus", m["frame_status"]).alias("dqv:hasQualityMeasurement"))
    layers = F.transform(b["layers"], lambda x, k: F.struct(
        F.concat(F.lit("ex:layer/"), rid, F.lit("/"), k.cast("string")).alias("@id"), F.lit("ifc:IfcMaterialLayer").alias("@type"),
        x["name"].alias("rdfs:label"), _quantity(x["thickness_m"], "MTR").alias("schema:depth")))
    parts = F.when(F.size(b["targets"]) > 1, F.transform(F.slice(b["targets"], F.lit(2), F.size(b["targets"])), lambda t: _element(t)))
    specimen = _element(F.try_element_at(b["targets"], F.lit(1)), parts.alias("bot:hasSubElement"),
                        F.when(b["layers"].isNotNull(), F.struct(layers.alias("@list"))).alias("dcterms:hasPart"))
    sample = F.struct(
        F.concat(F.lit("ex:point/"), rid).alias("@id"), F.lit("sosa:Sample").alias("@type"),
        m["point"].alias("dcterms:identifier"), geometry.alias("geo:hasGeometry"), specimen.alias("sosa:isSampleOf"))
    procedure = F.struct(
        F.concat(F.lit("ex:procedure/"), rid).alias("@id"), F.lit("sosa:Procedure").alias("@type"),
        m["procedure_source"].alias("dcterms:source"), _status("status", m["procedure_status"]).alias("dqv:hasQualityMeasurement"))
    sensor = F.struct(
        F.lit("ex:sensor/scanner").alias("@id"), F.lit("sosa:Sensor").alias("@type"),
        F.when(g["rig"].isNotNull(), F.struct(F.concat(F.lit("ex:platform/"), F.regexp_replace(g["rig"], r"\W+", "")).alias("@id"),
               F.lit("sosa:Platform").alias("@type"), g["rig"].alias("rdfs:label"))).alias("sosa:isHostedBy"))
    axis = F.struct(
        F.lit("schema:QuantitativeValue").alias("@type"), m["freq_min"].alias("schema:minValue"),
        m["freq_max"].alias("schema:maxValue"), m["step"].alias("ldv:step"), m["bins"].alias("ldv:binCount"),
        _ref(m["unit"]).alias("qudt:hasUnit"))
    years = F.when(g["year_start"].isNotNull(), F.struct(
        F.lit("dcterms:PeriodOfTime").alias("@type"), _typed(g["year_start"], "xsd:gYear").alias("dcat:startDate"),
        _typed(g["year_end"], "xsd:gYear").alias("dcat:endDate")))
    environment = F.transform(g["environment"], lambda e: F.struct(
        F.array(F.lit("qudt:QuantityValue"), F.lit("ssn-system:Condition")).alias("@type"), e["label"].alias("rdfs:label"),
        e["value"].alias("qudt:numericValue"), _ref(e["unit"]).alias("qudt:hasUnit")))
    observation = F.struct(
        m["observation"].alias("@id"), F.array(F.lit("sosa:Observation"), F.lit("prov:Activity")).alias("@type"),
        sample.alias("sosa:hasFeatureOfInterest"), F.struct(F.lit("ex:property/response").alias("@id")).alias("sosa:observedProperty"),
        sensor.alias("sosa:madeBySensor"), procedure.alias("sosa:usedProcedure"), result.alias("sosa:hasResult"),
        axis.alias("ldv:frequencyAxis"), years.alias("dcterms:temporal"), _ref(g["agent"]).alias("prov:wasAssociatedWith"),
        F.when(g["location"].isNotNull(), F.struct(F.concat(F.lit("ex:location/"), F.regexp_replace(g["location"], r"\W+", "")).alias("@id"),
               F.lit("prov:Location").alias("@type"), g["location"].alias("rdfs:label"))).alias("prov:atLocation"),
        environment.alias("prov:used"))
    model_url = F.concat(F.lit("data/"), b["model_file"])
    if "model_url" in flat.schema["binding"].dataType.fieldNames():
        model_url = F.coalesce(b["model_url"], model_url)

    def document(first: Column) -> Column:
        # Described once, at the first link; the others only point to it.
        once = lambda c: F.when(first, c)
        return F.struct(
            F.concat(F.lit("ex:ifcfile/"), b["model_file"]).alias("@id"), once(F.array(F.lit("dcat:Distribution"), F.lit("prov:Entity"))).alias("@type"),
            once(b["model_file"]).alias("dcterms:title"), once(_typed(b["model_modified"], "xsd:dateTime")).alias("dcterms:modified"),
            once(_checksum(b["model_sha256"])).alias("spdx:checksum"), once(_ref(model_url)).alias("dcat:downloadURL"))

    link_ids = F.filter(b["linked_gids"], lambda x: x.isNotNull())
    to_links = F.transform(link_ids, lambda gid, n: F.struct(
        F.lit("ls:LinkElement").alias("@type"), document(n == 0).alias("ls:hasDocument"),
        F.struct(F.lit("ls:StringBasedIdentifier").alias("@type"), F.lit("Guid").alias("ls:identifierField"),
                 gid.alias("ls:identifier")).alias("ls:hasIdentifier")))
    h = b["hypothesis"]
    hypothesis = F.when(h.isNotNull(), F.struct(
        F.concat(F.lit("ex:registration-hypothesis/"), rid).alias("@id"), F.lit("ldv:RegistrationHypothesis").alias("@type"),
        h["source"].alias("dcterms:source"), h["mapping"].alias("ldv:transform"), h["face"].alias("ldv:referenceFace"),
        h["origin"].alias("dcterms:description"), h["z_axis"].alias("skos:note"),
        _status("status", h["status"]).alias("dqv:hasQualityMeasurement")))
    verification = F.struct(
        F.lit("prov:Activity").alias("@type"), _typed(b["verified_at"], "xsd:dateTime").alias("prov:endedAtTime"),
        F.when(b["method"].isNotNull(), F.struct(F.lit("ex:plan/element-fingerprint").alias("@id"), F.lit("prov:Plan").alias("@type"),
               b["method"].alias("dcterms:description"))).alias("prov:used"))
    binding = F.struct(
        F.concat(F.lit("ex:binding/"), rid).alias("@id"), F.lit("ls:DirectedLink").alias("@type"),
        F.struct(F.lit("ls:LinkElement").alias("@type"), F.struct(F.concat(F.lit("ex:record/"), rid).alias("@id")).alias("ls:hasDocument"))
        .alias("ls:hasFromLinkElement"),
        to_links.alias("ls:hasToLinkElement"), b["level"].alias("ldv:associationLevel"), b["registration"].alias("ldv:registration"),
        hypothesis.alias("prov:wasInfluencedBy"), verification.alias("prov:wasGeneratedBy"),
        _status("bindingStatus", b["status"]).alias("dqv:hasQualityMeasurement"))
    completeness = F.array_compact(F.array(
        F.when(c["absent"].isNotNull(), _measurement("absentFields", c["absent"])),
        F.when(c["unresolved"].isNotNull(), _measurement("unresolvedFields", c["unresolved"]))))
    context = F.struct(*[F.lit(ns).alias(p) for p, ns in PREFIXES.items()], F.lit(BASE_IRI).alias("@base"))
    document_root = F.struct(
        context.alias("@context"), F.concat(F.lit("ex:record/"), rid).alias("@id"), F.lit("dcat:CatalogRecord").alias("@type"),
        F.struct(F.lit(PROFILE_IRI).alias("@id")).alias("dcterms:conformsTo"), F.lit(PROFILE_VERSION).alias("owl:versionInfo"),
        observation.alias("foaf:primaryTopic"), binding.alias("dcterms:relation"), completeness.alias("dqv:hasQualityMeasurement"),
        _ref(g["agent"]).alias("dcterms:creator"))
    return flat.select("record_id", F.to_json(document_root).alias("text"))


# ------------------------------------------------------------------ nested document -> flat row

def _get(doc: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(doc, path, kind)


def _path(*keys: str) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def _list(doc: Column | str, path: str) -> Column:
    """Array of variants at a path; a single value counts as a list of one."""
    whole = _get(doc, path, "array<variant>")
    one = _get(doc, path, "variant")
    return F.coalesce(whole, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))


def quality_value(node: Column | str, metric: str, path: str = "$['dqv:hasQualityMeasurement']") -> Column:
    """Values (array of text) of the first measurement on a node whose metric name ends with ``metric``; null if none."""
    def named(x: Column) -> Column:
        name = F.coalesce(_get(x, "$['dqv:isMeasurementOf']['@id']"), _get(x, "$['dqv:isMeasurementOf']"))
        return F.substring_index(F.substring_index(name, ":", -1), "/", -1) == metric

    hit = F.try_element_at(F.filter(_list(node, path), named), F.lit(1))
    values = F.transform(_list(hit, "$['dqv:value']"), lambda v: F.coalesce(_get(v, "$['@value']"), _get(v, "$")))
    return F.when(hit.isNotNull(), values)


def flatten_record(records: DataFrame) -> DataFrame:
    """Nested documents to one row of five part structs; the older flat layout is read from its own keys.

    What a document does not state is null (an empty array for lists); no document stops the job.
    """
    doc = F.col("doc")
    topic, link = "foaf:primaryTopic", "dcterms:relation"
    t1, t2, t4 = "ldv:tier1Integrity", "ldv:tier2Measurement", "ldv:tier4Binding"

    def value(path: str, kind: str = "string") -> Column:
        return F.coalesce(_get(doc, path + "['@value']", kind), _get(doc, path, kind))

    def either(new: tuple, old: tuple, kind: str = "string") -> Column:
        return F.coalesce(value(_path(*new), kind), value(_path(*old), kind))

    def first(node: Column, metric: str) -> Column:
        return F.get(quality_value(node, metric), F.lit(0))

    foi = (topic, "sosa:hasFeatureOfInterest")
    spec = (*foi, "sosa:isSampleOf")
    result = (topic, "sosa:hasResult")
    wkt = parse_point(value(_path(*foi, "geo:hasGeometry", "geo:asWKT")))
    status = _get(doc, _path(*result, "dcterms:type", "@id"))
    integrity = F.struct(
        either((*result, "dcterms:title"), (t1, "dcterms:title")).alias("title"),
        either((*result, "dcat:mediaType", "@id"), (t1, "dcat:mediaType", "@id")).alias("media_type"),
        either((*result, "dcat:byteSize"), (t1, "dcat:byteSize"), "bigint").alias("bytes"),
        either((*result, "spdx:checksum", "spdx:checksumValue"), (t1, "spdx:checksum", "spdx:checksumValue")).alias("sha256"),
        either((*result, "dcat:downloadURL", "@id"), (t1, "dcat:downloadURL", "@id")).alias("url"),
        F.coalesce(F.substring_index(F.substring_index(status, ":", -1), "/", -1), _get(doc, _path(t1, "ldv:dataStatus")),
                   F.lit("raw")).alias("status"))
    axis = (topic, "ldv:frequencyAxis")
    geometry = _get(doc, _path(*foi, "geo:hasGeometry"), "variant")
    procedure = _get(doc, _path(topic, "sosa:usedProcedure"), "variant")

    def coordinate(name: str) -> Column:
        return F.coalesce(wkt[name], value(_path(t2, "ldv:point", f"ldv:{name}"), "double")).alias(name)

    measurement = F.struct(
        either((topic, "@id"), (t2, "@id")).alias("observation"),
        either((*foi, "dcterms:identifier"), (t2, "ldv:point", "ldv:index"), "bigint").alias("point"),
        coordinate("x"), coordinate("y"), coordinate("z"),
        F.coalesce(wkt["frame"], value(_path(t2, "ldv:point", "ldv:scanFrame", "@id"))).alias("frame"),
        either((*axis, "schema:minValue"), (t2, "ldv:frequencyAxis", "ldv:min"), "double").alias("freq_min"),
        either((*axis, "schema:maxValue"), (t2, "ldv:frequencyAxis", "ldv:max"), "double").alias("freq_max"),
        either((*axis, "ldv:step"), (t2, "ldv:frequencyAxis", "ldv:step"), "double").alias("step"),
        either((*axis, "ldv:binCount"), (t2, "ldv:frequencyAxis", "ldv:binCount"), "int").alias("bins"),
        either((*axis, "qudt:hasUnit", "@id"), (t2, "ldv:frequencyAxis", "qudt:hasUnit", "@id")).alias("unit"),
        F.coalesce(first(geometry, "definitionStatus"), value(_path(t2, "ldv:point", "ldv:scanFrame", "ldv:definitionStatus"))).alias("frame_status"),
        either((topic, "sosa:usedProcedure", "dcterms:source"), (t2, "sosa:usedProcedure", "ldv:reportedInLabForm")).alias("procedure_source"),
        F.coalesce(first(procedure, "status"), value(_path(t2, "sosa:usedProcedure", "ldv:status"))).alias("procedure_status"))
    t3 = "ldv:tier3Lineage"
    conditions = F.filter(F.concat(_list(doc, _path(topic, "prov:used")), _list(doc, _path(t3, "ldv:environment"))), lambda e: F.exists(
        _list(e, "$['@type']"), lambda t: _get(t, "$") == "qudt:QuantityValue"))
    environment = F.transform(conditions, lambda e: F.struct(
        _get(e, "$['rdfs:label']").alias("label"), _get(e, "$['qudt:numericValue']", "double").alias("value"),
        _get(e, "$['qudt:hasUnit']['@id']").alias("unit")))
    lineage = F.struct(
        either((topic, "sosa:madeBySensor", "sosa:isHostedBy", "rdfs:label"), ("ldv:tier3Lineage", "ldv:testRig")).alias("rig"),
        either((topic, "prov:atLocation", "rdfs:label"), (t3, "prov:atLocation", "rdfs:label")).alias("location"),
        either((topic, "dcterms:temporal", "dcat:startDate"), (t2, "dcterms:temporal", "dcat:startDate")).alias("year_start"),
        either((topic, "dcterms:temporal", "dcat:endDate"), (t2, "dcterms:temporal", "dcat:endDate")).alias("year_end"),
        environment.alias("environment"), either((topic, "prov:wasAssociatedWith", "@id"), (t3, "prov:wasAssociatedWith", "@id")).alias("agent"))

    def text(n: Column, key: str) -> Column:
        return F.coalesce(_get(n, f"$['{key}']['@value']"), _get(n, f"$['{key}']"))

    def element(n: Column) -> Column:
        classes = F.filter(F.transform(_list(n, "$['@type']"), lambda t: _get(t, "$")), lambda t: t.startswith("ifc:"))
        return F.struct(F.coalesce(text(n, "dcterms:identifier"), text(n, "ldv:ifcGlobalId")).alias("gid"),
                        F.coalesce(F.substr(F.try_element_at(classes, F.lit(1)), F.lit(5)), text(n, "ldv:ifcClass")).alias("cls"), text(n, "rdfs:label").alias("label"),
                        F.coalesce(_get(n, "$['spdx:checksum']['spdx:checksumValue']"), text(n, "ldv:elementFingerprint")).alias("fingerprint"))

    old_target = (t4, "ldv:target")
    specimen = F.coalesce(_get(doc, _path(*spec), "variant"), _get(doc, _path(*old_target), "variant"))
    targets = F.transform(F.concat(F.when(specimen.isNotNull(), F.array(specimen)).otherwise(F.array().cast("array<variant>")),
                                   _list(specimen, "$['bot:hasSubElement']")), element)
    members = F.coalesce(_get(doc, _path(*spec, "dcterms:hasPart", "@list"), "array<variant>"), _get(doc, _path(*old_target, "ldv:layerStack", "@list"), "array<variant>"))
    layers = F.transform(members, lambda x: F.struct(
        F.coalesce(text(x, "rdfs:label"), text(x, "ldv:materialName")).alias("name"),
        F.coalesce(to_metres(_get(x, "$['schema:depth']['schema:value']"), _get(x, "$['schema:depth']['schema:unitCode']")), _get(x, "$['ldv:thicknessM']", "double")).alias("thickness_m")))
    links = _list(doc, _path(link, "ls:hasToLinkElement"))
    model = F.try_element_at(F.filter(F.transform(links, lambda e: _get(e, "$['ls:hasDocument']", "variant")), lambda d: F.coalesce(
        _get(d, "$['spdx:checksum']", "variant"), _get(d, "$['dcat:downloadURL']", "variant")).isNotNull()), F.lit(1))
    h = (link, "prov:wasInfluencedBy")
    old_h = (t4, "ldv:registrationHypothesis")
    h_node = F.coalesce(_get(doc, _path(*h), "variant"), _get(doc, _path(*old_h), "variant"))
    hypothesis = F.when(h_node.isNotNull(), F.struct(
        either((*h, "dcterms:source"), (*old_h, "ldv:source")).alias("source"), either((*h, "ldv:transform"), (*old_h, "ldv:mapping")).alias("mapping"),
        either((*h, "ldv:referenceFace"), (*old_h, "ldv:referenceFace")).alias("face"), either((*h, "dcterms:description"), (*old_h, "ldv:origin")).alias("origin"),
        either((*h, "skos:note"), (*old_h, "ldv:zAxis")).alias("z_axis"), F.coalesce(first(h_node, "status"), value(_path(*old_h, "ldv:status"))).alias("status")))
    binding = F.struct(
        either((link, "ldv:associationLevel"), (t4, "ldv:associationLevel")).alias("level"),
        either((link, "ldv:registration"), (t4, "ldv:registration")).alias("registration"),
        F.coalesce(_get(model, "$['dcterms:title']"), value(_path(t4, "ldv:ifcFile", "dcterms:title"))).alias("model_file"),
        F.coalesce(_get(model, "$['spdx:checksum']['spdx:checksumValue']"),
                   value(_path(t4, "ldv:ifcFile", "spdx:checksum", "spdx:checksumValue"))).alias("model_sha256"),
        F.coalesce(text(model, "dcterms:modified"), value(_path(t4, "ldv:ifcFile", "dcterms:modified"))).alias("model_modified"), targets.alias("targets"), layers.alias("layers"),
        F.filter(F.transform(links, lambda e: _get(e, "$['ls:hasIdentifier']['ls:identifier']")), lambda x: x.isNotNull()).alias("linked_gids"),
        hypothesis.alias("hypothesis"), F.coalesce(first(_get(doc, _path(link), "variant"), "bindingStatus"), value(_path(t4, "ldv:bindingStatus"))).alias("status"),
        either((link, "prov:wasGeneratedBy", "prov:endedAtTime"), (t4, "ldv:verifiedAt")).alias("verified_at"),
        either((link, "prov:wasGeneratedBy", "prov:used", "dcterms:description"), (t4, "ldv:fingerprintMethod")).alias("method"),
        F.coalesce(_get(model, "$['dcat:downloadURL']['@id']"), _get(model, "$['dcat:downloadURL']"), value(_path(t4, "ldv:ifcFile", "dcat:downloadURL", "@id"))).alias("model_url"))

    def declared(metric: str, old: str) -> Column:
        path = _path("ldv:completeness", old)
        listed = F.transform(_list(doc, path), lambda v: F.coalesce(_get(v, "$['@value']"), _get(v, "$")))
        return F.coalesce(quality_value(doc, metric), F.when(_get(doc, path, "variant").isNotNull(), listed))

    completeness = F.struct(declared("absentFields", "ldv:absent").alias("absent"), declared("unresolvedFields", "ldv:unresolved").alias("unresolved"))
    kept = [c for c in records.columns if c not in ("doc", "text")]
    return records.select(*kept, integrity.alias("integrity"), measurement.alias("measurement"), lineage.alias("lineage"),
                          binding.alias("binding"), completeness.alias("completeness"))


# ------------------------------------------------------------------ nested document -> triples

def context_of(given, contexts: Mapping[str, Mapping[str, str]]) -> dict[str, str] | None:
    """Prefixes of an ``@context``: null, an object, an address, or a list of these; None if an address is not in ``contexts``."""
    known = dict(PREFIXES)
    for part in given if isinstance(given, list) else [given]:
        if isinstance(part, str):
            if part not in contexts:
                return None
            part = contexts[part]
        if isinstance(part, Mapping):
            known |= {k: v for k, v in part.items() if isinstance(v, str)}
    return known


@lru_cache(maxsize=16)
def _expander(base: str, prefixes: tuple[tuple[str, str], ...]) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """Functions from names to IRIs for one context: the plain one for ids, and one that remembers, for keys and types, of which there are few."""
    context = dict(prefixes)

    def expand(name: str) -> str:
        prefix, colon, rest = name.partition(":")
        if colon and prefix in context and not rest.startswith("//"):
            return context[prefix] + rest
        return name if colon and "/" not in prefix else urljoin(base, name)

    return expand, lru_cache(maxsize=4096)(expand)


def document_triples(record_id: str, text: str | None, contexts: Mapping[str, Mapping[str, str]] | None = None,
                     predicates: frozenset[str] | None = None) -> list[tuple]:
    """The statements of one JSON-LD document, equal ones once, in first-seen order; those of ``predicates`` only, if given.

    Nodes without an id are named by record and key path, list cells carry their list head and position.
    Number types follow the JSON text: ``416.0`` is a double, ``6381`` an integer. Null values, types and ids that are no
    text give no statement; nodes of a ``@graph`` count like the document's own. Text that is no JSON object, and a
    document with a context address that ``contexts`` does not resolve, give nothing; :func:`record_rejects` lists them.
    """
    try:
        doc = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return []
    context = context_of(doc.get("@context"), contexts or {}) if isinstance(doc, dict) else None
    if context is None:
        return []
    base = context.pop("@base", BASE_IRI)
    expand, named = _expander(base, tuple(context.items()))
    rows: dict[tuple, None] = {}
    every = predicates is None
    types, firsts, rests = (every or p in predicates for p in (RDF_TYPE, RDF_FIRST, RDF_REST))

    def term(value, path: str) -> tuple | None:
        """(o, kind, type, language) of a JSON value, after the statements below it were added."""
        if value is None:
            return None
        if isinstance(value, str):
            return value, "literal", XSD_STRING, None
        if isinstance(value, dict):
            if "@value" in value:
                inner = value["@value"]
                if inner is None or isinstance(inner, (dict, list)):
                    return None
                if isinstance(value.get("@language"), str) and isinstance(inner, str):
                    return inner, "literal", LANG_STRING, value["@language"]
                o, kind, o_type, _ = term(inner, path)
                return o, kind, named(value["@type"]) if isinstance(value.get("@type"), str) else o_type, None
            if "@list" in value:
                return cells(many(value["@list"]), path)
            node = visit(value, path)
            return node, "bnode" if node.startswith("_:") else "iri", None, None
        if isinstance(value, bool):
            return str(value).lower(), "literal", XSD_BOOLEAN, None
        if isinstance(value, (int, float)):
            return repr(value), "literal", XSD_DOUBLE if isinstance(value, float) else XSD_INTEGER, None
        return value, "literal", XSD_STRING, None

    def many(value) -> list:
        """Values of a key: nested lists and sets are one list."""
        if isinstance(value, dict) and "@set" in value:
            return many(value["@set"])
        return [x for v in value for x in many(v)] if isinstance(value, list) else [value]

    def cells(items: list, path: str) -> tuple:
        names = [f"_:{record_id}{path}/@list{n}" for n in range(len(items))] + [RDF_NIL]
        for n, item in enumerate(items):
            o = term(item, f"{path}/{n}")
            if o and firsts:
                rows[(record_id, names[n], RDF_FIRST, *o, names[0], n)] = None
            if rests:
                rows[(record_id, names[n], RDF_REST, names[n + 1], "iri" if names[n + 1] == RDF_NIL else "bnode", None, None, None, None)] = None
        return names[0], "bnode" if items else "iri", None, None

    def visit(node: dict, path: str) -> str:
        given = node.get("@id")
        subject = expand(given) if isinstance(given, str) and given else f"_:{record_id}{path}"
        for key, value in node.items():
            if key == "@type":
                for name in many(value) if types else ():
                    if isinstance(name, str):
                        rows[(record_id, subject, RDF_TYPE, named(name), "iri", None, None, None, None)] = None
            elif key in ("@graph", "@included"):
                for n, item in enumerate(many(value)):
                    if isinstance(item, dict):
                        visit(item, f"{path}/{key}/{n}")
            elif key.startswith("@"):
                pass
            elif isinstance(value, str):
                # Most values are plain texts: no node below them, one statement.
                if every or named(key) in predicates:
                    rows[(record_id, subject, named(key), value, "literal", XSD_STRING, None, None, None)] = None
            elif isinstance(value, list) or isinstance(value, dict) and "@set" in value:
                for n, item in enumerate(many(value)):
                    o = term(item, f"{path}/{key}/{n}")
                    if o and (every or named(key) in predicates):
                        rows[(record_id, subject, named(key), *o, None, None)] = None
            else:
                o = term(value, f"{path}/{key}")
                if o and (every or named(key) in predicates):
                    rows[(record_id, subject, named(key), *o, None, None)] = None
        return subject

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, CALLS_PER_LEVEL * MAX_DEPTH))
    try:
        visit(doc, "")
    except RecursionError:
        return []
    finally:
        sys.setrecursionlimit(limit)
    return list(rows)


def records_to_triples(records: DataFrame, documents_per_batch: int = 256, contexts: Mapping[str, Mapping[str, str]] | None = None,
                       predicates: Iterable[str] | None = None) -> DataFrame:
    """Triples of ``(record_id, text)`` rows. A record's statements come from one row, so nothing is shuffled.

    ``contexts`` gives the prefixes of contexts that documents name by address; nothing is fetched. With ``predicates`` the
    result is that of a filter on them afterwards: whole documents are read, but other statements are not made.
    """
    wanted = None if predicates is None else frozenset(predicates)
    kinds = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string() for f in TRIPLES.fields]
    names = TRIPLES.fieldNames()

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, documents_per_batch):
                part = batch.slice(start, documents_per_batch).to_pydict()
                gc.disable()  # The many tuples of a batch are no garbage; looking through them again and again took a quarter of the time.
                try:
                    rows = [row for record_id, text in zip(part["record_id"], part["text"]) for row in document_triples(record_id, text, contexts, wanted)]
                finally:
                    gc.enable()
                columns = zip(*rows) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return records.select("record_id", "text").mapInArrow(unfold, TRIPLES)
