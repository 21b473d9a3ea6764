"""Column types of the tables in use, and the fixed values of the record profile."""

from __future__ import annotations

from pyspark.sql import types as T

CHANNELS = ("X", "Y", "Z", "NORM")
COMPONENTS = ("re_x", "re_y", "re_z", "im_x", "im_y", "im_z")

# Spectra are kept one row per file: arrays of equal length, so per-file work needs no shuffle.
SPECTRA = T.StructType(
    [T.StructField("point", T.LongType()), T.StructField("path", T.StringType())]
    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("freq", *COMPONENTS)]
)

TRIPLES = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("s", T.StringType()),
    T.StructField("p", T.StringType()),
    T.StructField("o", T.StringType()),
    T.StructField("o_kind", T.StringType()),   # iri | bnode | literal
    T.StructField("o_type", T.StringType()),
    T.StructField("o_lang", T.StringType()),
    T.StructField("list_id", T.StringType()),  # set on rdf:first rows: the list head and the place in it
    T.StructField("list_pos", T.IntegerType()),
])

# ---- Fixed values: field names of given files, registry objects and recorded scenario results.
REGISTRY_JSON = T.StructType([
    T.StructField("record_uri", T.StringType()),
    T.StructField("record", T.StructType([
        T.StructField(name, kind) for name, kind in [
            ("RecordIdentifier", T.StringType()), ("AcousticMetric", T.StringType()),
            ("AcousticValue", T.DoubleType()), ("AcousticUnit", T.StringType()),
            ("AssemblyDescription", T.StringType()), ("ConstructionType", T.StringType()),
            ("TotalThickness_m", T.DoubleType()), ("TestArea_m2", T.DoubleType()),
            ("SpecimenLengthX_m", T.DoubleType()), ("SpecimenLengthY_m", T.DoubleType()),
            ("SurfaceMass_kg_m2", T.DoubleType()), ("MethodType", T.StringType()),
            ("SourceType", T.StringType()), ("SourceReference", T.StringType()),
            ("DataYear", T.StringType()), ("RecordVersion", T.StringType()),
            ("ResponsibleAgent", T.StringType()), ("SourceURI", T.StringType()),
        ]
    ])),
])

SCENARIO_RESULTS = ("approach STRING, scenario STRING, model_modified BOOLEAN, external_modified BOOLEAN, "
                    "answered INT, total INT, link_status STRING, note STRING")

# ---- Fixed values: namespaces of the record profile, prefix -> (namespace, steward), lookup order kept.
VOCABULARIES = {
    "sosa": ("http://www.w3.org/ns/sosa/", "W3C / OGC"),
    "ssn-system": ("http://www.w3.org/ns/ssn/systems/", "W3C / OGC"),
    "prov": ("http://www.w3.org/ns/prov#", "W3C"),
    "dcat": ("http://www.w3.org/ns/dcat#", "W3C"),
    "csvw": ("http://www.w3.org/ns/csvw#", "W3C"),
    "dqv": ("http://www.w3.org/ns/dqv#", "W3C"),
    "dcterms": ("http://purl.org/dc/terms/", "DCMI"),
    "spdx": ("http://spdx.org/rdf/terms#", "SPDX"),
    "qudt": ("http://qudt.org/schema/qudt/", "QUDT"),
    "bot": ("https://w3id.org/bot#", "W3C LBD CG"),
    "geo": ("http://www.opengis.net/ont/geosparql#", "OGC"),
    "schema": ("https://schema.org/", "schema.org"),
    "foaf": ("http://xmlns.com/foaf/0.1/", "FOAF"),
    "ls": ("https://standards.iso.org/iso/21597/-1/ed-1/en/Linkset#", "ISO 21597"),
    "ifc": ("https://standards.buildingsmart.org/IFC/DEV/IFC4/ADD2_TC1/OWL#", "buildingSMART"),
    "skos": ("http://www.w3.org/2004/02/skos/core#", "W3C"),
    "owl": ("http://www.w3.org/2002/07/owl#", "W3C"),
    "ldv": ("https://example.org/ldv/profile#", "this thesis"),
}

# ---- Fixed values: further prefixes that occur in records but have no steward entry.
OTHER_PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "unit": "http://qudt.org/vocab/unit/",
    "ex": "https://example.org/ldv/id/",
    "ldvc": "https://example.org/ldv/concept/",
    "ldvm": "https://example.org/ldv/metric/",
}
BASE_IRI = "https://example.org/ldv/package/"
PROFILE_IRI = "https://example.org/ldv/profile/v0.6"
PROFILE_VERSION = "0.6"

PREFIXES = {**{p: ns for p, (ns, _) in VOCABULARIES.items()}, **OTHER_PREFIXES}


def iri(term: str) -> str:
    """``prefix:name`` to a full IRI, for the prefixes above."""
    prefix, name = term.split(":", 1)
    return PREFIXES[prefix] + name


RDF_TYPE = iri("rdf:type")
RDF_FIRST = iri("rdf:first")
RDF_REST = iri("rdf:rest")
RDF_NIL = iri("rdf:nil")

SEVERITY_RANK = {"Violation": 0, "Warning": 1, "Info": 2}
