"""The record profile's rules as table jobs.

Property rules are rows of a small constant table; each constraint kind is one join or filter over all rules of
that kind. Cross-field rules are one function each. All give
``results(record_id, severity, focus, path, message, rule_id)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkledger.functions.text import local_name
from linkledger.model import RDF_FIRST, RDF_TYPE, SEVERITY_RANK, iri
from linkledger.operators.graph import list_members, with_list_members
from linkledger.session import cut_lineage


class Rule(NamedTuple):
    """One constraint of a property. ``kind``: min, max, iri, datatype, class, in, pattern, node or any."""

    shape: str
    path: str
    kind: str
    param: str
    severity: str
    message: str

    @property
    def rule_id(self) -> str:
        return f"{self.shape}/{local_part(self.path)}/{self.kind}"


def local_part(value: str) -> str:
    return value.rsplit("#", 1)[-1] if "#" in value else value.rstrip("/").rsplit("/", 1)[-1]


RESULT_COLUMNS = ("record_id", "severity", "focus", "path", "message", "rule_id")
RULE_SCHEMA = "shape STRING, path STRING, kind STRING, param STRING, severity STRING, message STRING, rule_id STRING"

# ---- Fixed values: how a shape finds its focus nodes.
TARGETS = [
    ("Record", "class", "dcat:CatalogRecord"),
    ("QualityMeasurement", "class", "dqv:QualityMeasurement"),
    ("Distribution", "object", "sosa:hasResult"),
    ("Observation", "class", "sosa:Observation"),
    ("FrequencyAxis", "object", "ldv:frequencyAxis"),
    ("QuantityValue", "class", "qudt:QuantityValue"),
    ("Element", "class", "bot:Element"),
    ("MaterialLayer", "class", "ifc:IfcMaterialLayer"),
    ("LayerList", "subject", "dcterms:hasPart"),
    ("Binding", "class", "ls:DirectedLink"),
    ("LinkElement", "class", "ls:LinkElement"),
    ("StringIdentifier", "class", "ls:StringBasedIdentifier"),
    ("ModelDocument", "object", "ls:hasDocument"),
    ("RegistrationHypothesis", "class", "ldv:RegistrationHypothesis"),
]

# ---- Fixed values: property, constraints and message per shape. ``list/`` walks an ordered list.
HEX64 = r"^[0-9a-f]{64}$"
GUID22 = r"^[0-9A-Za-z_$]{22}$"
WKT = r"^<[^>]+>\s*POINT\s*Z\s*\(\s*[-+0-9.eE]+\s+[-+0-9.eE]+\s+[-+0-9.eE]+\s*\)\s*$"
PROPERTIES = {
    "Record": [
        ("dcterms:conformsTo", {"min": 1, "iri": ""}, "Record must name the profile it conforms to."),
        ("owl:versionInfo", {"min": 1}, "Record must state its profile version."),
        ("dcterms:creator", {"min": 1, "iri": ""}, "Record must name a creator (agent IRI)."),
        ("dcterms:identifier", {"min": 1}, "Persistent identifier missing (F1)."),
        ("dcterms:license", {"min": 1}, "Licence missing (R1.1)."),
        ("foaf:primaryTopic", {"min": 1, "max": 1, "class": "sosa:Observation"}, "Record needs exactly one sosa:Observation as primary topic."),
        ("dcterms:relation", {"min": 1, "max": 1, "class": "ls:DirectedLink"}, "Record needs its binding (ls:DirectedLink)."),
        ("dqv:hasQualityMeasurement", {"min": 1}, "Record must carry a completeness report (DQV measurements)."),
    ],
    "QualityMeasurement": [("dqv:isMeasurementOf", {"min": 1, "max": 1, "iri": ""}, "")],
    "Distribution": [
        ("dcat:mediaType", {"min": 1, "iri": ""}, "Media type must be given as an IRI."),
        ("dcat:byteSize", {"min": 1, "datatype": "xsd:nonNegativeInteger"}, "byteSize must be an xsd:nonNegativeInteger."),
        ("spdx:checksum", {"min": 1, "node": "Checksum"}, "File needs a checksum node."),
        ("csvw:dialect", {"min": 1, "node": "Dialect"}, ""),
        ("csvw:tableSchema", {"min": 1, "node": "Schema"}, ""),
        ("dcterms:type", {"min": 1, "in": "ldvc:raw ldvc:derived"}, "dcterms:type must be ldvc:raw or ldvc:derived."),
        ("dcat:accessURL", {"min": 1, "warning": ""}, "No access URL recorded (A1)."),
    ],
    "Checksum": [
        ("spdx:algorithm", {"min": 1, "iri": ""}, ""),
        ("spdx:checksumValue", {"min": 1, "pattern": HEX64}, "Checksum must be 64 lowercase hex characters (SHA-256)."),
    ],
    "Dialect": [
        ("csvw:delimiter", {"min": 1}, ""), ("csvw:encoding", {"min": 1}, ""),
        ("csvw:skipRows", {"datatype": "xsd:integer"}, ""), ("csvw:headerRowCount", {"datatype": "xsd:integer"}, ""),
    ],
    "Schema": [
        ("csvw:column", {"min": 1, "max": 1}, "Columns must be one ordered @list, not an unordered set."),
        ("list/csvw:column", {"class": "csvw:Column", "node": "Column"}, ""),
    ],
    "Column": [
        ("csvw:number", {"min": 1, "datatype": "xsd:integer"}, ""), ("csvw:name", {"min": 1}, ""), ("csvw:titles", {"min": 1}, ""),
        ("qudt:hasUnit", {"any": "schema:unitText"}, ""),
    ],
    "Observation": [
        ("sosa:hasFeatureOfInterest", {"min": 1, "max": 1, "class": "sosa:Sample", "node": "Sample"}, ""),
        ("sosa:observedProperty", {"min": 1, "iri": ""}, ""), ("sosa:madeBySensor", {"min": 1, "iri": ""}, ""),
        ("sosa:usedProcedure", {"min": 1, "iri": ""}, ""), ("sosa:hasResult", {"min": 1, "iri": ""}, ""),
        ("prov:wasAssociatedWith", {"min": 1, "iri": ""}, ""), ("ldv:frequencyAxis", {"min": 1}, ""),
        ("sosa:resultTime", {"min": 1, "warning": ""}, "Exact measurement date (sosa:resultTime) not recorded."),
        ("prov:atLocation", {"min": 1, "warning": ""}, ""),
    ],
    "Sample": [
        ("dcterms:identifier", {"min": 1, "max": 1, "datatype": "xsd:integer"}, "Scan point needs its integer index (dcterms:identifier)."),
        ("geo:hasGeometry", {"min": 1, "max": 1, "node": "PointGeometry"}, ""),
        ("sosa:isSampleOf", {"min": 1, "max": 1, "iri": ""}, ""),
    ],
    "PointGeometry": [("geo:asWKT", {"min": 1, "max": 1, "datatype": "geo:wktLiteral", "pattern": WKT},
                       "Point must be 'POINT Z (x y z)' prefixed by the IRI of the scan frame (GeoSPARQL 1.1).")],
    "FrequencyAxis": [
        ("schema:minValue", {"min": 1}, ""), ("schema:maxValue", {"min": 1}, ""), ("ldv:step", {"min": 1}, ""),
        ("ldv:binCount", {"min": 1}, ""), ("qudt:hasUnit", {"min": 1, "iri": ""}, ""),
    ],
    "QuantityValue": [("qudt:numericValue", {"min": 1, "datatype": "xsd:double"}, ""), ("qudt:hasUnit", {"min": 1, "iri": ""}, "")],
    "Element": [
        ("dcterms:identifier", {"max": 1, "pattern": GUID22}, "IFC GlobalId (dcterms:identifier) must be 22 characters from [0-9A-Za-z_$]."),
        ("spdx:checksum", {"max": 1, "node": "Checksum"}, ""),
    ],
    "MaterialLayer": [("rdfs:label", {"min": 1}, ""), ("schema:depth", {"min": 1, "max": 1, "node": "QuantitativeValue"}, "")],
    "QuantitativeValue": [("schema:value", {"min": 1, "datatype": "xsd:double"}, ""), ("schema:unitCode", {"min": 1}, "")],
    "LayerList": [("dcterms:hasPart", {"max": 1}, "Layer stack must be one ordered @list.")],
    "Binding": [
        ("ls:hasFromLinkElement", {"min": 1, "max": 1}, ""), ("ls:hasToLinkElement", {"min": 1}, ""),
        ("ldv:associationLevel", {"min": 1, "in": "none component surface point"}, ""), ("ldv:registration", {"min": 1}, ""),
        ("prov:wasGeneratedBy", {"min": 1, "max": 1, "node": "Verification"}, "Binding needs the verification activity that produced its fingerprints."),
    ],
    "Verification": [
        ("prov:endedAtTime", {"min": 1, "datatype": "xsd:dateTime"}, "Binding needs the time it was last verified."),
        ("prov:used", {"min": 1, "class": "prov:Plan", "node": "Plan"}, ""),
    ],
    "Plan": [("dcterms:description", {"min": 1}, "Binding must state how element fingerprints are computed.")],
    "LinkElement": [("ls:hasDocument", {"min": 1, "max": 1, "iri": ""}, ""), ("ls:hasIdentifier", {"max": 1}, "")],
    "StringIdentifier": [("ls:identifier", {"min": 1, "pattern": GUID22}, ""), ("ls:identifierField", {"min": 1}, "")],
    "ModelDocument": [("spdx:checksum", {"max": 1, "node": "Checksum"}, "")],
    "RegistrationHypothesis": [("dcterms:source", {"min": 1}, ""), ("ldv:transform", {"min": 1}, "")],
}


def profile_rules() -> list[Rule]:
    """The constant tables above as one :class:`Rule` per constraint, terms expanded."""
    out = []
    for shape, properties in PROPERTIES.items():
        for path, kinds, message in properties:
            full = iri(path.removeprefix("list/")) + ("/member" if path.startswith("list/") else "")
            severity = "Warning" if "warning" in kinds else "Violation"
            for kind, param in kinds.items():
                if kind == "warning":
                    continue
                if kind in ("datatype", "class", "any"):
                    param = iri(param)
                elif kind == "in":
                    param = " ".join(iri(v) if ":" in v else v for v in param.split())
                out.append(Rule(shape, full, kind, str(param), severity, message))
    return out


def profile_targets() -> list[tuple[str, str, str]]:
    return [(shape, kind, iri(term)) for shape, kind, term in TARGETS]


def named_predicates(rules: Iterable[Rule], targets: Iterable[tuple[str, str, str]]) -> set[str]:
    """Predicates of the statements that property rules and their targets look at."""
    rules, targets = list(rules), list(targets)
    paths = {r.path for r in rules} | {r.param for r in rules if r.kind == "any"}
    lists = {RDF_FIRST} if any(p.endswith("/member") for p in paths) else set()
    return {p.removesuffix("/member") for p in paths} | lists | {RDF_TYPE} | {term for _, how, term in targets if how != "class"}


def _rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    # A constant of the program (about a hundred short rows), hence safe to broadcast.
    return F.broadcast(spark.createDataFrame([(*r, r.rule_id) for r in rules], RULE_SCHEMA))


def rule_targets(triples: DataFrame, targets: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Distinct (shape, record_id, focus) for targets by class, by object or by subject of a property."""
    spark = triples.sparkSession
    # A constant of the program (a dozen short rows), hence safe to broadcast.
    table = lambda kinds: F.broadcast(spark.createDataFrame([t for t in targets if t[1] in kinds], "shape STRING, how STRING, term STRING"))
    by_class, by_property = table(("class",)), table(("object", "subject"))
    classes = sorted({term for _, how, term in targets if how == "class"})
    properties = sorted({term for _, how, term in targets if how != "class"})
    typed = (triples.where((F.col("p") == RDF_TYPE) & F.col("o").isin(classes)).select("record_id", F.col("s").alias("focus"), F.col("o").alias("term"))
             .join(by_class, "term"))
    linked = triples.where(F.col("p").isin(properties)).select("record_id", "s", "o", F.col("p").alias("term")).join(by_property, "term")
    ends = linked.select("shape", "record_id", F.when(F.col("how") == "object", F.col("o")).otherwise(F.col("s")).alias("focus"))
    return typed.select("shape", "record_id", "focus").unionByName(ends).distinct()


def _result(df: DataFrame) -> DataFrame:
    return df.select("record_id", "shape", "severity", "focus", local_name(F.regexp_replace("path", "/member$", "")).alias("path"),
                     "message", "rule_id")


def _wanted(targets: DataFrame, rules: DataFrame) -> DataFrame:
    return targets.join(rules, "shape")


def _empty_results(triples: DataFrame) -> DataFrame:
    empty = triples.sparkSession.createDataFrame([], "record_id STRING, shape STRING, severity STRING, focus STRING, path STRING, message STRING, rule_id STRING")
    return empty


def check_cardinality(triples: DataFrame, targets: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """min and max: one result per focus node. Values are counted with map-side combine before any join."""
    mine = [r for r in rules if r.kind in ("min", "max")]
    if not mine:
        return _empty_results(triples)
    table = _rule_table(triples.sparkSession, mine)
    counts = (triples.where(F.col("p").isin(sorted({r.path for r in mine})))
              .groupBy("record_id", F.col("s").alias("focus"), F.col("p").alias("path")).agg(F.count(F.lit(1)).alias("n")))
    found = _wanted(targets, table).join(counts, ["record_id", "focus", "path"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    limit = F.col("param").cast("int")
    return _result(found.where(F.when(F.col("kind") == "min", F.col("n") < limit).otherwise(F.col("n") > limit)))


def rule_values(triples: DataFrame, targets: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Values of the rules' properties at their focus nodes, one row per (rule, focus, value)."""
    table = _rule_table(triples.sparkSession, rules)
    values = triples.where(F.col("p").isin(sorted({r.path for r in rules}))).select(
        "record_id", F.col("s").alias("focus"), F.col("p").alias("path"), "o", "o_kind", "o_type")
    return _wanted(targets, table).join(values, ["record_id", "focus", "path"])


def _values(triples: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Values of the rules' properties at any node, one row per (rule, value)."""
    table = _rule_table(triples.sparkSession, rules)
    values = triples.where(F.col("p").isin(sorted({r.path for r in rules}))).select(
        "record_id", F.col("s").alias("focus"), F.col("p").alias("path"), "o", "o_kind", "o_type")
    return values.join(table, "path")


def _of_shapes(targets: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return targets.where(F.col("shape").isin(sorted({r.shape for r in rules}))).select("record_id", "shape", "focus")


def _decided(rules: Sequence[Rule]) -> Column:
    """Does a value break the rule beside it; ``rules`` decide by the value itself."""
    kind, param = F.col("kind"), F.col("param")
    integer_range = (param == iri("xsd:nonNegativeInteger")) & ~F.col("o").rlike(r"^\+?\d+$|^-0+$")
    tests = {
        "iri": F.col("o_kind") != "iri",
        "datatype": (F.col("o_kind") != "literal") | ~F.col("o_type").eqNullSafe(param) | integer_range,
        "in": ~F.array_contains(F.split(param, " "), F.col("o")),
        "pattern": (F.col("o_kind") == "bnode") | ~F.rlike(F.col("o"), param),
    }
    return reduce(lambda found, k: found.when(kind == k, tests[k]), sorted({r.kind for r in rules} & set(tests)), F.when(F.lit(False), F.lit(False)))


def check_values(triples: DataFrame, targets: DataFrame, rules: Sequence[Rule], kinds: Sequence[str] = ("iri", "datatype", "in", "pattern")) -> DataFrame:
    """Constraints that one value decides by itself: node kind, datatype, list of values, pattern."""
    mine = [r for r in rules if r.kind in kinds]
    if not mine:
        return _empty_results(triples)
    bad = _decided(mine)
    # Faulty values are few: they are picked out where they are read, before they meet the focus nodes.
    faulty = _values(triples, mine).where(bad)
    return _result(faulty.join(_of_shapes(targets, mine), ["record_id", "shape", "focus"], "left_semi"))


def check_class(triples: DataFrame, targets: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Values that lack the type a rule asks for."""
    mine = [r for r in rules if r.kind == "class"]
    if not mine:
        return _empty_results(triples)
    types = triples.where((F.col("p") == RDF_TYPE) & F.col("o").isin(sorted({r.param for r in mine}))).select(
        "record_id", F.col("s").alias("o"), F.col("o").alias("param"))
    return _result(rule_values(triples, targets, mine).join(types, ["record_id", "o", "param"], "left_anti"))


def check_any_of(triples: DataFrame, targets: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Focus nodes that have neither the property nor its alternative."""
    mine = [r for r in rules if r.kind == "any"]
    if not mine:
        return _empty_results(triples)
    table = _rule_table(triples.sparkSession, mine)
    wanted = _wanted(targets, table)
    # Which rules each property satisfies, as one map of constants.
    serves: dict[str, list[str]] = {}
    for r in mine:
        for p in (r.path, r.param):
            serves.setdefault(p, []).append(r.rule_id)
    lookup = F.create_map(*[x for p, ids in sorted(serves.items()) for x in (F.lit(p), F.array(*map(F.lit, ids)))])
    either = triples.where(F.col("p").isin(sorted(serves))).select(
        "record_id", F.col("s").alias("focus"), F.explode(F.element_at(lookup, F.col("p"))).alias("rule_id")).distinct()
    return _result(wanted.join(either, ["record_id", "focus", "rule_id"], "left_anti"))


class _Events:
    """Numbers for what statements tell about a node: a value of a path, a shape, a faulty value of a rule, a type."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}

    def __call__(self, *what) -> int:
        return self.numbers.setdefault(what, len(self.numbers))


def _lookup(events: dict[str, list[int]], key: str) -> Column:
    """The numbers listed under a term, none for other terms; ``events`` is a constant of the program."""
    none = F.array().cast("array<int>")
    if not events:
        return none
    table = F.create_map(*[x for term, numbers in sorted(events.items()) for x in (F.lit(term), F.array(*map(F.lit, numbers)))])
    return F.coalesce(F.element_at(table, F.col(key)), none)


def node_table(triples: DataFrame, rules: Sequence[Rule], targets: Sequence[tuple[str, str, str]], events: _Events) -> DataFrame:
    """``nodes(record_id, node, events, uses)``: all that the rules ask of a node, gathered in one aggregation.

    ``events`` are numbers of values per path, shapes, faulty values and types, repeats included. ``uses`` are the
    (focus, rule) of every value that is this node and has to be of a class or nested shape.
    """
    by_path: dict[str, list[int]] = {}
    by_class: dict[str, list[int]] = {}
    by_object: dict[str, list[int]] = {}
    asking: dict[str, list[int]] = {}

    def put(where: dict[str, list[int]], term: str, number: int) -> None:
        if number not in where.setdefault(term, []):
            where[term].append(number)

    for i, r in enumerate(rules):
        if r.kind in ("min", "max", "any"):
            for path in (r.path, r.param) if r.kind == "any" else (r.path,):
                put(by_path, path, events("path", path))
        elif r.kind in ("class", "node"):
            put(asking, r.path, i)
            if r.kind == "class":
                put(by_class, r.param, events("type", r.param))
            else:
                put(by_object, r.path, events("shape", r.param))
    for shape, how, term in targets:
        put({"class": by_class, "object": by_object, "subject": by_path}[how], term, events("shape", shape))
    valued = [(i, r) for i, r in enumerate(rules) if r.kind in ("iri", "datatype", "in", "pattern")]
    none, no_use = F.array().cast("array<int>"), F.lit(None).cast("struct<focus: string, rule: int>").alias("use")
    told = triples.where(F.col("p").isin(sorted(by_path)) | ((F.col("p") == RDF_TYPE) & F.col("o").isin(sorted(by_class)))).select(
        "record_id", F.col("s").alias("node"),
        F.concat(_lookup(by_path, "p"), F.when(F.col("p") == RDF_TYPE, _lookup(by_class, "o")).otherwise(none)).alias("event"), no_use)
    parts = [told]
    if by_object:
        parts.append(triples.where(F.col("p").isin(sorted(by_object))).select(
            "record_id", F.col("o").alias("node"), _lookup(by_object, "p").alias("event"), no_use))
    if asking:
        parts.append(triples.where(F.col("p").isin(sorted(asking))).select(
            "record_id", F.col("o").alias("node"), none.alias("event"), F.col("s").alias("focus"), F.explode(_lookup(asking, "p")).alias("rule")).select(
            "record_id", "node", "event", F.struct("focus", "rule").alias("use")))
    if valued:
        numbers = F.broadcast(triples.sparkSession.createDataFrame([(r.rule_id, events("fault", i)) for i, r in valued], "rule_id STRING, number INT"))
        faulty = _values(triples, [r for _, r in valued]).where(_decided([r for _, r in valued])).join(numbers, "rule_id")
        parts.append(faulty.select("record_id", F.col("focus").alias("node"), F.array("number").alias("event"), no_use))
    return reduce(DataFrame.unionByName, parts).groupBy("record_id", "node").agg(
        F.flatten(F.collect_list("event")).alias("events"), F.collect_list("use").alias("uses"))


def _own_failures(nodes: DataFrame, rules: Sequence[Rule], events: _Events) -> DataFrame:
    """(record_id, node, rule) of what a node's own statements decide, one row per result."""
    counted = []
    for i, r in enumerate(rules):
        if r.kind in ("min", "max"):
            counted.append((i, r.kind, int(r.param), [events("path", r.path)], events("shape", r.shape)))
        elif r.kind == "any":
            counted.append((i, "min", 1, [events("path", r.path), events("path", r.param)], events("shape", r.shape)))
        elif r.kind not in ("class", "node"):
            counted.append((i, "each", 0, [events("fault", i)], events("shape", r.shape)))
    table = F.broadcast(nodes.sparkSession.createDataFrame(counted, "rule INT, how STRING, least INT, paths ARRAY<INT>, shape INT"))
    shapes = [number for what, number in events.numbers.items() if what[0] == "shape"]
    # A node belongs to few shapes, each listed once.
    of = nodes.select("record_id", "node", "events", F.explode(F.array_distinct(F.filter("events", lambda e: e.isin(shapes)))).alias("shape"))
    n = F.size(F.filter("events", lambda e: F.array_contains("paths", e)))
    times = F.when(F.col("how") == "min", (n < F.col("least")).cast("int")).when(F.col("how") == "max", (n > F.col("least")).cast("int")).otherwise(n)
    found = of.join(table, "shape").select("record_id", "node", "rule", times.alias("times")).where(F.col("times") > 0)
    return found.select("record_id", "node", "rule", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("one")).drop("one")


def property_results(triples: DataFrame, rules: Sequence[Rule] | None = None,
                     targets: Sequence[tuple[str, str, str]] | None = None) -> DataFrame:
    """Results of all property rules.

    One aggregation gathers per node what the rules ask of it; most rules are then decided in that row. Values that lack a
    class or fail a nested shape are few, and only these look up the node they belong to, one join per nesting level.
    Nested results show up as the outer property that failed.
    """
    rules = list(profile_rules() if rules is None else rules)
    targets = list(profile_targets() if targets is None else targets)
    spark = triples.sparkSession
    listed = sorted({r.path.removesuffix("/member") for r in rules if r.path.endswith("/member")})
    triples = with_list_members(triples, listed)
    outer = {shape for shape, _, _ in targets}
    nested = {r.param for r in rules if r.kind == "node"}
    if outer & nested:
        raise ValueError(f"shapes are targeted or nested, not both: {sorted(outer & nested)}")
    events = _Events()
    nodes = cut_lineage(node_table(triples, rules, targets, events), "rule_nodes")
    asking = [(i, r.kind, events("shape", r.shape), events("type", r.param) if r.kind == "class" else events("shape", r.param))
              for i, r in enumerate(rules) if r.kind in ("class", "node")]
    failing = _own_failures(nodes, rules, events)
    if asking:
        table = F.broadcast(spark.createDataFrame(asking, "rule INT, kind STRING, shape INT, wanted INT"))
        askers = nodes.where(F.arrays_overlap("events", F.array(*[F.lit(n) for n in sorted({a[2] for a in asking})])))
        used = nodes.where(F.size("uses") > 0).select("record_id", "node", "events", F.inline("uses")).join(table, "rule")

        def at_focus(found: DataFrame) -> DataFrame:
            """Failures of values as failures of the nodes that have them, where these are of the rule's shape."""
            here = found.select("record_id", F.col("focus").alias("node"), "rule", "shape")
            return (here.join(askers.select("record_id", "node", F.col("events").alias("known")), ["record_id", "node"])
                    .where(F.array_contains("known", F.col("shape"))).select("record_id", "node", "rule"))

        lacking = used.where((F.col("kind") == "class") & ~F.array_contains("events", F.col("wanted")))
        failing = failing.unionByName(at_focus(lacking))
    # Failures are few and every nesting level reads them.
    failing = cut_lineage(failing, "rule_failures")
    results = failing
    if nested:
        shape_of = F.broadcast(spark.createDataFrame([(i, events("shape", r.shape)) for i, r in enumerate(rules)], "rule INT, wanted INT"))
        mine = [(i, r) for i, r in enumerate(rules) if r.kind == "node"]
        settled = {r.shape for r in rules} - {r.shape for _, r in mine}
        waiting = {r.shape for _, r in mine}
        settled |= nested - waiting
        while waiting:
            ready = sorted(s for s in waiting if {r.param for _, r in mine if r.shape == s} <= settled)
            if not ready:
                raise ValueError("nested shapes refer to each other")
            now = [i for i, r in mine if r.shape in ready]
            needed = sorted({events("shape", rules[i].param) for i in now})
            failed = results.join(shape_of, "rule").where(F.col("wanted").isin(needed)).select("record_id", "node", "wanted").distinct()
            hit = used.where(F.col("rule").isin(now)).join(failed, ["record_id", "node", "wanted"], "left_semi")
            results = results.unionByName(at_focus(hit))
            settled |= set(ready)
            waiting -= set(ready)
    names = F.broadcast(spark.createDataFrame([(i, *r, r.rule_id) for i, r in enumerate(rules) if r.shape in outer], "rule INT, " + RULE_SCHEMA))
    return _result(results.join(names, "rule").withColumnRenamed("node", "focus")).select(*RESULT_COLUMNS)


# ------------------------------------------------------------------ cross-field rules

def _typed(triples: DataFrame, cls: str) -> DataFrame:
    return triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == iri(cls))).select("record_id", F.col("s").alias("focus")).distinct()


def _objects(triples: DataFrame, path: str, name: str = "value") -> DataFrame:
    return triples.where(F.col("p") == iri(path)).select("record_id", F.col("s").alias("focus"), F.col("o").alias(name))


def _subjects_with(triples: DataFrame, path: str) -> DataFrame:
    return triples.where(F.col("p") == iri(path)).select("record_id", F.col("s").alias("focus")).distinct()


def _rule(df: DataFrame, name: str, message: str, severity: str = "Violation", path: str = "-") -> DataFrame:
    return df.select("record_id", F.lit(severity).alias("severity"), "focus", F.lit(path).alias("path"),
                     F.lit(message).alias("message"), F.lit(name).alias("rule_id"))


def measurement_facts(triples: DataFrame) -> DataFrame:
    """(record_id, measurement, metric, value, focus): metric as IRI tail, value and owning node null where missing."""
    metric = _objects(triples, "dqv:isMeasurementOf", "m").select("record_id", F.col("focus").alias("measurement"), local_name("m").alias("metric"))
    value = _objects(triples, "dqv:value").withColumnRenamed("focus", "measurement")
    owner = _objects(triples, "dqv:hasQualityMeasurement", "measurement")
    on = ["record_id", "measurement"]
    return metric.join(value, on, "left").join(owner, on, "left")


def _measured(triples: DataFrame, facts: DataFrame | None, test) -> DataFrame:
    """Nodes with a quality measurement whose (metric, value) passes ``test``."""
    facts = measurement_facts(triples) if facts is None else facts
    return facts.where(test & F.col("focus").isNotNull()).select("record_id", "focus").distinct()


def rule_completeness_declared(triples: DataFrame, facts: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Fires when both lists are missing; ``strict`` also when only one is, as the message says."""
    facts = measurement_facts(triples) if facts is None else facts
    named = facts.where(F.col("metric").isin("absentFields", "unresolvedFields") & F.col("focus").isNotNull())
    kinds = named.groupBy("record_id", "focus").agg(F.max(F.col("metric") == "absentFields").alias("a"), F.max(F.col("metric") == "unresolvedFields").alias("u"))
    enough = kinds.where((F.col("a") & F.col("u")) if strict else (F.col("a") | F.col("u")))
    bad = _typed(triples, "dcat:CatalogRecord").join(enough, ["record_id", "focus"], "left_anti")
    return _rule(bad, "completeness_declared", "Completeness report needs both the absentFields and the unresolvedFields measurement.")


def rule_axis_arithmetic(triples: DataFrame) -> DataFrame:
    """Bin count against (max - min) / step + 1 of a frequency axis."""
    axis = triples.where(F.col("p") == iri("ldv:frequencyAxis")).select("record_id", F.col("o").alias("focus")).distinct()
    fields = {"mn": iri("schema:minValue"), "mx": iri("schema:maxValue"), "st": iri("ldv:step"), "n": iri("ldv:binCount")}
    cells = [F.min(F.when(F.col("p") == p, F.col("o").try_cast("double"))).alias(k) for k, p in fields.items()]
    numbers = triples.where(F.col("p").isin(list(fields.values()))).groupBy("record_id", F.col("s").alias("focus")).agg(*cells)
    bad = axis.join(numbers, ["record_id", "focus"]).where(
        (F.col("st") != 0) & (F.col("n") != F.try_divide(F.col("mx") - F.col("mn"), F.col("st")) + 1))
    return _rule(bad, "axis_arithmetic", "binCount does not equal (max - min) / step + 1.")


def rule_unresolved_status(triples: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """A warning for an unresolved procedure, a violation when the record does not list it as unresolved."""
    facts = measurement_facts(triples) if facts is None else facts
    open_status = (F.col("metric") == "status") & (F.col("value") == "unresolved")
    unresolved = _typed(triples, "sosa:Procedure").join(_measured(triples, facts, open_status), ["record_id", "focus"], "left_semi")
    listed = facts.where((F.col("metric") == "unresolvedFields") & (F.col("value") == "excitationType")).select("record_id").distinct()
    warning = _rule(unresolved, "unresolved_status", "Excitation type is unresolved (lab form and file disagree).", "Warning")
    return warning.unionByName(_rule(
        unresolved.join(listed, "record_id", "left_anti"), "unresolved_not_listed",
        "Procedure is marked unresolved but 'excitationType' is not in the unresolvedFields measurement."))


def rule_bound_needs_fingerprint(triples: DataFrame) -> DataFrame:
    bad = (_typed(triples, "bot:Element").join(_subjects_with(triples, "dcterms:identifier"), ["record_id", "focus"], "left_semi")
           .join(_subjects_with(triples, "spdx:checksum"), ["record_id", "focus"], "left_anti"))
    return _rule(bad, "bound_needs_fingerprint", "Bound IFC element (has a GlobalId) needs an element fingerprint (spdx:checksum).")


def rule_list_members_typed(triples: DataFrame) -> DataFrame:
    """One result per list member that is neither a sub-element nor a layer."""
    members = list_members(triples, iri("dcterms:hasPart")).select("record_id", F.col("s").alias("focus"), F.col("o").alias("member")).distinct()
    parts = _objects(triples, "bot:hasSubElement", "member")
    layers = _typed(triples, "ifc:IfcMaterialLayer").withColumnRenamed("focus", "member")
    bad = members.join(parts, ["record_id", "focus", "member"], "left_anti").join(layers, ["record_id", "member"], "left_anti")
    return _rule(bad, "list_members_typed", "Layer list contains an entry that is neither a sub-element of the wall nor an ifc:IfcMaterialLayer.")


def rule_binding_status(triples: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    known = (F.col("metric") == "bindingStatus") & F.col("value").isin("valid", "stale", "unknown")
    bad = _typed(triples, "ls:DirectedLink").join(_measured(triples, facts, known), ["record_id", "focus"], "left_anti")
    return _rule(bad, "binding_status_known", "Binding needs a bindingStatus measurement: valid, stale or unknown.")


def rule_link_covers_elements(triples: DataFrame) -> DataFrame:
    """One result per (binding, element id) where no link element of the binding names the fingerprinted element."""
    gids = (_typed(triples, "bot:Element").join(_subjects_with(triples, "spdx:checksum"), ["record_id", "focus"], "left_semi")
            .join(_objects(triples, "dcterms:identifier", "gid"), ["record_id", "focus"]).select("record_id", "gid").distinct())
    links = _typed(triples, "ls:DirectedLink")
    ends = _objects(triples, "ls:hasToLinkElement", "end")
    idents = _objects(triples, "ls:hasIdentifier", "ident").withColumnRenamed("focus", "end")
    texts = _objects(triples, "ls:identifier", "gid").withColumnRenamed("focus", "ident")
    named = (ends.join(idents, ["record_id", "end"]).join(texts, ["record_id", "ident"])
             .select("record_id", "focus", "gid").distinct())
    # Ids that all bindings of their record name are out before any binding meets an id.
    bindings = links.groupBy("record_id").agg(F.count(F.lit(1)).alias("bindings"))
    covered = named.join(links, ["record_id", "focus"], "left_semi").groupBy("record_id", "gid").agg(F.count(F.lit(1)).alias("naming"))
    missed = (gids.join(covered, ["record_id", "gid"], "left").join(bindings, "record_id")
              .where(F.coalesce("naming", F.lit(0)) < F.col("bindings")).select("record_id", "gid"))
    bad = missed.join(links, "record_id").join(named, ["record_id", "focus", "gid"], "left_anti")
    return _rule(bad, "link_covers_elements", "An element of the specimen has a GlobalId that no link element of this binding names.")


def rule_document_complete(triples: DataFrame) -> DataFrame:
    documents = triples.where(F.col("p") == iri("ls:hasDocument")).select("record_id", F.col("o").alias("focus")).distinct()
    checksums = _subjects_with(triples, "spdx:checksum").withColumn("c", F.lit(True))
    times = _subjects_with(triples, "dcterms:modified").withColumn("t", F.lit(True))
    on = ["record_id", "focus"]
    bad = (documents.join(_subjects_with(triples, "dcat:downloadURL"), on, "left_semi").join(_typed(triples, "dcat:CatalogRecord"), on, "left_anti")
           .join(checksums, on, "left").join(times, on, "left").where(F.col("c").isNull() | F.col("t").isNull()))
    return _rule(bad, "document_complete", "A document that carries a download URL needs a checksum and a modification time.")


def rule_association_conditions(triples: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The three conditions on surface and point associations."""
    on = ["record_id", "focus"]
    fine = (_typed(triples, "ls:DirectedLink").join(
        _objects(triples, "ldv:associationLevel").where(F.col("value").isin("surface", "point")).select(*on).distinct(), on, "left_semi"))
    hypotheses = _objects(triples, "prov:wasInfluencedBy", "h")
    transforms = _subjects_with(triples, "ldv:transform").withColumnRenamed("focus", "h")
    with_transform = hypotheses.join(transforms, ["record_id", "h"], "left_semi")
    open_registration = _objects(triples, "ldv:registration").where(F.col("value") == "not established")
    samples = triples.where(F.col("p") == iri("sosa:hasFeatureOfInterest")).select("record_id", F.col("o").alias("focus"))
    geometries = _objects(triples, "geo:hasGeometry", "g").join(samples, on, "left_semi").select("record_id", F.col("g").alias("focus"))
    absent = _measured(triples, facts, (F.col("metric") == "definitionStatus") & (F.col("value") == "absent"))
    no_frame = geometries.join(absent, on, "left_semi").select("record_id").distinct()
    return (
        _rule(fine.join(with_transform, on, "left_anti"), "association_needs_transform",
              "Surface or point association requires an ldv:transform on the registration hypothesis.")
        .unionByName(_rule(fine.join(open_registration, on, "left_semi"), "association_needs_registration",
                           "Surface or point association is not allowed while registration is 'not established'."))
        .unionByName(_rule(fine.join(no_frame, "record_id", "left_semi"), "association_needs_frame",
                           "Surface or point association is not allowed while the scan frame definition is absent.")))


def rule_derived_needs_source(triples: DataFrame) -> DataFrame:
    results = triples.where(F.col("p") == iri("sosa:hasResult")).select("record_id", F.col("o").alias("focus")).distinct()
    derived = _objects(triples, "dcterms:type").where(F.col("value") == iri("ldvc:derived"))
    on = ["record_id", "focus"]
    bad = results.join(derived, on, "left_semi").join(_subjects_with(triples, "prov:wasDerivedFrom"), on, "left_anti")
    return _rule(bad, "derived_needs_source", "Data marked ldvc:derived must name its source (prov:wasDerivedFrom).")


def rule_hypothesis_status(triples: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    value = F.col("value")
    known = (F.col("metric") == "status") & (value.startswith("declared") | value.startswith("ASSUMED") | (value == "confirmed by lab"))
    bad = _typed(triples, "ldv:RegistrationHypothesis").join(_measured(triples, facts, known), ["record_id", "focus"], "left_anti")
    return _rule(bad, "hypothesis_status_known",
                 "Hypothesis needs a status measurement: 'declared by model; not confirmed by lab', 'declared in project.json; "
                 "not confirmed by lab', 'ASSUMED default; nobody declared it' or 'confirmed by lab'.")


# Rules that look at measurement facts, and rules that need statements only.
FACT_RULES = (rule_completeness_declared, rule_unresolved_status, rule_binding_status, rule_association_conditions, rule_hypothesis_status)
STATEMENT_RULES = (rule_axis_arithmetic, rule_bound_needs_fingerprint, rule_list_members_typed, rule_link_covers_elements,
                   rule_document_complete, rule_derived_needs_source)


# ---- Fixed values: the predicates each cross-field rule looks at, besides the types.
FACT_PREDICATES = "dqv:isMeasurementOf dqv:value dqv:hasQualityMeasurement"
CROSS_PREDICATES = {
    rule_completeness_declared: FACT_PREDICATES,
    rule_axis_arithmetic: "ldv:frequencyAxis schema:minValue schema:maxValue ldv:step ldv:binCount",
    rule_unresolved_status: FACT_PREDICATES,
    rule_bound_needs_fingerprint: "dcterms:identifier spdx:checksum",
    rule_list_members_typed: "dcterms:hasPart rdf:first bot:hasSubElement",
    rule_binding_status: FACT_PREDICATES,
    rule_link_covers_elements: "spdx:checksum dcterms:identifier ls:hasToLinkElement ls:hasIdentifier ls:identifier",
    rule_document_complete: "ls:hasDocument spdx:checksum dcterms:modified dcat:downloadURL",
    rule_association_conditions: FACT_PREDICATES + " ldv:associationLevel prov:wasInfluencedBy ldv:transform ldv:registration sosa:hasFeatureOfInterest geo:hasGeometry",
    rule_derived_needs_source: "sosa:hasResult dcterms:type prov:wasDerivedFrom",
    rule_hypothesis_status: FACT_PREDICATES,
}


def cross_predicates(*rules) -> set[str]:
    """Predicates of the statements that these cross-field rules look at."""
    return {RDF_TYPE, *(iri(p) for rule in rules for p in CROSS_PREDICATES[rule].split())}


def validate(triples: DataFrame) -> DataFrame:
    """All results of the profile for every record.

    ``triples`` should be a stored table, best sorted by predicate: every rule reads its own predicates from it.
    """
    facts = cut_lineage(measurement_facts(triples), "measurement_facts")
    parts = [property_results(triples)] + [rule(triples, facts) for rule in FACT_RULES] + [rule(triples) for rule in STATEMENT_RULES]
    return reduce(DataFrame.unionByName, parts)


def severity_rank(column="severity"):
    """Sort position of a severity; unknown ones last."""
    out = F.lit(len(SEVERITY_RANK))
    for name, rank in SEVERITY_RANK.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def validation_summary(results: DataFrame, records: DataFrame) -> DataFrame:
    """Counts per record of ``records(record_id)``. ``conforms`` counts every result, ``conforms_mandatory`` violations only."""
    counts = results.groupBy("record_id").agg(F.count_if(F.col("severity") == "Violation").alias("violations"),
                                              F.count_if(F.col("severity") == "Warning").alias("warnings"),
                                              F.count(F.lit(1)).alias("results"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("violations", "warnings", "results")]
    filled = records.select("record_id").distinct().join(counts, "record_id", "left").select("record_id", *zero)
    return filled.withColumns({"conforms": F.col("results") == 0, "conforms_mandatory": F.col("violations") == 0})
