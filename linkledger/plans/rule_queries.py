"""Queries on rule validation, over records with one planted defect each."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkledger.model import iri
from linkledger.operators import rules as R
from linkledger.plans import standins as S
from linkledger.plans.catalog import query

OUTER = {shape for shape, _, _ in R.TARGETS}


def expected(*rows: tuple[str, str, str]) -> str:
    """SQL of results from (rule_id, severity, condition on the defect code ``k``)."""
    parts = [f"SELECT record_id, '{rule}' AS rule_id, '{severity}' AS severity FROM R WHERE {when}" for rule, severity, when in rows]
    return "WITH " + S.RECORD_SQL + " " + " UNION ALL ".join(parts)


CARDINALITY = [
    ("Record/identifier/min", "Violation", "true"), ("Record/license/min", "Violation", "true"), ("Record/creator/min", "Violation", "k=12"),
    ("Record/hasQualityMeasurement/min", "Violation", "k=31"), ("Distribution/mediaType/min", "Violation", "k=1"),
    ("Distribution/accessURL/min", "Warning", "true"), ("Observation/wasAssociatedWith/min", "Violation", "k=12"),
    ("Observation/resultTime/min", "Warning", "true"), ("Observation/atLocation/min", "Warning", "k=11"),
    ("FrequencyAxis/hasUnit/min", "Violation", "k=6"), ("QuantityValue/numericValue/min", "Violation", "k=13"),
    ("MaterialLayer/depth/min", "Violation", "k=18"), ("RegistrationHypothesis/transform/min", "Violation", "k=20"),
]
NODE_KIND = [("Distribution/mediaType/iri", "Violation", "k=35")]
DATATYPE = [("Distribution/byteSize/datatype", "Violation", "k=2")]
IN_LIST = [("Distribution/type/in", "Violation", "k=4"), ("Binding/associationLevel/in", "Violation", "k=22")]
PATTERN = [("Element/identifier/pattern", "Violation", "k=14"), ("StringIdentifier/identifier/pattern", "Violation", "k=14")]
CLASS = [("Observation/hasFeatureOfInterest/class", "Violation", "k=36")]
NESTED = [("Distribution/checksum/node", "Violation", "k=3"), ("Distribution/tableSchema/node", "Violation", "k=32"),
          ("Observation/hasFeatureOfInterest/node", "Violation", "k=10"), ("Binding/wasGeneratedBy/node", "Violation", "k IN (26,27)")]
CROSS = {
    "completeness_declared": [("completeness_declared", "Violation", "k=31")],
    "axis_arithmetic": [("axis_arithmetic", "Violation", "k=7")],
    "unresolved_status": [("unresolved_status", "Warning", "k IN (8,9)"), ("unresolved_not_listed", "Violation", "k=9")],
    "bound_needs_fingerprint": [("bound_needs_fingerprint", "Violation", "k=15")],
    "list_members_typed": [("list_members_typed", "Violation", "k=19")],
    "binding_status_known": [("binding_status_known", "Violation", "k IN (23,24)")],
    "link_covers_elements": [("link_covers_elements", "Violation", "k=17")],
    "document_complete": [("document_complete", "Violation", "k=25")],
    "association_conditions": [("association_needs_transform", "Violation", "k=20"), ("association_needs_registration", "Violation", "k=20"),
                               ("association_needs_frame", "Violation", "k=21")],
    "derived_needs_source": [("derived_needs_source", "Violation", "k=5")],
    "hypothesis_status_known": [("hypothesis_status_known", "Violation", "k=28")],
}
CROSS_FUNCTIONS = {
    "completeness_declared": R.rule_completeness_declared, "axis_arithmetic": R.rule_axis_arithmetic, "unresolved_status": R.rule_unresolved_status,
    "bound_needs_fingerprint": R.rule_bound_needs_fingerprint, "list_members_typed": R.rule_list_members_typed,
    "binding_status_known": R.rule_binding_status, "link_covers_elements": R.rule_link_covers_elements, "document_complete": R.rule_document_complete,
    "association_conditions": R.rule_association_conditions, "derived_needs_source": R.rule_derived_needs_source,
    "hypothesis_status_known": R.rule_hypothesis_status,
}


def shown(results):
    return results.select("record_id", "rule_id", "severity")


def outer_rules():
    return [r for r in R.profile_rules() if r.shape in OUTER]


@query("rule_targets", "WITH " + S.RECORD_SQL + """
SELECT shape, n::BIGINT AS n FROM (SELECT 'Record' AS shape, count(*) AS n FROM R UNION ALL SELECT 'Distribution', count(*) FROM R UNION ALL SELECT 'Observation', count(*) FROM R
  UNION ALL SELECT 'FrequencyAxis', count(*) FROM R UNION ALL SELECT 'QuantityValue', count(*) FROM R UNION ALL SELECT 'Element', sum(1+doc_id%2) FROM R
  UNION ALL SELECT 'MaterialLayer', sum(CASE WHEN k=19 THEN 1 ELSE 2 END) FROM R UNION ALL SELECT 'LayerList', count(*) FROM R UNION ALL SELECT 'Binding', count(*) FROM R
  UNION ALL SELECT 'LinkElement', sum(CASE WHEN doc_id%2=1 AND k<>17 THEN 3 ELSE 2 END) FROM R UNION ALL SELECT 'StringIdentifier', sum(CASE WHEN doc_id%2=1 AND k<>17 THEN 2 ELSE 1 END) FROM R
  UNION ALL SELECT 'ModelDocument', count(*)*2 FROM R UNION ALL SELECT 'RegistrationHypothesis', count(*) FROM R
  UNION ALL SELECT 'QualityMeasurement', sum(3 + (k<>23)::INT + (k=21)::INT + (k NOT IN (30,31))::INT + (k<>31)::INT) FROM R) t""")
def rule_targets(spark, sf_dir):
    targets = R.rule_targets(S.record_triples(spark, sf_dir), R.profile_targets())
    return targets.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@query("min_count_max_count", expected(*CARDINALITY))
def cardinality(spark, sf_dir):
    t = S.record_triples(spark, sf_dir)
    return shown(R.check_cardinality(t, R.rule_targets(t, R.profile_targets()), outer_rules()))


TOO_MANY = {37: ["foaf:primaryTopic", "ls:hasFromLinkElement"], 38: ["dcterms:relation", "schema:depth", "prov:wasGeneratedBy"], 39: ["sosa:hasFeatureOfInterest", "ls:hasDocument"]}


@query("max_count", "WITH " + S.RECORD_SQL + """
SELECT record_id, rule_id, 'Violation' AS severity FROM (SELECT record_id, unnest(['Record/primaryTopic/max','Binding/hasFromLinkElement/max']) AS rule_id FROM R WHERE k=37
  UNION ALL SELECT record_id, unnest(['Record/relation/max','MaterialLayer/depth/max','MaterialLayer/depth/max','Binding/wasGeneratedBy/max']) FROM R WHERE k=38
  UNION ALL SELECT record_id, 'Observation/hasFeatureOfInterest/max' FROM R WHERE k=39
  UNION ALL SELECT record_id, r FROM (SELECT record_id, 'LinkElement/hasDocument/max' AS r, unnest(range(CASE WHEN doc_id%2=1 THEN 3 ELSE 2 END)) FROM R WHERE k=39)) t""")
def max_count(spark, sf_dir):
    # Three codes of records whose properties have a second value where one is allowed.
    t = S.record_triples(spark, sf_dir)
    code = F.substring_index("record_id", "-", -1).cast("bigint") % S.DEFECTS
    doubled = [(code == k) & F.col("p").isin([iri(p) for p in paths]) for k, paths in TOO_MANY.items()]
    second = t.where(doubled[0] | doubled[1] | doubled[2]).withColumn("o", F.concat("o", F.lit("/second")))
    targets = R.rule_targets(t, R.profile_targets())
    return shown(R.check_cardinality(t.unionByName(second), targets, [r for r in outer_rules() if r.kind == "max"]))


def targets_of(rules):
    """The profile's targets of the shapes that these rules belong to."""
    shapes = {r.shape for r in rules}
    return [t for t in R.profile_targets() if t[0] in shapes]


def value_query(kind):
    def run(spark, sf_dir):
        rules = [r for r in outer_rules() if r.kind == kind]
        t = S.record_triples(spark, sf_dir, R.named_predicates(rules, targets_of(rules)))
        return shown(R.check_values(t, R.rule_targets(t, targets_of(rules)), rules, (kind,)))

    return run


for _name, _kind, _rows in (("node_kind", "iri", NODE_KIND), ("datatype", "datatype", DATATYPE), ("in_list", "in", IN_LIST), ("pattern", "pattern", PATTERN)):
    query(_name, expected(*_rows))(value_query(_kind))


@query("has_class", expected(*CLASS))
def has_class(spark, sf_dir):
    t = S.record_triples(spark, sf_dir)
    return shown(R.check_class(t, R.rule_targets(t, R.profile_targets()), outer_rules()))


@query("any_of", expected(("Column/hasUnit/any", "Violation", "k=32")))
def any_of(spark, sf_dir):
    t = S.record_triples(spark, sf_dir)
    return shown(R.check_any_of(t, R.rule_targets(t, [("Column", "class", iri("csvw:Column"))]), [r for r in R.profile_rules() if r.shape == "Column"]))


@query("nested_node", expected(*NESTED))
def nested_node(spark, sf_dir):
    # Only the nested shapes and the properties that use them.
    rules = [r for r in R.profile_rules() if r.kind == "node" or r.shape not in OUTER]
    return shown(R.property_results(S.record_triples(spark, sf_dir, R.named_predicates(rules, R.profile_targets())), rules))


def cross_query(name):
    def run(spark, sf_dir):
        rule = CROSS_FUNCTIONS[name]
        return shown(rule(S.record_triples(spark, sf_dir, R.cross_predicates(rule))))

    return run


for _name, _rows in CROSS.items():
    query(_name, expected(*_rows))(cross_query(_name))


@query("completeness_declared_strict", expected(("completeness_declared", "Violation", "k IN (30,31)")))
def completeness_strict(spark, sf_dir):
    rule = R.rule_completeness_declared
    return shown(rule(S.record_triples(spark, sf_dir, R.cross_predicates(rule)), strict=True))


ALL_ROWS = CARDINALITY + NODE_KIND + DATATYPE + IN_LIST + PATTERN + CLASS + NESTED + [row for rows in CROSS.values() for row in rows]


@query("validate", expected(*ALL_ROWS))
def validate(spark, sf_dir):
    wanted = R.named_predicates(R.profile_rules(), R.profile_targets()) | R.cross_predicates(*R.FACT_RULES, *R.STATEMENT_RULES)
    return shown(R.validate(S.record_triples(spark, sf_dir, wanted)))


@query("severity_counts", """
SELECT o_orderkey::VARCHAR AS record_id, count(*) FILTER (l_returnflag='A')::BIGINT AS violations, count(*) FILTER (l_returnflag='R')::BIGINT AS warnings,
  count(l_orderkey)::BIGINT AS results, count(l_orderkey)=0 AS conforms, count(*) FILTER (l_returnflag='A')=0 AS conforms_mandatory FROM orders LEFT JOIN lineitem ON o_orderkey=l_orderkey GROUP BY 1""")
def severity_counts(spark, sf_dir):
    items = S.table(spark, sf_dir, "lineitem")
    severity = F.when(F.col("l_returnflag") == "A", "Violation").when(F.col("l_returnflag") == "R", "Warning").otherwise("Info")
    results = items.select(F.col("l_orderkey").cast("string").alias("record_id"), severity.alias("severity"))
    records = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"))
    return R.validation_summary(results, records)


@query("severity_order", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 3 END::INTEGER AS rank FROM lineitem""")
def severity_order(spark, sf_dir):
    items = S.table(spark, sf_dir, "lineitem").withColumn("severity", F.when(F.col("l_returnflag") == "A", "Violation").when(F.col("l_returnflag") == "R", "Warning").otherwise("Note"))
    return items.select("l_orderkey", "l_linenumber", "l_partkey", R.severity_rank().alias("rank"))
