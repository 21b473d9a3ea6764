"""Queries on triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkledger.functions.text import local_name
from linkledger.model import RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE, iri
from linkledger.operators import chains as C
from linkledger.operators import gaps as GP
from linkledger.operators import graph as G
from linkledger.plans import standins as S
from linkledger.plans.catalog import query
from linkledger.sources.tables import VOCAB, node_iri

EDGES_SQL = """
SELECT 'Customer' AS source_class, 'c_nationkey' AS property, 'Nation' AS target_class, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey=n_nationkey
UNION ALL SELECT 'Nation', 'n_regionkey', 'Region', count(*) FROM nation JOIN region ON n_regionkey=r_regionkey
UNION ALL SELECT 'Orders', 'o_custkey', 'Customer', count(*) FROM orders JOIN customer ON o_custkey=c_custkey"""


@query("class_graph", EDGES_SQL)
def class_graph(spark, sf_dir):
    edges = G.class_graph(S.table_graph(spark, sf_dir), scope=[])
    return edges.select(local_name("source_class").alias("source_class"), "property", local_name("target_class").alias("target_class"), "n")


@query("class_counts", """
SELECT 'Region' AS cls, count(*)::BIGINT AS instances FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Orders', count(*) FROM orders""")
def class_counts(spark, sf_dir):
    return G.class_counts(S.table_graph(spark, sf_dir), scope=[]).select(local_name("cls").alias("cls"), "instances")


@query("vocabulary_table", """
SELECT 'tables' AS vocabulary, 'driver' AS steward, 4::BIGINT AS classes, (SELECT count(*) FROM region)+(SELECT count(*) FROM nation)+(SELECT count(*) FROM customer)+(SELECT count(*) FROM orders) AS instances""")
def vocabulary_table(spark, sf_dir):
    counts = G.class_counts(S.table_graph(spark, sf_dir), include_quality=False, scope=[])
    return G.vocabulary_table(counts, {"tables": (VOCAB, "driver")})


@query("graph_edges", """
SELECT 'https://example.org/tables/id/orders/' || o_orderkey AS s, 'https://example.org/tables/v/o_custkey' AS p, 'https://example.org/tables/id/customer/' || o_custkey AS o FROM orders JOIN customer ON o_custkey=c_custkey
UNION ALL SELECT 'https://example.org/tables/id/customer/' || c_custkey, 'https://example.org/tables/v/c_nationkey', 'https://example.org/tables/id/nation/' || c_nationkey FROM customer JOIN nation ON c_nationkey=n_nationkey
UNION ALL SELECT 'https://example.org/tables/id/nation/' || n_nationkey, 'https://example.org/tables/v/n_regionkey', 'https://example.org/tables/id/region/' || n_regionkey FROM nation JOIN region ON n_regionkey=r_regionkey""")
def graph_edges(spark, sf_dir):
    return G.instance_edges(S.table_graph(spark, sf_dir), [])


@query("merge_parallel_edges", """
WITH E AS (SELECT 'Customer' AS a, 'Nation' AS b, 'c_nationkey' AS label FROM customer JOIN nation ON c_nationkey=n_nationkey
  UNION ALL SELECT 'Orders', 'Customer', unnest(['o_custkey','o_payer']) FROM orders JOIN customer ON o_custkey=c_custkey
  UNION ALL SELECT 'Nation', 'Region', 'n_regionkey' FROM nation JOIN region ON n_regionkey=r_regionkey)
SELECT least(a,b) AS class_a, greatest(a,b) AS class_b, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels FROM E GROUP BY 1, 2""")
def merge_parallel_edges(spark, sf_dir):
    edges = G.class_graph(S.table_graph(spark, sf_dir), scope=[]).select(
        local_name("source_class").alias("source_class"), "property", local_name("target_class").alias("target_class"), "n")
    # The order edge once more in the other direction and under a second name.
    back = edges.where(F.col("property") == "o_custkey").select(F.col("target_class").alias("source_class"), F.lit("o_payer").alias("property"), F.col("source_class").alias("target_class"), "n")
    return G.merge_parallel_edges(edges.unionByName(back))


@query("path_values", """
SELECT 'https://example.org/tables/id/customer/' || c_custkey AS focus, 'https://example.org/tables/id/region/' || n_regionkey AS value FROM customer JOIN nation ON c_nationkey=n_nationkey""")
def path_values(spark, sf_dir):
    t = S.table_graph(spark, sf_dir)
    focus = t.where((F.col("p") == RDF_TYPE) & (F.col("o") == VOCAB + "Customer")).select(F.col("s").alias("focus"))
    return G.path_values(t, focus, [VOCAB + "c_nationkey", VOCAB + "n_regionkey"], scope=[])


@query("list_places", "WITH " + S.RECORD_SQL + """
SELECT record_id, unnest(['frequency','real_x']) AS name, unnest([0,1])::BIGINT AS place FROM R""")
def list_places(spark, sf_dir):
    # The same lists by following the links from cell to cell, without the positions that the reader noted.
    t = S.record_triples(spark, sf_dir, (iri("csvw:column"), RDF_FIRST, RDF_REST, iri("csvw:name")))
    cell = lambda c: F.concat_ws(" ", "record_id", c)
    rest = t.where(F.col("p") == RDF_REST)
    links = rest.select(cell("s").alias("s"), F.when(F.col("o") != RDF_NIL, cell("o")).alias("o"))
    places = C.list_places(links)
    heads = t.where(F.col("p") == iri("csvw:column")).select("record_id", cell("o").alias("head"))
    first = t.where(F.col("p") == RDF_FIRST).select(cell("s").alias("cell"), F.col("o").alias("s"))
    members = heads.join(places, "head").join(first, "cell").select("record_id", "s", "place")
    names = t.where(F.col("p") == iri("csvw:name")).select("record_id", "s", F.col("o").alias("name"))
    return members.join(names, ["record_id", "s"]).select("record_id", "name", "place")


@query("list_members", "WITH " + S.RECORD_SQL + """
SELECT record_id, unnest(['frequency','real_x']) AS name, unnest([0,1])::BIGINT AS place FROM R""")
def list_members(spark, sf_dir):
    # The ordered column list of each record, walked through its cells.
    t = S.record_triples(spark, sf_dir, (iri("csvw:column"), RDF_FIRST, iri("csvw:name")))
    members = G.list_members(t, iri("csvw:column")).select("record_id", "list_pos", F.col("o").alias("s"))
    names = t.where(F.col("p") == iri("csvw:name")).select("record_id", "s", F.col("o").alias("name"))
    return members.join(names, ["record_id", "s"]).select("record_id", "name", F.col("list_pos").cast("bigint").alias("place"))


@query("not_exists", "SELECT 'https://example.org/tables/id/orders/' || o_orderkey AS s FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey)")
def not_exists(spark, sf_dir):
    t = S.table_graph(spark, sf_dir)
    orders = t.where((F.col("p") == RDF_TYPE) & (F.col("o") == VOCAB + "Orders")).select("s")
    filled = S.table(spark, sf_dir, "lineitem").select(node_iri("orders", "l_orderkey").alias("s"))
    return orders.join(filled, "s", "left_anti")


@query("record_summary", "WITH " + S.RECORD_SQL + """
SELECT record_id, record_id AS record, '0.6' AS profile, doc_id || '.txt' AS measurement_file, 'model.ifc' AS model_file,
  CASE WHEN doc_id%2=1 THEN least('Part', 'Wall ' || lang) ELSE 'Wall ' || lang END AS element_label, 'G' || lpad(doc_id::VARCHAR, CASE WHEN k=14 THEN 20 ELSE 21 END, '0') AS global_id,
  CASE WHEN k=20 THEN 'surface' WHEN k=21 THEN 'point' WHEN k=22 THEN 'room' ELSE 'component' END AS association_level,
  CASE WHEN k IN (21,34) THEN 'established' ELSE 'not established' END AS registration, 'declared axes' AS hypothesis_source,
  CASE WHEN k=28 THEN 'guessed' ELSE 'declared by model; not confirmed by lab' END AS hypothesis_status FROM R""")
def record_summary(spark, sf_dir):
    return G.record_summary(S.record_triples(spark, sf_dir)).drop("triples")


@query("competency_q1_q5", """
SELECT 'https://example.org/tables/id/customer/' || c_custkey AS record, c_name AS name, c_acctbal::DOUBLE AS value, c_mktsegment AS segment, 'https://example.org/tables/id/nation/' || c_nationkey AS source FROM customer""")
def competency(spark, sf_dir):
    fields = {"name": VOCAB + "c_name", "value": VOCAB + "c_acctbal", "segment": VOCAB + "c_mktsegment", "source": VOCAB + "c_nationkey"}
    found = G.competency(S.table_graph(spark, sf_dir), fields, VOCAB + "Customer")
    return found.select("record", "name", F.col("value").cast("double").alias("value"), "segment", "source")


QUESTIONS = {
    "Q1": {"balance": [VOCAB + "c_acctbal"]},
    "Q2": {"segment": [VOCAB + "c_mktsegment"], "nation": [VOCAB + "c_nationkey", VOCAB + "n_name"]},
    "Q3": {"nation_node": [VOCAB + "c_nationkey"], "region": [VOCAB + "c_nationkey", VOCAB + "n_regionkey", VOCAB + "r_name"]},
    "Q4": {"name": [VOCAB + "c_name"]},
    "Q5": {"status": ["^" + VOCAB + "o_custkey", VOCAB + "o_orderstatus"], "total": ["^" + VOCAB + "o_custkey", VOCAB + "o_totalprice"]},
}


@query("competency_answers", """
WITH C AS (SELECT *, 'https://example.org/tables/id/customer/' || c_custkey AS record, 'https://example.org/tables/id/nation/' || c_nationkey AS nation FROM customer),
O AS (SELECT record, 'https://example.org/tables/id/orders/' || o_orderkey AS item, o_orderstatus, o_totalprice FROM orders JOIN C ON o_custkey=c_custkey)
SELECT record, 'Q1' AS question, record AS item, 'balance' AS field, NULL::VARCHAR AS value, c_acctbal::DOUBLE AS number FROM C
UNION ALL SELECT record, 'Q2', record, 'segment', c_mktsegment, NULL FROM C UNION ALL SELECT record, 'Q2', nation, 'nation', n_name, NULL FROM C JOIN nation ON c_nationkey=n_nationkey
UNION ALL SELECT record, 'Q3', record, 'nation_node', nation, NULL FROM C
UNION ALL SELECT record, 'Q3', 'https://example.org/tables/id/region/' || r_regionkey, 'region', r_name, NULL FROM C JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
UNION ALL SELECT record, 'Q4', record, 'name', c_name, NULL FROM C
UNION ALL SELECT record, 'Q5', item, 'status', o_orderstatus, NULL FROM O UNION ALL SELECT record, 'Q5', item, 'total', NULL, o_totalprice::DOUBLE FROM O""")
def competency_answers(spark, sf_dir):
    # Customers as records: their nation as component, its region as source, and the orders that name them as linked elements.
    found = G.answer_questions(S.table_graph(spark, sf_dir), VOCAB + "Customer", QUESTIONS)
    numeric = F.col("field").isin("balance", "total")
    return found.select("record", "question", "item", "field", F.when(~numeric, F.col("value")).alias("value"), F.when(numeric, F.col("value").cast("double")).alias("number"))


@query("quality_rows", "WITH " + S.RECORD_SQL + """
SELECT record_id, 'status' AS metric, CASE WHEN k IN (8,9) THEN 'unresolved' ELSE 'stated in the lab form' END AS value FROM R
UNION ALL SELECT record_id, 'status', CASE WHEN k=28 THEN 'guessed' ELSE 'declared by model; not confirmed by lab' END FROM R
UNION ALL SELECT record_id, 'bindingStatus', CASE WHEN k=24 THEN 'fine' ELSE 'valid' END FROM R WHERE k<>23
UNION ALL SELECT record_id, 'definitionStatus', 'absent' FROM R WHERE k=21
UNION ALL SELECT record_id, 'unitStatus', 'QUDT IRI not yet resolved' FROM R
UNION ALL SELECT record_id, 'absentFields', unnest(['persistentIdentifier','accessURL','field_' || lang]) FROM R WHERE k NOT IN (30,31)
UNION ALL SELECT record_id, 'unresolvedFields', unnest(CASE WHEN k=9 THEN ['coordinateUnit'] ELSE ['excitationType','coordinateUnit'] END) FROM R WHERE k<>31""")
def quality_rows(spark, sf_dir):
    t = S.record_triples(spark, sf_dir, (RDF_TYPE, iri("dqv:isMeasurementOf"), iri("dqv:value"), iri("dqv:hasQualityMeasurement")))
    return G.quality_rows(t).select("record_id", "metric", "value")


@query("gap_report", "WITH " + S.QUALITY_SQL + """
SELECT record_id, CASE metric WHEN 'absentFields' THEN 'absent' WHEN 'unresolvedFields' THEN 'unresolved' ELSE 'note' END AS section, metric, value FROM Q
WHERE NOT (metric='unitStatus' AND value LIKE '%not yet resolved%')""")
def gap_report(spark, sf_dir):
    return GP.gap_report(S.quality(spark, sf_dir))


@query("gap_totals", "WITH " + S.QUALITY_SQL + """
SELECT record_id, count(*) FILTER (metric='absentFields')::BIGINT AS absent, count(*) FILTER (metric='unresolvedFields')::BIGINT AS unresolved,
  count(*) FILTER (metric='unitStatus' AND value LIKE '%not yet%')::BIGINT AS units_pending,
  count(*) FILTER (metric='status' OR (metric='unitStatus' AND value NOT LIKE '%not yet%'))::BIGINT AS notes FROM Q GROUP BY 1""")
def gap_totals(spark, sf_dir):
    return GP.gap_totals(S.quality(spark, sf_dir))


@query("gap_frequency", "WITH " + S.QUALITY_SQL + """
SELECT metric, value AS field, count(DISTINCT record_id)::BIGINT AS records FROM Q WHERE metric IN ('absentFields','unresolvedFields') GROUP BY 1, 2""")
def gap_frequency(spark, sf_dir):
    return GP.gap_frequency(S.quality(spark, sf_dir))
