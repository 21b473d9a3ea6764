"""Operators on triple tables: class counts, class-level edges, path steps and per-record facts.

``scope`` lists columns that separate graphs (``["record_id"]`` for record documents, whose shared IRIs are
typed once per record; ``[]`` for one graph over everything).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkledger.functions.text import file_name, local_name, vocabulary
from linkledger.model import RDF_FIRST, RDF_TYPE, VOCABULARIES, iri

QUALITY_CLASS = iri("dqv:QualityMeasurement")


def node_types(triples: DataFrame, scope: Sequence[str] = ("record_id",)) -> DataFrame:
    """Distinct (scope, node, cls) of all type statements with an IRI class."""
    return (triples.where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri"))
            .select(*scope, F.col("s").alias("node"), F.col("o").alias("cls")).distinct())


def class_counts(triples: DataFrame, include_quality: bool = True, scope: Sequence[str] = ("record_id",)) -> DataFrame:
    """Instances per class over all graphs."""
    types = node_types(triples, scope)
    if not include_quality:
        types = types.where(F.col("cls") != QUALITY_CLASS)
    return types.groupBy("cls").agg(F.count(F.lit(1)).alias("instances"))


def vocabulary_table(counts: DataFrame, table=VOCABULARIES) -> DataFrame:
    """Classes and instances per vocabulary."""
    known = counts.select(vocabulary("cls", table).alias("v"), "instances")
    return (known.groupBy(F.col("v.prefix").alias("vocabulary"), F.col("v.steward").alias("steward"))
            .agg(F.count(F.lit(1)).alias("classes"), F.sum("instances").alias("instances"))
            .orderBy(F.desc("classes"), "vocabulary"))


def instance_edges(triples: DataFrame, scope: Sequence[str] = ("record_id",)) -> DataFrame:
    """``(s, p, o)`` of every reference whose two ends are typed nodes, each once, over all predicates."""
    nodes = node_types(triples, scope).select(*scope, "node").distinct()
    links = triples.where((F.col("p") != RDF_TYPE) & F.col("o_kind").isin("iri", "bnode")).select(*scope, "s", "p", "o").distinct()
    starts, ends = nodes.withColumnRenamed("node", "s"), nodes.withColumnRenamed("node", "o")
    return links.join(starts, [*scope, "s"], "left_semi").join(ends, [*scope, "o"], "left_semi").select(*scope, "s", "p", "o")


def class_graph(triples: DataFrame, include_quality: bool = False, scope: Sequence[str] = ("record_id",)) -> DataFrame:
    """Edges (source class, property, target class, n) counted over instances.

    Statements are reduced to (source class, predicate, target node) before the join on the target, so a node
    that very many statements point to arrives there as a few pre-counted rows. A node with several classes
    gives an edge for each.
    """
    types = node_types(triples, scope)
    if not include_quality:
        # A quality class takes part in no edge; the other classes of the same node still do.
        types = types.where(F.col("cls") != QUALITY_CLASS)
    links = triples.where((F.col("p") != RDF_TYPE) & F.col("o_kind").isin("iri", "bnode")).select(*scope, "s", "p", "o").distinct()
    sources = types.select(*scope, F.col("node").alias("s"), F.col("cls").alias("source_class"))
    targets = types.select(*scope, F.col("node").alias("o"), F.col("cls").alias("target_class"))
    counted = (links.join(sources, [*scope, "s"])
               .groupBy(*scope, "source_class", "p", "o").agg(F.count(F.lit(1)).alias("n")))
    edges = counted.join(targets, [*scope, "o"])
    return (edges.groupBy("source_class", local_name("p").alias("property"), "target_class").agg(F.sum("n").alias("n")))


def merge_parallel_edges(edges: DataFrame) -> DataFrame:
    """Undirected class pairs with their sorted distinct labels; labels come from the predicate vocabulary."""
    pair = edges.select(F.least("source_class", "target_class").alias("class_a"),
                        F.greatest("source_class", "target_class").alias("class_b"), "property")
    return (pair.groupBy("class_a", "class_b")
            .agg(F.array_join(F.sort_array(F.collect_set("property")), ", ").alias("labels")))


def list_members(triples: DataFrame, path: str) -> DataFrame:
    """Triples ``(s, path + "/member", member)`` for every entry of the lists a property points to.

    The list head and position come with the ``rdf:first`` rows, so no recursion over cells is needed. The
    predicate is a literal: a reader that filters on other predicates drops this branch.
    """
    cells = triples.where((F.col("p") == RDF_FIRST) & F.col("list_id").isNotNull()).select(
        "record_id", F.col("list_id").alias("head"), "o", "o_kind", "o_type", "o_lang", "list_pos")
    heads = triples.where((F.col("p") == path) & (F.col("o_kind") == "bnode")).select("record_id", "s", F.col("o").alias("head"))
    return heads.join(cells, ["record_id", "head"]).select(
        "record_id", "s", F.lit(f"{path}/member").alias("p"), "o", "o_kind", "o_type", "o_lang", F.col("head").alias("list_id"), "list_pos")


def with_list_members(triples: DataFrame, paths: Sequence[str]) -> DataFrame:
    """The triples with the members of the named list properties added."""
    out = triples
    for path in paths:
        out = out.unionByName(list_members(triples, path))
    return out


def path_values(triples: DataFrame, focus: DataFrame, path: Sequence[str], scope: Sequence[str] = ("record_id",)) -> DataFrame:
    """Distinct values reached from ``focus(scope, focus)`` over a sequence of predicates."""
    current = focus.select(*scope, "focus", F.col("focus").alias("at"))
    for step in path:
        hop = triples.where(F.col("p") == step).select(*scope, F.col("s").alias("at"), F.col("o").alias("next"))
        current = current.join(hop, [*scope, "at"]).select(*scope, "focus", F.col("next").alias("at")).distinct()
    return current.select(*scope, "focus", F.col("at").alias("value"))


def quality_rows(triples: DataFrame) -> DataFrame:
    """``quality(record_id, node, measurement, metric, value)``, one row per value; value null when there is none."""
    wanted = triples.where(F.col("p").isin(iri("dqv:isMeasurementOf"), iri("dqv:value"), RDF_TYPE))
    # Statement order inside a measurement carries no meaning, so values stay separate rows.
    typed = wanted.where((F.col("p") == RDF_TYPE) & (F.col("o") == QUALITY_CLASS)).select("record_id", F.col("s").alias("measurement")).distinct()
    metrics = wanted.where(F.col("p") == iri("dqv:isMeasurementOf")).groupBy("record_id", F.col("s").alias("measurement")).agg(
        F.min(local_name("o")).alias("metric"))
    values = wanted.where(F.col("p") == iri("dqv:value")).select("record_id", F.col("s").alias("measurement"), F.col("o").alias("value"))
    owners = triples.where(F.col("p") == iri("dqv:hasQualityMeasurement")).select(
        "record_id", F.col("o").alias("measurement"), F.col("s").alias("node"))
    on = ["record_id", "measurement"]
    return (typed.join(metrics, on, "left").join(values, on, "left").join(owners, on, "left")
            .select("record_id", "node", "measurement", "metric", "value"))


def record_summary(triples: DataFrame) -> DataFrame:
    """One row of facts per record: files, element, association, registration, hypothesis and statement count.

    All facts and the count meet in a single aggregation by record.
    """
    classes = {iri("dcat:CatalogRecord"): "record", iri("ls:DirectedLink"): "link", iri("bot:Element"): "element",
               iri("ls:StringBasedIdentifier"): "identifier", iri("ldv:RegistrationHypothesis"): "hypothesis",
               iri("dcat:Distribution"): "file"}
    lookup = F.create_map(*[F.lit(v) for kv in classes.items() for v in kv])
    roles = (triples.where((F.col("p") == RDF_TYPE) & F.col("o").isin(list(classes)))
             .select("record_id", "s", F.element_at(lookup, F.col("o")).alias("role")).distinct())
    facts = {
        ("record", iri("owl:versionInfo")): "profile", ("element", iri("rdfs:label")): "element_label",
        ("identifier", iri("ls:identifier")): "global_id", ("link", iri("ldv:associationLevel")): "association_level",
        ("link", iri("ldv:registration")): "registration", ("hypothesis", iri("dcterms:source")): "hypothesis_source",
        ("file", iri("dcat:downloadURL")): "file",
    }
    values = (triples.where(F.col("p").isin([p for _, p in facts])).select("record_id", "s", "p", "o").join(roles, ["record_id", "s"]))
    key = None
    for (role, predicate), name in facts.items():
        test = (F.col("role") == role) & (F.col("p") == predicate)
        key = F.when(test, name) if key is None else key.when(test, name)
    named = values.select("record_id", key.alias("key"), F.col("o").alias("value"))
    is_model = F.lower(F.col("value")).endswith(".ifc")
    named = named.select("record_id", F.when(F.col("key") != "file", F.col("key"))
                         .otherwise(F.when(is_model, "model_file").otherwise("measurement_file")).alias("key"),
                         F.when(F.col("key") == "file", file_name("value")).otherwise(F.col("value")).alias("value"))
    names = roles.where(F.col("role") == "record").select("record_id", F.lit("record").alias("key"), local_name("s").alias("value"))
    hypotheses = roles.where(F.col("role") == "hypothesis").select("record_id", F.col("s").alias("node"))
    states = quality_rows(triples).join(hypotheses, ["record_id", "node"], "left_semi").select(
        "record_id", F.lit("hypothesis_status").alias("key"), "value")
    everything = (named.unionByName(names).unionByName(states).withColumn("triples", F.lit(0))
                  .unionByName(triples.select("record_id", F.lit(None).cast("string").alias("key"),
                                              F.lit(None).cast("string").alias("value"), F.lit(1).alias("triples"))))
    columns = ["record", "profile", "measurement_file", "model_file", "element_label", "global_id", "association_level",
               "registration", "hypothesis_source", "hypothesis_status"]
    return everything.groupBy("record_id").agg(
        *[F.coalesce(F.min(F.when(F.col("key") == c, F.col("value"))), F.lit("")).alias(c) for c in columns],
        F.sum("triples").alias("triples"))


def competency(triples: DataFrame, fields: dict[str, str], record_class: str, scope: Sequence[str] = ()) -> DataFrame:
    """Retrieval questions as one star: the requested literals of every record of a class."""
    wanted = triples.where(F.col("p").isin([*fields.values(), RDF_TYPE]))
    cells = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in fields.items()]
    is_record = F.max(F.when((F.col("p") == RDF_TYPE) & (F.col("o") == record_class), F.lit(True)))
    return wanted.groupBy(*scope, F.col("s").alias("record")).agg(*cells, is_record.alias("__is")).where(F.col("__is")).drop("__is")


def answer_questions(triples: DataFrame, record_class: str, questions: Mapping[str, Mapping[str, Sequence[str]]], scope: Sequence[str] = ()) -> DataFrame:
    """Answers of retrieval questions, ``(scope, record, question, item, field, value)``, for every record of a class.

    ``questions`` gives, per question and field, the predicates from the record to the value; a step ``^p`` goes from an
    object to its subjects, as from a record to the elements that name it. ``item`` is the node at which the value stands: the
    record itself, its component or agent, or one of the linked elements, so the fields of one element stay together. All
    values are given, equal ones once; a question without a value has no row. Each distinct path to an item is one join, and all
    fields of items that are reached by one path share a scan.
    """
    asked: dict[tuple[str, ...], dict[str, list[tuple[str, str]]]] = {}
    for question, fields in questions.items():
        for field, path in fields.items():
            if not path or path[-1].startswith("^"):
                raise ValueError(f"{question}/{field}: a path ends with the predicate of its value")
            asked.setdefault(tuple(path[:-1]), {}).setdefault(path[-1], []).append((question, field))
    records = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == record_class)).select(*scope, F.col("s").alias("record"), F.col("s").alias("item")).distinct()
    reached = {(): records}

    def items(path: tuple[str, ...]) -> DataFrame:
        if path not in reached:
            step = path[-1]
            near, far = ("o", "s") if step.startswith("^") else ("s", "o")
            hop = triples.where(F.col("p") == step.removeprefix("^")).select(*scope, F.col(near).alias("item"), F.col(far).alias("__next"))
            reached[path] = items(path[:-1]).join(hop, [*scope, "item"]).select(*scope, "record", F.col("__next").alias("item")).distinct()
        return reached[path]

    parts = []
    for path, fields in asked.items():
        names = F.create_map(*[x for p, pairs in fields.items() for x in (
            F.lit(p), F.array(*[F.struct(F.lit(q).alias("question"), F.lit(f).alias("field")) for q, f in pairs]))])
        values = triples.where(F.col("p").isin(list(fields))).select(*scope, F.col("s").alias("item"), F.explode(F.element_at(names, F.col("p"))).alias("q"), F.col("o").alias("value"))
        parts.append(items(path).join(values, [*scope, "item"]).select(*scope, "record", "q.question", "item", "q.field", "value"))
    return reduce(DataFrame.unionByName, parts).distinct()
