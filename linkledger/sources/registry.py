"""Reference records: JSON objects, N-Triples lines, or a triple table pivoted to one row per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkledger.functions.staging import computed_once
from linkledger.functions.text import local_name
from linkledger.model import RDF_TYPE, REGISTRY_JSON, iri

# ---- Fixed value: the grammar of one N-Triples line, restricted to one statement per line.
# Parts that can end in one place only give nothing back; a literal is runs of plain characters between escapes, so a long one needs no deep stack.
_LINE = (r'^\s*+(<[^>]*+>|_:\S++)\s++<([^>]*+)>\s++(?:<([^>]*+)>|(_:\S+)|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:\^\^<([^>]*+)>|@([A-Za-z0-9-]++))?)\s*+\.\s*+$')


def scan_registry(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """``json``: one object per file, 18 flat fields. ``ntriples``: a triple table."""
    if fmt == "json":
        raw = spark.read.schema(REGISTRY_JSON).json(path, multiLine=True)
        return raw.select("record_uri", "record.*")
    if fmt == "ntriples":
        return parse_ntriples(spark.read.text(path), "value", record_id=F.lit("registry"))
    raise ValueError(f"unknown registry format: {fmt}")


def parse_ntriples(lines: DataFrame, column: str, record_id) -> DataFrame:
    """Triples from N-Triples lines; blank and comment lines give nothing, other text is kept as a bad line.

    A line that does not parse keeps its text in ``o`` with a null predicate, so nothing is dropped silently.
    """
    line = F.col(column)
    content = lines.where((F.trim(line) != "") & ~F.trim(line).startswith("#"))
    # The grammar is applied once a line: its groups come out between line feeds. A text that holds a line feed itself is taken group by group.
    at_once = F.split(F.regexp_replace(line, _LINE, "\n".join(f"${i}" for i in range(1, 8))), "\n")
    apart = F.when(line.rlike(_LINE), F.array(*[F.regexp_extract(line, _LINE, i) for i in range(1, 8)])).otherwise(F.array(line))
    content = computed_once(content, {"__groups": F.when(F.contains(line, F.lit("\n")), apart).otherwise(at_once)})
    ok = F.size("__groups") == 7

    def group(i: int):
        return F.nullif(F.get("__groups", F.lit(i - 1)), F.lit(""))

    # Escaped backslashes step aside first, so that "\\\\n" stays a backslash and an n.
    literal = F.replace(F.get("__groups", F.lit(4)), F.lit("\\\\"), F.lit("\x01"))
    for escaped, plain in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\x01", "\\")):
        literal = F.replace(literal, F.lit(escaped), F.lit(plain))
    kind = F.when(group(3).isNotNull(), "iri").when(group(4).isNotNull(), "bnode").otherwise("literal")
    return content.select(
        record_id.alias("record_id"),
        F.when(ok, F.when(group(1).startswith("<"), F.substr(group(1), F.lit(2), F.length(group(1)) - 2)).otherwise(group(1))).alias("s"),
        F.when(ok, group(2)).alias("p"),
        F.when(ok, F.coalesce(group(3), group(4), literal)).otherwise(line).alias("o"),
        F.when(ok, kind).alias("o_kind"),
        F.when(ok & (kind == "literal"),
               F.coalesce(group(6), F.when(group(7).isNotNull(), F.lit(iri("rdf:langString"))), F.lit(iri("xsd:string")))).alias("o_type"),
        group(7).alias("o_lang"),
        F.lit(None).cast("string").alias("list_id"),
        F.lit(None).cast("int").alias("list_pos"),
    )


def to_ntriples(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple, column ``line``."""
    def node(c):
        return F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))

    text = F.col("o")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    suffix = (F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang"))
              .when(F.col("o_type") == iri("xsd:string"), F.lit(""))
              .when(F.col("o_type").isNotNull(), F.concat(F.lit("^^<"), "o_type", F.lit(">"))).otherwise(F.lit("")))
    obj = (F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), text, F.lit('"'), suffix)).otherwise(node("o")))
    return triples.select(F.concat_ws(" ", node("s"), F.concat(F.lit("<"), "p", F.lit(">")), obj, F.lit(".")).alias("line"))


def registry_from_triples(triples: DataFrame, record_class: str, component: str, record_fields: dict[str, str],
                          component_fields: dict[str, str]) -> DataFrame:
    """One row per record and component: the record's own literals and those of each component it points to.

    ``component`` is the linking predicate; the field maps give output name -> predicate. Both pivots are
    conditional aggregates over the statements needed, keyed by node. A record without component has one row.
    """
    def pivot(fields: dict[str, str]) -> DataFrame:
        cells = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in fields.items()]
        return triples.where(F.col("p").isin(list(fields.values()))).groupBy("s").agg(*cells)

    records = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == record_class)).select(F.col("s").alias("record_uri")).distinct()
    own = pivot(record_fields)
    links = triples.where(F.col("p") == component).select(F.col("s").alias("record_uri"), F.col("o").alias("__component")).distinct()
    part = pivot(component_fields).withColumnRenamed("s", "__part")
    return (records.join(own, F.col("record_uri") == F.col("s"), "left").drop("s")
            .join(links, "record_uri", "left")
            .join(part, F.col("__component") == F.col("__part"), "left")
            .withColumn("component", local_name("__component")).drop("__component", "__part"))


def registry_provenance(triples: DataFrame, record_class: str, attributed: str, agent_name: str, derived: str, generated: str, ended: str) -> DataFrame:
    """``(record_uri, role, node, label)``: where each record of a class comes from.

    Roles are ``agent`` (label: the agent's name), ``activity`` (label: when it ended) and ``source`` (no label). A record without
    any statement on its origin has one row with null role. Nodes are given once per record and role, with their least label.
    """
    roles = {attributed: "agent", generated: "activity", derived: "source"}
    labels = {"agent": agent_name, "activity": ended}
    role = F.element_at(F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]), F.col("p"))
    records = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == record_class)).select(F.col("s").alias("record_uri")).distinct()
    origins = triples.where(F.col("p").isin(list(roles))).select(F.col("s").alias("record_uri"), role.alias("role"), F.col("o").alias("node")).distinct()
    told = F.array_compact(F.array(*[F.when(F.col("p") == p, F.lit(r)) for r, p in labels.items()]))
    named = (triples.where(F.col("p").isin(list(labels.values()))).select(F.col("s").alias("node"), F.explode(told).alias("role"), "o")
             .groupBy("node", "role").agg(F.min("o").alias("label")))
    return records.join(origins.join(named, ["node", "role"], "left"), "record_uri", "left").select("record_uri", "role", "node", "label")


def layers_from_triples(triples: DataFrame, has_layer: str, fields: dict[str, str]) -> DataFrame:
    """One row per (component, layer) with the layer's literals; ordering is the caller's, by position column."""
    links = triples.where(F.col("p") == has_layer).select(F.col("s").alias("component"), F.col("o").alias("layer"))
    cells = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in fields.items()]
    values = triples.where(F.col("p").isin(list(fields.values()))).groupBy(F.col("s").alias("layer")).agg(*cells)
    return links.join(values, "layer", "left")
