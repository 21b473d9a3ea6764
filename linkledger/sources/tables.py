"""Triples from ordinary relations, so the graph operators run on any Spark tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkledger.model import RDF_TYPE, iri

VOCAB = "https://example.org/tables/v/"
NODES = "https://example.org/tables/id/"


def node_iri(table: str, key) -> F.Column:
    return F.concat(F.lit(f"{NODES}{table}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _xsd(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return iri("xsd:integer")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return iri("xsd:double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iri("xsd:dateTime")
    if isinstance(kind, T.BooleanType):
        return iri("xsd:boolean")
    return iri("xsd:string")


def table_triples(name: str, df: DataFrame, key: str, references: Mapping[str, str], class_name: str | None = None) -> DataFrame:
    """Type, literal and reference triples of one table; ``references`` maps a column to the table it points to.

    Rows are unfolded with one generator over an array literal, so the table is read once.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    subject = node_iri(name, key)

    def statement(p, o, kind, o_type):
        return F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"),
                        F.lit(o_type).cast("string").alias("o_type"))

    parts = [statement(RDF_TYPE, F.lit(VOCAB + (class_name or name.capitalize())), "iri", None)]
    for column, kind in fields.items():
        if column in references:
            parts.append(statement(VOCAB + column, node_iri(references[column], column), "iri", None))
        elif column != key:
            parts.append(statement(VOCAB + column, F.col(column), "literal", _xsd(kind)))
    unfolded = df.select(subject.alias("s"), F.explode(F.array(*parts)).alias("t")).select("s", "t.*").where(F.col("o").isNotNull())
    return unfolded.select(F.col("s").alias("record_id"), "s", "p", "o", "o_kind", "o_type",
                           F.lit(None).cast("string").alias("o_lang"),
                           F.lit(None).cast("string").alias("list_id"), F.lit(None).cast("int").alias("list_pos"))


def tables_to_triples(tables: Mapping[str, tuple[DataFrame, str, Mapping[str, str]]]) -> DataFrame:
    """``{table: (df, key, {column: referenced table})}`` to one triple set, equal triples collapsed."""
    # The other columns follow from these five, so whole rows are compared: hashed, not sorted.
    parts = [table_triples(name, df, key, refs) for name, (df, key, refs) in tables.items()]
    return reduce(DataFrame.unionByName, parts).distinct()
