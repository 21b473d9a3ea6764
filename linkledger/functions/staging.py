"""Keep costly expressions from being copied into later filters and projections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns whose expressions later filters on them cannot repeat.

    Predicates are not moved below a generator's own output, so the values leave one through a one-element array.
    """
    staged = df.withColumn("__once", F.struct(*[c.alias(n) for n, c in columns.items()]))
    return staged.select(*df.columns, F.inline_outer(F.array("__once")))
