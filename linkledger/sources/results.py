"""Recorded result tables: CSV with a declared schema, ``N/A`` read as null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkledger.model import SCENARIO_RESULTS


def scan_results(spark: SparkSession, path: str, schema: str = SCENARIO_RESULTS) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, nullValue="N/A", enforceSchema=True)


def parse_results(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """The same for CSV lines that already are a column."""
    return lines.select(F.from_csv(column, schema, {"nullValue": "N/A"}).alias("r")).select("r.*")
