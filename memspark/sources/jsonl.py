"""Append-only JSON lines: what can't be read is left out, and so are summary objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Rows of ``schema`` from the lines below ``path``; a row counts if its line parses and has the ``key`` field."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter(F.col("_bad").isNull() & F.col(key).isNotNull()).drop("_bad")
