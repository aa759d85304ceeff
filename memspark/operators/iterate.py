"""Cutting the lineage of iterative jobs with tables written to the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset a local master gets a temporary one, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="memspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, "memspark")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with ``name``: each row's place, from 1, in the order given; no task sees more than a range of it.

    Rows are dealt by ranges of the order and counted a partition; only these counts meet in one place.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    rows = materialize(rows.withColumn("_at", F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33)).drop("_id"))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_p", "_at", "_before")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for each vertex of ``edges`` (a, b) the smallest vertex it reaches; ids of any ordered type.

    Min-label contraction: each round maps a vertex to its smallest neighbour, follows the map twice and
    contracts the edges, so the number of rounds grows with the logarithm of the longest path.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = None
    while True:
        near = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        jump = near.select(F.col("a").alias("_a"), F.col("m").alias("_m"))
        step = materialize(near.join(jump, F.col("m") == F.col("_a"), "left").select(F.col("a").alias("v"), F.coalesce("_m", "m").alias("c")))
        move = step.select(F.col("v").alias("_v"), F.col("c").alias("_c"))
        labels = step if labels is None else materialize(labels.join(move, F.col("c") == F.col("_v"), "left").select("v", F.coalesce("_c", "c").alias("c")))
        over = move.select(F.col("_v").alias("_w"), F.col("_c").alias("_d"))
        both = both.join(move, F.col("a") == F.col("_v")).join(over, F.col("b") == F.col("_w"))
        both = materialize(both.filter("_c <> _d").select(F.col("_c").alias("a"), F.col("_d").alias("b")).distinct())
        if both.isEmpty():
            return labels
