"""Connected components of an edge table, by min-label contraction.  Edges and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for each vertex of ``edges`` (a, b) the smallest vertex it reaches.

    A round maps each vertex to its smallest neighbour or itself, follows that map twice, and contracts the
    edges; a path shrinks by a factor each round, a star in one.  Every round is a written table.
    An empty table gives an empty result; self-loops and repeated edges do no harm.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    labels = None
    while True:
        near = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "near")
        jump = near.select(F.col("a").alias("_a"), F.col("m").alias("_m"))
        step = near.join(jump, F.col("m") == F.col("_a"), "left").select(F.col("a").alias("v"), F.coalesce("_m", "m").alias("c"))
        step = materialize(step, "step")
        move = step.select(F.col("v").alias("_v"), F.col("c").alias("_c"))
        if labels is None:
            labels = step
        else:
            labels = materialize(labels.join(move, F.col("c") == F.col("_v"), "left").select("v", F.coalesce("_c", "c").alias("c")), "labels")
        over = move.select(F.col("_v").alias("_w"), F.col("_c").alias("_d"))
        both = both.join(move, F.col("a") == F.col("_v")).join(over, F.col("b") == F.col("_w"))
        both = materialize(both.filter("_c <> _d").select(F.col("_c").alias("a"), F.col("_d").alias("b")).distinct(), "edges")
        if both.isEmpty():
            return labels
