"""Insertion that sees its own batch: a row goes if it equals, contains or resembles one that stays before it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import containment_pairs, semantic_pairs
from .iterate import materialize

# The verdicts, by the order in which they count.
KINDS = ("same", "contained", "similar")


def first_kept(rows: DataFrame, group_links: DataFrame, row_links: DataFrame) -> DataFrame:
    """(v, kind) for ``rows`` (v, ord, g): null for rows that stay, else how they meet one that stays before them.

    Rows of one g are equal; groups of ``group_links`` (g, h, both ways) and rows of ``row_links`` (a, b, either way)
    exclude each other.  The result is that of going through the rows in the order of (ord, v): the lexicographically
    first maximal independent set.  A round settles every row that no open row can exclude any more, and those it
    excludes, so there are as many rounds as the longest chain of rows that wait for each other.  Of equal rows only
    the first open one matters, so copies are never paired.
    """
    place = F.struct("ord", "v")
    open_ = materialize(rows.select("v", "g", place.alias("at")))
    groups = group_links.select("g", "h", F.lit(1).alias("kind"))
    at = open_.select("v", "at")
    links = row_links.select("a", "b").union(row_links.select("b", "a")).distinct()
    links = links.join(at.toDF("a", "at_a"), "a").join(at.toDF("b", "at_b"), "b").filter("at_a < at_b")
    groups, links, stayed = materialize(groups.distinct()), materialize(links), []
    every = open_

    def met(kept: DataFrame, among: DataFrame) -> DataFrame:
        """(v, kind) of the rows ``among`` that meet a row of ``kept`` before them."""
        own = kept.select("g", F.col("at").alias("by"), F.lit(0).alias("kind"))
        near = groups.join(kept.select(F.col("g").alias("h"), F.col("at").alias("by")), "h").select("g", "by", "kind")
        by_row = links.join(kept.select(F.col("v").alias("a")), "a", "left_semi").select(F.col("b").alias("v"), F.lit(2).alias("kind"))
        by_group = among.join(own.unionByName(near), "g").filter("at > by").select("v", "kind")
        return by_group.unionByName(among.select("v").join(by_row, "v")).groupBy("v").agg(F.min("kind").alias("kind"))

    while True:
        first = open_.groupBy("g").agg(F.min("at").alias("first"))
        # each group meets itself and its neighbours
        near = groups.join(first.withColumnRenamed("g", "h"), "h").groupBy("g").agg(F.min("first").alias("near"))
        live = links.join(open_.select(F.col("v").alias("a")), "a", "left_semi")
        held = live.select(F.col("b").alias("v")).distinct().withColumn("held", F.lit(True))
        seen = open_.join(first, "g").join(near, "g", "left").join(held, "v", "left")
        stays = (F.col("at") == F.col("first")) & (F.col("near").isNull() | (F.col("at") < F.col("near"))) & F.col("held").isNull()
        kept = materialize(seen.filter(stays).select("v", "g", "at"))
        if kept.isEmpty():
            break
        stayed.append(kept)
        open_ = materialize(open_.join(kept.select("v").unionByName(met(kept, open_).select("v")), "v", "left_anti"))
    if not stayed:
        return every.select("v", F.lit(None).cast("int").alias("kind"))
    kept = materialize(reduce(DataFrame.unionByName, stayed))
    gone = met(kept, every.join(kept.select("v"), "v", "left_anti"))
    return kept.select("v", F.lit(None).cast("int").alias("kind")).unionByName(gone)


def layers(new: DataFrame, store: DataFrame, threshold: float, least: int = 21) -> DataFrame:
    """(memory_id, verdict) of a batch ``new`` (with ``ord``, its order) against ``store``: stored, same, contained or similar.

    Texts are compared lower-cased, with white space collapsed, within their category; containment, either way, from
    ``least`` characters on; likeness by cosine within category, scope and project.  First come the facts of the store,
    then earlier rows of the batch that stay.  A null text is empty.  Ids are of one kind and distinct over both tables.
    """
    flat = F.trim(F.regexp_replace(F.lower("content"), r"\s+", " "))
    digest = F.sha2(F.concat_ws("\x01", F.coalesce("category", F.lit("")), F.coalesce(flat, F.lit(""))), 256)
    columns = ["memory_id", "category", "content", "user_scope", "project_id", "embedding"]
    n = materialize(new.select(*columns, "ord", digest.alias("g")))
    s = materialize(store.select(*columns, digest.alias("g")))
    both = n.select(*columns).unionByName(s.select(*columns))
    names = n.select("memory_id", "g").unionByName(s.select("memory_id", "g"))
    pairs = containment_pairs(both, least).join(names.toDF("short_id", "g"), "short_id").join(names.toDF("long_id", "h"), "long_id").filter("g <> h").select("g", "h")
    groups = materialize(pairs.unionByName(pairs.select(F.col("h").alias("g"), F.col("g").alias("h"))).distinct())
    alike = materialize(semantic_pairs(both, threshold).select("a", "b"))
    alike = alike.union(alike.select("b", "a"))
    held = s.select("g").distinct()
    same = n.join(held, "g", "left_semi").select("memory_id", F.lit(0).alias("kind"))
    inside = n.join(groups.join(held.withColumnRenamed("g", "h"), "h", "left_semi").select("g").distinct(), "g", "left_semi").select("memory_id", F.lit(1).alias("kind"))
    known = alike.join(s.select(F.col("memory_id").alias("b")), "b", "left_semi").select(F.col("a").alias("memory_id"))
    like = n.join(known, "memory_id", "left_semi").select("memory_id", F.lit(2).alias("kind"))
    before = materialize(same.unionByName(inside).unionByName(like).groupBy("memory_id").agg(F.min("kind").alias("kind")))
    rest = n.join(before, "memory_id", "left_anti").select(F.col("memory_id").alias("v"), "ord", "g")
    among = first_kept(rest, groups, alike.join(n.select(F.col("memory_id").alias("b")), "b", "left_semi").select("a", "b"))
    kinds = before.unionByName(among.select(F.col("v").alias("memory_id"), "kind"))
    return kinds.select("memory_id", F.coalesce(F.get(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit("stored")).alias("verdict"))
