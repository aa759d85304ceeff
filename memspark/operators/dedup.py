"""Duplicates among facts: containment, semantic pairs, clusters and the maintenance plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import grams
from memspark.functions.vectors import unit

from .iterate import components, materialize
from .vector_index import kmeans

#: Rows of a block of the pairwise products; memory of a task is two blocks.
BLOCK_ROWS = 2000
#: Pivots of groups that need several blocks, fitted on so many of their vectors at most.
PIVOTS, PIVOT_SAMPLE = 64, 20_000
#: Keys of a text that are looked up before any text is compared.
_PROBES = 8
#: Bits of the table of keys that are asked for; it is sent to the tasks (32 MB), and keys beyond it only make it less sharp.
ASKED_BITS = 28


def _keyed(texts: DataFrame, least: int, asked: np.ndarray | None = None) -> DataFrame:
    """(memory_id, key) of ``texts`` (memory_id, category, flat): up to ``_PROBES`` keys of each text's own level, or,
    with the table ``asked``, the keys of every level that it holds."""
    sent = None if asked is None else texts.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = pd.util.hash_array(np.asarray(b["category"].to_pylist(), object), categorize=True) if len(b) else np.zeros(0, np.uint64)
            for ids, key in grams.keys(b["flat"], kinds, least, sent is None):
                if sent is not None:
                    bit = key >> np.uint64(64 - ASKED_BITS)
                    held = (sent.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                    ids, key = ids[held], key[held]
                order = np.lexsort((key, ids))
                ids, key = ids[order], key[order]
                new = np.ones(len(ids), bool)
                new[1:] = (ids[1:] != ids[:-1]) | (key[1:] != key[:-1])
                ids, key = ids[new], key[new]
                if sent is None:
                    some = np.arange(len(ids)) - np.searchsorted(ids, ids) < _PROBES
                    ids, key = ids[some], key[some]
                yield pa.RecordBatch.from_arrays([b["memory_id"].take(pa.array(ids)), pa.array(key.view(np.int64))], ["memory_id", "key"])

    return texts.select("memory_id", "category", "flat").mapInArrow(run, "memory_id string, key long")


def _asked(probes: DataFrame) -> np.ndarray:
    """The keys of ``probes`` as a table of ``2 ** ASKED_BITS`` bits, each of a key's first bits."""
    bit = f"shiftrightunsigned(key, {64 - ASKED_BITS})"
    words = probes.select(F.expr(f"shiftright({bit}, 6)").alias("word"), F.expr(f"shiftleft(1L, int({bit} & 63))").alias("bits"))
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (ASKED_BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def containment_pairs(facts: DataFrame, least: int = 20) -> DataFrame:
    """(short_id, long_id): facts whose text is part of another's of the same category, both of ``least`` characters or more.

    Texts are compared lower-cased, with white space collapsed.  Equal texts are pairs from each larger id to the
    smallest, which alone goes on for them; so copies never multiply pairs.

    A text's keys (``functions.grams``) are keys of every text that holds it, so one that has a key of its own alone can't
    be inside any; of what is left, the rarest of ``_PROBES`` keys finds the texts to compare.  Only keys that some text
    asks for leave the tasks, and only (id, key) rows meet by key; texts join the pairs that are left.
    """
    # a run that is one space stays as it is
    flat = F.trim(F.regexp_replace(F.lower("content"), r"[ ]\s+|[\t\n\x0B\f\r]\s*", " "))
    f = facts.select("memory_id", "category", flat.alias("flat")).withColumns({"n": F.length("flat"), "digest": F.sha2("flat", 256)})
    f = materialize(f).filter(F.col("n") >= least)
    same = f.groupBy("category", "digest").agg(F.min("memory_id").alias("first"), F.count("*").alias("n"))
    many = same.filter("n > 1").select(F.col("category").alias("_c"), F.col("digest").alias("_d"), "first")
    copies = f.join(many, F.col("category").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d"))).filter("memory_id <> first")
    copies = materialize(copies.select(F.col("memory_id").alias("short_id"), F.col("first").alias("long_id")))
    r = f.join(copies.select(F.col("short_id").alias("memory_id")), "memory_id", "left_anti").select("memory_id", F.coalesce("category", F.lit("")).alias("category"), "flat")
    probes = materialize(_keyed(r, least))
    held = materialize(_keyed(r, least, _asked(probes)))
    shared = held.groupBy("key").agg(F.count("*").alias("count")).filter("count > 1")
    wanted = probes.groupBy("memory_id").agg(F.count("*").alias("asked"))
    met = probes.join(shared, "key").groupBy("memory_id").agg(F.count("*").alias("found"), F.min_by("key", "count").alias("key"))
    met = met.join(wanted, "memory_id").filter("found = asked").select(F.col("memory_id").alias("short_id"), "key")
    pairs = materialize(met.join(held.withColumnRenamed("memory_id", "long_id"), "key").filter("short_id <> long_id").select("short_id", "long_id"))
    text = r.select("memory_id", F.col("category").alias("c"), "flat")
    pairs = pairs.join(text.toDF("short_id", "ca", "a"), "short_id").join(text.toDF("long_id", "cb", "b"), "long_id")
    return pairs.filter((F.col("ca") == F.col("cb")) & (F.length("a") < F.length("b")) & F.contains("b", "a")).select("short_id", "long_id").unionByName(copies)


def _grouped(facts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(memory_id, embedding, g): facts with a vector, g their group."""
    name = F.to_json(F.struct(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys)))
    return facts.filter("embedding is not null").select("memory_id", "embedding", name.alias("g"))


def _blocks(f: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows with cell and part, block pairs with ``kept``) of groups (memory_id, embedding, g) that need several blocks.

    A row's cell is its nearest pivot; a cell's rows are dealt over parts of about ``BLOCK_ROWS``.  Two blocks hold no
    pair if the angle between their pivots, less the widest angle of each to its own pivot, is beyond that of the
    threshold; such pairs of blocks are left out, and only such.
    """
    spark = f.sparkSession
    sample = unit([r["embedding"] for r in f.orderBy(F.xxhash64("memory_id"), "memory_id").limit(PIVOT_SAMPLE).collect()])
    centres = unit(list(kmeans(sample, PIVOTS)))
    schema = f"memory_id string, embedding {f.schema['embedding'].dataType.simpleString()}, g string, cell int, angle double"

    def deal(batches):
        for b in batches:
            if len(b):
                s = unit(b["embedding"].tolist()) @ centres.T
                yield b.assign(cell=s.argmax(1).astype(np.int32), angle=np.arccos(np.clip(s.max(1), -1, 1)))

    rows = materialize(f.mapInPandas(deal, schema))
    parts = rows.groupBy("g", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    rows = rows.join(parts, ["g", "cell"]).withColumn("part", F.pmod(F.xxhash64("memory_id"), F.col("parts")).cast("int")).drop("parts")
    blocks = rows.groupBy("g", "cell", "part").agg(F.max("angle").alias("wide"), F.count("*").alias("n"))
    blocks = materialize(blocks)
    far = np.arccos(np.clip(centres @ centres.T, -1, 1))
    between = spark.createDataFrame([(i, j, float(far[i, j])) for i in range(len(far)) for j in range(len(far))], "cell int, cell2 int, far double")
    other = blocks.select("g", F.col("cell").alias("cell2"), F.col("part").alias("part2"), F.col("wide").alias("wide2"), F.col("n").alias("n2"))
    pairs = blocks.join(other, "g").filter("(cell, part) <= (cell2, part2)").join(F.broadcast(between), ["cell", "cell2"])
    # zero vectors have no angle, so nothing is left out where they could reach the threshold
    out = F.lit(threshold > 0) & (F.col("far") - F.col("wide") - F.col("wide2") > float(np.arccos(min(1.0, threshold))) + 1e-6)
    same = (F.col("cell") == F.col("cell2")) & (F.col("part") == F.col("part2"))
    return rows, pairs.select("g", "cell", "part", "cell2", "part2", (~out).alias("kept"), F.when(same, F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("n2")).cast("long").alias("pairs"))


def semantic_pairs(facts: DataFrame, threshold: float, keys: tuple[str, ...] = ("category", "user_scope", "project_id")) -> DataFrame:
    """(a, b, cosine): pairs a < b of one group (equal ``keys``) whose cosine reaches the threshold.

    A group of up to ``BLOCK_ROWS`` facts is one product.  Larger ones are cut into blocks around pivots, and a task
    multiplies two blocks; block pairs that can't hold a pair are never formed.
    """
    f = _grouped(facts, keys)
    sizes = materialize(f.groupBy("g").agg(F.count("*").alias("n")))
    schema = "a string, b string, cosine double"

    def product(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        s = unit(left["embedding"].tolist()) @ unit(right["embedding"].tolist()).T
        x, y = np.nonzero(s >= threshold)
        a, b = left["memory_id"].to_numpy()[x], right["memory_id"].to_numpy()[y]
        keep = a < b if same else a != b
        return pd.DataFrame({"a": np.minimum(a[keep], b[keep]), "b": np.maximum(a[keep], b[keep]), "cosine": s[x, y][keep]})

    small = f.join(sizes.filter(F.col("n") <= BLOCK_ROWS), "g").groupBy("g").applyInPandas(lambda pdf: product(pdf, pdf, True), schema)
    if sizes.filter(F.col("n") > BLOCK_ROWS).isEmpty():
        return small

    def two_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        return product(left, right if len(right) else left, not len(right))

    rows, pairs = _blocks(f.join(sizes.filter(F.col("n") > BLOCK_ROWS).select("g"), "g").select("memory_id", "embedding", "g"), threshold)
    pairs = pairs.filter("kept").drop("kept", "pairs")
    alone = (F.col("cell") == F.col("cell2")) & (F.col("part") == F.col("part2"))
    first = rows.join(pairs, ["g", "cell", "part"]).withColumn("side", F.lit(0))
    second = rows.withColumnsRenamed({"cell": "cell2", "part": "part2"}).join(pairs.filter(~alone), ["g", "cell2", "part2"]).withColumn("side", F.lit(1))
    names = ["g", "cell", "part", "cell2", "part2"]
    both = first.select(*names, "memory_id", "embedding", "side").unionByName(second.select(*names, "memory_id", "embedding", "side"))
    return small.unionByName(both.groupBy(*names).applyInPandas(two_blocks, schema))


def pair_budget(facts: DataFrame, threshold: float, keys: tuple[str, ...] = ("category", "user_scope", "project_id"), budget: int = 20_000) -> DataFrame:
    """(g, facts, pairs, over, blocks, skipped, skipped_pairs): per group of ``semantic_pairs`` how many pairs there are,
    whether they pass ``budget``, the pairs of blocks, and how many of them, with how many pairs, need no product."""
    f = _grouped(facts, keys)
    sizes = materialize(f.groupBy("g").agg(F.count("*").alias("facts")))
    total = (F.col("facts") * (F.col("facts") - 1) / 2).cast("long")
    out = sizes.select("g", "facts", total.alias("pairs"), (total > budget).alias("over"))
    if sizes.filter(F.col("facts") > BLOCK_ROWS).isEmpty():
        return out.withColumns({"blocks": F.lit(1).cast("long"), "skipped": F.lit(0).cast("long"), "skipped_pairs": F.lit(0).cast("long")})
    pairs = _blocks(f.join(sizes.filter(F.col("facts") > BLOCK_ROWS).select("g"), "g").select("memory_id", "embedding", "g"), threshold)[1]
    cut = pairs.groupBy("g").agg(F.count("*").alias("blocks"), F.count_if(~F.col("kept")).alias("skipped"), F.sum(F.when(F.col("kept"), 0).otherwise(F.col("pairs"))).alias("skipped_pairs"))
    return out.join(cut, "g", "left").select(*out.columns, F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce("skipped", F.lit(0)).alias("skipped"), F.coalesce("skipped_pairs", F.lit(0)).alias("skipped_pairs"))


def clusters(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """(memory_id, cluster, keeper) of linked facts; the keeper has the best score, then is the newest, then the smallest id."""
    label = components(pairs.select("a", "b")).select(F.col("v").alias("memory_id"), F.col("c").alias("cluster"))
    s = label.join(scored.select("memory_id", "score", "created_at"), "memory_id")
    keep = s.groupBy("cluster").agg(F.min_by("memory_id", F.struct(-F.round("score", 9), -F.col("created_at"), "memory_id")).alias("keeper"))
    return s.select("memory_id", "cluster").join(keep, "cluster")


def seed_stars(facts: DataFrame, threshold: float, most: int = 7) -> DataFrame:
    """(seed, memory_id): the newest fact that is in no cluster yet is a seed, and the ``most`` nearest facts in none,
    with a cosine of ``threshold`` or more to the seed itself, join it; nothing follows from their own likeness.

    Exact in rounds: all facts with no newer free fact within two links go at once, for theirs are the clusters that
    no other open choice can touch.  Facts without a vector, or alone, are their own seeds.
    """
    near = materialize(semantic_pairs(facts, threshold))
    both = near.select("a", "b", "cosine").union(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    age = facts.select("memory_id", F.struct("created_at", "memory_id").alias("age"))
    links = materialize(both.join(age.toDF("a", "age_a"), "a").join(age.toDF("b", "age_b"), "b"))
    free = materialize(age)
    out = None
    while True:
        one = links.join(free.select(F.col("memory_id").alias("a")), "a", "left_semi").join(free.select(F.col("memory_id").alias("b")), "b", "left_semi")
        one = materialize(one)
        # the newest free fact within one link, then within two
        newest = free.join(one.groupBy(F.col("a").alias("memory_id")).agg(F.max("age_b").alias("n1")), "memory_id", "left").select("memory_id", "age", F.greatest("age", F.coalesce("n1", "age")).alias("n1"))
        second = one.join(newest.select(F.col("memory_id").alias("b"), F.col("n1").alias("n2")), "b").groupBy(F.col("a").alias("memory_id")).agg(F.max("n2").alias("n2"))
        seeds = materialize(newest.join(second, "memory_id", "left").filter(F.greatest("n1", F.coalesce("n2", "n1")) == F.col("age")).select("memory_id"))
        w = Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 9)), F.desc("age_b"))
        members = one.join(seeds.withColumnRenamed("memory_id", "a"), "a", "left_semi").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
        taken = materialize(members.select(F.col("a").alias("seed"), F.col("b").alias("memory_id")).unionByName(seeds.select(F.col("memory_id").alias("seed"), "memory_id")))
        out = taken if out is None else out.unionByName(taken)
        free = materialize(free.join(taken.select("memory_id"), "memory_id", "left_anti"))
        if free.isEmpty():
            return out


def consolidate(facts: DataFrame, unused: DataFrame, contained: DataFrame, clustered: DataFrame, scored: DataFrame, now: int, most: int | None) -> DataFrame:
    """Maintenance plan: memory_id, reason, keeper; one reason a fact, the first of expired, stale, contained, semantic.

    Of a contained pair the fact with the better score stays, the longer one where scores are equal.
    """
    base = facts.select("memory_id", "expires_at", "created_at", "category", "confidence")
    expired = base.filter(F.col("expires_at") <= now).select("memory_id", F.lit(1).alias("pri"), F.lit("expired").alias("reason"), F.lit(None).cast("string").alias("keeper"))
    stale = base.filter(F.col("category").isin("context_note", "event") & (F.col("created_at") <= now - 30 * 86400) & (F.col("confidence") <= 0.6)).join(unused, "memory_id")
    stale = stale.select("memory_id", F.lit(2).alias("pri"), F.lit("stale").alias("reason"), F.lit(None).cast("string").alias("keeper"))
    score = scored.select("memory_id", F.round("score", 9).alias("score"))
    both = contained.join(score.toDF("short_id", "s"), "short_id").join(score.toDF("long_id", "l"), "long_id").withColumn("turn", F.col("s") > F.col("l"))
    inside = both.select(F.when(F.col("turn"), F.col("long_id")).otherwise(F.col("short_id")).alias("memory_id"), F.lit(3).alias("pri"), F.lit("contained").alias("reason"), F.when(F.col("turn"), F.col("short_id")).otherwise(F.col("long_id")).alias("keeper"))
    alike = clustered.filter("memory_id <> keeper").select("memory_id", F.lit(4).alias("pri"), F.lit("semantic").alias("reason"), "keeper")
    rows = expired.unionByName(stale).unionByName(inside).unionByName(alike)
    one = rows.groupBy("memory_id").agg(F.min(F.struct("pri", "reason", "keeper")).alias("x"))
    one = one.select("memory_id", "x.reason", "x.keeper", "x.pri")
    return (one if most is None else one.orderBy("pri", "memory_id").limit(most)).drop("pri")
