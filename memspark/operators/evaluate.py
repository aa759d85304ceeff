"""Retrieval evaluation and diagnostics over tables of hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.vectors import cosine, top_k, unit

from .vector_index import VectorIndex


def date_rank(hits: DataFrame, target_day: Column) -> DataFrame:
    far = F.abs(F.floor(F.col("created_at") / 86400) - target_day)
    w = Window.partitionBy("query_id").orderBy(far.asc_nulls_last(), "rank")
    return hits.withColumn("date_rank", F.row_number().over(w))


def chronological(hits: DataFrame) -> DataFrame:
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("created_at", "memory_id")))


def ir_metrics(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """p@5, p@k, r@k, nDCG@k and reciprocal rank of each query with relevant facts."""
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    h = hits.join(relevant.withColumn("hit", F.lit(True)), ["query_id", "memory_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    m = h.groupBy("query_id").agg(
        (F.count_if(F.col("hit") & (F.col("rank") <= 5)) / 5).alias("p5"), (F.count_if("hit") / k).alias("p10"), F.count_if("hit").alias("hits"),
        F.sum(F.when(F.col("hit"), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), (1.0 / F.min(F.when(F.col("hit"), F.col("rank")))).alias("rr"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return n.join(m, "query_id", "left").select("query_id", *(F.round(v, 6).alias(c) for c, v in (("p5", z("p5")), ("p10", z("p10")), ("r10", F.coalesce("hits", F.lit(0)) / F.col("n")), ("ndcg10", z("dcg") / ideal), ("rr", z("rr")))))


def why_not(expected: DataFrame, facts: DataFrame, hits: DataFrame, now: int, user: str, low: float = 0.3) -> DataFrame:
    f = facts.select("memory_id", "status", "valid_to", "expires_at", "user_scope", F.lit(True).alias("known"))
    x = expected.join(f, "memory_id", "left").join(hits.select("query_id", "memory_id", "rank", "raw"), ["query_id", "memory_id"], "left")
    when = lambda c, r: F.when(c, F.lit(r))
    reasons = F.array_compact(F.array(
        when(F.col("known").isNull(), "not found"), when(F.col("status") == "quarantined", "quarantined"), when(F.col("valid_to").isNotNull(), "superseded"), when(F.col("expires_at") <= now, "expired"),
        when(F.col("user_scope") != user, "scope"), when(F.col("raw") < low, "low similarity"), when(F.col("known") & F.col("rank").isNull(), "ranked below k"),
    ))
    return x.select("query_id", "memory_id", F.col("rank").isNotNull().alias("found"), "rank", reasons.alias("reasons"))


def probe_hits(expected: DataFrame, facts: DataFrame, hits: DataFrame, ladder: list[int]) -> DataFrame:
    """A hit is the expected fact or another version of its chain."""
    chain = facts.select("memory_id", "chain_id")
    e = expected.join(chain, "memory_id").withColumnRenamed("memory_id", "want")
    h = hits.select("query_id", "memory_id", "rank").join(chain.withColumnRenamed("chain_id", "h_chain"), "memory_id")
    best = e.join(h, "query_id").filter("memory_id = want or h_chain = chain_id").groupBy("query_id").agg(F.min("rank").alias("rank"))
    out = e.select("query_id").join(best, "query_id", "left").withColumn("k", F.explode(F.array(*map(F.lit, ladder))))
    return out.select("query_id", "k", F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)).alias("hit"))


def approximate_top_k(queries: DataFrame, facts: DataFrame, k: int, tables: int = 48, bits: int = 10, flips: int = 7, seed: int = 7) -> DataFrame:
    """(query_id, memory_id, score, rank) from facts that share a bucket with the query in one of ``tables``, scored exactly.

    A bucket is the signs of ``bits`` random projections; a query also looks into the buckets whose ``flips`` least
    certain signs differ.  Buckets are an equi-join, so a query meets a share of the facts, not all of them.
    """
    head = facts.filter("embedding is not null").select(F.size("embedding").alias("n")).first()
    if head is None:
        return top_k(queries, facts, k)
    planes = np.random.default_rng(seed).normal(size=(tables * bits, head["n"]))

    def buckets(column: str, probe: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                side = (unit(b[column].tolist()) @ planes.T).reshape(len(b), tables, bits)
                own = ((side > 0) << np.arange(bits)).sum(2)
                found = [own]
                if probe:
                    unsure = np.argsort(np.abs(side), axis=2)
                    found += [own ^ (1 << unsure[:, :, i]) for i in range(flips)]
                keys = np.concatenate([f + (np.arange(tables) << bits) for f in found], axis=1)
                yield pd.DataFrame({b.columns[0]: b.iloc[:, 0], "keys": list(keys)})

        return run

    q = queries.filter("query_vec is not null").select("query_id", "query_vec")
    f = facts.filter("embedding is not null").select("memory_id", "embedding")
    asked = q.mapInPandas(buckets("query_vec", True), "query_id long, keys array<long>").select("query_id", F.explode(F.array_distinct("keys")).alias("key"))
    held = f.mapInPandas(buckets("embedding", False), "memory_id string, keys array<long>").select("memory_id", F.explode("keys").alias("key"))
    near = asked.join(held, "key").select("query_id", "memory_id").distinct()
    scored = near.join(q, "query_id").join(f, "memory_id").select("query_id", "memory_id", cosine("query_vec", "embedding").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "memory_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def retrieve(strategy: str, queries: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """Top k by ``exact`` products, from ``buckets`` or from an ``index``; all have the same columns."""
    if strategy == "index":
        return VectorIndex.build(facts).search(queries, k).select("query_id", "memory_id", "score", "rank")
    return {"exact": top_k, "buckets": approximate_top_k}[strategy](queries, facts, k)


def lsh_recall(queries: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """query_id, found and recall of the approximate top k against the exact one."""
    near, both = retrieve("buckets", queries, facts, k), retrieve("exact", queries, facts, k).select("query_id", "memory_id")
    both = both.join(near.select("query_id", "memory_id", F.lit(1).alias("one")), ["query_id", "memory_id"], "left")
    return both.groupBy("query_id").agg(F.count("one").alias("found"), F.avg(F.coalesce("one", F.lit(0))).alias("recall"))


def embedding_check(vectors: DataFrame) -> DataFrame:
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("x"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centre"))
    return vectors.join(centre, "label").groupBy("label").agg(F.round(F.avg(cosine("embedding", "centre")), 6).alias("mean_cosine"), F.count("*").alias("n"))


def config_hash(knobs: dict[str, Column]) -> Column:
    """16 hex digits of the SHA-256 of settings as JSON, keys sorted; equal settings give equal hashes."""
    return F.substring(F.sha2(F.to_json(F.struct(*(knobs[k].alias(k) for k in sorted(knobs)))), 256), 1, 16)
