"""Vector similarity: column form, and block products inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries, or of facts, in a task; and queries up to which the query side is sent to the tasks.
BLOCK, MAX_SENT = 2000, 4000


def cosine(a: str, b: str) -> Column:
    """Dot over norms in double precision, 0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def unit(rows: list) -> np.ndarray:
    m = np.array([np.asarray(v, float) for v in rows]).reshape(len(rows), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(ids: np.ndarray, matrix: np.ndarray, names: np.ndarray, vectors: list, k: int) -> pd.DataFrame:
    """The k best names of each query, ties at the edge to the smaller name."""
    s = matrix @ unit(vectors).T
    by_name = np.argsort(names, kind="stable")
    at = by_name[np.argsort(-np.round(s[:, by_name], 12), axis=1, kind="stable")[:, :k]]
    return pd.DataFrame({"query_id": np.repeat(ids, at.shape[1]), "memory_id": names[at].reshape(-1), "score": np.take_along_axis(s, at, 1).reshape(-1)})


def top_k(queries: DataFrame, facts: DataFrame, k: int, max_sent: int = MAX_SENT) -> DataFrame:
    """(query_id, memory_id, score, rank): exact cosine top k of each query over all facts.

    Up to ``max_sent`` queries are sent to the tasks, which read the facts once.  More queries meet the facts in blocks
    of ``BLOCK`` rows a side, dealt by pairs of blocks; nothing passes through the driver.  Either way a task keeps only
    its own k best a query, and the global rank is a window that Spark limits before the exchange.
    """
    q = queries.filter("query_vec is not null").select("query_id", "query_vec")
    f = facts.filter("embedding is not null").select("memory_id", "embedding")
    schema = "query_id long, memory_id string, score double"
    head = q.limit(max_sent + 1).collect()
    if len(head) <= max_sent:
        ids, matrix = np.array([r["query_id"] for r in head], np.int64), unit([r["query_vec"] for r in head])

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and len(ids):
                    yield _best(ids, matrix, b["memory_id"].to_numpy(), b["embedding"].tolist(), k)

        out = f.mapInPandas(scan, schema)
    else:
        n, m = (max(1, -(-side.count() // BLOCK)) for side in (q, f))
        deal = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        left = q.withColumn("i", deal("query_id", n)).withColumn("j", every(m))
        right = f.withColumn("j", deal("memory_id", m)).withColumn("i", every(n))

        def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "memory_id": [], "score": []})
            return _best(a["query_id"].to_numpy(), unit(a["query_vec"].tolist()), b["memory_id"].to_numpy(), b["embedding"].tolist(), k)

        out = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(product, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "memory_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def encode(texts: DataFrame, size: int = 64) -> DataFrame:
    """(memory_id, embedding): the encoder that stands where no model is given: hashed word counts of unit length, in the JVM."""
    words = texts.select("memory_id", F.filter(F.split(F.lower("content"), r"\s+"), lambda w: w != "").alias("words"))
    counted = HashingTF(numFeatures=size, inputCol="words", outputCol="counts").transform(words)
    scaled = Normalizer(p=2.0, inputCol="counts", outputCol="unit").transform(counted)
    return scaled.select("memory_id", vector_to_array("unit").alias("embedding"))
