"""An approximate vector index kept as Parquet tables: k-means cells, residuals as product codes, exact re-rank.

Vectors are scaled to unit length.  A vector's cell is its nearest centre; what is left is cut into ``parts`` pieces,
each stored as the number of its nearest of ``words`` centres.  Centres are fitted on a sample of at most ``SAMPLE``
vectors, those with the smallest hash of their id; every vector is indexed.

A search reads the cells nearest to a query, scores their vectors by code through one table of products a query, keeps
the ``rerank`` best, and scores those exactly.  Cells and queries meet in groups of bounded size: a cell of more than
``CELL_ROWS`` vectors is dealt over several tasks, and so are more than ``QUERY_ROWS`` queries of one cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions.vectors import cosine, unit

from .iterate import materialize, shared_dir

SAMPLE = 50_000
CELL_ROWS, QUERY_ROWS = 20_000, 500


def kmeans(x: np.ndarray, k: int, seed: int = 1, rounds: int = 12) -> np.ndarray:
    """At most ``k`` centres; an empty one keeps its place."""
    r = np.random.default_rng(seed)
    centres = x[np.sort(r.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)


class VectorIndex:
    """The index below ``path``: ``cells`` (cell, centre), ``books`` (part, word, centre) and ``vectors`` (memory_id, cell, codes, embedding)."""

    def __init__(self, spark: SparkSession, path: str):
        self.cells, self.books, self.vectors = (spark.read.parquet(f"{path}/{name}") for name in ("cells", "books", "vectors"))

    @classmethod
    def build(cls, facts: DataFrame, path: str | None = None, cells: int | None = None, parts: int = 32, words: int = 64) -> VectorIndex:
        """Index facts (memory_id, embedding); null vectors are left out.  ``cells`` is about the root of their number by default."""
        spark = facts.sparkSession
        path = path or shared_dir(spark, "index")
        f = facts.filter("embedding is not null").select("memory_id", "embedding")
        held = [r["embedding"] for r in f.orderBy(F.xxhash64("memory_id"), "memory_id").limit(SAMPLE).collect()]
        sample = unit(held) if held else np.zeros((1, 1))
        n = f.count()
        centres = kmeans(sample, cells or max(1, int(n**0.5)))
        parts = max(p for p in range(1, parts + 1) if sample.shape[1] % p == 0)
        left = (sample - centres[nearest(sample, centres)]).reshape(len(sample), parts, -1)
        books = np.stack([kmeans(left[:, p], min(words, max(1, len(sample) // 4)), seed=p) for p in range(parts)])

        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = unit(b["embedding"].tolist())
                    own = nearest(x, centres)
                    rest = (x - centres[own]).reshape(len(x), parts, -1)
                    codes = np.stack([nearest(rest[:, p], books[p]) for p in range(parts)], 1).astype(np.uint8)
                    yield pd.DataFrame({"memory_id": pd.Series(b["memory_id"].tolist(), dtype=object), "cell": own, "codes": [c.tobytes() for c in codes], "embedding": b["embedding"].tolist()})

        schema = f"memory_id string, cell int, codes binary, embedding {f.schema['embedding'].dataType.simpleString()}"
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/cells")
        spark.createDataFrame([(p, w, c.tolist()) for p, book in enumerate(books) for w, c in enumerate(book)], "part int, word int, centre array<double>").write.parquet(f"{path}/books")
        f.mapInPandas(code, schema).repartitionByRange("cell").sortWithinPartitions("cell").write.parquet(f"{path}/vectors")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int, probes: float = 0.8, rerank: int = 100) -> DataFrame:
        """(query_id, memory_id, score, rank, scanned, scored): scored exactly, from the ``rerank`` best by code of the
        share ``probes`` of all cells; with how many vectors were looked at by code, and exactly, for the query."""
        if self.vectors.isEmpty():
            return queries.sparkSession.createDataFrame([], "query_id long, memory_id string, score double, rank int, scanned long, scored long")
        rows = sorted(self.cells.collect())
        centres = np.array([r["centre"] for r in rows])
        book = sorted((r["part"], r["word"], r["centre"]) for r in self.books.collect())
        parts = book[-1][0] + 1
        books = np.array([c for _, _, c in book]).reshape(parts, -1, len(book[0][2]))
        many = max(1, -(-int(len(centres) * probes * 1000) // 1000))
        q = queries.filter("query_vec is not null").select("query_id", "query_vec")

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    near = np.argsort(-(unit(b["query_vec"].tolist()) @ centres.T), axis=1, kind="stable")[:, :many]
                    yield pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), near.shape[1]), "cell": near.reshape(-1)})

        asked = materialize(q.mapInPandas(probe, "query_id long, cell int").join(q, "query_id"))
        # both sides of a cell in blocks, each block of queries with each of vectors
        blocks = lambda n, most: F.ceil(F.count("*") / most).cast("int").alias(n)
        sizes = self.vectors.groupBy("cell").agg(blocks("n", CELL_ROWS), F.count("*").alias("held")).join(asked.groupBy("cell").agg(blocks("m", QUERY_ROWS)), "cell")
        sizes = materialize(sizes)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(sizes, "cell").withColumn("j", F.pmod(F.xxhash64("query_id"), F.col("m")).cast("int")).withColumn("i", every("n"))
        right = self.vectors.select("memory_id", "cell", "codes").join(sizes, "cell").withColumn("i", F.pmod(F.xxhash64("memory_id"), F.col("n")).cast("int")).withColumn("j", every("m"))

        def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": np.zeros(0, np.int64), "memory_id": np.zeros(0, object), "near": np.zeros(0)})
            x, centre = unit(a["query_vec"].tolist()), centres[int(a["cell"].iloc[0])]
            codes = np.frombuffer(b"".join(b["codes"]), np.uint8).reshape(len(b), parts)
            tables = np.einsum("qpd,pwd->qpw", x.reshape(len(x), parts, -1), books)
            score = np.repeat((x @ centre)[:, None], len(b), 1)
            for p in range(parts):
                score += tables[:, p, codes[:, p]]
            best = np.argsort(-score, axis=1, kind="stable")[:, :rerank]
            return pd.DataFrame({"query_id": np.repeat(a["query_id"].to_numpy(), best.shape[1]), "memory_id": pd.Series(b["memory_id"].to_numpy(object)[best].reshape(-1), dtype=object), "near": np.take_along_axis(score, best, 1).reshape(-1)})

        found = left.select("query_id", "query_vec", "cell", "i", "j").groupBy("cell", "i", "j").cogroup(right.select("memory_id", "codes", "cell", "i", "j").groupBy("cell", "i", "j")).applyInPandas(scan, "query_id long, memory_id string, near double")
        first = Window.partitionBy("query_id").orderBy(F.desc("near"), "memory_id")
        near = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= rerank)
        exact = near.join(q, "query_id").join(self.vectors.select("memory_id", "embedding"), "memory_id").select("query_id", "memory_id", cosine("query_vec", "embedding").alias("score"))
        scanned = asked.join(sizes, "cell").groupBy("query_id").agg(F.sum("held").alias("scanned"))
        w = Window.partitionBy("query_id")
        exact = exact.withColumns({"rank": F.row_number().over(w.orderBy(F.desc(F.round("score", 12)), "memory_id")), "scored": F.count("*").over(w)})
        return exact.filter(F.col("rank") <= k).join(scanned, "query_id").select("query_id", "memory_id", "score", "rank", "scanned", "scored")


def recall(queries: DataFrame, facts: DataFrame, k: int, exact: DataFrame, most: float = 0.05) -> DataFrame:
    """query_id, found of ``exact``'s k, recall, and the shares of all vectors looked at by code and exactly, at most ``most``."""
    n = facts.filter("embedding is not null").count()
    hits = materialize(VectorIndex.build(facts).search(queries, k, rerank=max(1, min(100, int(n * most)))))
    both = exact.select("query_id", "memory_id").join(hits.select("query_id", "memory_id", F.lit(1).alias("one")), ["query_id", "memory_id"], "left")
    found = both.groupBy("query_id").agg(F.count("one").alias("found"), F.avg(F.coalesce("one", F.lit(0))).alias("recall"))
    share = hits.groupBy("query_id").agg((F.max("scanned") / n).alias("scanned_share"), (F.max("scored") / n).alias("scored_share"))
    return found.join(share, "query_id")
