"""The stored vector index against exact search, and pruned pairs against all products."""

from __future__ import annotations

import numpy as np
import pytest

from memspark.functions import vectors
from memspark.operators import dedup, evaluate, vector_index


def unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


@pytest.mark.parametrize("block", [2000, 60])
def test_pairs_are_those_of_all_products(spark, monkeypatch, block):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(dedup, "PIVOTS", 8)
    r = np.random.default_rng(3)
    centres = r.normal(size=(9, 16))
    v = np.concatenate((centres[r.integers(0, 9, 500)] + 0.15 * r.normal(size=(500, 16)), np.zeros((3, 16)), r.normal(size=(40, 16))))
    group = ["big"] * 480 + [f"g{i % 3}" for i in range(62)] + [None]
    rows = [(f"m{i:03}", g, None, "p", [float(x) for x in w]) for i, (g, w) in enumerate(zip(group, v))] + [("none", "big", None, "p", None)]
    facts = spark.createDataFrame(rows, "memory_id string, category string, user_scope string, project_id string, embedding array<double>")
    got = {(x["a"], x["b"]): x["cosine"] for x in dedup.semantic_pairs(facts, 0.9).collect()}
    s = unit(v) @ unit(v).T
    want = {(f"m{i:03}", f"m{j:03}") for i in range(len(v)) for j in range(i + 1, len(v)) if group[i] == group[j] and s[i, j] >= 0.9}
    assert set(got) == want and len(want) > 1000
    report = {x["facts"]: x for x in dedup.pair_budget(facts, 0.9, budget=1000).collect()}
    assert report[480]["pairs"] == 480 * 479 // 2 and report[480]["over"] and not report[1]["over"]
    if block == 60:
        # the clusters lie far apart, so most pairs of blocks need no product
        assert report[480]["skipped"] > report[480]["blocks"] / 2 and report[480]["skipped_pairs"] > 50_000


def test_index_on_the_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    facts = e.selectExpr("concat('m', vec_id) as memory_id", "embedding")
    queries = e.filter("vec_id % 5 = 0").selectExpr("vec_id as query_id", "embedding as query_vec")
    exact = vectors.top_k(queries, facts, 10)
    got = vector_index.recall(queries, facts, 10, exact).collect()
    assert len(got) == queries.count()
    assert np.mean([x["recall"] for x in got]) >= 0.9
    assert max(x["scored_share"] for x in got) <= 0.05 and max(x["scanned_share"] for x in got) < 1


def test_index_in_blocks_is_the_same_and_can_be_opened_again(spark, monkeypatch, tmp_path):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 32))
    v = centres[r.integers(0, 12, 1500)] + 0.6 * r.normal(size=(1500, 32))
    facts = spark.createDataFrame([(f"m{i:04}", [float(x) for x in v[i]]) for i in range(1500)] + [("null", None)], "memory_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(0, 1500, 50)] + [(-1, None)], "query_id long, query_vec array<double>")
    index = vector_index.VectorIndex.build(facts, f"file://{tmp_path}/index")
    rows = {tuple(x)[:4] for x in index.search(queries, 5).collect()}
    monkeypatch.setattr(vector_index, "CELL_ROWS", 10)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 3)
    again = vector_index.VectorIndex(spark, f"file://{tmp_path}/index")
    assert {tuple(x)[:4] for x in again.search(queries, 5).collect()} == rows and len(rows) == 150
    exact = {(x["query_id"], x["memory_id"]) for x in evaluate.retrieve("exact", queries, facts, 5).collect()}
    assert len(exact & {(q, m) for q, m, _, _ in rows}) >= 0.95 * len(exact)


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "memory_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, query_vec array<double>")
    assert vector_index.VectorIndex.build(none).search(queries, 5).collect() == []
