"""Insertion and review that see their own batch, against going through the rows one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from memspark.operators import proposals, remember


def by_hand(rows, groups, links):
    kept, out = [], {}
    for v, _, g in sorted(rows, key=lambda r: (r[1], r[0])):
        kinds = [0 if h == g else 1 if (g, h) in groups else 2 for w, h in kept if h == g or (g, h) in groups or (v, w) in links]
        out[v] = min(kinds, default=None)
        if not kinds:
            kept.append((v, g))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_first_kept_in_dependent_chains(spark, seed):
    r = random.Random(seed)
    rows = [(f"v{i:03d}", r.choice([i, 7]), f"g{r.randrange(40)}") for i in range(90)]
    groups = {(a, b) for a, b in ((f"g{r.randrange(40)}", f"g{r.randrange(40)}") for _ in range(25)) if a != b}
    groups |= {(b, a) for a, b in groups}
    # a chain in which every second row goes because the one before it stays
    chain = [(f"c{i:02d}", 1000 + i, f"own{i}") for i in range(9)]
    links = {(f"c{i:02d}", f"c{i + 1:02d}") for i in range(8)} | {(r.choice(rows)[0], r.choice(rows)[0]) for _ in range(40)}
    links = {(a, b) for a, b in links if a != b}
    rows += chain
    got = remember.first_kept(
        spark.createDataFrame(rows, "v string, ord long, g string"), spark.createDataFrame(sorted(groups), "g string, h string"), spark.createDataFrame(sorted(links), "a string, b string"),
    ).collect()
    assert {x["v"]: x["kind"] for x in got} == by_hand(rows, groups, links | {(b, a) for a, b in links})
    assert len(got) == len(rows)


def test_first_kept_of_nothing(spark):
    none = spark.createDataFrame([], "v string, ord long, g string")
    assert remember.first_kept(none, spark.createDataFrame([], "g string, h string"), spark.createDataFrame([], "a string, b string")).collect() == []


FACT = "memory_id string, category string, content string, user_scope string, project_id string, embedding array<float>, status string, valid_to long"
A, B = "the user lives in a small house in oslo", "meetings are held on monday mornings"


def test_review_sees_its_batch(spark):
    facts = spark.createDataFrame([("m1", "goal", B, None, None, None, "active", None), ("m2", "goal", "an old text of some length", None, None, None, "active", 5)], FACT)
    rows = [
        ("c1", "goal", A, "pending", 1), ("c2", "goal", A + " ", "pending", 2), ("c3", "goal", A.upper(), "pending_user_confirmation", 3), ("c4", "goal", "so " + A, "reviewed_approved", 4),
        ("c5", "event", A, "pending", 5), ("c6", "goal", f"note: {B}!", "pending", 6), ("c7", "goal", "something else entirely, at length", "pending", 7), ("c8", "goal", "one more", "rejected", 8), ("c9", "goal", "only a machine says so", "pending", 9),
        ("d0", "goal", "an old text of some length", "pending", 10),
    ]
    cand = spark.createDataFrame([(i, c, t, None, None, s, n) for i, c, t, s, n in rows], "candidate_id string, category string, content string, user_scope string, project_id string, status string, created_at long")
    word = [(f"c{i}", "person", "accept", None) for i in range(1, 9)] + [("c9", "automatic", "accept", None), ("c7", "person", "reject", None), ("d0", "person", "accept", "m1")]
    got = proposals.apply_review(cand, spark.createDataFrame(word, "candidate_id string, actor string, decision string, supersedes string"), facts).collect()
    status = {r["id"]: r["detail"] for r in got if r["kind"] == "status"}
    assert status == {"c1": "approved", "c2": "deduplicated", "c3": "deduplicated", "c4": "deduplicated", "c5": "approved", "c6": "deduplicated", "c7": "approved", "d0": "approved"}
    assert sorted((r["id"], r["detail"]) for r in got if r["kind"] == "refused") == [("c7", "reject"), ("c8", "accept"), ("c9", "accept")]
    assert sorted(r["detail"] for r in got if r["kind"] == "fact") == ["event", "goal", "goal", "goal"]
    assert [r["id"] for r in got if r["kind"] == "closed"] == ["m1"]


def test_layers_without_vectors_or_rows(spark):
    empty = spark.createDataFrame([], FACT)
    assert remember.layers(empty.withColumn("ord", F.lit(1)), empty, 0.8).collect() == []
    one = spark.createDataFrame([("x", None, None, None, None, None, "active", None), ("y", None, "", None, None, None, "active", None)], FACT)
    got = {r["memory_id"]: r["verdict"] for r in remember.layers(one.withColumn("ord", F.lit(1)), empty, 0.8).collect()}
    assert got == {"x": "stored", "y": "same"}
