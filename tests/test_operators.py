"""Folds, chains, components, review and pointers on small hand-made tables."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from memspark.functions import text as x
from memspark.functions import vectors
from memspark import registry
from memspark.operators import chains, dedup, evaluate, graph, iterate, proposals, ranking, sessions
from memspark.sources import tables


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 120)] + [(5, 5)]
    got = {r["v"]: r["c"] for r in iterate.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 120))


def test_history_survives_forks_dangling_pointers_and_cycles(spark):
    rows = [("a", "b", 1), ("b", "c", 2), ("c", None, 3), ("f", "c", 2), ("d", "gone", 1), ("x", "y", 1), ("y", "x", 2)]
    got = {r["memory_id"]: r["head"] for r in chains.heads(spark.createDataFrame(rows, "memory_id string, superseded_by string, valid_from long"), rounds=6).collect()}
    assert got["a"] == got["b"] == got["f"] == "c" and got["d"] == "d" and got["x"] == got["y"] == "x"


def test_lineage_of_a_cycle_ends(spark):
    s = spark.createDataFrame([(1, None, None), (2, 1, "compression"), (3, 2, None), (7, 8, None), (8, 7, None)], "session_id long, parent_session_id long, end_reason string")
    got = {r["session_id"]: (r["root"], r["compressed"]) for r in sessions.lineage(s, rounds=5).collect()}
    assert got[3] == (1, True) and got[1] == (1, False)


def test_delete_reopens_only_the_predecessor_of_a_head(spark):
    facts = spark.createDataFrame([("a", "active", 5, "b"), ("b", "active", None, None), ("c", "active", 5, "d"), ("d", "active", None, None)], "memory_id string, status string, valid_to long, superseded_by string")
    gone = spark.createDataFrame([("b",), ("c",)], "memory_id string")
    got = {r["memory_id"]: (r["status"], r["valid_to"]) for r in chains.apply_deletes(facts, gone).collect()}
    assert got == {"a": ("active", None), "c": ("quarantined", 5), "d": ("active", None)}


def test_review_never_approves_and_never_moves_closed_candidates(spark):
    c = spark.createDataFrame([("1", "pending"), ("2", "rejected"), ("3", "pending"), ("4", "pending")], "candidate_id string, status string")
    d = spark.createDataFrame([("1", "approve"), ("2", "approve"), ("3", "nonsense")], "candidate_id string, decision string")
    after, bad = proposals.review(c, d)
    assert {r[0]: r[1] for r in after.collect()} == {"1": "reviewed_approved", "2": "rejected", "3": "pending", "4": "pending"}
    assert {r[0] for r in bad.collect()} == {"2", "3"}


def test_fusion_lies_between_zero_and_one_and_falls_back(spark):
    a = spark.createDataFrame([(1, "x", 0.9, 1), (1, "y", 0.5, 2), (2, "x", 0.4, 1)], "query_id long, memory_id string, score double, rank int")
    b = spark.createDataFrame([(1, "x", 0.8, 1)], "query_id long, memory_id string, score double, rank int")
    got = {(r["query_id"], r["memory_id"]): (round(r["score"], 6), r["score_kind"]) for r in ranking.fuse(a, b).collect()}
    assert got[1, "x"] == (1.0, "rrf") and 0 < got[1, "y"][0] < 1 and got[2, "x"] == (0.4, "single")


def test_removed_evidence_quarantines_an_edge(spark):
    e = spark.createDataFrame([("a", "knows", "b", "m1"), ("a", "knows", "c", "m1"), ("a", "knows", "c", "m2")], "src string, relation string, dst string, memory_id string")
    got = {r["dst"]: (r["status"], r["evidence"]) for r in graph.remove_evidence(graph.merge_evidence(e), spark.createDataFrame([("m1",)], "memory_id string")).collect()}
    assert got == {"b": ("quarantined", []), "c": ("active", ["m2"])}


def test_text_rules(spark):
    t = spark.createDataFrame([("my partner is anna now",), ("i live in oslo",), ("nothing here",), ("i work for acme trading today",), ("i am tired of queues",), ("i'm a keen gardener",), ("i am learning welsh",)], "s string")
    facts = [r[0] and tuple(r[0]) for r in t.select(x.fact(F.col("s"))).collect()]
    assert facts == [("relationship", "relationship", "anna now"), ("location", "personal_fact", "oslo"), None, ("work", "personal_fact", "acme trading today"), None, ("identity", "personal_fact", "keen gardener"), ("ongoing", "context_note", "welsh")]
    rel = [[(q["relation"], q["target"], q["type"]) for q in r[0]] for r in t.select(x.relations(F.col("s"))).collect()]
    assert rel[:4] == [[("has_partner", "anna", "person")], [("lives_in", "oslo", "place")], [], [("works_for", "acme trading", "organization")]] and rel[4] == []
    texts = {
        "short": ["junk"], "user is tired.": ["junk"], "a note that was cut (and then": ["junk"], "and so it went on to": ["fragment"], "the user is an ai model": ["wrong_subject"],
        "this person likes tea a lot": ["unanchored_subject"], "i told you to book a table": ["assistant_instruction", "second_person"], "as discussed in this chat we go": ["conversation_meta", "fragment"], "user lives in a house in oslo": [],
    }
    flags = spark.createDataFrame([(k,) for k in texts], "s string")
    assert {r[0]: r[1] for r in flags.select("s", x.flags(F.col("s"))).collect()} == texts
    asks = {"when did we meet bob?": True, "i met bob yesterday": False, "what did alice say about the move?": True, "what did she say?": False, "is this one better?": False}
    rows = spark.createDataFrame([(k, k.replace("alice", "Alice")) for k in asks], "s string, w string")
    assert {r[0]: r[1] for r in rows.select("s", x.routed(F.col("s"), F.col("w"))).collect()} == asks
    change = {"what has changed at work?": True, "do i still live in oslo?": True, "where do i work now?": True, "i work here now": False, "she is still here": False, "what did we eat before lunch?": True}
    assert {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in change], "s string").select("s", F.col("s").rlike(x.CHANGE)).collect()} == change


def test_dates_from_phrases(spark):
    day = dt.date
    sunday, leap = day(2024, 3, 3), day(2024, 3, 1)
    cases = [
        ("we met on march 2", leap, day(2023, 3, 2)), ("we met on february 29th", leap, day(2024, 2, 29)), ("on february 30", leap, None), ("on february 29", day(2024, 2, 1), None), ("valentine's day", leap, day(2024, 2, 14)), ("valentines day", day(2024, 1, 5), day(2023, 2, 14)),
        ("yesterday", leap, day(2024, 2, 29)), ("the day before yesterday", leap, day(2024, 2, 28)), ("last weekend", leap, day(2024, 2, 25)), ("the past weekend", sunday, sunday),
        ("the tuesday two weeks ago", leap, day(2024, 2, 13)), ("3 days ago", leap, day(2024, 2, 27)), ("a month ago", leap, day(2024, 1, 31)), ("two-week ago", leap, day(2024, 2, 16)), ("2.5 weeks ago, last year", leap, day(2023, 3, 2)), ("many years ago", leap, None), ("9999 days ago", leap, None),
        ("last friday", leap, day(2024, 2, 23)), ("last monday", leap, day(2024, 2, 26)), ("last month", leap, day(2024, 1, 31)), ("no date here", leap, None),
    ]
    rows = spark.createDataFrame([(s, (d - day(1970, 1, 1)).days) for s, d, _ in cases], "s string, d int")
    got = [r[0] for r in rows.select(x.resolved_day(F.col("s"), F.col("d"))).collect()]
    assert [g if g is None else day(1970, 1, 1) + dt.timedelta(days=g) for g in got] == [w for _, _, w in cases]


def test_the_whole_plan_has_semantic_duplicates(spark):
    d = "/root/testdata/sf0.001"
    plan = {r["memory_id"]: (r["reason"], r["keeper"]) for r in registry.QUERIES["consolidate_all"](spark, d).collect()}
    alike = {r["memory_id"]: r["keeper"] for r in registry.QUERIES["dup_clusters"](spark, d).collect() if r["memory_id"] != r["keeper"]}
    assert alike and all(m in plan for m in alike)
    assert {m: k for m, (reason, k) in plan.items() if reason == "semantic"} == {m: k for m, k in alike.items() if plan[m][0] == "semantic"}


def test_containment_is_plain_contains(spark):
    rnd = random.Random(4)
    vocab = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ra", "tu", "ne", "so") for c in ("", "n", "lis", "mentarium", "ologically")]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(6, 40))) for _ in range(60)]
    for t in list(texts):
        i = rnd.randrange(len(t) - 24)
        texts.append(t[i : i + rnd.randint(20, 60)])  # begins and ends inside words
    texts += ["user lives in oslo norway", "we know user lives in oslo norway, and more", "electroencephalography", "an electroencephalography-based test", "pre-electroencephalographys", "kamelosonologically", "ra" * 10, "xx " + "ra" * 12, "two longerwords12", "and two longerwords1234 here", texts[0], texts[0].upper(), "  " + texts[1], "short one"]
    rows = [(f"m{i:03}", "ab"[i % 2] if i < 100 else "a", x) for i, x in enumerate(texts)]
    got = [tuple(r) for r in dedup.containment_pairs(spark.createDataFrame(rows, "memory_id string, category string, content string")).collect()]
    flat = [(i, c, " ".join(x.lower().split())) for i, c, x in rows if len(" ".join(x.lower().split())) >= 20]
    first = {}
    for i, c, x in flat:
        first.setdefault((c, x), i)
    want = {(i, first[c, x]) for i, c, x in flat if first[c, x] != i}
    want |= {(i, j) for (c, x), i in first.items() for (k, y), j in first.items() if c == k and len(x) < len(y) and x in y}
    assert set(got) == want and len(got) == len(want) >= 60


def test_seed_stars_follow_the_sequential_rule(spark):
    rng = np.random.default_rng(2)
    n, dim = 90, 6
    v = rng.normal(size=(n, dim))
    rows = [(f"m{i:02}", "c" if i % 3 else "d", None, None, int(rng.integers(0, 40)), [float(x) for x in v[i]]) for i in range(n)]
    facts = spark.createDataFrame(rows, "memory_id string, category string, user_scope string, project_id string, created_at long, embedding array<double>")
    got = {r["memory_id"]: r["seed"] for r in dedup.seed_stars(facts, 0.5, 3).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want, order = {}, sorted(range(n), key=lambda i: (rows[i][4], rows[i][0]), reverse=True)
    for i in order:
        if rows[i][0] in want:
            continue
        want[rows[i][0]] = rows[i][0]
        near = [j for j in range(n) if rows[j][0] not in want and rows[j][1] == rows[i][1] and u[i] @ u[j] >= 0.5]
        near.sort(key=lambda j: (round(u[i] @ u[j], 9), rows[j][4], rows[j][0]), reverse=True)
        want.update({rows[j][0]: rows[i][0] for j in near[:3]})
    assert got == want


def test_antiparallel_edges_keep_their_evidence(spark):
    e = spark.createDataFrame([("a", "knows", "b", "m1"), ("b", "knows", "a", "m2"), ("b", "knows", "c", "m3")], "src string, relation string, dst string, memory_id string")
    got = graph.traverse(graph.merge_evidence(e), spark.createDataFrame([(1, "a")], "query_id long, node string"), 2, ["knows"]).collect()
    assert {r["memory_id"]: r["score"] for r in got} == {"m1": 3, "m2": 3, "m3": 1}


def test_deleting_a_head_and_its_predecessors_reopens_the_last_that_stays(spark):
    rows = [(f"{c}{i}", "active", 10 * i if i < 4 else None, f"{c}{i + 1}" if i < 4 else None) for c in "pqr" for i in range(1, 5)]
    facts = spark.createDataFrame(rows, "memory_id string, status string, valid_to long, superseded_by string")
    gone = spark.createDataFrame([("p4",), ("p3",), ("q2",), ("q4",), ("r1",), ("r2",), ("r3",), ("r4",)], "memory_id string")
    got = {r["memory_id"]: (r["status"], r["valid_to"], r["superseded_by"]) for r in chains.apply_deletes(facts, gone).collect()}
    assert got["p2"] == ("active", None, None) and got["p3"][0] == "quarantined" and "p4" not in got and got["p1"] == ("active", 10, "p2")
    assert got["q3"] == ("active", None, None) and got["q2"] == ("quarantined", 20, "q3") and got["q1"] == ("active", 10, "q2")
    assert {m: s[0] for m, s in got.items() if m[0] == "r"} == {"r1": "quarantined", "r2": "quarantined", "r3": "quarantined"}


def test_places_come_from_ranges(spark):
    got = iterate.numbered(spark.range(1000).withColumn("k", F.col("id") * 7919 % 1000), "place", F.desc("k")).collect()
    assert {r["k"]: r["place"] for r in got} == {k: 1000 - k for k in range(1000)}


def test_neighbourhood_goes_over_every_relation(spark, monkeypatch):
    ends = [("nation:a", "based_in", "region:ASIA"), ("region:ASIA", "works_with", "customer:1"), ("customer:1", "works_with", "customer:2"), ("customer:2", "works_with", "customer:3"), ("nation:a", "works_with", "region:EUROPE"), ("supplier:1", "lives_in", "nation:a")]
    edges = spark.createDataFrame([(*e, f"m{i}") for i, e in enumerate(ends)], "src string, relation string, dst string, memory_id string")
    monkeypatch.setattr(tables, "edges", lambda *_: edges)
    near = {}
    for seed in ("region:AFRICA", "region:AMERICA", "region:ASIA", "region:EUROPE", "region:MIDDLE EAST"):
        at = {seed: 0}
        for hop in (1, 2):
            at.update({y: hop for a, _, b in ends for x, y in ((a, b), (b, a)) if at.get(x) == hop - 1 and y not in at})
        near |= {(seed, node): k for node, k in at.items()}
    got = registry.QUERIES["neighbourhood"](spark, "/root/testdata/sf0.001").collect()
    assert {(r["seed"], r["node"]): r["distance"] for r in got} == near and len(got) == len(near)


def test_top_k_in_blocks_and_from_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 32))
    v = centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 32))
    facts = spark.createDataFrame([(f"m{i:04}", [float(x) for x in v[i]]) for i in range(3000)], "memory_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in v[i] + 0.1 * rng.normal(size=32)]) for i in range(0, 3000, 50)], "query_id long, query_vec array<double>")
    exact = {(r["query_id"], r["rank"]): r["memory_id"] for r in vectors.top_k(queries, facts, 10).collect()}
    monkeypatch.setattr(vectors, "BLOCK", 700)
    assert {(r["query_id"], r["rank"]): r["memory_id"] for r in vectors.top_k(queries, facts, 10, max_sent=5).collect()} == exact
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    q = np.array([r["query_vec"] for r in queries.orderBy("query_id").collect()])
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    best = np.argsort(-(q @ u.T), axis=1)[:, :10]
    assert {(50 * i, j + 1): f"m{best[i, j]:04}" for i in range(60) for j in range(10)} == exact
    recall = [r["recall"] for r in evaluate.lsh_recall(queries, facts, 10).collect()]
    assert len(recall) == 60 and np.mean(recall) >= 0.9


def test_containing_terms_is_plain_contains(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 9))) for _ in range(80)]
    terms = ["a", "ab", "b c", "abc", "aab ", "", "zz", "cccc"]
    got = {tuple(r) for r in ranking.contained_terms(spark.createDataFrame([(x,) for x in terms], "term string"), spark.createDataFrame([(x,) for x in texts], "text string")).collect()}
    assert got == {(a, b) for a in terms if a for b in texts if a in b}
