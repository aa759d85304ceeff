"""Bounded traversal against walking the graph by hand, hubs included."""

from __future__ import annotations

import collections
import random

from memspark.operators import graph


def by_hand(edges, start, depth, most, visited):
    out = collections.Counter()
    typed = {e for e in edges if e[1] == "r"}
    ways = {(s, r, d) for s, r, d, _ in typed}
    for q in {q for q, _ in start}:
        front = sorted({n for p, n in start if p == q})[: min(most, visited)]
        seen = set(front)
        for hop in range(1, depth + 1):
            # an edge between two nodes of the frontier is met from both ends
            met = [(e, to) for n in front for e in ways for a, to in ((e[0], e[2]), (e[2], e[0])) if a == n]
            for e in {e for e, _ in met}:
                for s, r, d, m in typed:
                    if (s, r, d) == e:
                        out[q, m] += 2 if hop == 1 else 1
            count = collections.Counter(to for _, to in met if to not in seen)
            front = sorted(count, key=lambda n: (-count[n], n))[: max(0, min(most, visited - len(seen)))]
            seen |= set(front)
    return out


def test_bounded_traversal(spark):
    r = random.Random(2)
    nodes = [f"n{i:02}" for i in range(40)]
    edges = [("hub", "r", n, f"m{r.randrange(30)}") for n in nodes] + [(r.choice(nodes), r.choice("rrx"), r.choice(nodes), f"m{r.randrange(30)}") for _ in range(120)]
    edges = [e for e in edges if e[0] != e[2]] * 2
    start = [(1, "hub"), (2, "n03"), (2, "n07"), (3, "n01"), (3, "nowhere")] + [(4, n) for n in nodes[:12]]
    e = spark.createDataFrame(edges, "src string, relation string, dst string, memory_id string")
    for most, visited in ((40, 200), (5, 200), (5, 8), (6, 6)):
        got = {(x["query_id"], x["memory_id"]): x["score"] for x in graph.bounded_traverse(e, spark.createDataFrame(start, "query_id long, node string"), 3, ["r"], most, visited).collect()}
        assert got == by_hand(set(edges), start, 3, most, visited)


def test_broad_queries_have_no_seeds(spark):
    types = spark.createDataFrame([("person:Ann Lee", "person"), ("person:Joanna", "person"), ("concept:planning", "concept"), ("person:user", "person")], "node string, type string")
    terms = spark.createDataFrame([(1, "ann"), (2, "lee"), (2, "plan"), (3, "user"), (3, "ann")], "query_id long, term string")
    got = {tuple(x) for x in graph.seeds(terms, types, ["concept"], ["person:user"]).collect()}
    assert got == {(q, n) for q in (1, 3) for n in ("person:Ann Lee", "person:Joanna", "concept:planning")}
