"""Findings of round 3, second part: keys of texts that hold each other, and steps whose cost grows with the input only."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memspark.functions import grams
from memspark.operators import dedup, ranking


@pytest.mark.parametrize("least", [1, 2, 5, 20, 21])
def test_a_text_has_the_keys_of_its_parts(least):
    rng = random.Random(least)
    for _ in range(60):
        outer = "".join(rng.choice("ab é一") for _ in range(rng.randrange(least, 40 * least)))
        at = rng.randrange(len(outer) - least + 1)
        inner = outer[at : at + rng.choice([least, rng.randrange(least, len(outer) - at + 1)])]
        # texts before and after must not matter
        texts, salts = pa.array(["x" * 30, inner, "y", inner]), np.array([1, 5, 1, 6], np.uint64)
        own = [(i, k) for ids, key in grams.keys(texts, salts, least, True) for i, k in zip(ids.tolist(), key.tolist(), strict=True)]
        mine, other = {k for i, k in own if i == 1}, {k for i, k in own if i == 3}
        every = {k for ids, key in grams.keys(pa.array(["", outer, "z" * 50]), np.array([5, 5, 5], np.uint64), least, False) for i, k in zip(ids.tolist(), key.tolist(), strict=True) if i == 1}
        assert mine and mine <= every and not other & every


def test_pairs_are_those_of_all_pairs(spark):
    rng, words = random.Random(3), ["that", "of", "ontion", "thereof", "and", "heathen", "x", "a" * 30, "é" * 12]
    rows = [(f"t{i:03d}", rng.choice(["a", "b", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    # parts that begin and end inside words, of every length
    for i, (_, category, text) in enumerate(rows[:100]):
        at = rng.randrange(len(text))
        rows.append((f"p{i:03d}", category, text[at : at + rng.randrange(15, 400)].replace(" ", rng.choice([" ", "  ", "\n", " \t"])) + rng.choice(["", " ", "\n"])))
    rows += [("c1", "a", rows[0][2]), ("n1", "a", None), ("n2", None, "")]
    got = [tuple(r) for r in dedup.containment_pairs(spark.createDataFrame(rows, "id string, category string, content string").withColumnRenamed("id", "memory_id")).collect()]
    flat = {i: (c or "", " ".join(t.lower().replace("\t", " ").split())) for i, c, t in rows if t is not None}
    flat = {i: x for i, x in flat.items() if len(x[1]) >= 20}
    kind = {i: c for i, c, _ in rows}
    first = {}
    for i in sorted(flat):
        first.setdefault((kind[i], flat[i][1]), i)
    want = [(i, first[kind[i], x[1]]) for i, x in flat.items() if first[kind[i], x[1]] != i]
    heads = set(first.values())
    want += [(a, b) for a in heads for b in heads if flat[a][0] == flat[b][0] and len(flat[a][1]) < len(flat[b][1]) and flat[a][1] in flat[b][1]]
    assert sorted(got) == sorted(want) and len(got) > 100


def test_common_words_bring_no_pairs(spark, monkeypatch):
    # four words around two that every text has: an inner word led from each short text to each long one
    short = spark.range(400).select(F.concat(F.lit("s"), "id").alias("memory_id"), F.lit("c").alias("category"), F.concat(F.lit("w"), F.sha2(F.col("id").cast("string"), 224), F.lit(" likewise of the "), F.lit("q"), "id").alias("content"))
    long = spark.range(400).select(F.concat(F.lit("l"), "id").alias("memory_id"), F.lit("c").alias("category"), F.concat(F.lit("so "), F.sha2(F.concat(F.lit("l"), "id"), 256), F.lit(" likewise of the rest "), F.sha2(F.concat(F.lit("m"), "id"), 256)).alias("content"))
    rows, plain = [], dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda df: (made := plain(df), rows.append((made.columns, made.count())))[0])
    assert dedup.containment_pairs(short.unionByName(long)).count() == 0
    assert [n for columns, n in rows if columns == ["short_id", "long_id"]] == [0, 0]


def test_best_by_words_is_the_first_of_all(spark, monkeypatch):
    rng, words = random.Random(5), ["file:", "the", "there", "other", "and", "sand", "zebra", "of", "on", "quill", "qui"]
    facts = spark.createDataFrame([(f"m{i}", " ".join(rng.choices(words[1:], k=rng.randrange(1, 5)))) for i in range(60)] + [("m99", None)], "memory_id string, content string")
    asked = [(i, " ".join(rng.choices(words + ["nowhere", "the"], k=rng.randrange(0, 7)))) for i in range(150)] + [(998, None), (999, "the the the the")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    for least in (0.1, 0.5, 1.0):
        want = ranking.ranked(ranking.keyword_scores(queries, facts), 1).filter(F.col("score") >= least)
        got = ranking.keyword_best(queries, facts, least)
        assert sorted(map(tuple, got.select("query_id", "memory_id", "score").collect())) == sorted(map(tuple, want.select("query_id", "memory_id", "score").collect()))


def test_equal_queries_look_at_facts_once(spark, monkeypatch):
    # 300 queries with common words and 300 facts: not their product
    facts = spark.range(300).select(F.concat(F.lit("m"), "id").alias("memory_id"), F.concat(F.lit("the other sand "), "id").alias("content"))
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.concat(F.lit("other sand absent"), "id").alias("query"))
    rows, plain = [], ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df: (made := plain(df), rows.append(made.count()))[0])
    assert ranking.keyword_best(queries, facts, 0.5).count() == 300
    assert max(rows) < 5000


def test_revived_edges_and_facts_are_told_once(spark):
    from memspark.operators import graph
    from memspark.plans import lifecycle

    e = spark.createDataFrame([("a", "r", "b", "m1"), ("a", "r", "b", "m2"), ("a", "r", "c", "m1"), ("a", "r", "d", "m2"), ("a", "r", "d", "m2"), ("x", "r", "y", "m9")], "src string, relation string, dst string, memory_id string")
    ids = lambda *m: spark.createDataFrame([(i,) for i in m], "memory_id string")
    got = {r["dst"]: r["status"] for r in graph.revived(e, ids("m1", "m2", "m3"), ids("m2", "m3")).collect()}
    assert got == {"b": "active", "c": "quarantined", "d": "active", "y": "active"}
    # the edges are joined from the tables once, and no list of evidence is made
    plan = lifecycle.graph_reactivate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_suppkey") <= 12 and "collect_set" not in plan


def test_maintenance_prepares_once_a_batch(spark, tmp_path):
    from memspark.streaming import ledger, mining

    calls = []
    steps = {n: lambda ready: ready[1] for n in ("one", "two", "three")}
    outputs = mining.maintenance(steps, lambda closed: (calls.append(1), closed))
    book = ledger.Ledger(spark, f"file://{tmp_path}/book")
    assert book.run(spark.createDataFrame([(1,), (2,)], "user_id long"), 0, outputs) and len(calls) == 1
    assert [book.table(n, "user_id long").count() for n in steps] == [2, 2, 2]
    assert book.run(spark.createDataFrame([], "user_id long"), 1, outputs) and len(calls) == 1


def test_hard_flags_run_no_other_rule(spark):
    from memspark.functions import text as x
    from memspark.plans import rules

    texts = ["", "you there", "and so on", "the user is a bot", "it ends (", "they said what?", "i told you \t so", "current chat", "a\x0b\x0b b\r\n c ", None]
    df = spark.createDataFrame([(t, "event") for t in texts], "content string, category string").withColumn("low", x.low())
    rows = df.select("content", "low", x.flags(F.col("low"), F.col("category")).alias("f"), x.flags(F.col("low"), among=x.HARD).alias("h")).collect()
    assert all(r["h"] == [n for n in r["f"] if n in x.HARD] for r in rows)
    assert [r["low"] for r in rows][-3:] == ["current chat", "a b c", None]
    plan = rules.hard_flags(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "second_person" not in plan and "question" not in plan
