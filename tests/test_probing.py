"""Probes in turn against one pass over all rows, the hit rule, and verdicts between stored runs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from memspark.operators import probing


def test_turns_are_those_of_one_pass(spark):
    rnd = random.Random(3)
    asks = [[f"q{i}-{t}" if rnd.random() < 0.4 else None for t in range(6)] for i in range(90)] + [[None] * 6] * 5 + [["only", *[None] * 5]] * 5
    rows = spark.createDataFrame([(f"m{i:03}", a) for i, a in enumerate(asks)], "memory_id string, asks array<string>")
    want, state = {}, 0
    for i, a in enumerate(asks):
        for n in range(6):
            at = (state + n) % 6
            if a[at] is not None:
                want[f"m{i:03}"], state = (probing.TEMPLATES[at], a[at]), (at + 1) % 6
                break
    for block in (1, 7, 1000):
        got = probing.in_turn(rows, F.col("memory_id"), block=block)
        assert {r["memory_id"]: (r["template"], r["probe"]) for r in got.collect()} == want
    assert probing.in_turn(rows.limit(0), F.col("memory_id")).isEmpty()


def test_questions(spark):
    facts = [("user likes the red car, bought 3 days ago", "preference", ["a"]), ("my is it", "goal", []), (None, "goal", ["a"]), ("", "goal", None), ("x" * 40, None, None)]
    rows = spark.createDataFrame([(t, c, g, 1_700_000_000) for t, c, g in facts], "content string, category string, tags array<string>, created_at long")
    got = [r["asks"] for r in probing.questions(rows, {"car": "vehicle", "red": "scarlet"}).collect()]
    subject, rest = "red car bought days", "user likes the red car,"
    assert got[0] == [f"what is {subject} {rest}?", f"when did {subject} {rest}?", f"what does the user prefer about {subject}?", f"{subject} car?", f"who is NOT {subject}", "what is scarlet car bought days user likes the scarlet?"]
    assert got[1] == ["what is my is it my is it?", None, None, None, "who is NOT my is it", None]
    assert got[2] == got[3] == [None] * 6
    assert got[4] == [f"what is {'x' * 40} {'x' * 24}?", None, None, None, f"who is NOT {'x' * 40}", None]


def test_hits(spark):
    facts = [("a1", 1, "one two three four"), ("a2", 1, "other words"), ("b1", 2, "one two three"), ("c1", 3, "nothing like it"), ("d1", 4, None)]
    f = spark.createDataFrame(facts, "memory_id string, chain_id long, content string")
    e = spark.createDataFrame([(1, "a1"), (2, "a1"), (3, "a1"), (4, "d1"), (5, "zz")], "query_id long, memory_id string")
    h = spark.createDataFrame([(1, "c1", 0.9, 1), (1, "b1", 0.8, 2), (1, "a2", 0.7, 30), (2, "a2", 0.5, 3), (2, "a1", 0.4, 100), (4, "c1", 0.1, 1)], "query_id long, memory_id string, score double, rank int")
    got = {r["query_id"]: (r["rank"], r["wide_rank"], r["top_ids"]) for r in probing.run(e, f, h).collect()}
    assert got == {1: (2, 30, ["c1", "b1"]), 2: (3, 100, ["a2"]), 3: (None, None, []), 4: (None, None, ["c1"])}


def test_verdicts_between_stored_runs(spark, tmp_path):
    ledger = probing.RunLedger(spark, f"file://{tmp_path}/runs")
    about = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "query_id long, template string")

    def found(hits):
        rows = spark.createDataFrame([(i, 7 if i < hits else None) for i in range(100)], "query_id long, rank int")
        return probing.recalls(rows, about, ("template",))

    for name, config, hits in (("base", "c1", 50), ("small", "c1", 47), ("large", "c1", 46), ("other", "c2", 90)):
        ledger.record(name, config, found(hits))
    word = lambda run: ledger.verdict(run, "base").first()["verdict"]
    assert [word(r) for r in ("base", "small", "large", "other", "never")] == ["pass", "pass", "fail", "refused", "missing"]
    with pytest.raises(ValueError):
        ledger.record("base", "c1", found(10))
    assert {(r["k"], r["by"], r["value"]): (r["n"], r["recall"]) for r in ledger.read("base").filter("k = 20").collect()} == {(20, "all", ""): (100, 0.5), (20, "template", "a"): (50, 0.5), (20, "template", "b"): (50, 0.5)}
    # a run without its end is none
    ledger.read("base").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"file://{tmp_path}/runs/dead")
    assert word("dead") == "missing"
