"""Findings of round 4: the search for the best fact, maintenance at the end of sessions, and the whole difference of two stages."""

from __future__ import annotations

import itertools
import os
import random

import duckdb
from pyspark.sql import functions as F

from memspark import registry
from memspark.functions import text as x
from memspark.operators import ranking
from memspark.plans import lifecycle, streams
from memspark.sources import tables as t
from memspark.streaming import mining

SF = "/root/testdata/sf0.001"


def test_no_row_is_written_for_a_set_and_a_fact(spark, monkeypatch):
    """435 pairs of words that 300 facts all hold: what is written grows with their sum."""
    words = [f"word{i:02}" for i in range(30)]
    facts = spark.range(300).select(F.format_string("m%03d", "id").alias("memory_id"), F.lit(" ".join(words)).alias("content"))
    queries = spark.createDataFrame([(i, f"{a} {b} absent missing") for i, (a, b) in enumerate(itertools.combinations(words, 2))], "query_id long, query string")
    rows, plain = [], ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df: (made := plain(df), rows.append(made.count()))[0])
    assert {tuple(r)[1:] for r in ranking.keyword_best(queries, facts, 0.5).collect()} == {("m000", 0.5)}
    assert max(rows) < 5000


def test_best_fact_over_rounds_and_portions(spark, monkeypatch):
    """A better set whose fact comes late wins over a lesser one that is found in the first round."""
    for name, value in {"MAX_SENT_SETS": 7, "FIRST_FACTS": 2, "MORE_FACTS": 2}.items():
        monkeypatch.setattr(ranking, name, value)
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("sand", "stone", "the", "other") for b in ("", "s", "and", "pit")]
    facts = spark.createDataFrame([(f"m{i:02}", " ".join(rng.choices(words, k=rng.randrange(4)))) for i in range(40)] + [("m95", "one two six"), ("m96", "one two ten six")], "memory_id string, content string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices([*words, "nowhere"], k=4))) for i in range(40)] + [(98, "one two ten"), (99, "ten two two one")], "query_id long, query string")
    want = ranking.ranked(ranking.keyword_scores(queries, facts), 1).filter("score >= 0.5")
    got = {tuple(r) for r in ranking.keyword_best(queries, facts, 0.5).collect()}
    assert got == {tuple(r) for r in want.select("query_id", "memory_id", "score").collect()} and (98, "m96", 1.0) in got


def test_no_fact_and_no_query(spark):
    none = spark.createDataFrame([], "memory_id string, content string")
    one = spark.createDataFrame([(1, "one two three")], "query_id long, query string")
    assert ranking.keyword_best(one, none, 0.5).collect() == []
    assert ranking.keyword_best(one.limit(0), one.select(F.lit("m").alias("memory_id"), F.col("query").alias("content")), 0.5).collect() == []


def test_junk_binds_its_text(spark):
    """What rules read is made once a row, and a filter with it is not taken apart."""
    plan = mining.junk(t.mem(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_hard_is_any_hard_flag(spark):
    said = ["", "a", "and", "x (", "user is fine", "and so on", "he is (a) b", "the man said", "the manx said long", "i like to walk with", "i like to walk ,", "told you so now", "he's here", "hello my friend (", "(hello) my ) friend (", "it ) was ( in order"]
    said += ["i like it a lot and", "i like it a lotand", "user is busy.", "the user is an ai", "as an ai, i would", "has an ai, i would", "text long enough the\n", "text long enough to ", "my land is grand", "twenty letters without", "it'without", "a letter'with", "user has a red car"]
    rows = spark.createDataFrame([(s,) for s in said], "content string").unionByName(t.mem(spark, SF).select("content"))
    rows = rows.select("content", (F.size(x.flags(x.low(), among=x.HARD)) > 0).alias("want"), x.hard(x.low()).alias("got"))
    assert rows.filter("want <> got").collect() == [] and rows.filter("got").count() > 20


def test_no_session_is_late_for_its_file(spark, tmp_path):
    """More files of one month than are read at a time elsewhere, one user in the last alone: its sessions count as well."""
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.filter("user_id <> 3").repartition(17).write.parquet(f"{tmp_path}/events.parquet")
    e.filter("user_id = 3").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got, want = (sorted(map(tuple, streams.stream_maintenance(spark, at).collect())) for at in (str(tmp_path), SF))
    assert got == want and {r[0] for r in got} >= {"plan", "proposals"}


def test_stage_diff_is_whole(spark, tmp_path):
    """Every sentence of a long turn is read, a turn without a difference has its row, and what one stage alone found is told."""
    c = spark.createDataFrame([(1, "Bob" + ". This says nothing here" * 30, 3, "BUILDING"), (23, "Carl", 3, "BUILDING"), (22, "Dora", 3, "BUILDING")], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string")
    c.write.parquet(f"{tmp_path}/customer.parquet")
    os.symlink(f"{SF}/nation.parquet", tmp_path / "nation.parquet")
    got = lifecycle.stage_diff(spark, str(tmp_path))
    with duckdb.connect() as duck:
        for name, at in (("customer", "customer.parquet/*.parquet"), ("nation", "nation.parquet")):
            duck.execute(f"create view {name} as select * from '{tmp_path}/{at}'")
        want = duck.execute(registry.ORACLE_SQL["stage_diff"])
        names, rows = [d[0] for d in want.description], sorted(want.fetchall())
    assert got.columns == names and sorted(map(tuple, got.collect())) == rows
    turns = {r["turn_id"]: r for r in got.collect()}
    nation = spark.read.parquet(f"{SF}/nation.parquet").filter("n_nationkey = 3").first()["n_name"].lower()
    assert turns[1]["n_first"] == 2 and turns[1]["n_second"] == 2 and turns[1]["only_first"] == turns[1]["only_second"] == 0
    assert tuple(turns[23])[1:] == (1, 0, 1, 0, [f"pay {nation} early"], [])
    assert tuple(turns[22])[1:] == (0, 0, 0, 0, [], [])
