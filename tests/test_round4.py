"""Findings of round 3: rules in one pass over a text, facts made once, streams over tables that are folders."""

from __future__ import annotations

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from memspark.functions import text as x
from memspark.plans import rules
from memspark.streaming import jobs

TEXTS = [
    "", "what earlier", "what is earlier", "was it after", "was after. before", "who later", "between may and june", "you said", "the person", "a person", "on 2024-01-02", "a12/3/99b", "said", "unsaid", "a link, links and links",
    "how do you and how does", "what is first", "what has changed in peru", "my chat, this chat", "we asked you", "mail a.b@c.de", "x@", "082 555 1234", "1082 555 1234", "it ends (", "when", "whenever", None,
]


@pytest.mark.parametrize("pattern", [*x.FLAGS.values(), *(p for _, p in x.TEMPORAL), *x.IDENTIFIERS.values(), x.CHANGE, x.QUESTION, x.REFERENTIAL, x.TOPIC[1], x.YOU_SAID[1], rules.SENSITIVE])
def test_one_pass_finds_what_the_pattern_says(spark, pattern):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, low string")
    got = [r["f"] for r in df.select("i", x.found(F.col("low"), pattern).alias("f")).orderBy("i").collect()]
    duck = duckdb.connect()
    assert got == [duck.execute("select regexp_matches(?, ?)", [t, pattern]).fetchone()[0] for t in TEXTS]


def test_long_texts_take_one_pass(spark):
    # every "was " began a search to the end of the text
    df = spark.createDataFrame([("it was what was " * 8000,)], "low string").repartition(1)
    df.select(x.temporal_score(F.lit("a"))).collect()
    began = time.time()
    assert df.select(x.temporal_score(F.col("low")).alias("s")).collect()[0]["s"] == 0.0
    assert time.time() - began < 10


def test_facts_are_made_once(spark):
    plan = rules.extract_turns(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # a rule stands in the filter and the rows of one generator, not in each use of its fact
    assert plan.count("(?:attended|finished|met|visited)") <= 8


@pytest.mark.parametrize("name", ["stream_dedup", "stream_extract", "stream_heads"])
def test_streams_read_tables_that_are_folders(spark, tmp_path, name):
    from __spark_entry__ import oracle_sql, queries

    duck = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
        duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = queries()[name](spark, f"file://{tmp_path}"), duck.sql(oracle_sql()[name])
    order = sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(repr, want.project(", ".join(f'"{c}"' for c in order)).fetchall()))


def test_a_text_comes_once_however_late(spark, tmp_path):
    for i, conv in enumerate((0, 5000, 1, 9000)):
        spark.createDataFrame([(conv, 0, "user", "the same"), (conv, 1, "user", f"own {i}"), (conv, 2, "user", None)], jobs.TURNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/conversations.parquet")
    turns = jobs.stream(spark, f"file://{tmp_path}", "conversations", jobs.TURNS, files=1)
    rows = [r["text"] for r in jobs.drain(spark, jobs.distinct_texts(turns), "append").collect()]
    assert len(rows) == 6 and set(rows) == {None, "the same", "own 0", "own 1", "own 2", "own 3"}


def test_relations_are_bound(spark):
    from memspark.plans import lifecycle

    plan = lifecycle.stage_diff(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # both stages are read from written tables
    assert "(?:attended|visited)" not in plan
