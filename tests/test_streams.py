"""Streaming jobs over several files, so that results are made of more than one batch."""

from __future__ import annotations

import datetime as dt

import pytest

from pyspark.sql import functions as F

from memspark.streaming import jobs, ledger, mining

START = dt.datetime(2024, 1, 1)


def write(spark, path, batches):
    """One file a batch; the source takes files in the order of their times."""
    for i, rows in enumerate(batches):
        table = [(k, START + dt.timedelta(minutes=m), u, e, float(v), "") for k, m, u, e, v in rows]
        spark.createDataFrame(table, jobs.EVENTS).coalesce(1).write.parquet(f"{path}/b{i}/events.parquet")


def source(spark, path):
    return spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{path}")


def test_complete_and_update_give_the_last_state(spark, tmp_path):
    write(spark, tmp_path, [[(1, 0, 7, "view", 1), (2, 1, 7, "view", 2), (3, 2, 7, "view", 3)], [(4, 3, 7, "view", 4), (5, 4, 7, "view", 5), (6, 5, 8, "view", 9)]])
    rows = jobs.drain(spark, jobs.counters(source(spark, tmp_path)), "complete").collect()
    assert {(r["user_id"], r["n"], r["total"]) for r in rows} == {(7, 5, 15.0), (8, 1, 9.0)} and len(rows) == 2
    rows = jobs.drain(spark, jobs.latencies(source(spark, tmp_path), size=3, least=2), "update", ("user_id",)).collect()
    assert [(r["user_id"], r["p95_ms"]) for r in rows] == [(7, 4.0)]


def test_late_versions_close_under_the_head(spark, tmp_path):
    write(spark, tmp_path, [[(30, 30, 1, "v", 0), (10, 10, 1, "v", 0)], [(20, 20, 1, "v", 0)]])
    log = source(spark, tmp_path).select(F.col("user_id").alias("chain_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.concat(F.lit("m"), "event_id").alias("memory_id"))
    rows = jobs.drain(spark, jobs.chain_heads(log), "update", ("chain_id",)).collect()
    assert [(r["chain_id"], r["memory_id"], r["versions"]) for r in rows] == [(1, "m30", 3)]


def test_sessions_end_once_and_pending_goes_stale(spark, tmp_path):
    write(spark, tmp_path, [[(1, 0, 1, "click", 0), (2, 10, 1, "click", 0), (3, 0, 2, "click", 0), (4, 30, 2, "purchase", 0)], [(5, 300, 3, "click", 0)], [(6, 5000, 4, "click", 0)], [(7, 5001, 4, "click", 0)]])
    rows = jobs.drain(spark, jobs.closed_sessions(source(spark, tmp_path), "20 minutes", "0 minutes"), "append").collect()
    base = int(START.replace(tzinfo=dt.UTC).timestamp())
    assert sorted((r["user_id"], (r["began"] - base) // 60, r["n"]) for r in rows) == [(1, 0, 2), (2, 0, 1), (2, 30, 1), (3, 300, 1)]
    e = source(spark, tmp_path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "0 minutes")
    log = e.select(F.concat(F.lit("c"), "user_id").alias("candidate_id"), F.unix_timestamp("ts").alias("at"), F.when(F.col("event_type") == "click", "pending").otherwise("approved").alias("status"), "ts")
    rows = jobs.drain(spark, jobs.stale(log, 3600), "append").collect()
    assert sorted((r["candidate_id"], (r["since"] - base) // 60) for r in rows) == [("c1", 0), ("c3", 300)]


def turns(spark, path):
    schema = "turn_id long, user_scope string, content string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{path}")


def test_turns_are_queued_once_while_they_are_pending(spark, tmp_path):
    files = [
        [(5, "u1", "I live in Oslo. I hate rain and love the snow."), (6, "u2", "I live in Oslo.")],
        # the same again, and a late turn
        [(7, "u1", "I live in Oslo. Nothing to say."), (2, "u1", "I prefer the early morning market.")],
        [(8, "u1", "I live in Oslo."), (9, None, None)],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "turn_id long, user_scope string, content string").coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    at = f"file://{tmp_path}/store"
    queue = lambda done: {(r["turn_id"], r["user_scope"], r["content"]) for r in done.table("queue", mining.QUEUE).collect()}
    got = queue(ledger.drain(turns(spark, f"{tmp_path}/in"), at, mining.queueing()))
    homes = {(t, u) for t, u, c in got if "oslo" in c}
    assert homes == {(5, "u1"), (6, "u2")} and any(t == 2 for t, _, _ in got)
    # nothing new: nothing changes; once decided, a text may be queued again
    assert queue(ledger.drain(turns(spark, f"{tmp_path}/in"), at, mining.queueing())) == got
    spark.createDataFrame([(12, "u1", "I live in Oslo."), (13, "u2", "I live in Oslo.")], "turn_id long, user_scope string, content string").coalesce(1).write.parquet(f"{tmp_path}/in/b9")
    decided = lambda: spark.createDataFrame([("cand-000000000005-000",)], "candidate_id string")
    assert queue(ledger.drain(turns(spark, f"{tmp_path}/in"), at, mining.queueing(decided))) - got == {(12, "u1", next(c for t, _, c in got if t == 5 and "oslo" in c))}


def test_a_killed_batch_is_done_again_and_a_done_one_never(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [[(1, 0, 1, "click", 0), (2, 10, 1, "click", 0)], [(3, 300, 2, "click", 0)], [(4, 900, 3, "click", 0)]])
    at, runs = f"file://{tmp_path}/store", []

    def step(fail):
        def make(closed):
            runs.append("step")
            if fail:
                raise RuntimeError("killed between outputs")
            return closed.select(F.col("user_id").cast("string").alias("id"), F.lit("x").alias("detail"))

        return make

    closed = lambda: jobs.closed_sessions(source(spark, f"{tmp_path}/in"), "20 minutes", "0 minutes")
    first = lambda rows: rows.select(F.col("user_id").cast("string").alias("id"), F.lit("y").alias("detail"))
    with pytest.raises(Exception, match="killed between outputs"):
        ledger.drain(closed(), at, mining.maintenance({"first": first, "second": step(True)}))
    assert ledger.Ledger(spark, at).table("first", "id string, detail string").count() == 0
    done = ledger.drain(closed(), at, mining.maintenance({"first": first, "second": step(False)}))
    tables = lambda: [sorted(r["id"] for r in done.table(n, "id string, detail string").collect()) for n in ("first", "second")]
    assert tables() == [["1", "2"], ["1", "2"]]
    # a batch that comes once more, with other rows even, changes nothing
    n, many = done.last(), len(runs)
    other = spark.createDataFrame([(99, 0, 0, 1)], "user_id long, began long, ended long, n long")
    assert not any(done.run(other, k, mining.maintenance({"first": first, "second": step(False)})) for k in range(n + 1))
    assert tables() == [["1", "2"], ["1", "2"]] and len(runs) == many
