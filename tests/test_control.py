"""The run gate and its control table: two runs at once, failed runs, cooldown, novelty and limits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from memspark.operators import control

NOW = 10_000_000


def facts(spark, n=150):
    rows = [("goal", f"g{i:03}", 1000 + i) for i in range(n)] + [("event", f"e{i:03}", 1000 + i) for i in range(5)] + [(None, f"n{i:03}", 1000 + i % 3) for i in range(30)]
    return spark.createDataFrame(rows, "category string, memory_id string, created_at long")


def test_two_runs_at_once(spark, tmp_path):
    table, rows = control.ControlTable(spark, f"file://{tmp_path}/c"), facts(spark)
    calls = lambda taken: taken.groupBy(F.col("category").alias("scope")).agg(F.lit(1).alias("calls"))
    inner = []
    fast = lambda taken, budget: (taken, calls(taken))

    def slow(taken, budget):
        # while this run works, another one starts from the same version and ends first
        inner.append(control.run(table, rows, NOW, fast, F.col("memory_id"), 5).count())
        return fast(taken, budget)

    with pytest.raises(control.Busy):
        control.run(table, rows, NOW, slow, F.col("memory_id"), 5)
    assert inner == [130] and table.version() == 1
    state = {r["scope"]: (r["last_run"], r["watermark"]) for r in table.read().collect()}
    assert state == {"goal": (NOW, 1099), None: (NOW, 1002)}
    # within a day nothing runs; later on only what is new does
    assert control.run(table, rows, NOW + 3600, fast, F.col("memory_id"), 5) is None
    assert control.run(table, rows, NOW + 90_000, fast, F.col("memory_id"), 5).count() == 50
    assert {r["scope"]: r["watermark"] for r in table.read().collect()} == {"goal": 1149, None: 1002} and table.version() == 2
    assert control.run(table, rows, NOW + 900_000, fast, F.col("memory_id"), 5) is None


def test_a_failed_run_leaves_the_watermark(spark, tmp_path):
    table, rows = control.ControlTable(spark, f"file://{tmp_path}/c"), facts(spark)

    def dies(taken, budget):
        raise ValueError("no answer")

    with pytest.raises(ValueError, match="no answer"):
        control.run(table, rows, NOW, dies, F.col("memory_id"), 5)
    assert table.version() == 0 and table.read().count() == 0

    def half(taken, budget):
        # calls for one scope succeed, for the other all fail
        return taken, spark.createDataFrame([("goal", 2), (None, 0)], "scope string, calls long")

    control.run(table, rows, NOW, half, F.col("memory_id"), 5)
    assert [(r["scope"], r["watermark"], r["calls"]) for r in table.read().collect()] == [("goal", 1099, 2)]
    due = {r["scope"]: (r["n_new"], r["reason"]) for r in control.gate(rows, table.read(), NOW + 1).collect()}
    assert due == {"goal": (50, "cooldown"), "event": (5, "novelty"), None: (30, "due")}


def test_gate_of_nothing(spark):
    none = facts(spark).limit(0)
    assert control.gate(none, spark.createDataFrame([], control.STATE), NOW).collect() == []
