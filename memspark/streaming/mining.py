"""Turns mined into the proposal queue, and maintenance at the end of sessions, as batches of a ledger."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as x
from memspark.operators.iterate import materialize
from memspark.operators.proposals import new_candidates

from .ledger import Ledger, Outputs

QUEUE = "candidate_id string, category string, content string, user_scope string, turn_id long"


def mined(turns: DataFrame) -> DataFrame:
    """Facts that turns (turn_id, user_scope, content) state, worded for the queue; junk is dropped."""
    s = turns.select("turn_id", "user_scope", F.posexplode(x.sentences(F.col("content"))).alias("pos", "s")).select("turn_id", "user_scope", "pos", F.inline(x.facts(F.lower("s"))))
    s = s.select("turn_id", "user_scope", "pos", "category", x.worded(F.col("rule"), F.col("detail")).alias("content"))
    name = F.concat(F.lit("cand-"), F.lpad(F.col("turn_id").cast("string"), 12, "0"), F.lit("-"), F.lpad(F.col("pos").cast("string"), 3, "0"))
    return s.select("*", F.inline(x.kept(F.col("content"), F.col("category")))).select(name.alias("candidate_id"), "category", "content", "user_scope", "turn_id")


def junk(facts: DataFrame) -> DataFrame:
    """Facts (category, content, ...) with a flag that excludes them."""
    # the array binds the text as the rules read it, which a filter would make anew for each of them
    return facts.filter(F.exists(F.array(x.low()), x.hard))


def queueing(decided: Callable[[], DataFrame] | None = None) -> Outputs:
    """Outputs of a batch of turns: ``queue``, its candidates that are not pending yet, one of each.

    Pending is what earlier batches queued, less what ``decided`` (candidate_id) says by now; what has been decided may
    be queued again.
    """

    def outputs(turns: DataFrame, batch: int, ledger: Ledger) -> list[tuple[str, DataFrame]]:
        rows = materialize(mined(turns))
        pending = ledger.table("queue", QUEUE, before=batch)
        if decided:
            pending = pending.join(decided().select("candidate_id"), "candidate_id", "left_anti")
        fresh = new_candidates(rows, pending).select("candidate_id")
        return [("queue", rows.join(fresh, "candidate_id", "left_semi"))]

    return outputs


def maintenance(steps: dict[str, Callable[[Any], DataFrame]], prepare: Callable[[DataFrame], Any] = lambda closed: closed) -> Outputs:
    """Outputs of a batch of closed sessions: ``closings``, and what each step makes of them; nothing runs where none closed.

    ``prepare`` is called once a batch; steps get what it returns.
    """

    def outputs(closed: DataFrame, batch: int, ledger: Ledger) -> list[tuple[str, DataFrame]]:
        closed = materialize(closed)
        if closed.isEmpty():
            return []
        ready = prepare(closed)
        return [("closings", closed), *((name, step(ready)) for name, step in steps.items())]

    return outputs
