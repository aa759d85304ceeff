"""The run gate: when a background job is due, and a control table that two runs can't both move on.

Fixed values of the gate: a day between runs, twenty new facts, a hundred facts a run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COOLDOWN, LEAST_NEW, MOST = 86400, 20, 100
STATE = "scope string, last_run long, watermark long, calls long"


class Busy(RuntimeError):
    """Another run has moved the table on."""


class ControlTable:
    """Versions of the state (scope, last_run, watermark, calls) below a folder of the shared store.

    A version is written under a name of its own and holds from the moment its number is claimed, by creating a file
    that must not exist: one of several runs that start from one version gets the next number, the others get ``Busy``.
    The claim is as atomic as the file system's exclusive creation.  A run that dies before it claims leaves no trace.
    """

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.at).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the version that holds, 0 before the first."""
        claims = self._path(f"{self.at}/claims")
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(claims)), default=0) if self._fs.exists(claims) else 0

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], STATE)
        claim = self._fs.open(self._path(f"{self.at}/claims/{version}"))
        try:
            name = claim.readUTF()
        finally:
            claim.close()
        return self.spark.read.schema(STATE).parquet(f"{self.at}/{name}")

    def compare_and_set(self, seen: int, state: DataFrame) -> int:
        """Makes ``state`` the version after ``seen``; ``Busy`` if there is one already."""
        if self.version() != seen:
            raise Busy(f"version {seen} has been followed")
        name = f"state-{uuid.uuid4().hex}"
        state.select("scope", "last_run", "watermark", "calls").write.parquet(f"{self.at}/{name}")
        try:
            claim = self._fs.create(self._path(f"{self.at}/claims/{seen + 1}"), False)
        except Exception as error:
            raise Busy(f"version {seen} has been followed") from error
        claim.writeUTF(name)
        claim.close()
        return seen + 1


def gate(facts: DataFrame, state: DataFrame, now: int, scope: str = "category", cooldown: int = COOLDOWN, least: int = LEAST_NEW) -> DataFrame:
    """(scope, n_new, last_run, watermark, reason) for every scope of facts (scope column, created_at): ``due``, ``cooldown``
    or ``novelty``.  New is what was created after the scope's watermark; without one, everything is."""
    s = state.select(F.col("scope").alias("_s"), "last_run", "watermark")
    f = facts.select(F.col(scope).alias("scope"), "created_at").join(s, F.col("scope").eqNullSafe(F.col("_s")), "left")
    new = F.count_if(F.col("watermark").isNull() | (F.col("created_at") > F.col("watermark")))
    out = f.groupBy("scope").agg(new.alias("n_new"), F.first("last_run").alias("last_run"), F.first("watermark").alias("watermark"))
    reason = F.when(F.lit(now) - F.col("last_run") < cooldown, "cooldown").when(F.col("n_new") < least, "novelty").otherwise("due")
    return out.select("scope", "n_new", "last_run", "watermark", reason.alias("reason"))


def batch(facts: DataFrame, due: DataFrame, order: Column, scope: str = "category", most: int = MOST) -> DataFrame:
    """The facts a run takes: of each due scope the ``most`` oldest after its watermark, by created_at and ``order``."""
    d = due.filter("reason = 'due'").select(F.col("scope").alias("_s"), "watermark")
    f = facts.join(d, F.col(scope).eqNullSafe(F.col("_s"))).filter("watermark is null or created_at > watermark")
    w = Window.partitionBy("_s").orderBy("created_at", order)
    return f.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n", "_s", "watermark")


def completed(state: DataFrame, taken: DataFrame, now: int, calls: DataFrame, scope: str = "category") -> DataFrame:
    """The state after a run over ``taken``: of scopes with a successful call (scope, calls) the watermark moves to the
    newest fact taken, the run's time and calls are kept; others stay as they were, so their facts come again."""
    done = taken.groupBy(F.col(scope).alias("_s")).agg(F.max("created_at").alias("new_mark"))
    done = done.join(calls.filter("calls > 0").select(F.col("scope").alias("_c"), F.col("calls").alias("used")), F.col("_s").eqNullSafe(F.col("_c"))).select("_s", "new_mark", "used")
    both = state.join(done, F.col("scope").eqNullSafe(F.col("_s")), "full_outer")
    ran = F.col("new_mark").isNotNull()
    return both.select(
        F.coalesce("scope", "_s").alias("scope"), F.when(ran, F.lit(now)).otherwise(F.col("last_run")).cast("long").alias("last_run"),
        F.when(ran, F.greatest("new_mark", "watermark")).otherwise(F.col("watermark")).cast("long").alias("watermark"), F.when(ran, F.col("used")).otherwise(F.col("calls")).cast("long").alias("calls"),
    )


def run(table: ControlTable, facts: DataFrame, now: int, work, order: Column, budget: int, scope: str = "category") -> DataFrame | None:
    """One gated run: what is due is handed to ``work(taken, budget)``, which gives its result and calls (scope, calls);
    the state moves on only then.  None where nothing is due; ``Busy`` where another run was faster, and its result counts."""
    seen = table.version()
    state = table.read(seen)
    taken = batch(facts, gate(facts, state, now, scope), order, scope)
    if taken.isEmpty():
        return None
    result, calls = work(taken, budget)
    table.compare_and_set(seen, completed(state, taken, now, calls, scope))
    return result
