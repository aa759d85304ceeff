"""The store's background work as Structured Streaming jobs over file streams.

Each job takes a streaming DataFrame and a folder for its checkpoint and result; ``run`` drains what is there
(``availableNow``) or keeps going with a processing-time trigger.  Results are written by ``foreachBatch`` or
a file sink into the shared folder, so nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memspark.functions import text as x
from memspark.operators.iterate import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
TURNS = "conv_id long, turn long, role string, text string"


def stream(spark: SparkSession, sf_dir: str, table: str, schema: str, files: int | None = 16) -> DataFrame:
    """A table's files as a stream, ``files`` at a time or all that are there; the table is one file or a folder of files."""
    # the source takes a folder or a pattern but no file: a pattern that fits just this name serves for both
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/[{table[0]}]{table[1:]}.parquet")


def drain(spark: SparkSession, df: DataFrame, mode: str, keys: tuple[str, ...] = (), at: str | None = None) -> DataFrame:
    """Run to the end of what is there; returns the result table.

    ``append``: every row; ``complete``: the last batch, which is the whole state; ``update``: each key's latest row.
    """
    at = at or shared_dir(spark, "stream")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    found = _batches(spark, at)
    if not found:
        return spark.createDataFrame([], df.schema)
    if mode == "complete":
        return spark.read.schema(df.schema).parquet(f"{at}/out/batch={found[-1]}")
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{at}/out")
    if mode == "append":
        return rows.drop("batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "batch").alias("row")).select("row.*")


def _batches(spark: SparkSession, at: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/out")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(path)) if files.exists(path) else []


def counters(events: DataFrame) -> DataFrame:
    """Counts by user and kind, kept up to date; a bounded state a key."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def distinct_texts(turns: DataFrame, at: str | None = None, within: str | None = None) -> DataFrame:
    """Each text once, whenever it comes; the state is a digest a text.  With ``at`` and ``within`` a text is let through
    once within the watermark's delay; after that its state goes, and it may be queued again."""
    if at is None:
        return turns.select("text", F.unhex(F.sha2("text", 256)).alias("digest")).dropDuplicates(["digest"]).select("text")
    return turns.withWatermark(at, within).dropDuplicatesWithinWatermark(["text"]).select("text")


def candidates(turns: DataFrame) -> DataFrame:
    """Finished user turns to flagged sentences, ready for the queue."""
    s = turns.filter("role = 'user'").select("conv_id", "turn", F.posexplode(x.sentences(F.col("text"))).alias("pos", "sentence"))
    return s.select(F.sha2(F.concat_ws("|", "conv_id", "turn", "pos"), 256).alias("candidate_id"), "conv_id", "turn", "sentence", x.flags(F.lower("sentence")).alias("flags"))


def latencies(events: DataFrame, size: int = 50, least: int = 5) -> DataFrame:
    """Each user's p95 over the newest ``size`` values; the state is those values with their times and nothing more."""

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = list(zip(*state.get, strict=True)) if state.exists else []
        new = [tuple(r) for b in rows for r in b[["at", "event_id", "value"]].itertuples(index=False)]
        held = sorted(old + new)[-size:]
        state.update(tuple(list(c) for c in zip(*held, strict=True)))
        if len(held) >= least:
            values = sorted(v for _, _, v in held)
            yield pd.DataFrame({"user_id": [key[0]], "p95_ms": [round(values[max(0, int(len(values) * 0.95) - 1)], 6)]})

    rows = events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, p95_ms double", "at array<long>, id array<long>, value array<double>", "update", GroupStateTimeout.NoTimeout)


def chain_heads(log: DataFrame) -> DataFrame:
    """The current version of each chain from a log of versions (chain_id, at, memory_id): the latest by its own time,
    whatever order the log arrives in; a version that comes late closes under the head that is already there."""
    newest = F.max_by(F.struct("memory_id", "at"), F.struct("at", "memory_id"))
    return log.groupBy("chain_id").agg(newest.alias("head"), F.count("*").alias("versions")).select("chain_id", "head.memory_id", "head.at", "versions")


def stale(changes: DataFrame, age: int) -> DataFrame:
    """(candidate_id, since, age): candidates still pending ``age`` seconds after they were queued.

    ``changes`` has candidate_id, at (seconds) and status, and a watermark on ``ts``.  A candidate's state is its
    queueing time; an event-time timer fires once the watermark has passed its age, a decision clears it.
    """

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since = state.get[0]
            state.remove()
            yield pd.DataFrame({"candidate_id": [key[0]], "since": [since], "age": [state.getCurrentWatermarkMs() // 1000 - since]})
            return
        new = pd.concat(list(rows))
        since = [state.get[0]] if state.exists else []
        decided = new.loc[new["status"] != "pending", "at"]
        if len(decided):
            # what was queued before the last decision is settled
            new, since = new[new["at"] > decided.max()], []
        since += new.loc[new["status"] == "pending", "at"].astype(int).tolist()
        if not since:
            if state.exists:
                state.remove()
            return
        since = min(since)
        if since + age <= state.getCurrentWatermarkMs() // 1000:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"candidate_id": [key[0]], "since": [since], "age": [state.getCurrentWatermarkMs() // 1000 - since]})
            return
        state.update((since,))
        state.setTimeoutTimestamp((since + age) * 1000)

    return changes.groupBy("candidate_id").applyInPandasWithState(update, "candidate_id string, since long, age long", "since long", "append", GroupStateTimeout.EventTimeTimeout)


def closed_sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """(user_id, began, ended, n): activity sessions whose gap the watermark has passed; each is emitted once."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.floor(F.unix_micros("w.start") / 1000000).alias("began"), F.floor(F.unix_micros("w.end") / 1000000).alias("ended"), "n")
