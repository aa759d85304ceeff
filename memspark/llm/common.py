"""Shared helpers: scratch tables in the cluster's shared folder, input columns, split rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A character class of the six ASCII white-space characters, as used by every operator here.
WS = r"[\x20\x09-\x0D]"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests) gets a temporary folder; a cluster has none that all its
    executors share, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            base = "file://" + tempfile.mkdtemp(prefix="memspark-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/memspark-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has such a column (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks of one stage, never the whole job.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Whole texts reach Python a thousand rows at a time, so buffers on either side stay small; a session's own setting holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def split_remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of doc_id as decimal text, modulo ``mod`` (null ids count as remainder 0)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % mod, F.lit(0)).cast("int")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit("")).alias(col)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions, the one knob that follows the input's size."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
