"""Several outputs a batch, all or none: a repeated batch changes nothing, a killed one is done again.

A batch writes each output to a folder of its own number, over whatever an attempt before left there, and then its
entry in the ledger.  Readers see the batches of the ledger only.  Batches of a stream come one after the other, so a
batch that is repeated after a failure sees the very tables that its first attempt saw.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Makes the outputs of a batch, in order, from its rows, its number and the ledger; later ones may read earlier ones' frames.
Outputs = Callable[[DataFrame, int, "Ledger"], list[tuple[str, DataFrame]]]


class Ledger:
    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def _files(self, path: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def done(self, batch: int) -> bool:
        return "_SUCCESS" in self._files(f"{self.at}/ledger/batch={batch}")

    def last(self) -> int:
        """The last batch that is done, -1 before the first."""
        numbers = [int(f.split("=")[1]) for f in self._files(f"{self.at}/ledger") if f.startswith("batch=")]
        return max((n for n in numbers if self.done(n)), default=-1)

    def table(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """An output over all batches that are done, or those before one."""
        end = self.last() + 1 if before is None else before
        want = StructType([*self.spark.createDataFrame([], schema).schema.fields, StructField("batch", LongType())])
        if not self._files(f"{self.at}/{name}"):
            return self.spark.createDataFrame([], want).drop("batch")
        return self.spark.read.schema(want).parquet(f"{self.at}/{name}").filter(F.col("batch") < end).drop("batch")

    def run(self, rows: DataFrame, batch: int, outputs: Outputs) -> bool:
        """Write a batch's outputs and then its entry; False, and nothing is done, where it has one."""
        if self.done(batch):
            return False
        names = []
        for name, df in outputs(rows, batch, self):
            df.write.mode("overwrite").parquet(f"{self.at}/{name}/batch={batch}")
            names.append(name)
        entry = self.spark.range(1).select(F.array(*map(F.lit, names)).alias("outputs"), F.current_timestamp().alias("done_at"))
        entry.write.mode("overwrite").parquet(f"{self.at}/ledger/batch={batch}")
        return True


def drain(stream: DataFrame, at: str, outputs: Outputs, mode: str = "append") -> Ledger:
    """Run a stream to the end of what is there, its batches through the ledger at ``at``."""
    ledger = Ledger(stream.sparkSession, at)
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, n: ledger.run(rows, n, outputs) and None)
    q.option("checkpointLocation", f"{ledger.at}/check").trigger(availableNow=True).start().awaitTermination()
    return ledger
