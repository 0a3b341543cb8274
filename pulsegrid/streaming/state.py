"""State tables carried from one micro-batch to the next.

Two slots per table, chosen by the parity of the batch: batch n reads what batch n-1 wrote and
writes the other slot, so a batch that is replayed after a failure starts from the same state again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class StateTable:
    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.base = spark, f"{folder}/{name}"

    def _slot(self, batch_id: int) -> str:
        return f"{self.base}/slot={batch_id % 2}"

    def before(self, batch_id: int) -> DataFrame | None:
        if batch_id == 0:
            return None
        return self.spark.read.parquet(self._slot(batch_id - 1))

    def after(self, batch_id: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._slot(batch_id))


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Output of one micro-batch; a replay overwrites it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
