"""Tables written under batch ids in a shared folder; a batch that runs again overwrites its own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muletrace.sources.readers import path_exists

COMPACT_EVERY = 50


class BatchTables:
    """Tables written once per batch under its id; repeating a batch replaces its own part and nothing else."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, name: str, batch_id: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")

    def until(self, name: str, before: int) -> DataFrame | None:
        """Rows of all batches before one, with their ``batch``; None before the first."""
        root = f"{self.folder}/{name}"
        if not path_exists(self.spark, root):
            return None
        return self.spark.read.parquet(root).where(F.col("batch") < before)

    def latest(self, name: str, before: int) -> DataFrame | None:
        """Rows of the newest batch before one that has any."""
        rows = self.until(name, before)
        newest = None if rows is None else rows.agg(F.max("batch")).first()[0]
        return None if newest is None else rows.where(F.col("batch") == newest).drop("batch")

    def log(self, name: str, before: int) -> DataFrame | None:
        """Rows of a log of changes before a batch: the newest merged form and what came after it."""
        log, merged = self.until(name, before), self.until(f"{name}_merged", before)
        newest = None if merged is None else merged.agg(F.max("batch")).first()[0]
        if newest is None:
            return log
        start = merged.where(F.col("batch") == newest)
        return start if log is None else start.unionByName(log.where(F.col("batch") > newest))

    def merge_due(self, name: str, batch_id: int) -> bool:
        merged = self.until(f"{name}_merged", batch_id)
        newest = None if merged is None else merged.agg(F.max("batch")).first()[0]
        return batch_id - (newest or 0) >= COMPACT_EVERY
