"""What a stream took in: accepted and rejected transfers by reason, per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

LINES, TRANSFERS = "ingest_lines", "ingest_transfers"
UNKNOWN = "unknown line"


def observed_lines(lines: DataFrame, unknown: Column) -> DataFrame:
    """``lines``, counted on their way."""
    return lines.observe(LINES, F.count(F.lit(1)).alias("lines"), F.count_if(unknown).alias(UNKNOWN))


def observed_transfers(tagged: DataFrame, reasons: list[str]) -> DataFrame:
    """Transfers with the list ``broken_rules``, counted on their way: a transfer that breaks two rules counts for both."""
    bad = F.size("broken_rules") > 0
    each = [F.count_if(F.array_contains("broken_rules", r)).alias(f"broken {r}") for r in reasons]
    return tagged.observe(TRANSFERS, F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"), *each)


class IngestCounts(StreamingQueryListener):
    """Writes the observed counts of every batch to ``folder/query=<id>/batch=<id>``. A query keeps its id over a restart and
    a batch that runs again replaces its own counts, so every batch counts once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counts = {k: v for row in p.observedMetrics.values() for k, v in row.asDict().items() if v}
        if counts:
            rows = self.spark.createDataFrame([(k, int(v)) for k, v in sorted(counts.items())], "what string, n long")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/query={p.id}/batch={p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def ingest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(query, batch, what, n): ``what`` is lines, unknown line, accepted, rejected or ``broken <rule>``."""
    return spark.read.parquet(folder).select("query", "batch", "what", "n")
