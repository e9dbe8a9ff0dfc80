"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "muletrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for. On a cluster, leave ``master`` unset."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``; a private one only if it names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="muletrace-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder, so lost executors do not replay whole loops."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counting(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """Like :func:`cut_lineage`, and how many rows meet the condition, counted while they are written."""
    seen = Observation()
    done = cut_lineage(df.observe(seen, F.count_if(condition).alias("n")))
    return done, seen.get["n"]


def table_folder(spark: SparkSession) -> str:
    """A new folder for a table beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid4().hex}"


def cut_table(df: DataFrame) -> DataFrame:
    """Like :func:`cut_lineage`, as a table in the same folder, whose size Spark knows from its files. For what every round of
    a loop joins anew: size estimates of checkpointed rows are handed on, so they multiply from round to round."""
    path = table_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A join side that is shuffled, never broadcast. For tables that grow with the accounts, and for loops: many small
    broadcasts, by hint or by Spark's own estimate, add up in the driver, where each takes a page of memory at least."""
    return df.hint("merge")


BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a join side whose counted size is within ``limit`` rows; larger sides shuffle as usual."""
    return F.broadcast(df) if rows <= limit else df
