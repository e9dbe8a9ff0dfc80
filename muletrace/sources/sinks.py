"""Writers: snapshots published all at once, idempotent appends, nested and text exports."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muletrace.schemas import assert_contract
from muletrace.sources.readers import path_exists


def write_outputs(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Every table into its own sub-folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def append_new(df: DataFrame, folder: str, key: str, rules: dict[str, Column], table: str) -> None:
    """Validate, then append only rows whose key is not stored yet; a second delivery of the same rows adds nothing."""
    spark = df.sparkSession
    fresh = assert_contract(df, rules, table).dropDuplicates([key])
    if path_exists(spark, folder):
        stored = spark.read.parquet(folder).select(key)
        fresh = fresh.join(stored, key, "left_anti")
    fresh.write.mode("append").parquet(folder)


def publish_snapshot(tables: dict[str, DataFrame], folder: str, source: str, profile: str, may_be_empty: tuple[str, ...] = ()) -> int:
    """Replace all tables at once: write a new version, check its counts, then point to it.

    A pointer is a small file of its own for every version, and readers take the newest complete one, so there is a
    snapshot at any time, and a failed load leaves the previous version in place. Tables that may be empty are named.
    """
    spark = next(iter(tables.values())).sparkSession
    version = (current_version(spark, folder) or 0) + 1
    counts = {}
    for name, df in tables.items():
        path = f"{folder}/v={version}/{name}"
        df.write.mode("overwrite").parquet(path)
        counts[name] = spark.read.parquet(path).count()
        if counts[name] == 0 and name not in may_be_empty:
            raise ValueError(f"snapshot table {name} is empty; version {version} not published")
    meta = {"version": version, "source": source, "profile": profile, "counts": counts, "at": int(time.time())}
    pointer = spark.createDataFrame([(json.dumps(meta),)], "value string")
    pointer.coalesce(1).write.mode("overwrite").text(f"{folder}/pointers/{version:010d}")
    return version


def current_version(spark: SparkSession, folder: str) -> int | None:
    meta = snapshot_meta(spark, folder)
    return meta["version"] if meta else None


def snapshot_meta(spark: SparkSession, folder: str) -> dict | None:
    """Metadata of the newest published version; None before the first."""
    if not path_exists(spark, f"{folder}/pointers"):
        return None
    text = spark.read.option("recursiveFileLookup", True).text(f"{folder}/pointers")
    newest = text.orderBy(F.desc(F.get_json_object("value", "$.version").cast("long"))).first()
    return json.loads(newest[0]) if newest else None


def read_snapshot(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/v={current_version(spark, folder)}/{table}")


def upsert_single(df: DataFrame, folder: str) -> None:
    """A one-row table (metrics note, path summary): replaced as a whole."""
    df.coalesce(1).write.mode("overwrite").parquet(folder)


def write_paths(paths: DataFrame, folder: str) -> None:
    """Fund-flow paths with typed times and nested chains."""
    typed = paths.withColumns({"start_time": F.timestamp_micros("start_us"), "end_time": F.timestamp_micros("end_us")})
    typed.write.mode("overwrite").parquet(folder)


def write_feature_collections(documents: DataFrame, folder: str) -> None:
    """GeoJSON FeatureCollections (column ``document``), one per line."""
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(folder)
