"""Exact duplicates by a tree merge of sorted digest runs. DataFrame functions only.

Every task of the scan is a run: its rows become (digest, run, best row, size), one row per digest and run. The runs are
then merged in rounds, ``FAN`` neighbouring runs into one each time (five binomial rounds in one multiway merge), until
one run is left. The exchange of a round is dealt by digest *and* run, so the copies of one text, however many, first
meet in small companies all over the cluster and only their winners travel on. ``max`` of a struct is merged by sorting,
so every run is a sorted one.

Equal means equal SHA-256, equal length and equal xxHash of the text without white space; all three are carried
through every round, which verifies the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muletrace.llm.base import cut_lineage, free_name

SPACE = " \t\n\x0b\x0c\r"
RUNS = 1024
FAN = 32


def without_space(text: Column) -> Column:
    """The text without the characters of ``SPACE``; a missing one is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bare = without_space(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        bare.alias("bare"),
        F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "row",
        F.unhex(F.sha2(F.col("bare").cast("binary"), 256)).alias("digest"),
        F.struct(F.octet_length("bare").alias("bytes"), F.xxhash64("bare").alias("hash")).alias("verify"),
        (F.spark_partition_id() % RUNS).alias("run"),
    )


def merged_runs(rows: DataFrame) -> DataFrame:
    """(digest, verify, best, size): one row per text. ``best`` orders by length, then smallest id, then first row."""
    # a missing id loses against any other; ids may be of any integer type
    best = F.struct(
        F.col("n_chars"),
        F.col("doc_id").isNotNull().alias("named"),
        (-F.col("doc_id").cast("decimal(20,0)")).alias("back"),
        (-F.col("row")).alias("first"),
        F.col("doc_id").alias("keep_id"),
    )
    level = rows.select("digest", "verify", "run", best.alias("best"), F.lit(1).cast("long").alias("size"))
    runs = RUNS
    while True:
        level = level.groupBy("digest", "verify", "run").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
        if runs == 1:
            return level.select("digest", "verify", "best", "size")
        runs = -(-runs // FAN)
        level = level.withColumn("run", F.floor(F.col("run") / FAN).cast("int"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, row): one row per row of ``docs``.

    Texts are equal when they are identical without white space (space, tab to carriage return). The one with the most
    code points stays, then the one with the smallest id; a missing id comes last. Rows that repeat the very same id and
    text count as members, and only the first of them is kept. Missing and empty texts are equal to each other and to
    texts of white space only. An empty table gives an empty result; other columns are not looked at. ``row`` is the
    row's ``monotonically_increasing_id``.
    """
    rows = cut_lineage(_fingerprints(docs, id_col, text_col))
    groups = merged_runs(rows).select(
        "digest",
        "verify",
        F.col("best.keep_id").alias("keep_id"),
        (-F.col("best.first")).alias("first"),
        F.col("size").alias("group_size"),
    )
    return rows.join(groups, ["digest", "verify"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("first")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns kept. ``docs`` must read the same rows in the
    same order twice, as tables in files do."""
    row = free_name(docs, "row")
    keep = exact_groups(docs, id_col, text_col).where("kept").select(F.col("row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(keep, row, "left_semi").drop(row)
