"""Documents made ready for training, stage by stage; every stage works on what its predecessor kept.

``STAGES`` lists (name, function); each function takes the session, the documents its predecessor left and the folder of
the other tables. All but the last return the columns they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muletrace.llm import bpe, decontaminate, exact, quality, simhash
from muletrace.llm.base import cut_lineage, free_name, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of the folder, does not reject. Missing and empty texts
    are scored like others; equal texts have equal scores, so repeated rows stay or go together. Without labels the scores are those of the
    untrained model; an empty table stays empty."""
    score = quality.quality_scorer(spark, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.coalesce("text", F.lit(""))) >= quality.THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of texts that are equal but for white space: the longest, then the smallest id, then the
    first row. Missing and empty texts are one group; an empty table stays empty."""
    return exact.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component: the smallest id, then the first row; a missing id comes last. Texts
    without words are one component; an empty table stays empty."""
    return simhash.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows. Missing and empty texts stay; repeated rows stay or
    go together; an empty table, or an empty benchmark, leaves all as it is."""
    hits = free_name(docs, "hits")
    found = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"), hits)
    return found.where(~decontaminate.contaminated(F.col(hits))).drop(hits)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to. One row per row, repeated ones
    too; missing and empty texts have no ids; an empty table stays empty."""
    coder = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = docs.select("doc_id", coder.encode(F.coalesce("text", F.lit(""))).alias("ids"))
    return coded.select(
        "doc_id",
        bpe.n_tokens(F.col("ids")).alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(coder.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # trained scores, XXH64 and BPE are not in SQL; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. Between two stages the documents are written to the checkpoint folder, as
    stages read them more than once and must find the same rows in the same order."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut_lineage(docs) if k else docs, sf_dir)
    return docs
