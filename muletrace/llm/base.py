"""What the text operators share: reading tables, row keys, word bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muletrace.session import cut_lineage, ensure_checkpoint_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a missing text as the empty one. All other columns go, so none can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are kept for testing: crc32 of the id as text, modulo 5, is 0. A missing id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def hash_share(key: Column, wanted: int, total: int) -> Column:
    """Rows whose key's hash lies in a share of about ``wanted`` of ``total`` rows; all, if there are no more. What a later
    ``limit`` looks at then does not grow with the number of tasks."""
    span = 1 << 32
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(span)) < F.lit(min(span, span * wanted // max(1, total)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[str, int]]:
    """At most ``per_class`` training texts of either label, chosen by a hash of the id; held-out documents never.

    The bound keeps the driver's share the same at every size. Labels other than 0 and 1, and missing ids, are skipped; of
    contradicting labels of an id the smaller one counts.
    """
    lab = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
    lab = lab.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    lab = lab.groupBy("id").agg(F.min("y").alias("y"))
    out: list[tuple[str, int]] = []
    sizes = {r.y: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    for y in (0, 1):
        order = [F.xxhash64("id"), F.col("id")]
        some = lab.where((F.col("y") == y) & hash_share(F.col("id"), 2 * per_class, sizes.get(y, 0)))
        chosen = some.orderBy(*order).limit(per_class)
        rows = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
        got = rows.select("doc_id", "text", "y").collect()
        out += [(r.text, r.y) for r in sorted(got, key=lambda r: (r.doc_id, r.text))]
    return out


PORTION = 1 << 20


def portions(batches: Iterator) -> Iterator:
    """Arrow batches (arrays, or tuples of them) cut into runs of rows of about ``PORTION`` bytes in the first column, so
    that a task holds little more at a time than its longest row."""
    for b in batches:
        first = b[0] if isinstance(b, tuple) else b
        if not len(first):
            continue
        size = pc.fill_null(pc.binary_length(first), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size + 1) - size - 1) // PORTION
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(first)]
        for a, z in zip(cut, cut[1:]):
            yield tuple(x.slice(a, z - a) for x in b) if isinstance(b, tuple) else b.slice(a, z - a)
