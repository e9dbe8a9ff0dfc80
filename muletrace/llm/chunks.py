"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where its top bits are zero, so boundaries depend on the last 32
bytes alone and fall into step again soon after an insertion. Chunks are known by a 128-bit digest. The first chunk of a
digest, by document id, stays; later ones are repeats, and runs of repeats of ``MIN_SPAN`` bytes or more are removed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muletrace.llm.base import portions

MIN_CHUNK, MAX_CHUNK, BITS = 24, 256, 5
MIN_SPAN = 80
_PART = 1 << 20
_REACH = 32


def _gear() -> np.ndarray:
    """256 well mixed numbers."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """After every byte, the sum of the gear numbers of the last 32 bytes, each doubled once per byte since."""
    h = GEAR[data]
    step = 1
    while step < _REACH:
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h, step = longer, step * 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks, the last one the length; none of them splits a character."""
    a = np.frombuffer(data, np.uint8)
    ends: list[np.ndarray] = []
    for at in range(0, len(a), _PART):
        lead = min(at, _REACH - 1)
        h = gear_hash(a[at - lead : at + _PART])[lead:]
        ends.append(np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + at + 1)
    wanted = np.concatenate(ends).tolist() if ends else []
    out, last, n = [], 0, len(data)
    while last < n:
        k = bisect_left(wanted, last + MIN_CHUNK)
        end = min(wanted[k] if k < len(wanted) else n, last + MAX_CHUNK, n)
        while end < n and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(end)
        last = end
    return out


_CHUNK = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])
_CHUNK_TYPE = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("high", T.LongType()), T.StructField("low", T.LongType())])
)


@F.arrow_udf(_CHUNK_TYPE)
def chunked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Start, size and digest of every chunk of a text."""
    digest = xxhash.xxh3_128_digest
    for texts in portions(batches):
        offsets, starts, sizes, digests = [0], [], [], []
        for t in texts:
            data = (t.as_py() or "").encode("utf-8", "replace")
            ends = cuts(data)
            begins = [0, *ends[:-1]] if ends else []
            starts += begins
            sizes += [z - a for a, z in zip(begins, ends)]
            digests += [digest(data[a:z]) for a, z in zip(begins, ends)]
            offsets.append(len(starts))
        d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        flat = pa.StructArray.from_arrays(
            [pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], fields=list(_CHUNK)
        )
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


_KEPT_TYPE = T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])
_KEPT = pa.struct([("kept", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])


@F.arrow_udf(_KEPT_TYPE)
def without_spans(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A text without the byte spans given as a sorted array of disjoint (start, end)."""
    for texts, spans in portions(batches):
        out = []
        for t, s in zip(texts, spans):
            data = (t.as_py() or "").encode("utf-8", "replace")
            parts, last, removed, runs = [], 0, 0, s.as_py() or []
            for r in runs:
                parts.append(data[last : r["start"]])
                removed += r["end"] - r["start"]
                last = r["end"]
            out.append({"kept": b"".join(parts) + data[last:], "n_removed": removed, "n_spans": len(runs)})
        yield pa.array(out, _KEPT)


_SPANS_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


@F.arrow_udf(_SPANS_TYPE)
def long_runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Touching spans joined, in order; only runs of ``MIN_SPAN`` bytes or more."""
    for rows in batches:
        out = []
        for spans in rows:
            runs: list[list[int]] = []
            for a, z in sorted((s["start"], s["end"]) for s in spans.as_py()):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = z
                else:
                    runs.append([a, z])
            out.append([{"start": a, "end": z} for a, z in runs if z - a >= MIN_SPAN])
        yield pa.array(out, _SPANS)


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, start, end, first_id): every chunk that is not the first of its digest, by document id (missing ones
    last), row and place."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), chunked(F.coalesce(F.col(text_col), F.lit(""))).alias("c"))
    flat = rows.select("doc_id", "row", F.explode("c").alias("c")).select("doc_id", "row", "c.start", "c.size", "c.high", "c.low")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row", "start")
    seen = flat.groupBy("high", "low").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # a negated key is dealt anew, so that the join splits a chunk that is everywhere
    seen = seen.select(F.bitwise_not("high").alias("key"), "low", "first").select(F.bitwise_not("key").alias("high"), "low", "first")
    again = flat.join(seen, ["high", "low"])
    later = again.where((F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start")))
    return later.select("row", "start", (F.col("start") + F.col("size")).alias("end"), F.col("first.doc_id").alias("first_id"))


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, kept, n_removed, n_spans, first_docs): one row per row of ``docs``.

    ``kept`` are the UTF-8 bytes without later repeats; chunks never split a character, so it is UTF-8 again.
    ``first_docs`` are the ids of documents whose chunks the document repeats. Missing and empty texts have no chunks and
    stay as they are. Repeated rows count as documents: the first keeps its text. An empty table gives an empty result;
    other columns are not looked at. ``docs`` must read the same rows in the same order twice, as tables in files do.
    """
    spans = repeated_chunks(docs, id_col, text_col).groupBy("row").agg(
        F.collect_list(F.struct("start", "end")).alias("chunks"), F.array_sort(F.collect_set("first_id")).alias("first_docs")
    )
    spans = spans.withColumn("runs", long_runs("chunks")).where(F.size("runs") > 0).drop("chunks")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    cut = rows.join(spans, "row", "left").withColumn("cut", without_spans("text", "runs"))
    return cut.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "cut.kept",
        "cut.n_removed",
        "cut.n_spans",
        F.coalesce("first_docs", F.expr("cast(array() as array<bigint>)")).alias("first_docs"),
    )
