"""Repeated byte strings by range-partitioned suffix sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere else. Sorting every suffix of a corpus
would write hundreds of times its size, so suffixes that cannot have an equal are left out first, without loss:

1. Every window of ``LENGTH`` bytes has an anchor, its ``GRAM``-byte string of the smallest hash (leftmost on ties).
   Equal windows have equal anchors at equal offsets. Neighbouring windows mostly share theirs; such a run is a unit.
   A unit whose anchor string occurs nowhere else holds no repeated window.
2. A unit that occurs twice as a whole is repeated as a whole; of each different one, one is sorted.
3. What is left is range-partitioned by the leading bytes of the suffix at the anchor, with splitters that Spark samples.
   Splitters never part equal leading bytes, so suffixes next to each other across a boundary differ within ``GRAM`` bytes
   and no pair of equal windows is cut. Every bucket expands its windows and sorts them by multikey quicksort, eight bytes
   a character, one three-way partition of all open segments at a time; equal neighbours at the full length are repeats.

Anchor strings with more than ``HOT`` different units are not sorted in one bucket: their windows are counted by
128-bit digests, which spreads any group over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muletrace.llm.base import cut_lineage, portions
from muletrace.session import cut_counting, small_side

LENGTH = 200
GRAM = 32
HOT = 4096
FEW_ROWS = 1 << 20  # ids of documents that a broadcast may hold
_PART = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of the ``GRAM`` bytes from every position."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    by, step = _ODD, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(by) + h[step:]
        by, step = by * by & 0xFFFFFFFFFFFFFFFF, step * 2
    return h


def _smallest(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive numbers."""
    step = 1
    while step * 2 <= size:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = size - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def units(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, offset of the anchor, hash of the anchor string) of every run of windows with one anchor."""
    a = np.frombuffer(data, np.uint8)
    out = []
    for at in range(0, len(a) - LENGTH + 1, _PART):
        part = a[at : at + _PART + LENGTH - 1]
        h = gram_hashes(part)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        place = np.arange(len(h), dtype=np.uint64)
        anchor = (_smallest(mixed >> np.uint64(32) << np.uint64(32) | place, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        size = np.diff(np.concatenate([start, [len(anchor)]]))
        out.append((start + at, size, anchor[start] - start, h[anchor[start]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


_UNIT_TYPE = T.ArrayType(T.StructType([_long("gram"), _long("said"), _long("place")]))
_UNIT = [pa.field("gram", pa.int64()), pa.field("said", pa.int64()), pa.field("place", pa.int64())]


@F.arrow_udf(_UNIT_TYPE)
def text_units(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Units of a text: hash of the anchor string, hash of all their bytes, and start, windows and offset packed."""
    whole = xxhash.xxh3_64_intdigest
    for texts in portions(batches):
        offsets, grams, said, places = [0], [], [], []
        for t in texts:
            data = (t.as_py() or "").encode("utf-8", "replace")
            start, size, lead, gram = units(data)
            grams.append(gram)
            places.append(start << 16 | size << 8 | lead)
            said += [whole(data[s : s + n + LENGTH - 1]) for s, n in zip(start.tolist(), size.tolist())]
            offsets.append(len(said))
        flat = [np.concatenate(grams).view(np.int64), np.array(said, np.uint64).view(np.int64), np.concatenate(places)]
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=_UNIT))


_STRING_TYPE = T.ArrayType(
    T.StructType([_long("place"), T.StructField("hot", T.BooleanType()), T.StructField("lead", T.BinaryType()), T.StructField("data", T.BinaryType())])
)
_STRING = [pa.field("place", pa.int64()), pa.field("hot", pa.bool_()), pa.field("lead", pa.binary()), pa.field("data", pa.binary())]


@F.arrow_udf(_STRING_TYPE)
def unit_bytes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Bytes of the units that are asked for, and the leading bytes of the suffix at their anchor."""
    for texts, asked in portions(batches):
        offsets, places, hots, leads, strings = [0], [], [], [], []
        for t, units_ in zip(texts, asked):
            data = t.as_py().encode("utf-8", "replace")
            for u in units_.as_py():
                start, size, lead = u["place"] >> 16, u["place"] >> 8 & 255, u["place"] & 255
                places.append(u["place"])
                hots.append(u["hot"])
                leads.append(data[start + lead : start + lead + GRAM])
                strings.append(data[start : start + size + LENGTH - 1])
            offsets.append(len(places))
        flat = [pa.array(places, pa.int64()), pa.array(hots, pa.bool_()), pa.array(leads, pa.binary()), pa.array(strings, pa.binary())]
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, fields=_STRING))


def equal_windows(buffer: bytes, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the windows at ``at`` have an equal one in their group.

    Multikey quicksort, all segments at once: a segment's first character is its pivot; segments that equal it throughout
    go one character deeper as they are, the others are ordered by this character and split; single windows are done."""
    chars = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    live = np.argsort(group, kind="stable")
    g = group[live]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    for depth in range(0, LENGTH + 1, 8):
        seg = np.cumsum(new) - 1
        many = np.bincount(seg) > 1
        keep = many[seg]
        if not keep.all():
            live, new = live[keep], new[keep]
            seg = np.cumsum(new) - 1
        if depth == LENGTH or not len(live):
            break
        c = chars[at[live] + depth].astype(np.uint64)
        first = np.flatnonzero(new)
        mixed = np.zeros(len(first), bool)
        mixed[seg[c != c[first][seg]]] = True
        if mixed.any():
            part = np.flatnonzero(mixed[seg])
            order = part[np.lexsort((c[part], seg[part]))]
            live[part], c[part] = live[order], c[order]
            new[1:] |= (c[1:] != c[:-1]) & (seg[1:] == seg[:-1])
    out = np.zeros(len(at), bool)
    out[live] = True
    return out


_SPAN = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_WINDOWS = 1 << 18  # sorted at a time, and a last anchor string's


def _spans(row: np.ndarray, first: np.ndarray, size: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
    """Byte spans of runs of repeated windows."""
    who = np.repeat(np.arange(len(row)), size)
    inside = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
    hit = np.flatnonzero(repeated)
    cut = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(who[hit]) != 0)]) if len(hit) else np.zeros(0, bool)
    a = hit[cut]
    z = hit[np.concatenate([cut[1:], [True]])] if len(hit) else a
    begin = first[who[a]]
    return pa.record_batch([pa.array(row[who[a]]), pa.array(begin + inside[a]), pa.array(begin + inside[z] + LENGTH)], schema=_SPAN)


def _sorted_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows of one bucket, which comes ordered by leading bytes."""

    def done(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        row = np.array([r[0] for r in rows], np.int64)
        place = np.array([r[1] for r in rows], np.int64)
        group = np.array([r[2] for r in rows], np.int64)
        size, lead = place >> 8 & 255, place & 255
        base = np.cumsum([0] + [len(r[3]) for r in rows[:-1]])
        who = np.repeat(np.arange(len(rows)), size)
        inside = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
        # equal windows lie at the same offset from equal anchors
        key = group[who] << 8 | (lead[who] - inside)
        return _spans(row, place >> 16, size, equal_windows(b"".join(r[3] for r in rows), base[who] + inside, key))

    held: list[tuple[int, int, int, bytes]] = []
    last, groups, windows = None, 0, 0
    for b in batches:
        for row, place, lead, data in zip(*(b.column(c).to_pylist() for c in ("row", "place", "lead", "data"))):
            if lead != last:
                if windows >= _WINDOWS:
                    yield done(held)
                    held, windows, groups = [], 0, 0
                last, groups = lead, groups + 1
            held.append((row, place, groups, data))
            windows += place >> 8 & 255
    if held:
        yield done(held)


_DIGEST_TYPE = T.ArrayType(T.StructType([_long("at"), _long("high"), _long("low")]))
_DIGEST = pa.list_(pa.struct([("at", pa.int64()), ("high", pa.int64()), ("low", pa.int64())]))


@F.arrow_udf(_DIGEST_TYPE)
def window_digests(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Start and digest of every window of a unit."""
    for places, strings in batches:
        out = []
        for place, data in zip(places.to_pylist(), strings.to_pylist()):
            d = b"".join(xxhash.xxh3_128_digest(data[k : k + LENGTH]) for k in range(place >> 8 & 255))
            pair = np.frombuffer(d, "<i8").reshape(-1, 2).tolist()
            out.append([{"at": (place >> 16) + k, "high": h, "low": low} for k, (h, low) in enumerate(pair)])
        yield pa.array(out, _DIGEST)


def _hot_spans(strings: DataFrame) -> DataFrame:
    each = strings.select("row", F.explode(window_digests("place", "data")).alias("w")).select("row", "w.at", "w.high", "w.low")
    twice = each.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    return each.join(twice, ["high", "low"], "left_semi").select("row", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end"))


def repeated_spans(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(row, start, end): byte spans, possibly touching and overlapping, whose union is all that is repeated.

    ``rows`` has row (unique) and text."""
    unit = rows.select("row", F.explode(text_units("text")).alias("u")).select("row", "u.gram", "u.said", "u.place")
    # A gram may be everywhere. Keys are negated after every grouping, so that both sides of the joins are dealt anew and
    # a join splits a hot one, and so that strings are grouped by (gram, said) and not where their gram lies.
    negated = lambda df, old, new: df.withColumn(new, F.bitwise_not(old)).drop(old)
    grams = unit.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("gram")
    grams = negated(negated(grams, "gram", "key"), "key", "gram")
    again = unit.join(grams, "gram", "left_semi")
    strings = negated(again, "gram", "key").groupBy("key", "said").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "place")).alias("one"))
    strings = cut_lineage(strings)
    sides = negated(strings.groupBy("key").agg(F.count(F.lit(1)).alias("sides")).where(F.col("sides") > 1), "key", "gram")
    strings = negated(strings, "key", "gram")
    whole = again.join(strings.where(F.col("copies") > 1).select("gram", "said"), ["gram", "said"], "left_semi")
    start, size = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255).cast("long"))
    whole = whole.select("row", start.alias("start"), (start + size + LENGTH - 1).alias("end"))
    asked, n = cut_counting(
        strings.join(sides, "gram")
        .groupBy("one.row")
        .agg(F.collect_list(F.struct("one.place", (F.col("sides") > hot).alias("hot"))).alias("asked"), F.max(F.col("sides") > hot).alias("has_hot")),
        F.lit(True),
    )
    texts = _only(rows, asked, n).join(asked, "row")
    strings_ = texts.select("row", F.explode(unit_bytes("text", "asked")).alias("u")).select("row", "u.place", "u.hot", "u.lead", "u.data")
    cold = strings_.where(~F.col("hot")).select("row", "place", "lead", "data")
    found = cold.repartitionByRange("lead").sortWithinPartitions("lead").mapInArrow(_sorted_bucket, "row long, start long, end long")
    spans = whole.unionByName(found)
    if asked.where("has_hot").limit(1).count():
        spans = spans.unionByName(_hot_spans(strings_.where("hot")))
    return spans


def _only(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Rows of the given ids, before their texts are shuffled, if the counted ids fit a broadcast; else all rows."""
    return rows.join(small_side(ids.select("row"), n, FEW_ROWS), "row", "left_semi") if n <= FEW_ROWS else rows


_RUNS_TYPE = T.ArrayType(T.StructType([_long("start"), _long("end")]))
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@F.arrow_udf(_RUNS_TYPE)
def merged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Overlapping and touching spans joined, in order."""
    for rows in batches:
        out = []
        for spans in rows:
            runs: list[list[int]] = []
            for a, z in sorted((s["start"], s["end"]) for s in spans.as_py()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(z, runs[-1][1])
                else:
                    runs.append([a, z])
            out.append([{"start": a, "end": z} for a, z in runs])
        yield pa.array(out, _RUNS)


@F.arrow_udf(T.BinaryType())
def kept_bytes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A text's bytes outside the given runs."""
    for texts, runs in portions(batches):
        out = []
        for t, r in zip(texts, runs):
            data, parts, last = t.as_py().encode("utf-8", "replace"), [], 0
            for x in r.as_py():
                parts.append(data[last : x["start"]])
                last = x["end"]
            out.append(b"".join(parts) + data[last:])
        yield pa.array(out, pa.binary())


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, runs, kept): one row per row of ``docs``.

    ``runs`` are the maximal byte runs that go, ``kept`` the other bytes; it is missing where nothing goes. All
    occurrences of a repeated string go, the first one too, and overlapping occurrences in one text count. Missing and
    empty texts, and texts of fewer than 200 bytes, stay. Repeated rows repeat each other. An empty table gives an empty
    result; other columns are not looked at. ``docs`` must read the same rows in the same order twice, as tables in files do.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    body = rows.select("row", "text")
    spans = repeated_spans(body, hot)
    runs, n = cut_counting(spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")).select("row", merged("spans").alias("runs")), F.lit(True))
    cut = _only(body, runs, n).join(runs, "row").select("row", "runs", kept_bytes("text", "runs").alias("kept"))
    return rows.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).join(cut, "row", "left").select(
        "doc_id", "n_bytes", "runs", "kept", F.coalesce(F.sha2("kept", 256), "sha256").alias("kept_sha256")
    )
