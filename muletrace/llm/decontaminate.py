"""Benchmark decontamination by Wu-Manber search over words.

The test strings are windows of ``WINDOW`` consecutive words of benchmark items. Windows of one length are searched
together: the last ``BLOCK`` words of a text window are hashed; a shift table says how far the search may jump at least,
and only where it says 0 the bucket of test strings with that suffix is looked up and compared word by word. Many
stretches of text are searched side by side, one numpy step each.

Words a benchmark never uses all get number 0, which no test string has, so they end any window they stand in.
The benchmark is packed in blocks of bounded size. Every document row passes ``LIVE_PACKS`` of them in one go, without a
shuffle; a larger benchmark takes several passes, whose hits are merged by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muletrace.llm.base import cut_lineage, free_name, portions

WINDOW = 13
BLOCK = 3
LANE = 256
PACK_BYTES = 2 << 20  # of benchmark text in one broadcast; its search structure takes about ninety times that
LIVE_PACKS = 2  # broadcast at a time
_TABLE_BITS = 18

#: Letters, digits and all bytes of non-ASCII characters are parts of words, A-Z in lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

HITS = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


class TestStrings:
    """Test strings of one length, with their shift table and suffix buckets."""

    def __init__(self, owners: dict[tuple[int, ...], set[int]], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.strings = np.array(list(owners), np.int32).reshape(-1, length)
        self.owners = [sorted(x) for x in owners.values()]
        self.shift = np.full(1 << _TABLE_BITS, length - self.block + 1, np.int16)
        for at in range(length - self.block + 1):
            np.minimum.at(self.shift, self.hashed([self.strings[:, at + k] for k in range(self.block)]), length - self.block - at)
        suffix = self.hashed([self.strings[:, length - self.block + k] for k in range(self.block)])
        self.order = np.argsort(suffix, kind="stable")
        self.suffixes = suffix[self.order]

    @staticmethod
    def hashed(columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, index of the test string) of every occurrence in an array of word numbers."""
        n = len(text) - self.length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(0, n, LANE)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            last = at + self.length - self.block
            code = self.hashed([text[last + k] for k in range(self.block)])
            jump = self.shift[code]
            here = jump == 0
            if here.any():
                found.append((at[here], code[here]))
            at = at + np.maximum(jump, 1)
            on = at < stop
            if not on.all():
                at, stop = at[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos, code = (np.concatenate(x) for x in zip(*found))
        first, end = np.searchsorted(self.suffixes, code, "left"), np.searchsorted(self.suffixes, code, "right")
        out = []
        while len(pos):  # the next candidate of every position's bucket at a time
            more = first < end
            pos, first, end = pos[more], first[more], end[more]
            which = self.order[first]
            same = np.arange(len(pos))
            for k in range(self.length):
                same = same[text[pos[same] + k] == self.strings[which[same], k]]
            out.append((pos[same], which[same]))
            first = first + 1
        pos, which = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        return pos, which


class Benchmark:
    """The test strings of some benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids = sorted({i for i, _ in items})
        index = {x: k for k, x in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            size = min(window, len(w))
            for k in range(len(w) - size + 1) if size else ():
                by_length.setdefault(size, {}).setdefault(tuple(w[k : k + size]), set()).add(index[item])
        self.sets = [TestStrings(owners, size) for size, owners in sorted(by_length.items())]

    def scan(self, texts: list[str]) -> list[dict]:
        """n_words, merged spans of hit words and ids of occurring items, for each text."""
        number = self.vocabulary.get
        parts, sizes = [], []
        for t in texts:
            w = words(t) if t else []
            sizes.append(len(w))
            parts.append(np.fromiter((number(x, 0) for x in w), np.int32, len(w)))
            parts.append(np.zeros(1, np.int32))  # no window reaches over the end
        text = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
        edge = np.zeros(len(text) + 1, np.int32)
        items: list[set[int]] = [set() for _ in texts]
        for s in self.sets:
            pos, which = s.search(text)
            np.add.at(edge, pos, 1)
            np.add.at(edge, pos + s.length, -1)
            for d, k in set(zip((np.searchsorted(starts, pos, "right") - 1).tolist(), which.tolist())):
                items[d].update(s.owners[k])
        turn = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
        up, down = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        first, end = np.searchsorted(up, starts[:-1]), np.searchsorted(up, starts[1:])
        return [
            {
                "n_words": n,
                "spans": [{"start": int(a - b), "end": int(z - b)} for a, z in zip(up[i:j], down[i:j])],
                "items": [self.ids[k] for k in sorted(items[d])],
            }
            for d, (n, b, i, j) in enumerate(zip(sizes, starts[:-1].tolist(), first.tolist(), end.tolist()))
        ]


_HITS_ARROW = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]
)


def _scanner(spark, items: list[tuple[str, str]], window: int):
    """A function of a text column, and the broadcast behind it."""
    shared = spark.sparkContext.broadcast(Benchmark(items, window))

    @F.arrow_udf(HITS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bench = shared.value
        for texts in portions(batches):
            yield pa.array(bench.scan(texts.to_pylist()), _HITS_ARROW)

    return scan, shared


def _packs(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """How many packs of about ``PACK_BYTES`` the benchmark is, and the packs one after the other; one item alone may be
    longer."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packs = max(1, -(-size // PACK_BYTES))

    def each() -> Iterator[list[tuple[str, str]]]:
        for k in range(packs):
            part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(packs)) == k) if packs > 1 else items
            yield [(r.item, r.text) for r in part.collect()]

    return packs, each()


def _union(hits: Column) -> Column:
    """One result from those of all packs."""
    spans = F.array_sort(F.flatten(F.transform(hits, lambda h: h["spans"])))
    zero = F.lit(0).cast("long")
    union = F.aggregate(
        spans,
        F.struct(zero.alias("n"), zero.alias("reach")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(zero, s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach")
        ),
    )
    return F.struct(
        hits[0]["n_words"].alias("n_words"),
        union["n"].alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"])))).alias("items"),
        spans.alias("spans"),
    )


def with_hits(docs: DataFrame, benchmark: DataFrame, out: str = "hits", doc_text: str = "text", item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the column ``out``: struct<n_words, n_hit, items, spans>, all other columns kept.

    A window is ``window`` consecutive words of an item; a shorter item that has words is one window. A text's word is
    hit if it lies in any occurrence of any window. ``items`` are the ids of items with occurring windows, as strings in
    string order without repeats; a missing id is ''. Missing and empty texts have no words and no hits; empty items have
    no windows; with an empty benchmark nothing is hit. Overlapping and repeated windows count words once. Repeated rows
    get the same result each; an empty table gives an empty one. With more than ``LIVE_PACKS`` packs ``docs`` must read the
    same rows in the same order each time, as tables in files do.
    """
    spark, text = benchmark.sparkSession, F.coalesce(F.col(doc_text).cast("string"), F.lit(""))
    n, packs = _packs(benchmark, item_col, text_col)
    if n <= LIVE_PACKS:
        return docs.withColumn(out, _union(F.array(*[_scanner(spark, items, window)[0](text) for items in packs])))
    row, part = free_name(docs, "row"), 0
    found = docs.withColumn(row, F.monotonically_increasing_id())
    names = []
    while some := list(islice(packs, LIVE_PACKS)):
        scans = [_scanner(spark, items, window) for items in some]
        hits = docs.select(F.monotonically_increasing_id().alias(row), F.array(*[scan(text) for scan, _ in scans]).alias("h"))
        if names:  # the first pass tells the words of every row
            hits = hits.where(F.exists("h", lambda h: F.size(h["spans"]) > 0))
        names.append(free_name(found, f"hits{part}"))
        found = found.join(cut_lineage(hits.withColumnRenamed("h", names[-1])), row, "left")
        for _, shared in scans:
            shared.destroy()
        part += 1
    every = F.concat(*[F.coalesce(F.col(c), F.array().cast(f"array<{HITS}>")) for c in names])
    return found.withColumn(out, _union(every)).drop(row, *names)


def contaminated(hits: Column) -> Column:
    """At least one word in twenty is hit."""
    return (hits["n_hit"] > 0) & (20 * hits["n_hit"] >= hits["n_words"])
