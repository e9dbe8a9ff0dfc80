"""Near-duplicates by SimHash with bit-sliced comparison.

Fingerprints at ``RADIUS`` or fewer differing bits are linked. The 64 bits are cut into pieces; with 4 differing bits at
most, at least (pieces - 4) pieces agree, so fingerprints that agree there meet in a bucket. How many pieces there are
follows from the number of fingerprints, which keeps buckets small; any choice gives the same links.

Inside buckets, 64 fingerprints are stored as 64 bit planes of one word each. A fingerprint is compared with all of them
at once: differing bits of four planes at a time go through carry-save adders into three counter planes, and a block is
left as soon as all its distances exceed the radius. A bucket only hands on a spanning forest of its links.

Buckets beyond ``HOT`` fingerprints are cut again by pieces of their other bits; what still is too large is cut in blocks,
and every pair of blocks goes to a task of its own, so nothing is dropped and no task grows with a bucket.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muletrace.llm.base import cut_lineage, free_name, portions, texts
from muletrace.llm.components import components, looked_up
from muletrace.session import cut_counting, small_side

SHINGLE = 4
RADIUS = 4
HOT = 4096
DEPTH = 3
SHINGLES = 1 << 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash_of(text: str) -> int:
    """Signed 64 bits: majority of the bits of the XXH64 (seed 42) of all word shingles; 0 without words."""
    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    end = array("q", accumulate(len(x) + 1 for x in w))
    begin = array("q", [0]) + end[:-1]
    size = min(SHINGLE, len(w))
    hashed = xxhash.xxh64_intdigest
    n, ones = len(w) - size + 1, np.zeros(64, np.int64)
    for k in range(0, n, SHINGLES):  # the bits of so many at a time
        h = np.array([hashed(line[a : b - 1], 42) for a, b in zip(begin[k : min(n, k + SHINGLES)], end[k + size - 1 :])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts_ in portions(batches):
        yield pa.array([simhash_of(t.as_py() or "") for t in texts_], pa.int64())


def near(seed: np.ndarray, block: np.ndarray, planes: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Lanes within ``RADIUS`` bits: for every row, ``seed`` against the 64 lanes of ``block``.

    ``planes[j, block]`` holds bit j of the block's lanes, ``empty[block]`` the unused lanes."""
    out = np.zeros(len(seed), np.uint64)
    row = np.arange(len(seed))
    one = two = four = np.zeros(len(seed), np.uint64)
    over = empty[block]

    def adder(a, b, c):
        half = a ^ b
        return half ^ c, (a & b) | (half & c)

    for j in range(0, 64, 4):
        x = [planes[j + k][block] ^ (np.uint64(0) - ((seed >> np.uint64(j + k)) & np.uint64(1))) for k in range(4)]
        one, t1 = adder(one, x[0], x[1])
        one, t2 = adder(one, x[2], x[3])
        two, f = adder(two, t1, t2)
        over = over | (four & f)
        four = four ^ f
        over = over | (four & (two | one))  # more than RADIUS = 4
        live = over != _ALL
        if j % 8 == 4 and not live.all():  # blocks whose lanes all exceed the radius are abandoned
            row, seed, block, one, two, four, over = (v[live] for v in (row, seed, block, one, two, four, over))
            if not len(row):
                break
    out[row] = ~over
    return out


def _sliced(prints: np.ndarray, lane: np.ndarray, block: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes and unused lanes of fingerprints put at (block, lane)."""
    planes = np.zeros((64, blocks), np.uint64)
    used = np.zeros(blocks, np.uint64)
    np.bitwise_or.at(used, block, np.uint64(1) << lane)
    for j in range(64):
        np.bitwise_or.at(planes[j], block, ((prints >> np.uint64(j)) & np.uint64(1)) << lane)
    return planes, ~used


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


ROWS = 1 << 17
LARGE = 512


def _small_buckets(prints: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links (as indices) of consecutive buckets of at most ``LARGE`` fingerprints each."""
    n = len(prints)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    own = np.repeat(np.arange(len(size)), size)
    place = np.arange(n) - start[own]
    per = -(-size // 64)
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    block, lane = first[own] + place // 64, (place % 64).astype(np.uint64)
    planes, empty = _sliced(prints, lane, block, int(per.sum()))
    # every fingerprint against its own block and those after it
    count = first[own] + per[own] - block
    forest, links = _Forest(n), []
    ends = np.cumsum(count)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ROWS, "right")))
        c = count[lo:hi]
        who = np.repeat(np.arange(lo, hi), c)
        against = np.arange(len(who)) - np.repeat(np.cumsum(c) - c, c) + block[who]
        hit = near(prints[who], against, planes, empty)
        any_ = np.flatnonzero(hit)
        for k, h in zip(any_.tolist(), hit[any_].tolist()):
            a = int(who[k])
            b0 = int(against[k] - first[own[a]]) * 64 + int(start[own[a]])
            while h:
                low = h & -h
                b = b0 + low.bit_length() - 1
                h ^= low
                if b > a and forest.join(a, b):
                    links.append((a, b))
        lo = hi
    return links


def _large_bucket(prints: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of one bucket: what is reached is taken out of the planes' lanes, so groups of near copies shrink
    at once."""
    n = len(prints)
    at = np.arange(n)
    planes, unreached = _sliced(prints, (at % 64).astype(np.uint64), at // 64, -(-n // 64))
    unreached = ~unreached
    links, queue, fresh = [], [], 0
    while True:
        if not queue:
            while fresh < n and not (int(unreached[fresh // 64]) >> (fresh % 64)) & 1:
                fresh += 1
            if fresh == n:
                return links
            queue = [fresh]
            unreached[fresh // 64] &= ~(np.uint64(1) << np.uint64(fresh % 64))
        a = queue.pop()
        blocks = np.flatnonzero(unreached)
        hit = near(np.full(len(blocks), prints[a]), blocks, planes, ~unreached)
        for k in np.flatnonzero(hit):
            b0, h = int(blocks[k]) * 64, int(hit[k])
            unreached[blocks[k]] &= ~hit[k]
            while h:
                low = h & -h
                b = b0 + low.bit_length() - 1
                h ^= low
                links.append((a, b))
                queue.append(b)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of buckets; the input is sorted by bucket, which may reach over batches."""

    def done(prints: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.concatenate([[0], np.cumsum(size)])
        small = size <= LARGE
        parts = []
        if (small & (size > 1)).any():
            take = np.repeat(small & (size > 1), size)
            parts.append((prints[take], _small_buckets(prints[take], size[small & (size > 1)])))
        for k in np.flatnonzero(~small):
            p = prints[start[k] : start[k + 1]]
            parts.append((p, _large_bucket(p)))
        for p, links in parts:
            if links:
                ab = p.view(np.int64)[np.array(links)]
                yield pa.record_batch([pa.array(ab[:, 0]), pa.array(ab[:, 1])], schema=_LINKS)

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows < 1 << 16:
            continue
        prints, cut = _cut(held)
        if cut[-2] == 0:
            continue  # one bucket so far
        yield from done(prints[: cut[-2]], np.diff(cut[:-1]))
        held = [pa.Table.from_batches(held).slice(int(cut[-2])).combine_chunks().to_batches()[0]]
        rows = len(held[0])
    if held:
        prints, cut = _cut(held)
        yield from done(prints, np.diff(cut))


def _cut(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, and the offsets at which buckets begin, with the end."""
    t = pa.Table.from_batches(held)
    mask, key, part, fp = (t[c].to_numpy() for c in ("mask", "key", "part", "fp"))
    new = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])
    return fp.view(np.uint64), np.concatenate([[0], np.flatnonzero(new) + 1, [len(fp)]])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pieces(bits: list[int], n: int) -> list[int]:
    """``bits`` cut into n masks of about equal size."""
    edge = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(edge, edge[1:])]


def masks_for(n: int, room: int = 128) -> list[int]:
    """Bits that must agree, one mask per table, such that about ``room`` of n fingerprints share a bucket."""
    for pieces in range(RADIUS + 1, 2 * RADIUS + 1):
        agree = pieces - RADIUS
        if n <= room << (64 * agree // pieces) or pieces == 2 * RADIUS:
            return [reduce(int.__or__, c) for c in combinations(_pieces(list(range(64)), pieces), agree)]
    raise AssertionError


def simhash_links(prints: DataFrame, hot: int = HOT, room: int = 128) -> DataFrame:
    """(a, b): links between different fingerprints (column ``fp``, distinct) whose components are those of all pairs
    at ``RADIUS`` or fewer differing bits."""
    spark = prints.sparkSession
    n = prints.count()
    masks = masks_for(n, room)
    rows = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    ready: list[DataFrame] = []
    for depth in range(DEPTH + 1):
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"))
        big = cut_lineage(sizes.where(F.col("n") > hot))
        n_big = big.count()
        if not n_big:
            ready.append(rows.withColumn("part", F.lit(0)))
            break
        ready.append(rows.join(small_side(big, n_big), ["mask", "key"], "left_anti").withColumn("part", F.lit(0)))
        rows = rows.join(small_side(big, n_big), ["mask", "key"])
        if depth == DEPTH:
            # blocks by hash, every pair of blocks a company of its own
            side = F.ceil(F.col("n") * 2 / hot).cast("int")
            mine = F.pmod(F.xxhash64("fp"), side).cast("int")
            pair = F.transform(F.sequence(F.lit(0), side - 1), lambda k: F.least(k, mine) * side + F.greatest(k, mine))
            ready.append(rows.select("fp", "mask", "key", F.explode(pair).alias("part")))
        else:
            finer = spark.createDataFrame(
                [(_signed(m), [_signed(m | p) for p in _pieces([b for b in range(64) if not m >> b & 1], RADIUS + 1)]) for m in masks],
                "mask long, finer array<long>",
            )
            masks = sorted({m | p for m in masks for p in _pieces([b for b in range(64) if not m >> b & 1], RADIUS + 1)})
            rows = rows.join(F.broadcast(finer), "mask").select("fp", F.explode("finer").alias("mask")).distinct()
    dealt = reduce(DataFrame.unionByName, [r.select("mask", "key", "part", "fp") for r in ready])
    dealt = dealt.repartition("mask", "key", "part").sortWithinPartitions("mask", "key", "part")
    return dealt.mapInArrow(_bucket_links, "a long, b long").distinct()


def _members(prints: DataFrame) -> DataFrame:
    """(fp, component): smallest fingerprint reachable, for fingerprints with a link to another one."""
    links = cut_lineage(simhash_links(prints.select("fp").distinct()))
    return components(links).select(F.col("node").alias("fp"), "component")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    Links join fingerprints at 4 or fewer differing bits; a component's id is its smallest document id, missing only if
    no member has one. Missing and empty texts have fingerprint 0, linked like any other; a text of fewer than 4 words
    is one shingle; repeated shingles count each time. Repeated rows and ids give a row each. An empty table gives an
    empty result; other columns are not looked at.
    """
    prints = cut_lineage(texts(docs, id_col, text_col).select("doc_id", simhash("text").alias("fp")))
    one = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ends = one.join(_members(one), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named, n = cut_counting(ends.groupBy("component").agg(F.min("least").alias("component_id")), F.lit(True))
    by_print = looked_up(ends, named, "component", n, "fp").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component, the one with the smallest id (then the first row), all columns kept.
    ``docs`` must read the same rows in the same order twice, as tables in files do."""
    row, fp = free_name(docs, "row"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    prints = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), simhash(fp).alias("fp"), F.monotonically_increasing_id().alias("row")))
    best = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    one = prints.groupBy("fp").agg(F.min(best).alias("best"))
    ends = one.join(_members(one), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    keep = ends.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(keep, row, "left_semi").drop(row)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
