"""Byte-level BPE by a rank queue with a hierarchical bitmap.

The pieces that the pattern cuts a text into are merged one by one. Symbols form a linked list over byte positions; every
adjacent pair whose joined bytes have a rank is put in the bucket of that rank. A bitmap over the ranks, with a bitmap of
its non-zero words above it and one more above that, names the smallest rank in use by three find-first-set steps.
Entries whose pair has changed meanwhile are stale and skipped. So a piece of n bytes takes O(n log n), however long.
Pieces do not touch each other, so many of them go through one queue together.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muletrace.llm.base import portions

CACHE = 1 << 19  # pieces remembered
LONG = 64  # characters of a piece that is not worth remembering


def read_ranks(path: str) -> list[bytes]:
    """Bytes of every rank, from a file of base64 and rank lines; ranks run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class RankQueue:
    """Positions by rank. ``first`` names the smallest rank in use; its bucket is a heap, so the leftmost goes first."""

    def __init__(self, ranks: int):
        self.words = [0] * (ranks + 64 >> 6)
        self.groups = [0] * (len(self.words) + 64 >> 6)
        self.top = 0
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]

    def fill(self, rank: int, positions: list[int]) -> None:
        """Positions of a rank that has none yet, in ascending order."""
        self.buckets[rank] = positions
        word = rank >> 6
        self.words[word] |= 1 << (rank & 63)
        self.groups[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket:
            heappush(bucket, position)
        else:
            self.fill(rank, [position])

    def first(self) -> int:
        """The smallest rank in use, -1 if there is none."""
        top = self.top
        while top:
            group = (top & -top).bit_length() - 1
            bits = self.groups[group]
            word = group << 6 | (bits & -bits).bit_length() - 1
            bits = self.words[word]
            rank = word << 6 | (bits & -bits).bit_length() - 1
            if self.buckets[rank]:
                return rank
            self.words[word] &= bits - 1
            if not self.words[word]:
                self.groups[group] &= ~(1 << (word & 63))
                if not self.groups[group]:
                    self.top = top = top & (top - 1)
        return -1


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: r for r, t in enumerate(tokens)}
        self.pieces = regex.compile(pattern).findall
        self.queue = RankQueue(len(tokens))
        self.pairs = np.full(1 << 16, -1, np.int64)
        for t, r in self.rank.items():
            if len(t) == 2:
                self.pairs[t[0] << 8 | t[1]] = r
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pieces. They share one queue: whichever has the smallest rank goes on, none past its edges."""
        text = b"".join(pieces)
        n, rank, queue = len(text), self.rank.get, self.queue
        ends = np.cumsum([len(p) for p in pieces])
        edge = bytearray(n + 1)
        edge[0] = 1
        for e in ends.tolist():
            edge[e] = 1
        after = list(range(1, n + 1))  # start of the next symbol
        before = list(range(-1, n - 1))
        data = np.frombuffer(text, np.uint8).astype(np.int64)
        ranks = np.full(n, -1)
        ranks[:-1] = self.pairs[data[:-1] << 8 | data[1:]]
        ranks[ends[ends > 0] - 1] = -1
        pending = ranks.tolist()  # rank of the pair that starts at a symbol; -1: none, or no symbol starts here
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        cuts = np.flatnonzero(np.diff(ranks[order], prepend=-1))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            queue.fill(int(ranks[order[a]]), order[a:z].tolist())
        buckets, push = queue.buckets, queue.push
        while (r := queue.first()) >= 0:
            bucket = buckets[r]
            while bucket:
                a = heappop(bucket)
                if pending[a] != r:
                    continue  # stale
                b = after[a]
                c = after[b]
                after[a] = c
                pending[b] = -1
                if c < n:
                    before[c] = a
                lowest = r
                if edge[c]:
                    pending[a] = -1
                elif (x := rank(text[a : after[c]])) is None:
                    pending[a] = -1
                else:
                    pending[a] = x
                    push(x, a)
                    lowest = x
                if not edge[a]:
                    p = before[a]
                    if (x := rank(text[p:c])) is None:
                        pending[p] = -1
                    else:
                        pending[p] = x
                        push(x, p)
                        if x < lowest:
                            lowest = x
                if lowest < r:
                    break  # the rest of the bucket waits for the new pair
        out, k = [], 0
        for e in ends.tolist():
            ids = []
            while k < e:
                ids.append(self.rank[text[k : after[k]]])
                k = after[k]
            out.append(pack(f"<{len(ids)}I", *ids))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers. Pieces met before are remembered, up to a bound."""
        cut = [self.pieces(t) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if new:
            self.known.update(zip(new, self.merge([p.encode("utf-8", "replace") for p in new])))
        out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        if len(self.known) > CACHE:
            self.known = {}
        else:
            for p in new:
                if len(p) > LONG:
                    del self.known[p]
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(SparkFiles.get(path)), pattern)


class ByteBpe:
    """Column functions of one vocabulary. The rank file goes to the executors with the session's files."""

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str):
        spark.sparkContext.addFile(rank_file)
        name = rank_file.rpartition("/")[2]

        @F.arrow_udf(T.BinaryType())
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            e = _encoder(name, pattern)
            for b in portions(batches):
                yield pa.array(e.encode([t or "" for t in b.to_pylist()]), pa.binary())

        @F.arrow_udf(T.BinaryType())
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            e = _encoder(name, pattern)
            for b in portions(batches):
                yield pa.array([e.decode(t.as_py() or b"") for t in b], pa.binary())

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        """Token ids of a text, packed as little-endian unsigned 32-bit integers; a missing or empty text has none."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """The bytes that packed ids stand for."""
        return self._decode(ids)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
