"""What the searches over vectors share: whole-number vectors, exact inner products, groups of rows streamed past a block."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muletrace.llm.base import cut_lineage

EXACT = float(1 << 53)  # whole numbers below this are exact as doubles, sums in any order included
MOST = (1 << 63) - 1
SCALE = 256
SLACK = 1e-6  # of the lengths involved, for what rounding may do to a bound; scores themselves are exact


def whole_vectors(rows: DataFrame, vec_col: str, *more, scale: int = SCALE) -> DataFrame:
    """``more`` and ``v``: floor(scale * x) of every component x, as doubles, all of one length (missing ends are 0).

    Vectors that are null or hold a null or non-finite component (scaled ones included) leave. Written once, since later
    steps read it several times. ``row`` is a number of the row's own.
    """
    x = F.transform(F.col(vec_col).cast("array<double>"), lambda c: c * scale)
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))
    kept = rows.select(*more, x.alias("v")).where(F.col("v").isNotNull()).where(~odd)
    # beyond 2^53 every double is whole, and Spark's floor would stop at the largest long
    floor = F.transform("v", lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c))
    kept = cut_lineage(kept.withColumn("v", floor).withColumn("row", F.monotonically_increasing_id()))
    least, most = kept.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        kept = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("v"))))
    return kept


def matrix(vectors) -> np.ndarray:
    """Vectors of one length as the rows of an array."""
    vectors = list(vectors)
    return np.array(vectors, dtype=np.float64).reshape(len(vectors), -1 if vectors and len(vectors[0]) else 0)


def lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m, m))


def scores(m: np.ndarray, u: np.ndarray, longest: float) -> np.ndarray:
    """Exact inner products of the rows of ``m``, none longer than ``longest``, with ``u``. Past the range of a long they
    stay at its end, so scores there count as ties."""
    if longest * math.sqrt(float(u @ u)) < EXACT:
        return (m @ u).astype(np.int64)
    v = [int(c) for c in u]
    exact = (sum(int(a) * b for a, b in zip(r, v)) for r in m)
    return np.array([max(-MOST - 1, min(MOST, s)) for s in exact], dtype=np.int64)


def grouped(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of equal keys in sorted batches, one piece per batch and key: (key, rows)."""
    for f in frames:
        if not len(f):
            continue
        codes = f[key].to_numpy()
        cut = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1).tolist(), len(f)]
        for a, z in zip(cut, cut[1:]):
            yield tuple(codes[a].tolist()), f.iloc[a:z]


def past_blocks(
    items: DataFrame,
    asks: DataFrame,
    key: list[str],
    order: list[str],
    build: Callable[[pd.DataFrame], object],
    answer: Callable[[object, pd.DataFrame], pd.DataFrame],
    schema: str,
    per_task: int = 65_536,
) -> DataFrame:
    """Every ask meets the items of its key: ``answer(build(items of the key), some asks of the key)``.

    The items of a key must fit a task, as the callers see to; asks need not: they are streamed past what was built. A key
    with more asks than ``per_task`` is split into parts that each get the items again. Both sides travel in one exchange,
    sorted so that a key's items come first.
    """
    n_asks = asks.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    left = items.join(n_asks, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = asks.join(n_asks, key).withColumn("part", part).drop("parts")
    both = left.withColumn("asking", F.lit(0)).unionByName(right.withColumn("asking", F.lit(1)), allowMissingColumns=True)
    at = [*key, "part"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, here, built = [], None, None
        for (*k, asking), rows in grouped(frames, [*at, "asking"]):
            if k != here:
                held, here, built = [], k, None
            if not asking:
                held.append(rows)
                continue
            if built is None and held:
                built = build(pd.concat(held))
                held = []
            if built is not None:
                yield answer(built, rows)

    dealt = both.repartition(*at).sortWithinPartitions(*at, "asking", *order)
    return dealt.mapInPandas(run, schema)


class Best:
    """The first ``k`` of the (score, id) pairs seen: larger scores first, then smaller ids."""

    def __init__(self, k: int, floor: int | None = None):
        self.k, self.floor, self.found = k, floor, []

    def least(self) -> int | None:
        """A score below this is of no use; None while any is."""
        return self.found[-1][0] if len(self.found) == self.k else self.floor

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        low = self.least()
        if low is not None:
            use = score >= low
            score, ids = score[use], ids[use]
        if len(score) > self.k:
            use = np.lexsort((ids, -np.maximum(score, -MOST)))[: self.k]
            score, ids = score[use], ids[use]
        self.found = sorted([*self.found, *zip(score.tolist(), ids.tolist())], key=lambda p: (-p[0], p[1]))[: self.k]
