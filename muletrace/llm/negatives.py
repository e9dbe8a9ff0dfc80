"""Hard negatives by shared lists: anchors of a cluster walk one list of candidates ordered by an angular upper bound.

Anchors are clustered by direction. For a cluster with centre c and widest angle b between c and a member, no member u can
score candidate i above |u| * |i| * cos(max(0, angle(c, i) - b)). So the candidates are sorted by |i| * cos(...) once per
cluster, and every member walks that order, computing exact scores, until the bound of what is left lies below what it
still needs: that certifies its result.

A list is kept in blocks of candidates that fit a task; a task sorts its block once for every cluster whose members come
along, and the members' results of all blocks are merged. The positives of an anchor are looked for in the blocks of its
own label, the negatives in blocks of all candidates, with the window that the positives set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muletrace.llm.base import cut_lineage, hash_share
from muletrace.llm.vectors import SLACK, Best, lengths, matrix, past_blocks, scores, whole_vectors

BLOCK_ROWS = 8_192
CLUSTERS = 64
FIT_ROWS = 4_096  # anchors that cluster centres are fitted on
STEP = 512  # candidates of a list looked at in one go
TURNS = 12


def _directions(m: np.ndarray) -> np.ndarray:
    size = lengths(m)[:, None]
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def fit_centres(m: np.ndarray, most: int = CLUSTERS) -> np.ndarray:
    """Unit centres by k-means on directions, for at most one cluster per 16 vectors."""
    m = np.unique(_directions(m), axis=0)
    centres = m[np.random.default_rng(11).permutation(len(m))[: max(1, min(most, len(m) // 16))]]
    for _ in range(TURNS):
        near = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        moved = _directions(sums)
        centres = np.where((lengths(moved) > 0)[:, None], moved, centres)
    return centres


class _Block:
    """A block of candidates with the list of one cluster at a time."""

    def __init__(self, f: pd.DataFrame, centres: np.ndarray, widest: np.ndarray):
        self.m, self.ids, self.centres, self.widest = matrix(f.v), f.vec_id.to_numpy(), centres, widest
        self.labels, names = pd.factorize(f.label)
        self.code = {n: c for c, n in enumerate(names)}
        self.size, self.unit = lengths(self.m), _directions(self.m)
        self.longest, self.cluster, self.walked = float(self.size.max(initial=0.0)), None, 0

    def shared_list(self, cluster: int) -> None:
        """Sorts the candidates for a cluster, unless its list is the one at hand."""
        if cluster == self.cluster:
            return
        apart = _angles(self.unit, self.centres[cluster][None])[:, 0] - self.widest[cluster]
        bound = self.size * np.cos(np.maximum(apart, 0.0)) + SLACK * self.size
        self.order = np.argsort(-bound, kind="stable")
        self.cluster, self.bound = cluster, bound[self.order]


class _Walk:
    """One member's way along the list, as far as it goes."""

    def __init__(self, block: _Block, u: np.ndarray):
        self.block, self.u, self.size, self.at = block, u, float(np.sqrt(u @ u)), 0

    def certified(self, needed: int | None) -> bool:
        """Whether nothing that is left can score ``needed``; None: anything will do."""
        if self.at >= len(self.block.order):
            return True
        return needed is not None and float(self.block.bound[self.at]) * self.size < needed

    def step(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact scores, ids and label codes of the next candidates."""
        b, some = self.block, self.block.order[self.at : self.at + STEP]
        self.at += STEP
        b.walked += len(some)
        return scores(b.m[some], self.u, b.longest), b.ids[some], b.labels[some]


def best_alike(block: _Block, u: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of a block of one label, the member's own id aside."""
    best, walk = Best(k), _Walk(block, u)
    while not walk.certified(best.least()):
        score, ids, _ = walk.step()
        best.add(score[ids != own], ids[ids != own])
    return best.found


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def best_unlike(block: _Block, u: np.ndarray, label: object, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For every window the k best (score, id) inside it whose label is another."""
    best, walk, code = [Best(k, low) for low, _ in windows], _Walk(block, u), block.code.get(label, -1)
    while not walk.certified(min(b.least() for b in best)):
        score, ids, labels = walk.step()
        other = labels != code
        score, ids = score[other], ids[other]
        for b, (_, high) in zip(best, windows):
            b.add(score[score <= high], ids[score <= high])
    return [b.found for b in best]


def _clustered(anchors: DataFrame) -> tuple[DataFrame, object, object]:
    """Anchors with their cluster; broadcasts of the centres and of every cluster's widest angle."""
    spark, n = anchors.sparkSession, anchors.count()
    some = anchors.where(hash_share(F.col("row"), 2 * FIT_ROWS, n)).orderBy(F.xxhash64("row", F.lit(7)), "row").limit(FIT_ROWS)
    picked = [r.v for r in some.select("v").collect()] or [r.v for r in anchors.limit(1).select("v").collect()]
    centres = spark.sparkContext.broadcast(fit_centres(matrix(picked)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            apart = _angles(_directions(matrix(f.v)), centres.value)
            near = apart.argmin(axis=1) if len(f) else np.zeros(0, dtype=int)
            yield f.assign(cluster=near.astype(np.int32), apart=apart[np.arange(len(f)), near])

    kinds = ", ".join(f"`{c}` {t}" for c, t in anchors.dtypes)
    placed = cut_lineage(anchors.mapInPandas(run, f"{kinds}, cluster int, apart double"))
    widest = np.zeros(len(centres.value))
    for r in placed.groupBy("cluster").agg(F.max("apart").alias("apart")).collect():  # CLUSTERS rows at most
        widest[r.cluster] = r.apart + SLACK
    return placed.drop("apart"), centres, spark.sparkContext.broadcast(widest)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ``rank`` from 1 for every anchor and positive.

    Scores are inner products of floor(256 * x). An anchor's positives are the best other rows of its label; for each, the
    best rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's are returned, none where the
    window is empty (as for negative scores). Rows without id, label or vector, or with a null or non-finite component, take
    no part; missing ends of shorter vectors are 0. Rows with the anchor's own id are never its positives; other
    repeated ids count each; anchors that repeat an id are each answered. Ties go to the smaller id. An empty table
    gives an empty result; columns of other names are not looked at. ``is_anchor`` sees ``vec_id``.
    """
    named = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    ident = F.col(id_col).cast("long").alias("vec_id")
    clean = whole_vectors(named, vec_col, ident, F.col(label_col).cast("string").alias("label"))
    n = clean.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    anchors = clean.where(is_anchor).select("row", F.col("vec_id").alias("anchor_id"), "label", "v")
    if anchors.isEmpty():
        return rows.sparkSession.createDataFrame([], schema)
    anchors, centres, widest = _clustered(anchors)
    build = lambda f: _Block(f, centres.value, widest.value)

    def answer_alike(block: _Block, f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, own, cluster, v in zip(f.row, f.anchor_id, f.cluster, f.v):
            block.shared_list(int(cluster))
            out += [(row, i, s) for s, i in best_alike(block, np.asarray(v, dtype=float), int(own), positives)]
        return pd.DataFrame(out, columns=["row", "positive_id", "positive_score"])

    sized = clean.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = clean.join(sized, "label").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    asks = anchors.join(sized, "label").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    alike = past_blocks(
        dealt.select("label", "block", "vec_id", "v"),
        asks.select("label", "block", "row", "anchor_id", "cluster", "v"),
        ["label", "block"],
        ["cluster"],
        build,
        answer_alike,
        "row long, positive_id long, positive_score long",
    )
    by = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    first = alike.withColumn("at", F.row_number().over(by)).where(F.col("at") <= positives)
    firsts = first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "positive_id", "positive_score"))).alias("first"))
    wanting = cut_lineage(anchors.join(firsts, "row"))

    def answer_unlike(block: _Block, f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, own, cluster, v, label, first in zip(f.row, f.anchor_id, f.cluster, f.v, f.label_, f["first"]):
            windows = [(p, window(p["positive_score"], low, high)) for p in first]
            windows = [(p, w) for p, w in windows if w[0] <= w[1]]
            if windows:
                block.shared_list(int(cluster))
                found = best_unlike(block, np.asarray(v, dtype=float), label, [w for _, w in windows], negatives)
                out += [(row, own, p["at"], p["positive_id"], i, p["positive_score"], s) for (p, _), b in zip(windows, found) for s, i in b]
        return pd.DataFrame(out, columns=["row", "anchor_id", "at", "positive_id", "negative_id", "positive_score", "negative_score"])

    blocks = -(-n // BLOCK_ROWS)
    unlike = past_blocks(
        clean.select("vec_id", "label", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")),
        wanting.select("row", "anchor_id", F.col("label").alias("label_"), "cluster", "v", "first", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")),
        ["block"],
        ["cluster"],
        build,
        answer_unlike,
        "row long, anchor_id long, at int, positive_id long, negative_id long, positive_score long, negative_score long",
    )
    by = Window.partitionBy("row", "at").orderBy(F.desc("negative_score"), "negative_id")
    ranked = unlike.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
