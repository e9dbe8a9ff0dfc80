"""Exact top-k search by inner product with an M-tree, searched best first.

Largest inner product is made a nearest-neighbour question in a metric: every vector x gets one more component,
sqrt(M * M - |x| * |x|) with M the largest length of all, and a query gets 0 there. Then d(q, x) ** 2 = |q| ** 2 + M ** 2
- 2 q.x, and the triangle inequality holds for queries and rows alike.

The tree is a table of entries, one row each. The regions of the top level are Voronoi cells of sampled rows; a region's
rows are dealt into slices that fit a task, and each slice becomes a subtree of pages: a page's entries carry the
distance to the page's routing vector, entries of inner pages also a child page and its covering radius. Subtrees are
built from the sorted slices and written once.

A search first looks through the query's home slice, whose k-th best score bounds what other regions can add, then
through the slices of all regions whose covering ball reaches inside that bound. In a slice a queue hands out pages by
their least possible distance; an entry is only compared with the query when its stored parent distance does not rule it
out. Bounds give way by ``SLACK``; the scores compared are exact whole numbers, so results are exact, with ties.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muletrace.llm.base import cut_lineage, hash_share
from muletrace.llm.vectors import SLACK, Best, grouped, lengths, matrix, past_blocks, scores, whole_vectors

SLICE_ROWS = 16_384
REGION_ROWS = 4_096
REGION_BYTES = 16 << 20  # of sampled vectors, broadcast
PAGE = 256


def _distances(a: np.ndarray, b: np.ndarray, top: float) -> np.ndarray:
    """Between rows, all with their last component."""
    last = lambda m: np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", m, m), 0.0))
    return np.sqrt(np.maximum(2 * top * top - 2 * (a @ b.T + np.outer(last(a), last(b))), 0.0))


def _pages(ids: list[list[int]], m: np.ndarray, routing: np.ndarray, top: float) -> Iterator[tuple]:
    """Bulk load: (page, child, v, dist, radius, ids) per entry; page 0 is the root, its routing vector given."""
    todo, n_pages = [(0, np.arange(len(m)), routing)], 1
    while todo:
        page, rows, centre = todo.pop()
        if len(rows) <= PAGE:
            dist = _distances(m[rows], centre[None], top)[:, 0]
            yield from ((page, -1, m[r], d, 0.0, ids[r]) for r, d in zip(rows, dist.tolist()))
            continue
        chosen = rows[np.unique(np.linspace(0, len(rows) - 1, min(PAGE, -(-2 * len(rows) // PAGE))).astype(int))]
        away = _distances(m[rows], m[chosen], top)
        near = away.argmin(axis=1)
        if (np.bincount(near, minlength=len(chosen)) == len(rows)).any():  # too close to tell apart: by position
            near = np.arange(len(rows)) * len(chosen) // len(rows)
        dist = _distances(m[chosen], centre[None], top)[:, 0].tolist()
        for c, at in enumerate(chosen):
            mine = near == c
            if mine.any():
                yield page, n_pages, m[at], dist[c], float(away[mine, c].max()), None
                todo.append((n_pages, rows[mine], m[at]))
                n_pages += 1


class Index:
    """An M-tree over the rows of a table. ``entries`` is its table of pages, ``regions`` the bounded top level."""

    def __init__(self, rows: DataFrame, k: int):
        """``rows(vec_id, row, v)`` as :func:`whole_vectors` gives them. A page's entry stands for all rows of one vector in
        its slice and holds the ``k + 1`` smallest ids of them: no more can be among the k best of any query."""
        self.spark, self.k = rows.sparkSession, k
        square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
        n, top, dim = rows.agg(F.count(F.lit(1)), F.sqrt(F.max(square)), F.max(F.size("v"))).first()
        self.n, self.top = n, (top or 0.0) * (1 + 1e-12)
        wanted = max(1, min(-(-n // REGION_ROWS), REGION_BYTES // (8 * max(1, dim or 0))))
        some = rows.where(hash_share(F.col("row"), 4 * wanted, n)).orderBy(F.xxhash64("row", F.lit(7)), "row").limit(wanted)
        picked = [r.v for r in some.select("v").collect()] or [r.v for r in rows.limit(1).select("v").collect()]
        self.regions = np.unique(matrix(picked), axis=0) if picked else np.zeros((0, 0))
        self._shared = self.spark.sparkContext.broadcast(self.regions)
        placed = cut_lineage(self._placed(rows))
        sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"))
        self.radius, self.slices = np.zeros(len(self.regions)), np.zeros(len(self.regions), dtype=np.int64)
        for r in sizes.collect():  # no more rows than there are regions
            self.radius[r.region], self.slices[r.region] = r.radius, -(-r.n // SLICE_ROWS)
        counts = [(k, int(s)) for k, s in enumerate(self.slices) if s]
        self._counts = F.broadcast(self.spark.createDataFrame(counts, "region int, slices int"))
        self.entries = cut_lineage(self._built(self._sliced(placed)))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """With the nearest region and the distance to its centre."""
        shared, top = self._shared, self.top

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for a in range(0, len(f), 256):
                    some = f.iloc[a : a + 256]
                    away = _distances(matrix(some.v), shared.value, top)
                    near = away.argmin(axis=1)
                    yield some.assign(region=near.astype(np.int32), dist=away[np.arange(len(some)), near])

        return rows.select("vec_id", "row", "v").mapInPandas(run, "vec_id long, row long, v array<double>, region int, dist double")

    def _sliced(self, placed: DataFrame) -> DataFrame:
        """A region's rows dealt by hash into as many slices as its count asks for."""
        slice_ = F.pmod(F.xxhash64("row"), F.coalesce("slices", F.lit(1))).cast("int")
        return placed.join(self._counts, "region", "left").withColumn("slice", slice_).drop("slices")

    def _built(self, sliced: DataFrame) -> DataFrame:
        shared, top, k = self._shared, self.top, self.k

        def tree(key: tuple, held: list[pd.DataFrame]) -> pd.DataFrame:
            f = pd.concat(held)
            distinct, which = np.unique(matrix(f.v), axis=0, return_inverse=True)
            ids: list[list[int]] = [[] for _ in distinct]
            for w, i in sorted(zip(which.ravel().tolist(), f.vec_id.tolist())):
                if len(ids[w]) <= k:
                    ids[w].append(i)
            mixed = np.random.default_rng(7).permutation(len(distinct))  # routing vectors are taken by position
            made = _pages([ids[w] for w in mixed], distinct[mixed], shared.value[key[0]], top)
            out = pd.DataFrame(made, columns=["page", "child", "v", "dist", "radius", "ids"])
            return out.assign(region=key[0], slice=key[1])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, here = [], None
            for key, rows in grouped(frames, ["region", "slice"]):
                if key != here and held:
                    yield tree(here, held)
                    held = []
                here = key
                held.append(rows)
            if held:
                yield tree(here, held)

        dealt = sliced.select("region", "slice", "vec_id", "v").repartition("region", "slice").sortWithinPartitions("region", "slice")
        schema = "region int, slice int, page int, child int, v array<double>, dist double, radius double, ids array<long>"
        return dealt.mapInPandas(run, schema)

    def _reached(self, queries: DataFrame) -> DataFrame:
        """``queries(row, ..., v, floor, home_region, home_slice)`` with (region, slice) for every slice but the home one
        that may hold a score of ``floor`` or more."""
        shared, top, radius, slices = self._shared, self.top, self.radius, self.slices

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for a in range(0, len(f), 256):
                    some = f.iloc[a : a + 256]
                    q = matrix(some.v)
                    qq = np.einsum("ij,ij->i", q, q)
                    away = np.sqrt(np.maximum(qq[:, None] + top * top - 2 * q @ shared.value.T, 0.0))
                    reach = _reach(qq, some.floor.to_numpy(dtype=float), top)
                    hit = (away - radius <= (reach + SLACK * (np.sqrt(qq) + top))[:, None]) & (slices > 0)
                    yield some.assign(regions=[[{"region": int(r), "away": float(d[r])} for r in np.flatnonzero(h)] for h, d in zip(hit, away)])

        kinds = ", ".join(f"`{c}` {t}" for c, t in queries.dtypes)
        found = queries.mapInPandas(run, f"{kinds}, regions array<struct<region:int,away:double>>").select("*", F.inline("regions")).drop("regions")
        found = found.join(self._counts, "region").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        return found.where((F.col("region") != F.col("home_region")) | (F.col("slice") != F.col("home_slice")))

    def _asked(self, asks: DataFrame) -> DataFrame:
        top, k = self.top, self.k

        def answer(tree: _Subtree, f: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row, own, v, floor, away in zip(f.row, f.query_id, f.v, f.floor, f.away):
                least, away = None if pd.isna(floor) else int(floor), None if pd.isna(away) else float(away)
                out += [(row, own, i, s) for s, i in tree.search(np.asarray(v, dtype=float), int(own), k, least, away)]
            return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"])

        return past_blocks(
            self.entries,
            asks.select("region", "slice", "row", "query_id", "v", "floor", "away"),
            ["region", "slice"],
            ["page"],
            lambda f: _Subtree(f, top),
            answer,
            "row long, query_id long, vec_id long, score long",
        )

    def search(self, queries: DataFrame) -> DataFrame:
        """(row, query_id, rank, vec_id, score) for ``queries(row, query_id, v)``; rows with the query's own id stand out."""
        if not self.n:
            return queries.select("row", "query_id", *[F.lit(None).cast(t).alias(c) for c, t in (("rank", "int"), ("vec_id", "long"), ("score", "long"))]).limit(0)
        placed = self._sliced(self._placed(queries.withColumnRenamed("query_id", "vec_id")))
        home = cut_lineage(placed.withColumnsRenamed({"vec_id": "query_id", "region": "home_region", "slice": "home_slice"}))
        at_home = home.select(F.col("home_region").alias("region"), F.col("home_slice").alias("slice"), "row", "query_id", "v", *[F.lit(None).cast(t).alias(c) for c, t in (("floor", "long"), ("away", "double"))])
        first = cut_lineage(self._asked(at_home))
        full = first.groupBy("row").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == self.k)
        asks = self._reached(home.join(full.select("row", "floor"), "row", "left").drop("dist"))
        found = first.unionByName(self._asked(asks))
        by = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= self.k)
        return best.select("row", "query_id", "rank", "vec_id", "score")


def _reach(qq, floor, top: float):
    """The distance of a row whose score is ``floor``; without a floor any distance will do."""
    far = np.sqrt(np.maximum(qq + top * top - 2 * floor, 0.0))
    return np.where(np.isnan(floor), np.inf, far)


class _Subtree:
    """The pages of a slice, in a task."""

    def __init__(self, f: pd.DataFrame, top: float):
        self.top, self.pages = top, {}
        for page, e in f.groupby("page", sort=False):
            m = matrix(e.v)
            flat = None
            if int(e.child.iloc[0]) < 0:
                size = [len(i) for i in e.ids]
                flat = (np.repeat(np.arange(len(e)), size), np.concatenate([np.asarray(i, dtype=np.int64) for i in e.ids]))
            self.pages[int(page)] = (m, e.child.to_numpy(), e.dist.to_numpy(), e.radius.to_numpy(), flat, float(lengths(m).max(initial=0.0)))
        self.compared = 0

    def search(self, q: np.ndarray, own: int, k: int, floor: int | None = None, away_root: float | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) of at least ``floor`` whose id is not ``own``; ``away_root``: distance to the region's centre."""
        qq, best = float(q @ q), Best(k, floor)
        give = SLACK * (math.sqrt(qq) + self.top)
        square = qq + self.top * self.top
        away = lambda least: math.inf if least is None else math.sqrt(max(square - 2.0 * least, 0.0)) + give
        queue = [(0.0, 0, away_root)]
        while queue:
            low, page, from_parent = heapq.heappop(queue)
            reach = away(best.least())
            if low > reach:
                break
            m, child, dist, radius, flat, longest = self.pages[page]
            use = np.arange(len(m))
            if from_parent is not None and reach < math.inf:
                use = np.flatnonzero(np.abs(from_parent - dist) - radius <= reach)
            self.compared += len(use)
            if flat is not None:
                score = np.zeros(len(m), dtype=np.int64)
                score[use] = scores(m[use], q, longest)
                near = np.zeros(len(m), dtype=bool)
                near[use] = True
                entry, ids = flat
                named = near[entry] & (ids != own)
                best.add(score[entry[named]], ids[named])
                continue
            d = np.sqrt(np.maximum(square - 2.0 * (m[use] @ q), 0.0))
            least = np.maximum(d - radius[use], 0.0)
            for at in np.flatnonzero(least <= reach):
                heapq.heappush(queue, (float(least[at]), int(child[use[at]]), float(d[at])))
        return best.found


def top_k(rows: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product for every row whose id ``every`` divides.

    Components become floor(256 * x). Vectors that are null, or hold a null or non-finite component, take no part, nor do
    rows without an id; missing ends of shorter vectors are 0. Rows with the query's own id are never its results; other
    repeated ids are results of their own. Query rows that repeat an id are each answered. Ties go to the smaller id. With
    fewer than k others all are returned; an empty table gives an empty result; other columns are not looked at.
    """
    named = rows.where(F.col(id_col).isNotNull())
    clean = whole_vectors(named, vec_col, F.col(id_col).cast("long").alias("vec_id"))
    queries = clean.where(F.col("vec_id") % every == 0).select("row", F.col("vec_id").alias("query_id"), "v")
    return Index(clean, k).search(queries).drop("row")
