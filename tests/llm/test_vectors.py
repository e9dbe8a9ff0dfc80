"""Top-k search and hard negatives against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from muletrace.llm import mtree, negatives, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, row long, v string, region int, score double"


def _clustered(r, n, dim=8, centres=12, spread=0.05):
    return r.normal(size=(centres, dim))[r.integers(0, centres, n)] + spread * r.normal(size=(n, dim))


def _rows(seed=3, n=400):
    """Clusters, a third of copies of one vector, nulls of every kind, repeated ids, zero and huge vectors."""
    r = np.random.default_rng(seed)
    m = _clustered(r, n)
    m[: n // 3] = m[0]
    out = [(k, [float(np.float32(x)) for x in v], int(r.integers(0, 4))) for k, v in enumerate(m)]
    some = out[5][1]
    out += [(1000, None, 1), (1001, [1.0, None] + some[2:], 1), (1002, [float("nan")] + some[1:], 1), (1003, [float("inf")] + some[1:], 1)]
    out += [(1050, [0.0] * 8, 1), (1100, [], 2), (1150, [1.0, 2.0], 3), (1200, [3e30] * 8, 0), (1201, [3e30] * 8, 1), (None, some, 1)]
    out += [(7, some, 0), (1250, some, None)]
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(*t, 1, "x", 2, 0.5) for t in rows], SCHEMA).repartition(3)


def _whole(rows):
    """(id, exact whole numbers, label) of the rows that take part."""
    out = []
    for i, v, label in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        out.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label))
    return out


def _dot(a, b):
    return max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))


def _top(rows, k=5):
    clean, out = _whole(rows), []
    for q, u, _ in clean:
        if q % 50 == 0:
            best = sorted((-_dot(u, v), i) for i, v, _ in clean if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def _found(df, names):
    return sorted(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("slice_rows,region_rows", [(16_384, 4_096), (20, 40)])
def test_top_k(spark, monkeypatch, slice_rows, region_rows):
    monkeypatch.setattr(mtree, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(mtree, "REGION_ROWS", region_rows)
    rows = _rows()
    got = mtree.top_k(_frame(spark, rows))
    assert _found(got, ["query_id", "rank", "vec_id", "score"]) == _top(rows)


def test_top_k_of_few_and_none(spark):
    names = ["query_id", "rank", "vec_id", "score"]
    few = [(0, [1.0, 0.5], 1), (50, [0.5, 0.5], 1), (3, [1.0, 0.5], 1)]
    assert _found(mtree.top_k(_frame(spark, few)), names) == _top(few)
    assert mtree.top_k(_frame(spark, [])).count() == 0
    assert mtree.top_k(_frame(spark, [(1, None, 1)])).count() == 0
    assert mtree.top_k(_frame(spark, [(0, [1.0], 1)])).count() == 0


def _subtree(m, ids, k=5):
    top = float(vectors.lengths(m).max())
    centre = m[0]
    f = pd.DataFrame(list(mtree._pages([[i] for i in ids], m, centre, top)), columns=["page", "child", "v", "dist", "radius", "ids"])
    return mtree._Subtree(f, top), f, top


def test_pages_cover_their_entries():
    r = np.random.default_rng(5)
    m = np.unique(np.floor(256 * _clustered(r, 3000, dim=6)), axis=0)
    _, f, top = _subtree(m, range(len(m)))
    assert f.groupby("page").size().max() <= mtree.PAGE
    assert sorted(i for x in f.ids if x is not None for i in x) == list(range(len(m)))
    by_page = {p: e for p, e in f.groupby("page")}

    def below(page):
        e = by_page[page]
        return np.concatenate([vectors.matrix([v]) if c < 0 else below(c) for v, c in zip(e.v, e.child)])

    for page, e in by_page.items():
        for v, child, radius in zip(e.v, e.child, e.radius):
            if child >= 0:
                assert mtree._distances(below(child), np.asarray(v)[None], top).max() <= radius + 1e-6 * top
                # entries of the child page know their distance to its routing vector
                away = mtree._distances(vectors.matrix(by_page[child].v), np.asarray(v)[None], top)[:, 0]
                assert np.allclose(away, by_page[child].dist)


def test_bounds_spare_comparisons():
    r = np.random.default_rng(6)
    m = np.unique(np.floor(256 * _clustered(r, 8000, dim=6, centres=40, spread=0.01)), axis=0)
    m = np.floor(m * (5000 / vectors.lengths(m))[:, None])  # of nearly one length, as embeddings are
    tree, _, _ = _subtree(m, range(len(m)))
    for q in range(0, len(m), 500):
        s = (m @ m[q]).astype(int)
        want = [(int(s[i]), int(i)) for i in np.lexsort((np.arange(len(m)), -s)) if i != q][:5]
        assert tree.search(m[q], q, 5) == want
    assert tree.compared < 0.3 * len(m) * len(range(0, len(m), 500))


def _hard(rows):
    clean, out = [(i, v, x) for i, v, x in _whole(rows) if x is not None], []
    for a, u, label in clean:
        if a % 50:
            continue
        alike = sorted((-_dot(u, v), i) for i, v, x in clean if x == label and i != a)[:5]
        other = sorted((-_dot(u, v), i) for i, v, x in clean if x != label)
        for p, i in alike:
            use = [(s, j) for s, j in other if 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(use)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [8_192, 40])
def test_hard_negatives(spark, monkeypatch, block_rows):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block_rows)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = _rows(4)
    got = negatives.hard_negatives(_frame(spark, rows), F.col("vec_id") % 50 == 0)
    assert _found(got, names) == _hard(rows)
    if block_rows > 40:
        assert negatives.hard_negatives(_frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
        one = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 2), (3, [-1.0, 0.0], 2)]  # a window of the score 0 alone
        assert _found(negatives.hard_negatives(_frame(spark, one), F.col("vec_id") % 50 == 0), names) == [(0, 1, 1, 2, 0, 0)] == _hard(one)


def test_walks_end_early_and_are_certified():
    r = np.random.default_rng(9)
    m = np.floor(256 * _clustered(r, 6000, dim=6, centres=40, spread=0.02))
    ids, labels = np.arange(len(m)), r.integers(0, 3, len(m)).astype(str)
    centres = negatives.fit_centres(m[::50])
    unit = negatives._directions(m)
    apart = negatives._angles(unit[::50], centres)
    near = apart.argmin(axis=1)
    widest = np.array([apart[near == c, c].max(initial=0.0) + 1e-6 for c in range(len(centres))])
    block = negatives._Block(pd.DataFrame({"v": list(m), "vec_id": ids, "label": labels}), centres, widest)
    anchors = list(range(0, len(m), 50))
    for n, a in sorted(enumerate(anchors), key=lambda p: near[p[0]]):
        block.shared_list(int(near[n]))
        # no member of the cluster scores a candidate above its bound
        assert ((m @ m[a])[block.order] <= block.bound * np.sqrt(m[a] @ m[a]) + 1e-6).all()
        s = (m @ m[a]).astype(int)
        want = [(int(s[i]), int(i)) for i in np.lexsort((ids, -s)) if i != a][:5]
        assert negatives.best_alike(block, m[a], a, 5) == want
    assert block.walked < 0.5 * len(m) * len(anchors)


def test_scores_are_exact_and_stay_in_range():
    m = np.array([[2.0**52 + 1, 3.0], [2.0**70, 1.0], [-(2.0**70), 1.0]])
    got = vectors.scores(m, np.array([2.0**30, 1.0]), float(vectors.lengths(m).max()))
    assert got.tolist() == [vectors.MOST, vectors.MOST, -vectors.MOST - 1]
    u = np.array([3.0, 1.0])
    assert vectors.scores(m[:1], u, float(vectors.lengths(m[:1]).max())).tolist() == [3 * (2**52 + 1) + 3]
