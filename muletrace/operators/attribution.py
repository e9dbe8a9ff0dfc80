"""Exact Shapley values of boosted trees.

The game: a feature outside the coalition sends a row down both sides of its splits, by the shares of training rows that went
there. A leaf then pays value * product over the features on its path of (1 or 0: the row meets the feature's bounds, if the
feature is in; else the share of rows that do). The Shapley value of a product has the closed form

    value * (met_i - share_i) * integral over t from 0 to 1 of product over j <> i of (share_j * (1 - t) + met_j * t)

and a quadrature with half as many points as the path has features integrates that polynomial exactly. So a row costs
leaves x depth x points, whatever the number of features, and all rows of a batch are worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muletrace.functions.exprs import signal_label
from muletrace.operators.scoring import top_signals

Node = tuple  # (prediction, rows of training, feature, threshold, left, right); a leaf has no left
ROWS = 2048


def tree_nodes(model: PipelineModel, spark: SparkSession, folder: str) -> list[tuple[float, dict[int, Node]]]:
    """Trees of a model, saved to ``folder`` on the way: [(tree weight, {node id: node})]. A model has at most trees x
    2 ** (depth + 1) nodes."""
    path = f"{folder}/gbt"
    model.stages[-1].write().overwrite().save(path)
    weights = model.stages[-1].treeWeights
    trees: dict[int, dict[int, Node]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        cut = r["split"]["leftCategoriesOrThreshold"]
        trees.setdefault(r["treeID"], {})[r["id"]] = (r["prediction"], r["rawCount"], r["split"]["featureIndex"], cut[0] if cut else 0.0, r["leftChild"], r["rightChild"])
    return [(weights[t], trees[t]) for t in sorted(trees)]


class Leaf:
    """Its value, and for every feature on its path the bounds low < x <= high and the share of rows within them."""

    def __init__(self, value: float, path: dict[int, tuple[float, float, float]]):
        self.value, self.features = value, sorted(path)
        self.low, self.high, self.share = (np.array([path[f][k] for f in self.features]) for k in range(3))


def leaves(trees: list[tuple[float, dict[int, Node]]]) -> list[Leaf]:
    out, todo = [], [(w, nodes, 0, {}) for w, nodes in trees]
    while todo:
        w, nodes, at, path = todo.pop()
        value, rows, f, cut, left, right = nodes[at]
        if left < 0:
            out.append(Leaf(w * value, path))
            continue
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        part = nodes[left][1] / rows if rows else 0.5
        todo.append((w, nodes, left, path | {f: (low, min(high, cut), share * part)}))
        todo.append((w, nodes, right, path | {f: (max(low, cut), high, share * (1 - part))}))
    return out


def shapley(all_leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Contributions, one row per row of ``x`` and one column per feature."""
    out = np.zeros(x.shape)
    for leaf in all_leaves:
        n = len(leaf.features)
        if not n:
            continue
        here = x[:, leaf.features]
        met = ((here > leaf.low) & (here <= leaf.high)).astype(float)
        points, weights = np.polynomial.legendre.leggauss((n + 1) // 2)
        sums = np.zeros_like(met)
        for t, w in zip((points + 1) / 2, weights / 2):
            factor = leaf.share * (1 - t) + met * t
            # of each feature the product of all others, from both sides: a share may be 0
            before = np.cumprod(np.hstack([np.ones((len(x), 1)), factor[:, :-1]]), axis=1)
            after = np.cumprod(np.hstack([np.ones((len(x), 1)), factor[:, :0:-1]]), axis=1)[:, ::-1]
            sums += w * before * after
        out[:, leaf.features] += leaf.value * (met - leaf.share) * sums
    return out


def mean_margin(all_leaves: list[Leaf]) -> float:
    """What a row of which nothing is known gets; contributions add up to a row's margin less this."""
    return float(sum(leaf.value * leaf.share.prod() for leaf in all_leaves))


def attributions(model: PipelineModel, df: DataFrame, folder: str, columns: list[str]) -> DataFrame:
    """``df`` with ``contributions``: to the margin, one per column, in order. ``df`` should hold only the rows to explain."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(leaves(tree_nodes(model, spark, folder)))
    filled = df.na.fill(0, columns)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), ROWS):
                some = b.iloc[a : a + ROWS]
                yield some.assign(contributions=list(shapley(shared.value, some[columns].to_numpy(dtype=float))))

    kinds = ", ".join(f"`{c}` {t}" for c, t in filled.dtypes)
    return filled.mapInPandas(explain, f"{kinds}, contributions array<double>")


def attributed_signals(columns: list[str]) -> Column:
    """The three largest positive contributions with their labels, from the columns and ``contributions``."""
    items = [
        F.struct(F.round(F.get("contributions", F.lit(k)), 4).alias("weight"), F.lit(c).alias("feature"), signal_label(c, F.col(c)).alias("label"))
        for k, c in enumerate(columns)
    ]
    return top_signals(F.array(*items))
