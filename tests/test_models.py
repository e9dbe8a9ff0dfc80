"""Trained models on a small separable table."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from muletrace.operators import attribution, models
from muletrace.plans.tables import Tables


def test_train_explain_save(spark, tmp_path):
    df = spark.range(60).select(
        F.format_string("A%02d", "id").alias("account"),
        (F.col("id") % 10).cast("double").alias("txn_in"),
        F.col("id").cast("double").alias("txn_out"),
        (F.col("id") >= 40).cast("int").alias("label"),
    )
    cols = ["txn_in", "txn_out"]
    m = models.train(df, cols, trees=3)
    p = {r["account"]: r["p"] for r in models.probability(m, df, "p").collect()}
    assert p["A59"] > 0.5 > p["A00"]
    told = attribution.attributions(m, df, str(tmp_path), cols)
    by = {r["account"]: r["contributions"] for r in told.collect()}
    assert by["A59"][1] > 0 > by["A00"][1]
    mean = attribution.mean_margin(attribution.leaves(attribution.tree_nodes(m, spark, str(tmp_path / "again"))))
    for a, c in by.items():  # they add up to the margin, of which the probability is a function, less the mean
        assert math.isclose(sum(c) + mean, math.log(p[a] / (1 - p[a])) / 2, abs_tol=1e-9)
    why = {r["account"]: r["s"] for r in told.select("account", attribution.attributed_signals(cols).alias("s")).collect()}
    assert [x["feature"] for x in why["A59"]][0] == "txn_out" and all(x["weight"] > 0 for s in why.values() for x in s)
    iso = models.isolation_scores(df.drop("label"), cols, trees=20, sample=32)
    assert iso.count() == 60 and iso.where("iso_raw >= 0 or iso_raw < -1").isEmpty()


def _random_tree(r, depth, features):
    """Node ids in no order of use; thresholds repeat, features come twice on a path, a side may have had no rows."""
    nodes = {}

    def grow(rows, left):
        me = len(nodes)
        nodes[me] = None
        if not left or r.random() < 0.15:
            nodes[me] = (float(r.normal()), rows, -1, 0.0, -1, -1)
            return me
        mine = int(rows * r.choice([0.0, 0.3, 0.5, 1.0]))
        kids = grow(mine, left - 1), grow(rows - mine, left - 1)
        nodes[me] = (0.0, rows, int(r.integers(features)), float(r.integers(3)), *kids)
        return me

    grow(64, depth)
    return nodes


def _worth(nodes, at, x, known):
    value, rows, f, cut, left, right = nodes[at]
    if left < 0:
        return value
    if f in known:
        return _worth(nodes, left if x[f] <= cut else right, x, known)
    share = nodes[left][1] / rows if rows else 0.5
    return share * _worth(nodes, left, x, known) + (1 - share) * _worth(nodes, right, x, known)


def test_shapley_equals_enumeration():
    r, features = np.random.default_rng(4), 5
    for depth in (0, 1, 3, 6):
        trees = [(0.5, _random_tree(r, depth, features)), (2.0, _random_tree(r, depth, features))]
        found = attribution.leaves(trees)
        x = r.integers(0, 4, (6, features)).astype(float)
        got = attribution.shapley(found, x)
        total = lambda row, s: sum(w * _worth(n, 0, row, s) for w, n in trees)
        for row, mine in zip(x, got):
            for i in range(features):
                rest, want = [f for f in range(features) if f != i], 0.0
                for n in range(features):
                    share = math.factorial(n) * math.factorial(features - n - 1) / math.factorial(features)
                    want += share * sum(total(row, {*s, i}) - total(row, set(s)) for s in itertools.combinations(rest, n))
                assert math.isclose(mine[i], want, abs_tol=1e-9)
            assert math.isclose(mine.sum(), total(row, set(range(features))) - attribution.mean_margin(found), abs_tol=1e-9)


def test_reasons_of_flagged_accounts(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    det = models.train_detector(t.accounts, t.ledger, t.links, t.truth, days=(5, 30), trees=2)
    told = {r["account"]: r for r in models.explain(det, t.accounts, t.ledger, t.links, floor=0.3).collect()}
    scores = {r["account"]: r["risk_combined"] for r in models.detect(det, t.accounts, t.ledger, t.links).collect()}
    assert {a: r["risk_combined"] for a, r in told.items()} == {a: s for a, s in scores.items() if s >= 0.3} != {}
    assert all(1 <= len(r["signals"]) <= 3 and all(s["label"] for s in r["signals"]) for r in told.values())


def test_detector_is_kept_and_applied_to_other_rows(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    det = models.train_detector(t.accounts, t.ledger, t.links, t.truth, days=(5, 30), trees=2)
    models.save_detector(det, t.ledger, str(tmp_path / "d"))
    assert models.load_detector(spark, str(tmp_path / "d"), t.ledger.limit(3)) is None
    again = models.load_detector(spark, str(tmp_path / "d"), t.ledger)
    assert again.bounds == det.bounds and again.v2_columns == det.v2_columns
    some = t.accounts.where("account < 'ACC000010'")
    one, two = (sorted(map(tuple, models.detect(x, some, t.ledger, t.links).collect())) for x in (det, again))
    assert one == two and len(one) == some.count()
    table = {r.model: r for r in models.evaluate_on(again, t.accounts, t.ledger, t.links, t.truth).collect()}
    assert len(table) == 3 and all(0 <= r.pr_auc <= 1 for r in table.values())
