"""Training reads the snapshots' ledger once and gives its many small jobs few tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from muletrace.operators import features, models, snapshots
from muletrace.plans.tables import Tables


def test_snapshot_money_is_computed_once(spark, monkeypatch):
    calls, real = [], features.transaction_features
    count = lambda *a, **k: calls.append(1) or real(*a, **k)
    monkeypatch.setattr(features, "transaction_features", count)
    monkeypatch.setattr(snapshots, "transaction_features", count, raising=False)
    t = Tables(spark, "/root/testdata/sf0.001")
    models.train_detector(t.accounts, t.ledger, t.links, t.truth, days=(5, 30), trees=1)
    assert len(calls) == 1


def test_trees_are_grown_by_few_tasks(spark, monkeypatch):
    seen = []

    class Seen(models.Pipeline):
        def fit(self, data):
            seen.append((data.rdd.getNumPartitions(), data.count()))
            return super().fit(data)

    monkeypatch.setattr(models, "Pipeline", Seen)
    df = spark.range(300).select(F.col("id").cast("double").alias("x"), (F.col("id") >= 200).cast("int").alias("label")).repartition(30)
    models.train(df, ["x"], trees=1)
    monkeypatch.setattr(models, "ROWS_PER_TASK", 100, raising=False)
    models.train(df, ["x"], trees=1)
    assert seen == [(1, 300), (3, 300)]
