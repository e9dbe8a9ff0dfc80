"""Steps on tables that grow with the accounts send none of them through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from muletrace.operators import features, graph, matching, quantiles
from tests.micro import CASE_ROWS, ledger


def _sends_nothing(df) -> bool:
    df.collect()  # the plan that ran, after Spark saw the sizes
    return "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_scoring_steps_broadcast_nothing(spark):
    led = ledger(spark, CASE_ROWS)
    names = [("S",), ("M1",), ("M2",), ("X",), ("O",)]
    accounts = spark.createDataFrame([(a, 0, 8.5, 69.5) for (a,) in names], "account string, opened_us bigint, home_lat double, home_lng double")
    links = spark.createDataFrame([("D1", "device", a) for (a,) in names], "identifier_id string, type string, account string")
    m = features.feature_matrix(accounts, led, links, lambda df: df.withColumn("v1_bp", F.lit(5000).cast("bigint")))
    assert _sends_nothing(m) and m.count() == 5
    scores = m.select("account", F.lit(6000).cast("bigint").alias("v2_bp"))
    seed = graph.seeds(scores)
    inside = graph.candidates(accounts, led, links, scores, seed)
    assert _sends_nothing(inside) and inside.count() == 5
    assert _sends_nothing(graph.identity_stars(links, graph.ring_like_identifiers(links, seed), inside))
    assert _sends_nothing(graph.money_edges(led, inside))
    rings = graph.discover_rings(accounts, led, links, scores)
    assert _sends_nothing(rings) and {r["ring_id"] for r in rings.collect()} == {"RING-M1"}


def test_matching_and_medians_broadcast_nothing(spark):
    one = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "left_id string, account string")
    two = spark.createDataFrame([("c", "x"), ("c", "y")], "right_id string, account string")
    best = matching.best_jaccard(one, two)
    assert _sends_nothing(best) and [tuple(r) for r in best.collect()] == [("a", "c", 1.0)]
    med = quantiles.grouped_median(spark.range(9).withColumn("k", F.col("id") % 2), ["k"], "id", F.col("id"), "m")
    assert _sends_nothing(med) and {tuple(r) for r in med.collect()} == {(0, 4.0), (1, 4.0)}
