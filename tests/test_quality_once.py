"""Live quality scores the accounts once, for the rings and for the flagged accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from muletrace.operators import evaluate, graph
from muletrace.plans import whole_queries


def test_scores_are_computed_once(spark, tmp_path, monkeypatch):
    kinds = F.array(*map(F.lit, ["signup", "view", "click", "purchase", "error"]))
    events = spark.range(60).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 600).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 9).alias("user_id"),
        kinds[(F.col("id") % 5).cast("int")].alias("event_type"),
        (F.col("id") + 1.5).alias("value"),
        F.format_string('{"k": %d}', F.col("id") % 7).alias("props"),
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    used, real = [], graph.discover_rings
    monkeypatch.setattr(graph, "discover_rings", lambda a, led, li, scores, **k: used.append(scores) or real(a, led, li, scores, **k))
    monkeypatch.setattr(evaluate, "live_quality", lambda planted, found, alerts, scores: used.append(scores) or scores)
    assert whole_queries.live_quality(spark, str(tmp_path)).count() == 9
    assert len(used) == 2 and used[0] is used[1]
