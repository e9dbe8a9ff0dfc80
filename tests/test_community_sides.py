"""Community rounds send no table through the driver."""

from __future__ import annotations

from muletrace.operators import communities


def test_community_sides_are_never_broadcast(spark):
    small = spark.range(5).withColumnRenamed("id", "c")
    plan = spark.range(50).withColumnRenamed("id", "c").join(communities._side(small), "c")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
