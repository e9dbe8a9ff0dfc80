"""Spread of many small rings beside large ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from muletrace.operators import geo


def test_spread_of_small_and_large_rings_by_all_pairs(spark, monkeypatch):
    """Rings on both sides of the bound agree with all pairs; small ones start no group of their own."""
    monkeypatch.setattr(geo, "FEW_POINTS", 10)
    rows = [(f"R{r}", 20 + (r * 31 + k * 17) % 97 / 30, 75 + (r * 13 + k * 29) % 89 / 30) for r in range(8) for k in range(3 + 5 * r)]
    rows += [("R0", None, None), ("ONE", 20.0, 75.0)]
    df = spark.createDataFrame(rows, "ring_id string, lat double, lng double")
    known = df.where(F.col("lat").isNotNull())
    p, q = known.toDF("ring_id", "a", "b"), known.toDF("ring_id", "c", "d")
    km = geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    want = {x.ring_id: x.km for x in p.join(q, "ring_id").groupBy("ring_id").agg(F.round(F.max(km), 2).alias("km")).collect()}
    assert {x.ring_id: x.spread_km for x in geo.point_spread(df).collect()} == want
