"""Matching of member sets: planted against found rings, and rings of one discovery run against the next.

Sets are compared through their shared accounts only, so work grows with memberships, not with pairs of sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muletrace.session import shuffled


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, both, left_n, right_n) for every pair with a common account.

    Inputs ``(left_id, account)`` and ``(right_id, account)``.
    """
    ln = left.groupBy("left_id").agg(F.count(F.lit(1)).alias("left_n"))
    rn = right.groupBy("right_id").agg(F.count(F.lit(1)).alias("right_n"))
    both = left.join(shuffled(right), "account").groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("both"))
    return both.join(shuffled(ln), "left_id").join(shuffled(rn), "right_id")


def best_jaccard(planted: DataFrame, found: DataFrame, floor: float = 0.5) -> DataFrame:
    """Best found ring per planted ring by Jaccard similarity, if at least ``floor``; ties to the smaller id."""
    o = overlaps(planted, found)
    j = F.col("both") / (F.col("left_n") + F.col("right_n") - F.col("both"))
    best = o.withColumn("score", j).groupBy("left_id").agg(
        F.min(F.struct((-F.col("score")).alias("o"), F.col("right_id").alias("id"))).alias("m")
    )
    return best.select("left_id", F.col("m.id").alias("right_id"), (-F.col("m.o")).alias("score")).where(F.col("score") >= floor)


def best_overlap(fresh: DataFrame, known: DataFrame, floor: float = 0.5) -> DataFrame:
    """Known ring a new community continues: largest overlap coefficient of at least ``floor``."""
    o = overlaps(fresh, known)
    c = F.col("both") / F.greatest(F.least("left_n", "right_n"), F.lit(1))
    best = o.withColumn("score", c).groupBy("left_id").agg(
        F.min(F.struct((-F.col("score")).alias("o"), F.col("right_id").alias("id"))).alias("m")
    )
    return best.select("left_id", F.col("m.id").alias("right_id"), (-F.col("m.o")).alias("score")).where(F.col("score") >= floor)
