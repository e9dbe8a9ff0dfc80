"""Exact grouped medians that do not hold a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muletrace.session import shuffled


def grouped_median(df: DataFrame, keys: list[str], value: str, bucket: Column, out: str) -> DataFrame:
    """Interpolated median of ``value`` per ``keys``.

    ``bucket`` is a monotone coarsening of ``value`` (a value in a lower bucket is lower). Equal values are
    counted first, buckets are ordered by their counts, and ranks are looked up only in the one or two buckets that
    hold the middle. A group is therefore spread over its buckets however many rows it has.
    """
    kb = [*keys, "_b"]
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, bucket.alias("_b"), value).agg(F.count(F.lit(1)).alias("_n"))
    wb = W.partitionBy(*kb).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    local = counted.withColumn("_hi", F.sum("_n").over(wb))
    buckets = local.groupBy(*kb).agg(F.sum("_n").alias("_bn"))
    wk = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    wt = W.partitionBy(*keys)
    lower, upper = F.floor((F.col("_t") + 1) / F.lit(2)), F.floor(F.col("_t") / F.lit(2)) + 1
    middle = (
        buckets.withColumn("_cum", F.sum("_bn").over(wk))
        .withColumn("_t", F.sum("_bn").over(wt))
        .withColumn("_before", F.col("_cum") - F.col("_bn"))
        .where((F.col("_cum") >= lower) & (F.col("_before") < upper))
        .select(*kb, (lower - F.col("_before")).alias("_lo_rank"), (upper - F.col("_before")).alias("_up_rank"))
    )

    def at(rank: str) -> Column:
        covers = (F.col("_hi") >= F.col(rank)) & (F.col("_hi") - F.col("_n") < F.col(rank))
        return F.max(F.when(covers & (F.col(rank) > 0), F.col(value)))

    picked = local.join(shuffled(middle), kb).groupBy(*keys).agg(at("_lo_rank").alias("_lo"), at("_up_rank").alias("_up"))
    return picked.select(*keys, ((F.col("_lo") + F.col("_up")) / F.lit(2.0)).alias(out))
