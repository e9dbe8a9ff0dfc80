"""Connected components of links that may all lead to a few nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muletrace.llm.base import cut_lineage
from muletrace.session import BROADCAST_ROWS, cut_counting, small_side

SALTS = 64


def looked_up(rows: DataFrame, table: DataFrame, key: str, n: int, by: str) -> DataFrame:
    """``rows`` joined with a table of one row per key, n in all. Any share of the rows may have one key: a small table is
    broadcast, a larger one is repeated ``SALTS`` times and the rows of a key spread by ``by``."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key)
    spread = table.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread, [key, "salt_"]).drop("salt_")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links(a, b)``.

    A round takes the smallest label of the neighbours and then the label of that label. The second step looks at distinct
    labels only, however many nodes share one. No links give no rows; repeated links and loops change nothing.
    """
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label, n = cut_counting(both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"), F.lit(True).alias("moved")), F.lit(True))
    while n:
        active = label.where("moved").select(F.col("node").alias("a"), "component")
        heard = both.join(small_side(active, n), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("heard"))
        step = cut_lineage(label.join(heard, "node", "left").select("node", "component", F.least("component", "heard").alias("next")))
        far = step.select(F.col("next").alias("node")).distinct().join(step.select("node", F.col("next").alias("far")), "node")
        far, labels = cut_counting(far.select(F.col("node").alias("next"), "far"), F.lit(True))
        nearest = F.least("next", "far")
        jumped = looked_up(step, far, "next", labels, "node").select("node", nearest.alias("component"), (nearest < F.col("component")).alias("moved"))
        label, n = cut_counting(jumped, F.col("moved"))
    return label.select("node", "component")
