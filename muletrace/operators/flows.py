"""Temporal chains of transfers: each hop leaves the account the last one reached, later and within a gap."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muletrace.functions.exprs import MICROS_PER_MINUTE
from muletrace.schemas import VICTIM_PREFIX
from muletrace.session import cut_counting, cut_lineage

HOP = "struct<step:int,from_account:string,to_account:string,txn_id:string,us:bigint,amount_paise:bigint,latency_min:double>"


def fund_flow_paths(
    ledger: DataFrame,
    max_gap_minutes: int = 1440,
    max_hops: int | None = None,
    max_paths: int | None = None,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Paths from victim deposits onwards that cannot be extended.

    With ``max_hops``, paths end there at the latest, and ``truncated`` says which could go on. An account is not visited
    twice, so every path ends. Hops meet on (account, time bucket of one gap), so a path is only compared with
    transfers of two adjacent buckets of its account. ``max_paths`` (none by default) keeps the first paths by id.
    """
    gap = max_gap_minutes * MICROS_PER_MINUTE
    moves = ledger.select("txn_id", "src", "dst", "us", "amount_paise").withColumn("bucket", F.floor(F.col("us") / F.lit(gap)))
    # dealt and ordered once; a round shuffles its paths only
    tasks = int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moves = moves.repartition(tasks, "src", "bucket").sortWithinPartitions("src", "bucket").persist(StorageLevel.DISK_ONLY)
    first = starts if starts is not None else ledger.where(F.col("src").startswith(VICTIM_PREFIX))

    def hop(step, latency):
        return F.struct(
            F.lit(step).cast("int").alias("step"),
            F.col("src").alias("from_account"),
            F.col("dst").alias("to_account"),
            F.col("txn_id").alias("txn_id"),
            F.col("us").alias("us"),
            F.col("amount_paise").alias("amount_paise"),
            latency.alias("latency_min"),
        )

    frontier = first.select(
        F.col("txn_id").alias("path_id"),
        F.array(hop(1, F.lit(None).cast("double"))).alias("chain"),
        F.array("src", "dst").alias("visited"),
        F.col("dst").alias("at"),
        F.col("us").alias("at_us"),
    )
    done, step = None, 1
    frontier, n = cut_counting(frontier, F.lit(True))
    while n:
        step += 1
        b = F.floor(F.col("at_us") / F.lit(gap))
        probe = frontier.withColumn("bucket", F.explode(F.array(b, b + 1)))
        later = (F.col("us") > F.col("at_us")) & (F.col("us") <= F.col("at_us") + gap)
        ext = probe.join(moves, (probe["at"] == moves["src"]) & (probe["bucket"] == moves["bucket"])).where(
            later & ~F.array_contains("visited", F.col("dst"))
        )
        if max_hops is not None and step > max_hops:
            more = cut_lineage(ext.select("path_id", F.lit(True).alias("truncated")).distinct())
            ended, n = frontier.join(more, "path_id", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False))), 0
            done = ended if done is None else done.unionByName(ended)
            break
        latency = (F.col("us") - F.col("at_us")) / F.lit(float(MICROS_PER_MINUTE))
        grown, n = cut_counting(
            ext.select(
                F.col("path_id").alias("parent"),
                F.concat_ws(">", "path_id", "txn_id").alias("path_id"),
                F.concat("chain", F.array(hop(step, latency))).alias("chain"),
                F.concat("visited", F.array("dst")).alias("visited"),
                F.col("dst").alias("at"),
                F.col("us").alias("at_us"),
            ),
            F.lit(True),
        )
        ended = frontier.join(grown.select(F.col("parent").alias("path_id")).distinct(), "path_id", "left_anti")
        ended = ended.withColumn("truncated", F.lit(False))
        done = ended if done is None else done.unionByName(ended)
        frontier = grown.drop("parent")
    moves.unpersist()
    if done is None:
        done = frontier.withColumn("truncated", F.lit(False))
    start, end = F.element_at("chain", 1), F.element_at("chain", -1)
    initial, final = start["amount_paise"], end["amount_paise"]
    out = done.select(
        "path_id",
        F.size("chain").cast("bigint").alias("hops"),
        start["us"].alias("start_us"),
        end["us"].alias("end_us"),
        ((end["us"] - start["us"]) / F.lit(float(MICROS_PER_MINUTE))).alias("duration_minutes"),
        initial.alias("initial_amount_paise"),
        final.alias("final_amount_paise"),
        F.when(initial > 0, (initial - final) / initial * F.lit(100.0)).otherwise(F.lit(0.0)).alias("amount_decay_pct"),
        "chain",
        "truncated",
    )
    if max_paths is not None:
        out = out.orderBy("path_id").limit(max_paths)
    return out


def path_summary(paths: DataFrame) -> DataFrame:
    """Totals over all paths: count, mean latency per hop, fastest path, whether any could go on."""
    hops = F.col("hops") - 1
    latency = F.aggregate(
        "chain", F.lit(0.0), lambda a, h: a + F.coalesce(h["latency_min"], F.lit(0.0))
    )
    return paths.agg(
        F.count(F.lit(1)).alias("total_paths"),
        F.round(F.try_divide(F.sum(latency), F.sum(hops)), 4).alias("avg_hop_latency_min"),
        F.round(F.min(F.when(hops > 0, F.col("duration_minutes"))), 4).alias("fastest_path_minutes"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"),
    )


def two_hop_chains(ledger: DataFrame, max_gap_minutes: int = 60) -> DataFrame:
    """Per account: how many (in, out) transfer pairs follow each other within the gap, without forming the pairs.

    Every transfer out counts the transfers in of the preceding gap by two running counts, so the work is linear.
    """
    from pyspark.sql import Window as W

    from muletrace.operators.events import account_events

    gap = max_gap_minutes * MICROS_PER_MINUTE
    e = account_events(ledger).select("account", "dir", "us")
    # one row per account and instant; blocks of one gap plus a copy into the next keep a busy account spread out
    t = e.groupBy("account", "us").agg(F.count_if(F.col("dir") == "C").alias("c"), F.count_if(F.col("dir") == "D").alias("d"))
    b = F.floor(F.col("us") / F.lit(gap))
    t = t.select("account", "us", "c", "d", b.alias("home"), F.explode(F.array(b, b + 1)).alias("block"))
    w = W.partitionBy("account", "block").orderBy("us").rangeBetween(-gap, -1)
    counted = t.withColumn("prior", F.coalesce(F.sum("c").over(w), F.lit(0))).where(F.col("home") == F.col("block"))
    return counted.groupBy("account").agg(F.sum(F.col("prior") * F.col("d")).alias("chained")).where(F.col("chained") > 0)
