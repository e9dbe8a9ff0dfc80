"""Candidate graph, connected components and rings.

Shared identifiers stay in star form, (identifier, account), at every step. A star of n accounts stands for n(n-1)/2 unit
edges, which are never written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muletrace.operators.communities import communities
from muletrace.operators.quantiles import grouped_median
from muletrace.schemas import is_pseudo
from muletrace.session import cut_counting, cut_lineage, shuffled, small_side


def seeds(scores: DataFrame, threshold: float = 0.5, fallback: float = 0.3) -> DataFrame:
    """Accounts at or above the threshold; if there are none, at or above the fallback."""
    bp = F.col("v2_bp")
    floor = scores.agg(
        F.when(F.max(bp) >= round(threshold * 10000), round(threshold * 10000)).otherwise(round(fallback * 10000))
    ).scalar()
    return scores.where(bp >= floor).select("account")


def ring_like_identifiers(links: DataFrame, seed: DataFrame) -> DataFrame:
    """Identifiers with at least two flagged users that make up at least half of all users."""
    flagged = seed.select("account").distinct().withColumn("flagged", F.lit(True))
    g = (
        links.join(shuffled(flagged), "account", "left")
        .groupBy("type", "identifier_id")
        .agg(F.count_if("flagged").alias("flagged"), F.count(F.lit(1)).alias("users"))
    )
    return g.where((F.col("flagged") >= 2) & (F.col("flagged") * 2 >= F.col("users")))


def candidates(
    accounts: DataFrame, ledger: DataFrame, links: DataFrame, scores: DataFrame, seed: DataFrame, neighbour_floor: float = 0.2
) -> DataFrame:
    """Seeds, their counterparties of at least ``neighbour_floor`` risk, and users of ring-like identifiers."""
    able = scores.where(F.col("v2_bp") >= round(neighbour_floor * 10000)).select("account")
    pairs = ledger.select("src", "dst").distinct()
    out = pairs.join(shuffled(seed.withColumnRenamed("account", "src")), "src", "left_semi").select(F.col("dst").alias("account"))
    into = pairs.join(shuffled(seed.withColumnRenamed("account", "dst")), "dst", "left_semi").select(F.col("src").alias("account"))
    traded = out.unionByName(into).distinct().join(shuffled(able), "account", "left_semi")
    tied = links.join(shuffled(ring_like_identifiers(links, seed)), ["type", "identifier_id"], "left_semi").select("account")
    found = seed.select("account").unionByName(traded).unionByName(tied).distinct()
    return found.where(~is_pseudo(F.col("account"))).join(shuffled(accounts.select("account")), "account", "left_semi")


def neighbourhood(ledger: DataFrame, links: DataFrame, seed: DataFrame) -> DataFrame:
    """Seeds, everyone they traded with and everyone on their identifiers; outside accounts left out."""
    pairs = ledger.select("src", "dst").distinct()
    out = pairs.join(seed.withColumnRenamed("account", "src"), "src", "left_semi").select(F.col("dst").alias("account"))
    into = pairs.join(seed.withColumnRenamed("account", "dst"), "dst", "left_semi").select(F.col("src").alias("account"))
    theirs = links.join(seed, "account", "left_semi").select("type", "identifier_id").distinct()
    users = links.join(theirs, ["type", "identifier_id"], "left_semi").select("account")
    around = seed.select("account").unionByName(out).unionByName(into).unionByName(users)
    return around.where(~is_pseudo(F.col("account"))).distinct()


def money_edges(ledger: DataFrame, inside: DataFrame, cap: float = 3.0) -> DataFrame:
    """Undirected money edges between candidates: pair total over the median pair total, at most ``cap``."""
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    pairs = (
        ledger.where(F.col("src") != F.col("dst"))
        .join(shuffled(inside.select(F.col("account").alias("src"))), "src", "left_semi")
        .join(shuffled(inside.select(F.col("account").alias("dst"))), "dst", "left_semi")
        .groupBy(a, b)
        .agg(F.sum("amount_paise").alias("total"))
    )
    one = pairs.withColumn("all", F.lit(1))
    # bucketed by size class, so no task orders all pairs
    bucket = F.floor(F.log2(F.col("total") + 1) * 16)
    median = grouped_median(one, ["all"], "total", bucket, "median").agg(F.max("median")).scalar()
    weight = F.least(F.col("total") / F.greatest(F.coalesce(median, F.lit(1.0)), F.lit(1.0)), F.lit(cap))
    return pairs.select("a", "b", "total", weight.alias("weight"))


def identity_stars(links: DataFrame, ring_like: DataFrame, inside: DataFrame) -> DataFrame:
    """(identifier key, account) of ring-like identifiers with at least two candidates on them."""
    key = F.concat_ws("|", "type", "identifier_id")
    on = (
        links.join(shuffled(ring_like.select("type", "identifier_id")), ["type", "identifier_id"], "left_semi")
        .join(shuffled(inside), "account", "left_semi")
        .select(key.alias("star"), "account")
        .distinct()
    )
    sizes = on.groupBy("star").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= 2)
    return on.join(shuffled(sizes), "star")


def weighted_degrees(money: DataFrame, stars: DataFrame) -> DataFrame:
    """Total edge weight at every account; a star gives each of its accounts size - 1."""
    ends = money.select(F.explode(F.array("a", "b")).alias("account"), F.col("weight"))
    ident = stars.select("account", (F.col("size") - 1).cast("double").alias("weight"))
    return ends.unionByName(ident).groupBy("account").agg(F.sum("weight").alias("degree"))


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): smallest node id of the component.

    ``links(a, b)`` undirected; identifier nodes of stars are ordinary nodes here. Each round takes the smallest label
    of the neighbours and then jumps to that label's own label, so long chains shorten geometrically.
    """
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label, n = cut_counting(
        nodes.select(F.col("node"), F.col("node").alias("component"), F.lit(True).alias("moved")), F.lit(True)
    )
    while n:
        active = label.where("moved").select(F.col("node").alias("a"), "component")
        heard = both.join(small_side(active, n), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("heard"))
        step = label.join(heard, "node", "left").select(
            "node", "component", F.least("component", "heard").alias("next")
        )
        # pointer jump
        own = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        nearest = F.least("next", "far")
        jumped = step.join(own, "next", "left").select(
            "node", nearest.alias("component"), (nearest < F.col("component")).alias("moved")
        )
        label, n = cut_counting(jumped, F.col("moved"))
    return label.select("node", "component")


def discover_rings(
    accounts: DataFrame,
    ledger: DataFrame,
    links: DataFrame,
    scores: DataFrame,
    threshold: float = 0.5,
    min_members: int = 3,
    min_mean_risk: float = 0.6,
    neighbour_floor: float = 0.2,
) -> DataFrame:
    """(ring_id, account, risk): communities of the candidate graph that stay risky after trimming.

    ``scores(account, v2_bp)``. Members below 0.6 x threshold are dropped unless tied by a ring-like identifier. The
    ring is named after its smallest member.
    """
    scores = cut_lineage(scores.select("account", "v2_bp"))
    seed = cut_lineage(seeds(scores, threshold))
    # every later step needs pair totals only: one small table instead of passes over the ledger
    pairs = ledger.where(~is_pseudo(F.col("src")) & ~is_pseudo(F.col("dst"))).groupBy("src", "dst")
    pairs = cut_lineage(pairs.agg(F.sum("amount_paise").alias("amount_paise")))
    inside = cut_lineage(candidates(accounts, pairs, links, scores, seed, neighbour_floor))
    ring_like = ring_like_identifiers(links, seed)
    stars = cut_lineage(identity_stars(links, ring_like, inside))
    found = communities(money_edges(pairs, inside), stars)
    tied = stars.select("account").distinct().withColumn("tied", F.lit(True))
    kept = (
        found.join(shuffled(scores), "account", "left")
        .join(shuffled(tied), "account", "left")
        .where((F.coalesce("v2_bp", F.lit(0)) >= round(threshold * 6000)) | F.col("tied"))
    )
    kept = cut_lineage(kept)
    good = (
        kept.groupBy("community")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("v2_bp")).alias("mean_bp"), F.min("account").alias("first"))
        .where((F.col("n") >= min_members) & (F.col("mean_bp") >= min_mean_risk * 10000))
    )
    return kept.join(shuffled(good), "community").select(
        F.concat(F.lit("RING-"), F.col("first")).alias("ring_id"), "account", F.round(F.col("mean_bp") / F.lit(10000.0), 4).alias("risk")
    )


def discover_with_retries(accounts, ledger, links, scores, thresholds=(0.5, 0.3, 0.4), **kw) -> DataFrame:
    """Discovery, tried again with the next threshold while nothing is found."""
    for t in thresholds:
        rings = cut_lineage(discover_rings(accounts, ledger, links, scores, threshold=t, **kw))
        if not rings.isEmpty():
            break
    return rings


# ---- layering of a ring picture ----------------------------------------------------------------------------------


def hop_distance(edges: DataFrame, start: DataFrame, key: str = "ring_id") -> DataFrame:
    """(key, account, hop): fewest transfers from any start account. ``edges(key, src, dst)``."""
    e = cut_lineage(edges.select(key, "src", "dst").distinct())
    found, n = cut_counting(start.select(key, "account").distinct().withColumn("hop", F.lit(0)), F.lit(True))
    hop = 0
    while n:
        front = found.where(F.col("hop") == hop).select(key, F.col("account").alias("src"))
        hop += 1
        step = e.join(small_side(front, n), [key, "src"]).select(key, F.col("dst").alias("account"), F.lit(hop).alias("hop"))
        reached = found.unionByName(step).groupBy(key, "account").agg(F.min("hop").alias("hop"))
        found, n = cut_counting(reached, F.col("hop") == hop)
    return found


def layer_columns(edges: DataFrame, hops: DataFrame, key: str = "ring_id") -> DataFrame:
    """(key, account, column): one past the last payer along forward edges, so money reads left to right.

    An edge is forward when it leads to a larger hop distance, or to the same one in account order; forward edges have no
    cycle, so the rounds end after the longest chain.
    """
    h1 = hops.select(key, F.col("account").alias("src"), F.col("hop").alias("h1"))
    h2 = hops.select(key, F.col("account").alias("dst"), F.col("hop").alias("h2"))
    forward = edges.select(key, "src", "dst").distinct().join(h1, [key, "src"]).join(h2, [key, "dst"])
    ahead = (F.col("h1") < F.col("h2")) | ((F.col("h1") == F.col("h2")) & (F.col("src") < F.col("dst")))
    forward = cut_lineage(forward.where(ahead).select(key, "src", "dst"))
    first = hops.where(F.col("hop") == 0).select(key, "account", F.lit(0).alias("column"), F.lit(True).alias("fresh"))
    col, n = cut_counting(first, F.lit(True))
    while n:
        front = col.where("fresh").select(key, F.col("account").alias("src"), (F.col("column") + 1).alias("column"))
        step = forward.join(small_side(front, n), [key, "src"]).select(key, F.col("dst").alias("account"), "column")
        old = col.select(key, "account", "column", F.col("column").alias("old"))
        merged = old.unionByName(step, allowMissingColumns=True).groupBy(key, "account")
        merged = merged.agg(F.max("column").alias("column"), F.max("old").alias("old"))
        fresh = F.col("old").isNull() | (F.col("column") > F.col("old"))
        col, n = cut_counting(merged.select(key, "account", "column", fresh.alias("fresh")), F.col("fresh"))
    return col.select(key, "account", "column")


def account_degrees(ledger: DataFrame) -> DataFrame:
    """Transfers touching each account and its display weight."""
    ends = ledger.select(F.explode(F.array("src", "dst")).alias("account"))
    g = ends.groupBy("account").agg(F.count(F.lit(1)).alias("degree"))
    return g.withColumn("display_weight", F.round(F.sqrt(F.lit(1.0) + F.lit(0.3) * (F.col("degree") - 1)), 6))
