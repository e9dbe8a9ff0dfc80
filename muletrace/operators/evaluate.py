"""Quality of scores and found rings against known rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muletrace.operators.matching import best_jaccard


def labelled(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores with a 0/1 label: member of any known ring."""
    fraud = truth.select("account").distinct().withColumn("label", F.lit(1))
    return scores.join(fraud, "account", "left").withColumn("label", F.coalesce("label", F.lit(0)))


SCORE_BUCKETS = 4096


def average_precision(labels: DataFrame, score: str) -> DataFrame:
    """One row: average precision (step-wise, not the trapezoid) over the scores as they are, probabilities.

    Accounts are counted per score. Scores are ordered inside ``SCORE_BUCKETS`` slices of 0 to 1; what lies above a slice
    is added from one row per slice.
    """
    g = labels.groupBy(F.col(score).alias("s")).agg(F.sum("label").alias("tp"), F.count(F.lit(1)).alias("n"))
    place = F.greatest(F.lit(0), F.least(F.lit(SCORE_BUCKETS - 1), F.floor(F.col("s") * SCORE_BUCKETS)))
    g = g.withColumn("slice", F.coalesce(place, F.lit(-1)))
    above = W.orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)  # one row per slice
    slices = g.groupBy("slice").agg(F.sum("tp").alias("stp"), F.sum("n").alias("sn"))
    slices = slices.select("slice", F.coalesce(F.sum("stp").over(above), F.lit(0)).alias("tp0"), F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("n0"))
    w = W.partitionBy("slice").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    run = g.join(F.broadcast(slices), "slice").withColumn("ctp", F.col("tp0") + F.sum("tp").over(w)).withColumn("cn", F.col("n0") + F.sum("n").over(w))
    return run.agg(
        F.round(F.try_divide(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")), F.sum("tp")), 4).alias("pr_auc")
    )


def recall(scores: DataFrame, truth: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: share of known members flagged, over all rings and over pattern D only (null when there are none)."""
    per_account = truth.groupBy("account").agg(F.bool_or(F.col("pattern") == "D").alias("d"))
    s = scores.join(per_account, "account").withColumn("hit", F.col(score) >= threshold)
    return s.agg(
        F.round(F.count_if("hit") / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("ring_recall"),
        F.round(F.try_divide(F.count_if(F.col("hit") & F.col("d")), F.count_if("d")), 4).alias("pattern_d_recall"),
        F.count(F.lit(1)).alias("fraud_accounts"),
    )


def metrics_table(scores: DataFrame, truth: DataFrame, models: dict[str, str]) -> DataFrame:
    """One row per model: ``models`` maps a display name to its score column."""
    lab = labelled(scores, truth)
    out = None
    for name, col in models.items():
        ap, rc = average_precision(lab, col), recall(scores, truth, col).drop("fraud_accounts")
        # two one-row tables side by side
        row = rc.withColumn("pr_auc", ap.scalar()).withColumn("model", F.lit(name))
        row = row.select("model", "pr_auc", "ring_recall", "pattern_d_recall")
        out = row if out is None else out.unionByName(row)
    return out


def live_quality(planted: DataFrame, found: DataFrame, alerts: DataFrame, scores: DataFrame, clock_us: int | None = None) -> DataFrame:
    """One row of detection quality.

    ``planted(ring_id, account, planted_us)``, ``found(ring_id, account)``, ``alerts(ring_id, fired_us,
    before_cashout)``, ``scores(account, v2_bp)``. A planted ring counts once its time has come.
    """
    due = planted if clock_us is None else planted.where(F.col("planted_us") <= clock_us)
    rings_due = due.groupBy("ring_id").agg(F.min("planted_us").alias("planted_us"))
    best = best_jaccard(
        due.select(F.col("ring_id").alias("left_id"), "account"), found.select(F.col("ring_id").alias("right_id"), "account")
    )
    a = alerts.select(F.col("ring_id").alias("right_id"), "fired_us", "before_cashout")
    hit = (
        best.join(rings_due.withColumnRenamed("ring_id", "left_id"), "left_id")
        .join(a, "right_id", "left")
        .withColumn("minutes", (F.col("fired_us") - F.col("planted_us")) / F.lit(6e7))
    )
    ranked = hit.where(F.col("minutes").isNotNull()).select("minutes")
    caught = hit.agg(
        F.count(F.lit(1)).alias("caught"),
        F.count_if(F.col("fired_us").isNotNull() & F.col("before_cashout")).alias("caught_before_cashout"),
        F.count_distinct("right_id").alias("matched"),
    )
    n = ranked.agg(F.count(F.lit(1))).scalar()
    by_value = ranked.groupBy("minutes").agg(F.count(F.lit(1)).alias("k"))
    w = W.orderBy("minutes").rowsBetween(W.unboundedPreceding, 0)  # one row per caught ring at most
    pos = by_value.withColumn("upto", F.sum("k").over(w)).where(F.col("upto") > F.floor(n / F.lit(2)))
    fraud = planted.select("account").distinct()
    flagged = scores.where(F.col("v2_bp") >= 5000).select("account")
    due_n, found_n = rings_due.agg(F.count(F.lit(1))).scalar(), found.agg(F.count_distinct("ring_id")).scalar()
    return caught.select(
        due_n.alias("planted"),
        "caught",
        (due_n - F.col("caught")).alias("missed"),
        (found_n - F.col("matched")).alias("false_rings"),
        F.floor(pos.agg(F.min("minutes")).scalar() + 0.5).cast("bigint").alias("median_minutes_to_alert"),
        "caught_before_cashout",
        flagged.agg(F.count(F.lit(1))).scalar().alias("flagged_accounts"),
        flagged.join(fraud, "account", "left_semi").agg(F.count(F.lit(1))).scalar().alias("flagged_in_rings"),
    )
