"""Queries on trained scores and stream-shaped roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from muletrace.operators import features, models, scoring
from muletrace.plans.registry import query
from muletrace.plans.tables import Tables
from muletrace.streaming import live


@query("isolation_scores")
def isolation_scores(spark, d):
    t = Tables(spark, d)
    f = features.transaction_features(t.accounts, t.ledger)
    s = models.isolation_scores(f.select("account", *features.V1_FEATURES))
    return scoring.normalised_anomaly(s, "iso_raw").select("account", F.round("anomaly", 4).alias("anomaly"))


def _detector(t: Tables):
    return models.train_detector(t.accounts, t.ledger, t.links, t.truth)


@query("gbt_scores")
def gbt_scores(spark, d):
    """Detector trained on the snapshots, applied to all accounts as they are at the end."""
    t = Tables(spark, d)
    det = _detector(t)
    s = models.detect(det, t.accounts, t.ledger, t.links)
    return s.select("account", "risk_v1", "risk_v2", "anomaly_score", "risk_combined", models.gain_signals(det.v2).alias("signals"))


@query("gbt_reasons")
def gbt_reasons(spark, d):
    """Why the detector flags an account: up to three features by exact attribution, best first."""
    t = Tables(spark, d)
    told = models.explain(_detector(t), t.accounts, t.ledger, t.links)
    return told.select("account", "risk_combined", F.posexplode("signals").alias("pos", "s")).select(
        "account", "risk_combined", (F.col("pos") + 1).cast("bigint").alias("rank"), "s.feature", "s.label", "s.weight"
    )


@query(
    "activity_sessions",
    """SELECT account, min(us) start_us, max(us)+600000000 end_us, count(*) events, CAST(sum(amount_paise) AS BIGINT) amount_paise FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY account ORDER BY us, txn_id, dir ROWS UNBOUNDED PRECEDING) s FROM (
        SELECT *, CASE WHEN us-lag(us) OVER (PARTITION BY account ORDER BY us, txn_id, dir) <= 600000000 THEN 0 ELSE 1 END fresh FROM acct_ev)) GROUP BY account, s""",
)
def activity_sessions(spark, d):
    return live.activity_sessions(Tables(spark, d).ledger)


@query(
    "tumbling_activity",
    "SELECT us//3600000000*3600000000 start_us, channel, count(*) transfers, CAST(sum(amount_paise) AS BIGINT) amount_paise FROM ledger GROUP BY 1,2",
)
def tumbling_activity(spark, d):
    return live.tumbling_activity(Tables(spark, d).ledger)


@query(
    "touched_accounts",
    """SELECT DISTINCT account FROM acct_ev WHERE us>(SELECT max(us) FROM ledger)-86400000000 UNION SELECT l.account FROM links l WHERE identifier_id IN (SELECT identifier_id FROM links WHERE account='ACC000004')""",
)
def touched_accounts(spark, d):
    t = Tables(spark, d)
    last = t.ledger.agg(F.max("us")).scalar()
    batch = t.ledger.where(F.col("us") > last - 86_400_000_000)
    return live.touched_accounts(batch, t.links, t.links.where(F.col("account") == "ACC000004"))
