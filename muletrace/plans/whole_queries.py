"""Queries of which a test also runs a form on partial tables (``tests/cut_cases.py``). Each is registered under its name and,
as in earlier versions, as ``<name>_whole``. Rings in the matching queries are those found by the rule score.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from muletrace.functions.exprs import risk_band
from muletrace.operators import evaluate, features, flows, freeze, graph, matching, rings, scoring, serve
from muletrace.plans import graph_queries, sqlviews
from muletrace.plans.registry import query
from muletrace.plans.ring_queries import _roles
from muletrace.plans.tables import Tables
from muletrace.session import cut_lineage
from muletrace.streaming import live


def queries(name: str, sql: str, also: str = ""):
    """Registers under the name and under the earlier one."""
    return lambda fn: query(name, sql)(query(also or f"{name}_whole", sql)(fn))


_ONE_DAY_US = 86_400_000_000

_HOPS = """e AS (SELECT DISTINCT ring_id, src, dst FROM internal WHERE src<>dst),
     r(ring_id, account, hop) AS (SELECT DISTINCT ring_id, account, 0 FROM ledger JOIN planted ON account=dst WHERE src LIKE 'VICTIM%'
       UNION SELECT e.ring_id, e.dst, hop+1 FROM r JOIN e ON e.ring_id=r.ring_id AND e.src=r.account WHERE hop<(SELECT max(n) FROM (SELECT count(*) n FROM planted GROUP BY ring_id))),
     h AS (SELECT ring_id, account, min(hop) hop FROM r GROUP BY 1,2)"""


def _layered(t: Tables):
    """All internal channels; the accounts that victims paid are the start."""
    e = cut_lineage(rings.ring_edges(t.ledger, t.members).where(F.col("src") != F.col("dst")).select("ring_id", "src", "dst"))
    start = rings.victim_deposits(t.ledger, t.members).select("ring_id", F.col("dst").alias("account"))
    return e, graph.hop_distance(e, start)


@queries("hop_distance", f"WITH RECURSIVE {_HOPS} SELECT ring_id, account, hop FROM h")
def hop_distance(spark, d):
    return _layered(Tables(spark, d))[1]


@queries(
    "layer_columns",
    f"""WITH RECURSIVE {_HOPS},
     f AS (SELECT e.* FROM e JOIN h a ON a.ring_id=e.ring_id AND a.account=e.src JOIN h b ON b.ring_id=e.ring_id AND b.account=e.dst WHERE a.hop<b.hop OR (a.hop=b.hop AND e.src<e.dst)),
     c(ring_id, account, col) AS (SELECT ring_id, account, 0 FROM h WHERE hop=0 UNION SELECT f.ring_id, f.dst, col+1 FROM c JOIN f ON f.ring_id=c.ring_id AND f.src=c.account)
     SELECT ring_id, account, max(col) "column" FROM c GROUP BY 1,2""",
)
def layer_columns(spark, d):
    e, h = _layered(Tables(spark, d))
    return graph.layer_columns(e, h)


@queries(
    "freeze_reachability",
    """WITH RECURSIVE fz AS (SELECT account FROM scored WHERE v2_bp>=5000),
     e AS (SELECT * FROM channels c WHERE dst<>src AND NOT EXISTS (SELECT 1 FROM fz WHERE fz.account=c.src) AND NOT EXISTS (SELECT 1 FROM fz WHERE fz.account=c.dst)),
     r(ring_id, account) AS (SELECT ring_id, src FROM e WHERE dst='CASH' UNION SELECT e.ring_id, e.src FROM e JOIN r ON r.ring_id=e.ring_id AND r.account=e.dst)
     SELECT ring_id, account FROM r""",
)
def freeze_reachability(spark, d):
    """All channels; the accounts at high risk by the rule score are frozen."""
    t = Tables(spark, d)
    edges = freeze.flow_graph(t.ledger, t.members).where(F.col("src") != F.col("dst"))
    frozen = t.members.join(t.scores().where(F.col("v2_bp") >= 5000).select("account"), "account", "left_semi")
    return freeze.reaches_cash(edges, cut_lineage(frozen))


@queries(
    "complete_ring",
    """WITH ed AS (SELECT ring_id, src, dst, CAST(sum(amount_paise) AS BIGINT) amount_paise FROM internal GROUP BY 1,2,3),
     dep AS (SELECT ring_id, src, dst, amount_paise FROM ledger JOIN planted p ON p.account=dst WHERE src LIKE 'VICTIM%'),
     r AS (SELECT roles.*, EXISTS(SELECT 1 FROM ed WHERE ed.ring_id=roles.ring_id AND ed.dst=roles.account) paid FROM roles WHERE ring_id NOT IN (SELECT ring_id FROM dep)),
     t AS (SELECT *, CASE WHEN role='source' THEN 1 WHEN NOT paid THEN 2 ELSE 3 END tier FROM r),
     c AS (SELECT t.* FROM t JOIN (SELECT ring_id, min(tier) bt, min(account) fa FROM t GROUP BY 1) b ON b.ring_id=t.ring_id AND t.tier=b.bt AND (t.tier<3 OR t.account=b.fa))
     SELECT ring_id, src, dst, amount_paise, 'transfer' kind FROM ed UNION ALL SELECT *, 'victim' FROM dep
     UNION ALL SELECT ring_id, concat('VICTIM:',ring_id), account, CAST(coalesce(nullif((SELECT sum(amount_paise) FROM ed WHERE ed.ring_id=c.ring_id AND ed.src=c.account),0), (SELECT volume_paise FROM ring_summary s WHERE s.ring_id=c.ring_id),0) AS BIGINT), 'victim' FROM c
     UNION ALL SELECT ring_id, account, 'CASH', CAST(coalesce((SELECT sum(amount_paise) FROM ed WHERE ed.ring_id=roles.ring_id AND ed.dst=roles.account),0) AS BIGINT), 'cash' FROM roles WHERE role='cash-out'""",
)
def complete_ring(spark, d):
    """All deposits; stand-in victims only where a ring has none."""
    t = Tables(spark, d)
    seen = rings.victim_deposits(t.ledger, t.members)
    return rings.complete_ring_edges(rings.ring_edges(t.ledger, t.members), _roles(t), seen, rings.ring_volumes(t.ledger, t.members))


@queries("alerts_with_ring", "SELECT alert_id, a.ring_id, fired_at, risk, members FROM alerts a JOIN ring_summary USING(ring_id)")
def alerts_with_ring(spark, d):
    t = Tables(spark, d)
    known = rings.ring_summary(t.ledger, t.members, t.scores())
    return rings.alerts_with_ring(rings.alerts(t.ledger, t.members), known).select("alert_id", "ring_id", "fired_at", "risk", "members")


@queries("unknown_accounts", "SELECT DISTINCT account FROM acct_ev WHERE account NOT IN (SELECT account FROM accounts)")
def unknown_accounts(spark, d):
    t = Tables(spark, d)
    return serve.unknown_accounts(t.ledger, t.accounts)


def _score_changes_sql() -> str:
    """The scores of all transfers against those of a day before the last one."""
    whole = sqlviews.VIEWS["ledger"]
    earlier = f"SELECT * FROM ({whole}) WHERE us<=(SELECT max(us) FROM ({whole}))-{_ONE_DAY_US}"
    before = sqlviews.complete("SELECT account, v2_bp obp FROM scored", {"ledger": earlier})
    band = "CASE WHEN {0}>=8000 THEN 'CRITICAL' WHEN {0}>=6000 THEN 'HIGH' WHEN {0}>=3500 THEN 'MEDIUM' ELSE 'LOW' END"
    return f"""WITH n AS (SELECT account, v2_bp, {band.format("v2_bp")} band, txn_in+txn_out txns FROM scored), o AS ({before})
      SELECT n.account, v2_bp, band, txns<3 provisional FROM n LEFT JOIN o USING(account) WHERE obp IS NULL OR abs(v2_bp-obp)>=200 OR band<>{band.format("obp")}"""


@queries("score_changes", _score_changes_sql())
def score_changes(spark, d):
    """What is worth sending after the last day, all accounts having been sent a day before."""
    t = Tables(spark, d)
    until = t.ledger.agg(F.max("us")).first()[0] - _ONE_DAY_US
    earlier = features.feature_matrix(t.accounts, t.ledger.where(F.col("us") <= until), t.links, scoring.rule_score_v1)
    before = scoring.rule_score_v2(earlier).select("account", "v2_bp").withColumn("band", risk_band(F.col("v2_bp") / F.lit(10000.0)))
    now = t.scored.select("account", "v2_bp", (F.col("txn_in") + F.col("txn_out")).alias("txns"))
    return live.worth_sending(cut_lineage(now), cut_lineage(before))


@queries(
    "merged_delivery",
    """SELECT 'accounts' "table", account "key", concat_ws('|', bank, CAST(opened_on AS VARCHAR), CAST(opening_balance_paise AS VARCHAR), home_city) "row" FROM accounts
       UNION ALL SELECT 'ledger', txn_id, concat_ws('|', src, dst, CAST(amount_paise AS VARCHAR), CAST(us AS VARCHAR), channel, city) FROM ledger
       UNION ALL SELECT 'links', identifier_id, concat_ws('|', "type", account) FROM links""",
    "merged_delivery_rows",
)
def merged_delivery(spark, d):
    """The rows of two overlapping deliveries, which together hold everything, merged into each table once."""
    t = Tables(spark, d)
    no = F.expr("cast(substring(account, 4) as int)")
    early, late = F.col("us") <= F.lit(1_705_000_000_000_000), F.col("us") > F.lit(1_704_500_000_000_000)
    a, led, li = serve.merge_new_data(
        t.accounts.where(no % 3 != 0), t.ledger.where(early), t.links.where(no % 3 != 0), t.accounts.where(no % 3 != 1), t.ledger.where(late), t.links.where(no % 3 != 1)
    )

    def rows(df, name, key, *columns):
        return df.select(F.lit(name).alias("table"), F.col(key).alias("key"), F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("row"))

    return (
        rows(a, "accounts", "account", "bank", "opened_on", "opening_balance_paise", "home_city")
        .unionByName(rows(led, "ledger", "txn_id", "src", "dst", "amount_paise", "us", "channel", "city"))
        .unionByName(rows(li, "links", "identifier_id", "type", "account"))
    )


def _by_rule(t: Tables, scores=None):
    found = graph.discover_rings(t.accounts, t.ledger, t.links, t.scores() if scores is None else scores, min_mean_risk=0.5)
    return cut_lineage(found.select("ring_id", "account"))


_RULE_RINGS = f"{graph_queries._rings_sql(0.5)}, fnd AS (SELECT ring_id right_id, account FROM found)"
_OVERLAP = """SELECT left_id, right_id, count(*) b, any_value(ln) ln, any_value(rn) rn FROM (SELECT ring_id left_id, account, count(*) OVER (PARTITION BY ring_id) ln FROM truth) JOIN (SELECT *, count(*) OVER (PARTITION BY right_id) rn FROM fnd) USING(account) GROUP BY 1,2"""


def _best_sql(score: str) -> str:
    return f"""WITH RECURSIVE {_RULE_RINGS} SELECT left_id, right_id, round(score,6) score FROM (SELECT *, {score} score,
      row_number() OVER (PARTITION BY left_id ORDER BY {score} DESC, right_id) k FROM ({_OVERLAP})) WHERE k=1 AND score>=0.5e0"""


def _truth_and_found(t: Tables):
    return t.truth.select(F.col("ring_id").alias("left_id"), "account"), _by_rule(t).withColumnRenamed("ring_id", "right_id")


@queries("ring_match", _best_sql("b/CAST(ln+rn-b AS DOUBLE)"))
def ring_match(spark, d):
    return matching.best_jaccard(*_truth_and_found(Tables(spark, d))).withColumn("score", F.round("score", 6))


@queries("ring_continuity", _best_sql("b/CAST(least(ln,rn) AS DOUBLE)"))
def ring_continuity(spark, d):
    return matching.best_overlap(*_truth_and_found(Tables(spark, d))).withColumn("score", F.round("score", 6))


_LIVE_QUALITY = f"""WITH RECURSIVE {_RULE_RINGS}, best AS (SELECT left_id, right_id FROM (SELECT *, b/CAST(ln+rn-b AS DOUBLE) score, row_number() OVER (PARTITION BY left_id ORDER BY b/CAST(ln+rn-b AS DOUBLE) DESC, right_id) k FROM ({_OVERLAP})) WHERE k=1 AND score>=0.5e0),
     pl AS (SELECT ring_id, min(us) planted_us FROM ledger JOIN truth ON account=dst WHERE src LIKE 'VICTIM%' GROUP BY 1),
     tr AS (SELECT DISTINCT ring_id FROM truth JOIN pl USING(ring_id)),
     it AS (SELECT s.right_id, l.us, l.txn_id, row_number() OVER (PARTITION BY s.right_id ORDER BY l.us, l.txn_id) rn FROM ledger l JOIN fnd s ON s.account=l.src JOIN fnd q ON q.account=l.dst AND q.right_id=s.right_id),
     al AS (SELECT right_id, max(us) fired_us FROM it WHERE rn<=3 GROUP BY 1),
     bc AS (SELECT al.right_id, NOT EXISTS (SELECT 1 FROM ledger l JOIN fnd f ON f.account=l.src WHERE l.dst='CASH' AND f.right_id=al.right_id AND l.us<=al.fired_us) before_cashout FROM al),
     hit AS (SELECT b.*, (al.fired_us-pl.planted_us)/6e7 mins, bc.before_cashout FROM best b JOIN tr ON tr.ring_id=b.left_id JOIN pl ON pl.ring_id=b.left_id LEFT JOIN al USING(right_id) LEFT JOIN bc USING(right_id))
     SELECT (SELECT count(*) FROM tr) planted, count(*) caught, (SELECT count(*) FROM tr)-count(*) missed, (SELECT count(DISTINCT right_id) FROM fnd)-count(DISTINCT right_id) false_rings,
       CAST(floor(list_sort(list(mins))[count(mins)//2+1]+0.5e0) AS BIGINT) median_minutes_to_alert, count(*) FILTER (before_cashout) caught_before_cashout,
       (SELECT count(*) FROM scored WHERE v2_bp>=5000) flagged_accounts, (SELECT count(*) FROM scored WHERE v2_bp>=5000 AND account IN (SELECT account FROM truth JOIN tr USING(ring_id))) flagged_in_rings FROM hit"""


@queries("live_quality", _LIVE_QUALITY)
def live_quality(spark, d):
    t = Tables(spark, d)
    planted = t.truth.join(
        rings.victim_deposits(t.ledger, t.truth.select("ring_id", "account")).groupBy("ring_id").agg(F.min("us").alias("planted_us")), "ring_id"
    )
    scores = cut_lineage(t.scores())
    found = _by_rule(t, scores)
    al = rings.alerts(t.ledger, found)
    al = al.join(rings.cashout_eta(t.ledger, found, al).select("ring_id", "before_cashout"), "ring_id")
    return evaluate.live_quality(planted, found, al, scores)


@queries(
    "fund_flow_summary",
    """WITH RECURSIVE p AS (SELECT 1 hops, us s, us e, [src,dst] seen, dst "at" FROM ledger WHERE src LIKE 'VICTIM%'
      UNION ALL SELECT hops+1, s, l.us, list_append(seen,l.dst), l.dst FROM p JOIN ledger l ON l.src=p."at" AND l.us>p.e AND l.us<=p.e+86400000000 AND NOT list_contains(seen,l.dst)),
      y AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.src=p."at" AND l.us>p.e AND l.us<=p.e+86400000000 AND NOT list_contains(seen,l.dst)))
      SELECT count(*) total_paths, round(sum((e-s)/6e7)/sum(hops-1),4) avg_hop_latency_min, round(min((e-s)/6e7) FILTER (hops>1),4) fastest_path_minutes, false truncated FROM y""",
)
def fund_flow_summary(spark, d):
    """All paths to their end."""
    return flows.path_summary(flows.fund_flow_paths(Tables(spark, d).ledger))
