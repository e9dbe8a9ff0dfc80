"""The awkward cases of some queries on partial tables: channels, deposits, rings or accounts that are missing; each beside SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from muletrace.functions.exprs import risk_band
from muletrace.operators import evaluate, flows, freeze, graph, matching, rings, serve
from muletrace.plans import sqlviews
from muletrace.plans.ring_queries import _roles
from muletrace.plans.tables import Tables
from muletrace.session import cut_lineage
from muletrace.streaming import live

CASES = {}


def query(name, sql):
    def wrap(fn):
        CASES[name] = (fn, sql)
        return fn

    return wrap


sqlviews.define(
    "foundv",
    "SELECT concat('F', lpad(CAST((TRY_CAST(substr(account,4) AS INT)+TRY_CAST(substr(account,4) AS INT)//37)//8 AS VARCHAR),6,'0')) right_id, account FROM accounts",
)


_OVERLAP = """SELECT left_id, right_id, count(*) b, any_value(ln) ln, any_value(rn) rn FROM (SELECT ring_id left_id, account, count(*) OVER (PARTITION BY ring_id) ln FROM truth) JOIN (SELECT *, count(*) OVER (PARTITION BY right_id) rn FROM foundv) USING(account) GROUP BY 1,2"""


def _shifted_sets(t: Tables):
    """Other member sets over the same accounts, for matching: blocks of eight that drift against the planted tens."""
    no = F.expr("(cast(substring(account, 4) as int) + cast(substring(account, 4) as int) div 37) div 8")
    return t.accounts.select(F.concat(F.lit("F"), F.lpad(no.cast("string"), 6, "0")).alias("right_id"), "account")


@query(
    "ring_match",
    f"""SELECT left_id, right_id, round(score,6) score FROM (SELECT *, b/CAST(ln+rn-b AS DOUBLE) score, row_number() OVER (PARTITION BY left_id ORDER BY b/CAST(ln+rn-b AS DOUBLE) DESC, right_id) k FROM ({_OVERLAP})) WHERE k=1 AND score>=0.5e0""",
)
def ring_match(spark, d):
    t = Tables(spark, d)
    m = matching.best_jaccard(t.truth.select(F.col("ring_id").alias("left_id"), "account"), _shifted_sets(t))
    return m.withColumn("score", F.round("score", 6))


@query(
    "ring_continuity",
    f"""SELECT left_id, right_id, round(score,6) score FROM (SELECT *, b/CAST(least(ln,rn) AS DOUBLE) score, row_number() OVER (PARTITION BY left_id ORDER BY b/CAST(least(ln,rn) AS DOUBLE) DESC, right_id) k FROM ({_OVERLAP})) WHERE k=1 AND score>=0.5e0""",
)
def ring_continuity(spark, d):
    t = Tables(spark, d)
    m = matching.best_overlap(t.truth.select(F.col("ring_id").alias("left_id"), "account"), _shifted_sets(t))
    return m.withColumn("score", F.round("score", 6))


@query(
    "live_quality",
    f"""WITH best AS (SELECT left_id, right_id FROM (SELECT *, b/CAST(ln+rn-b AS DOUBLE) score, row_number() OVER (PARTITION BY left_id ORDER BY b/CAST(ln+rn-b AS DOUBLE) DESC, right_id) k FROM ({_OVERLAP})) WHERE k=1 AND score>=0.5e0),
     pl AS (SELECT ring_id, min(us) planted_us FROM ledger JOIN truth ON account=dst WHERE src LIKE 'VICTIM%' GROUP BY 1),
     tr AS (SELECT DISTINCT ring_id FROM truth JOIN pl USING(ring_id)),
     it AS (SELECT s.right_id, l.us, l.txn_id, row_number() OVER (PARTITION BY s.right_id ORDER BY l.us, l.txn_id) rn FROM ledger l JOIN foundv s ON s.account=l.src JOIN foundv q ON q.account=l.dst AND q.right_id=s.right_id),
     al AS (SELECT right_id, max(us) fired_us FROM it WHERE rn<=3 GROUP BY 1),
     bc AS (SELECT al.right_id, NOT EXISTS (SELECT 1 FROM ledger l JOIN foundv f ON f.account=l.src WHERE l.dst='CASH' AND f.right_id=al.right_id AND l.us<=al.fired_us) before_cashout FROM al),
     hit AS (SELECT b.*, (al.fired_us-pl.planted_us)/6e7 mins, bc.before_cashout FROM best b JOIN tr ON tr.ring_id=b.left_id JOIN pl ON pl.ring_id=b.left_id LEFT JOIN al USING(right_id) LEFT JOIN bc USING(right_id))
     SELECT (SELECT count(*) FROM tr) planted, count(*) caught, (SELECT count(*) FROM tr)-count(*) missed, (SELECT count(DISTINCT right_id) FROM foundv)-count(DISTINCT right_id) false_rings,
       CAST(floor(list_sort(list(mins))[count(mins)//2+1]+0.5e0) AS BIGINT) median_minutes_to_alert, count(*) FILTER (before_cashout) caught_before_cashout,
       (SELECT count(*) FROM scored WHERE v2_bp>=5000) flagged_accounts, (SELECT count(*) FROM scored WHERE v2_bp>=5000 AND account IN (SELECT account FROM truth JOIN tr USING(ring_id))) flagged_in_rings FROM hit""",
)
def live_quality(spark, d):
    t = Tables(spark, d)
    planted = t.truth.join(
        rings.victim_deposits(t.ledger, t.truth.select("ring_id", "account")).groupBy("ring_id").agg(F.min("us").alias("planted_us")), "ring_id"
    )
    found = _shifted_sets(t).withColumnRenamed("right_id", "ring_id")
    al = rings.alerts(t.ledger, found)
    al = al.join(rings.cashout_eta(t.ledger, found, al).select("ring_id", "before_cashout"), "ring_id")
    return evaluate.live_quality(planted, found, al, cut_lineage(t.scores()))


def _layered(t: Tables):
    """Internal channels a few accounts apart, first account of each block as the start: several layers deep."""
    gap = F.expr("try_cast(substring(dst, 4) as int) - try_cast(substring(src, 4) as int)")
    e = cut_lineage(rings.ring_edges(t.ledger, t.members).where(gap.isin(1, 2, -4)).select("ring_id", "src", "dst"))
    start = t.members.where(F.expr("cast(substring(account, 4) as int) % 10 = 0"))
    return e, graph.hop_distance(e, start)


@query(
    "hop_distance",
    """WITH RECURSIVE e AS (SELECT ring_id, src, dst FROM internal WHERE TRY_CAST(substr(dst,4) AS INT)-TRY_CAST(substr(src,4) AS INT) IN (1,2,-4)),
     r AS (SELECT ring_id, account, 0 hop FROM planted WHERE TRY_CAST(substr(account,4) AS INT)%10=0 UNION SELECT e.ring_id, e.dst, hop+1 FROM r JOIN e ON e.ring_id=r.ring_id AND e.src=r.account WHERE hop<12)
     SELECT ring_id, account, min(hop) hop FROM r GROUP BY 1,2""",
)
def hop_distance(spark, d):
    return _layered(Tables(spark, d))[1]


@query(
    "layer_columns",
    """WITH RECURSIVE e AS (SELECT DISTINCT ring_id, src, dst FROM internal WHERE TRY_CAST(substr(dst,4) AS INT)-TRY_CAST(substr(src,4) AS INT) IN (1,2,-4)),
     r AS (SELECT ring_id, account, 0 hop FROM planted WHERE TRY_CAST(substr(account,4) AS INT)%10=0 UNION SELECT e.ring_id, e.dst, hop+1 FROM r JOIN e ON e.ring_id=r.ring_id AND e.src=r.account WHERE hop<12),
     h AS (SELECT ring_id, account, min(hop) hop FROM r GROUP BY 1,2),
     f AS (SELECT e.* FROM e JOIN h a ON a.ring_id=e.ring_id AND a.account=e.src JOIN h b ON b.ring_id=e.ring_id AND b.account=e.dst WHERE a.hop<b.hop OR (a.hop=b.hop AND e.src<e.dst)),
     c AS (SELECT ring_id, account, 0 col FROM h WHERE hop=0 UNION SELECT f.ring_id, f.dst, col+1 FROM c JOIN f ON f.ring_id=c.ring_id AND f.src=c.account)
     SELECT ring_id, account, max(col) "column" FROM c GROUP BY 1,2""",
)
def layer_columns(spark, d):
    e, h = _layered(Tables(spark, d))
    return graph.layer_columns(e, h)


@query(
    "freeze_reachability",
    """WITH RECURSIVE fz AS (SELECT ring_id, account FROM planted WHERE TRY_CAST(substr(account,4) AS INT)%3=0),
     e AS (SELECT * FROM channels c WHERE dst<>src AND NOT EXISTS (SELECT 1 FROM fz WHERE fz.account=c.src) AND NOT EXISTS (SELECT 1 FROM fz WHERE fz.account=c.dst) AND TRY_CAST(substr(src,4) AS INT)%2=CASE WHEN dst='CASH' THEN 0 ELSE TRY_CAST(substr(src,4) AS INT)%2 END),
     r(ring_id, account) AS (SELECT ring_id, src FROM e WHERE dst='CASH' UNION SELECT e.ring_id, e.src FROM e JOIN r ON r.ring_id=e.ring_id AND r.account=e.dst)
     SELECT ring_id, account FROM r""",
)
def freeze_reachability(spark, d):
    """Every third account frozen, and only even accounts keep their channel to cash, so longer ways are needed."""
    t = Tables(spark, d)
    no = F.expr("cast(substring(src, 4) as int)")
    edges = freeze.flow_graph(t.ledger, t.members).where(F.col("src") != F.col("dst"))
    edges = edges.where((F.col("dst") != "CASH") | (no % 2 == 0))
    frozen = t.members.where(F.expr("cast(substring(account, 4) as int) % 3 = 0"))
    return freeze.reaches_cash(edges, frozen)


@query(
    "fund_flow_summary",
    """WITH RECURSIVE p AS (SELECT 1 hops, us s, us e, [src,dst] seen, dst "at" FROM ledger WHERE src LIKE 'VICTIM%'
      UNION ALL SELECT hops+1, s, l.us, list_append(seen,l.dst), l.dst FROM p JOIN ledger l ON l.src=p."at" AND l.us>p.e AND l.us<=p.e+86400000000 AND NOT list_contains(seen,l.dst) WHERE hops<3),
      x AS (SELECT *, EXISTS (SELECT 1 FROM ledger l WHERE l.src=p."at" AND l.us>p.e AND l.us<=p.e+86400000000 AND NOT list_contains(seen,l.dst)) more FROM p), y AS (SELECT * FROM x WHERE hops=3 OR NOT more)
      SELECT count(*) total_paths, round(sum((e-s)/6e7)/sum(hops-1),4) avg_hop_latency_min, round(min((e-s)/6e7) FILTER (hops>1),4) fastest_path_minutes, bool_or(more) truncated FROM y""",
)
def fund_flow_summary(spark, d):
    """Paths cut at three hops, so some could go on."""
    return flows.path_summary(flows.fund_flow_paths(Tables(spark, d).ledger, max_hops=3))


@query(
    "complete_ring",
    """WITH ed AS (SELECT ring_id, src, dst, CAST(sum(amount_paise) AS BIGINT) amount_paise FROM internal GROUP BY 1,2,3),
     dep AS (SELECT ring_id, src, dst, amount_paise FROM ledger JOIN planted p ON p.account=dst WHERE src LIKE 'VICTIM%' AND TRY_CAST(substr(ring_id,5) AS INT)%2=0),
     r AS (SELECT roles.*, EXISTS(SELECT 1 FROM ed WHERE ed.ring_id=roles.ring_id AND ed.dst=roles.account) paid FROM roles WHERE ring_id NOT IN (SELECT ring_id FROM dep)),
     t AS (SELECT *, CASE WHEN role='source' THEN 1 WHEN NOT paid THEN 2 ELSE 3 END tier FROM r),
     c AS (SELECT t.* FROM t JOIN (SELECT ring_id, min(tier) bt, min(account) fa FROM t GROUP BY 1) b ON b.ring_id=t.ring_id AND t.tier=b.bt AND (t.tier<3 OR t.account=b.fa))
     SELECT ring_id, src, dst, amount_paise, 'transfer' kind FROM ed UNION ALL SELECT *, 'victim' FROM dep
     UNION ALL SELECT ring_id, concat('VICTIM:',ring_id), account, CAST(coalesce(nullif((SELECT sum(amount_paise) FROM ed WHERE ed.ring_id=c.ring_id AND ed.src=c.account),0), (SELECT volume_paise FROM ring_summary s WHERE s.ring_id=c.ring_id),0) AS BIGINT), 'victim' FROM c
     UNION ALL SELECT ring_id, account, 'CASH', CAST(coalesce((SELECT sum(amount_paise) FROM ed WHERE ed.ring_id=roles.ring_id AND ed.dst=roles.account),0) AS BIGINT), 'cash' FROM roles WHERE role='cash-out'""",
)
def complete_ring(spark, d):
    """Deposits of every second ring are treated as not yet seen, so stand-in victims occur."""
    t = Tables(spark, d)
    seen = rings.victim_deposits(t.ledger, t.members).where(F.expr("cast(substring(ring_id, 5) as int) % 2 = 0"))
    edges = rings.ring_edges(t.ledger, t.members)
    return rings.complete_ring_edges(edges, _roles(t), seen, rings.ring_volumes(t.ledger, t.members))


@query(
    "alerts_with_ring",
    """SELECT alert_id, a.ring_id, fired_at, CASE WHEN known THEN risk END risk, CASE WHEN known THEN members ELSE 0 END members
       FROM (SELECT *, TRY_CAST(substr(ring_id,5) AS INT)%4<>3 known FROM alerts) a JOIN ring_summary USING(ring_id)""",
)
def alerts_with_ring(spark, d):
    """A quarter of the rings is held back from the summary side, so dangling alerts occur."""
    t = Tables(spark, d)
    known = rings.ring_summary(t.ledger, t.members, t.scores()).where(F.expr("cast(substring(ring_id, 5) as int) % 4 <> 3"))
    return rings.alerts_with_ring(rings.alerts(t.ledger, t.members), known).select(
        "alert_id", "ring_id", "fired_at", "risk", "members"
    )


@query("unknown_accounts", "SELECT DISTINCT account FROM acct_ev WHERE account NOT IN (SELECT account FROM accounts WHERE TRY_CAST(substr(account,4) AS INT)%9<>0)")
def unknown_accounts(spark, d):
    """Accounts divisible by nine are taken out of the account table, so gaps exist."""
    t = Tables(spark, d)
    return serve.unknown_accounts(t.ledger, t.accounts.where(F.expr("cast(substring(account, 4) as int) % 9 <> 0")))


@query(
    "merged_delivery",
    """SELECT 'accounts' "table", count(*) n FROM accounts UNION ALL SELECT 'ledger', count(*) FROM ledger UNION ALL SELECT 'links', count(*) FROM links""",
)
def merged_delivery(spark, d):
    """Two overlapping deliveries of the same tables merge back into each table once."""
    t = Tables(spark, d)
    no = F.expr("cast(substring(account, 4) as int)")
    early, late = F.col("us") <= F.lit(1_705_000_000_000_000), F.col("us") > F.lit(1_704_500_000_000_000)
    a, led, li = serve.merge_new_data(
        t.accounts.where(no % 3 != 0), t.ledger.where(early), t.links.where(no % 3 != 0), t.accounts.where(no % 3 != 1), t.ledger.where(late), t.links.where(no % 3 != 1)
    )
    tables = {"accounts": a, "ledger": led, "links": li}
    out = None
    for n, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@query(
    "score_changes",
    """WITH n AS (SELECT account, v2_bp, CASE WHEN v2_bp>=8000 THEN 'CRITICAL' WHEN v2_bp>=6000 THEN 'HIGH' WHEN v2_bp>=3500 THEN 'MEDIUM' ELSE 'LOW' END band, txn_in+txn_out txns FROM scored),
      o AS (SELECT account, CAST(v2_bp+TRY_CAST(substr(account,4) AS INT)*37%400-200 AS BIGINT) obp FROM scored WHERE TRY_CAST(substr(account,4) AS INT)%5<>0)
      SELECT n.account, v2_bp, band, txns<3 provisional FROM n LEFT JOIN o USING(account) WHERE obp IS NULL OR abs(v2_bp-obp)>=200 OR band<>CASE WHEN obp>=8000 THEN 'CRITICAL' WHEN obp>=6000 THEN 'HIGH' WHEN obp>=3500 THEN 'MEDIUM' ELSE 'LOW' END""",
)
def score_changes(spark, d):
    """Scores sent before are shifted by a fixed pattern, and a fifth of the accounts was never sent."""
    s = cut_lineage(Tables(spark, d).scored.select("account", "v2_bp", (F.col("txn_in") + F.col("txn_out")).alias("txns")))
    no = F.expr("cast(substring(account, 4) as int)")
    before = s.where(no % 5 != 0).select("account", (F.col("v2_bp") + no * 37 % 400 - 200).alias("v2_bp"))
    before = before.withColumn("band", risk_band(F.col("v2_bp") / F.lit(10000.0)))
    return live.worth_sending(s, before)
