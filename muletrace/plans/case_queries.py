"""Queries on cases: traced money, freezes, fund-flow paths, recruits, case report."""

from __future__ import annotations

from pyspark.sql import functions as F

from muletrace.operators import flows, freeze, recruits, rings, taint
from muletrace.plans import sqlviews
from muletrace.plans.registry import query
from muletrace.plans.tables import Tables

# Tracing in SQL: one step per transfer of the case, balances carried in maps. Money of a case cannot leave its block
# of accounts (counterparties are inside the block), so the block's transfers are the whole case.
sqlviews.define(
    "cases",
    "SELECT txn_id case_id, ring_id, us vus FROM ledger JOIN planted p ON p.account=dst WHERE src LIKE 'VICTIM%'",
)
sqlviews.define(
    "case_txn",
    """SELECT c.case_id, c.ring_id, l.src, l.dst, l.amount_paise x, l.us, l.txn_id=c.case_id isv, row_number() OVER (PARTITION BY c.case_id ORDER BY l.us, l.txn_id) rn
     FROM cases c JOIN (SELECT DISTINCT p.ring_id, l.* FROM ledger l JOIN planted p ON p.account=l.src OR p.account=l.dst) l ON l.ring_id=c.ring_id""",
)
sqlviews.define(
    "fold",
    """SELECT c.case_id, CAST(0 AS BIGINT) rn, '' src, '' dst, CAST(0 AS BIGINT) moved, CAST(0 AS BIGINT) fresh,
       map_from_entries(list((a.account, CAST(a.opening_balance_paise AS BIGINT)))) bal, map_from_entries(list((a.account, CAST(0 AS BIGINT)))) tn
     FROM cases c JOIN planted p USING(ring_id) JOIN accounts a ON a.account=p.account GROUP BY c.case_id
     UNION ALL
     SELECT case_id, rn, src, dst, moved, fresh,
       map_concat(bal, map_from_entries([(src, coalesce(bal[src],1000000000000000)-x)]), map_from_entries([(dst, coalesce(bal[dst],0)+x)])),
       map_concat(tn, map_from_entries([(src, coalesce(tn[src],0)-moved)]), map_from_entries([(dst, coalesce(tn[dst],0)+moved+fresh)]))
     FROM (SELECT t.case_id, t.rn, t.src, t.dst, t.x, f.bal, f.tn,
        CASE WHEN coalesce(f.bal[t.src],0)>0 AND coalesce(f.tn[t.src],0)>0 THEN (t.x*f.tn[t.src])//f.bal[t.src] ELSE 0 END moved, CASE WHEN t.isv THEN t.x ELSE 0 END fresh
       FROM fold f JOIN case_txn t ON t.case_id=f.case_id AND t.rn=f.rn+1)""",
)
sqlviews.define(
    "tbal",
    """SELECT case_id, unnest(map_keys(bal)) account, unnest(map_values(bal)) balance, tn FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rn DESC) last FROM fold) WHERE last=1""",
)
sqlviews.define(
    "tacc",
    "SELECT case_id, account, greatest(balance,0) balance, tn[account] tainted, least(tn[account], greatest(balance,0)) lien FROM tbal WHERE account LIKE 'ACC%' AND tn[account]>0",
)
sqlviews.define(
    "tflow",
    "SELECT case_id, src, dst, CAST(sum(moved) AS BIGINT) \"value\" FROM fold WHERE moved>0 GROUP BY 1,2,3",
)
sqlviews.define(
    "tsum",
    """SELECT c.case_id, l.amount_paise victim_amount, CAST(coalesce((SELECT sum("value") FROM tflow f WHERE f.case_id=c.case_id AND dst='CASH'),0) AS BIGINT) lost_to_cash,
      (SELECT count(*) FROM tacc a WHERE a.case_id=c.case_id) holders FROM cases c JOIN ledger l ON l.txn_id=c.case_id""",
)
sqlviews.define(
    "channels",
    """SELECT DISTINCT s.ring_id, l.src, l.dst FROM ledger l JOIN planted s ON s.account=l.src LEFT JOIN planted d ON d.account=l.dst AND d.ring_id=s.ring_id WHERE l.dst='CASH' OR d.account IS NOT NULL""",
)


def _cases(t: Tables):
    return taint.victim_cases(rings.victim_deposits(t.ledger, t.members))


def _traced(t: Tables):
    cases = _cases(t)
    balances, moved = taint.trace(t.ledger, t.accounts, cases)
    return cases, balances, moved


@query("taint_accounts", "WITH RECURSIVE one AS (SELECT 1) SELECT case_id, account, balance, tainted, lien FROM tacc")
def taint_accounts(spark, d):
    _c, balances, _f = _traced(Tables(spark, d))
    return taint.case_accounts(balances)


@query("taint_flows", 'WITH RECURSIVE one AS (SELECT 1) SELECT case_id, src, dst, "value" FROM tflow')
def taint_flows(spark, d):
    _c, _b, moved = _traced(Tables(spark, d))
    return moved


@query("taint_summary", "WITH RECURSIVE one AS (SELECT 1) SELECT case_id, victim_amount, lost_to_cash, holders FROM tsum")
def taint_summary(spark, d):
    _c, balances, _f = _traced(Tables(spark, d))
    return taint.case_summary(balances)


@query(
    "taint_members_as_of",
    """WITH RECURSIVE one AS (SELECT 1), last AS (SELECT t.case_id, max(t.rn) rn FROM case_txn t JOIN cases c USING(case_id) WHERE t.us<=c.vus+172800000000 GROUP BY 1),
       st AS (SELECT f.case_id, unnest(map_keys(bal)) account, unnest(map_values(bal)) balance, tn FROM fold f JOIN last ON last.case_id=f.case_id AND last.rn=f.rn)
       SELECT case_id, account, greatest(balance,0) balance, tn[account] tainted, least(tn[account], greatest(balance,0)) lien FROM st WHERE account LIKE 'ACC%' AND tn[account]>0""",
)
def taint_members_as_of(spark, d):
    """Cases looked at two days after the deposit, payload limited to ring members."""
    t = Tables(spark, d)
    deposits = rings.victim_deposits(t.ledger, t.members)
    cases = taint.victim_cases(deposits).join(
        deposits.select(F.col("txn_id").alias("case_id"), (F.col("us") + 2 * 86_400_000_000).alias("as_of_us")), "case_id"
    )
    balances, _f = taint.trace(t.ledger, t.accounts, cases)
    return taint.member_accounts(taint.case_accounts(balances), cases, t.members)


@query(
    "sankey_links",
    """WITH RECURSIVE one AS (SELECT 1), o AS (SELECT case_id, src account, sum("value") v FROM tflow GROUP BY 1,2), i AS (SELECT case_id, dst account, sum("value") v FROM tflow GROUP BY 1,2),
     k AS (SELECT case_id, account FROM o UNION SELECT case_id, account FROM i UNION SELECT case_id, account FROM tacc)
     SELECT case_id, src, dst, "value" FROM tflow UNION ALL
     SELECT case_id, 'VICTIM', account, CAST(owed AS BIGINT) FROM (SELECT k.case_id, k.account, coalesce(o.v,0)+coalesce(a.tainted,0)-coalesce(i.v,0) owed FROM k LEFT JOIN o ON o.case_id=k.case_id AND o.account=k.account
       LEFT JOIN i ON i.case_id=k.case_id AND i.account=k.account LEFT JOIN tacc a ON a.case_id=k.case_id AND a.account=k.account WHERE k.account<>'CASH') WHERE owed>0.5""",
)
def sankey_links(spark, d):
    _c, balances, moved = _traced(Tables(spark, d))
    return taint.sankey_links(taint.case_accounts(balances), moved)


@query(
    "conserving_rupees",
    """WITH RECURSIVE one AS (SELECT 1), h AS (SELECT case_id, account, tainted FROM tacc),
     r AS (SELECT *, (tainted+50)//100 ru, row_number() OVER (PARTITION BY case_id ORDER BY (tainted+50)//100 DESC, account) rk, sum((tainted+50)//100) OVER (PARTITION BY case_id) s, sum(tainted) OVER (PARTITION BY case_id) tt FROM h)
     SELECT case_id, account, CAST(ru + CASE WHEN rk=1 THEN (tt+50)//100 - s ELSE 0 END AS BIGINT) rupees FROM r""",
)
def conserving_rupees(spark, d):
    _c, balances, _f = _traced(Tables(spark, d))
    acc = taint.case_accounts(balances)
    totals = acc.groupBy("case_id").agg(F.sum("tainted").alias("total"))
    return taint.conserving_rupees(acc, totals)


@query(
    "ring_last_activity",
    "SELECT ring_id, max(us) as_of_us, max(ts) as_of FROM (SELECT src a, us, ts FROM ledger UNION ALL SELECT dst, us, ts FROM ledger) JOIN planted ON account=a GROUP BY 1",
)
def ring_last_activity(spark, d):
    t = Tables(spark, d)
    return taint.ring_last_activity(t.ledger, t.members)


@query(
    "flow_graph",
    """SELECT s.ring_id, l.src, l.dst, CAST(sum(amount_paise) AS BIGINT) amount_paise FROM ledger l JOIN planted s ON s.account=l.src LEFT JOIN planted d ON d.account=l.dst AND d.ring_id=s.ring_id
       WHERE l.dst='CASH' OR d.account IS NOT NULL GROUP BY 1,2,3""",
)
def flow_graph(spark, d):
    t = Tables(spark, d)
    return freeze.flow_graph(t.ledger, t.members)


def _freeze_sql(excluded: str = "FALSE") -> str:
    """Three rounds; each tries every holder that may be frozen on top of those of the rounds before."""
    rounds, chosen = [], "base AS (SELECT case_id, ring_id, CAST([] AS VARCHAR[]) cut, CAST(0 AS BIGINT) secured FROM cases)"
    risk = """risk{k} AS (SELECT t.case_id, t.account, CAST(coalesce(sum(nd.tainted),0) AS BIGINT) risk FROM try{k} t LEFT JOIN r{k} r ON r.case_id=t.case_id AND r.account=t.account
      LEFT JOIN nd ON nd.case_id=r.case_id AND nd.account=r.here GROUP BY 1,2)"""
    reach = """r{k}(case_id, ring_id, account, cut, here) AS (SELECT case_id, ring_id, account, cut, 'CASH' FROM try{k}
      UNION SELECT r.case_id, r.ring_id, r.account, r.cut, e.src FROM r{k} r JOIN channels e ON e.ring_id=r.ring_id AND e.dst=r.here WHERE NOT list_contains(r.cut, e.src))"""
    before = [
        "try0 AS (SELECT case_id, ring_id, '' account, CAST([] AS VARCHAR[]) cut FROM cases)",
        reach.format(k=0),
        risk.format(k=0),
    ]
    last = "base"
    for k in (1, 2, 3):
        rounds += [
            f"try{k} AS (SELECT p.case_id, p.ring_id, nd.account, list_append(p.cut, nd.account) cut FROM {last} p JOIN nd USING(case_id) WHERE NOT nd.excluded AND NOT list_contains(p.cut, nd.account))",
            reach.format(k=k),
            risk.format(k=k),
            f"""best{k} AS (SELECT * FROM (SELECT x.case_id, x.account, b.risk-x.risk gain, row_number() OVER (PARTITION BY x.case_id ORDER BY x.risk, x.account) rk FROM risk{k} x JOIN risk0 b USING(case_id)) WHERE rk=1)""",
            f"""step{k} AS (SELECT p.case_id, p.ring_id, CASE WHEN g.gain>p.secured THEN list_append(p.cut, g.account) ELSE p.cut END cut, greatest(p.secured, coalesce(g.gain,0)) secured FROM {last} p LEFT JOIN best{k} g USING(case_id))""",
        ]
        last = f"step{k}"
    nd = f"nd AS (SELECT c.case_id, c.ring_id, a.account, a.tainted, {excluded} excluded FROM tacc a JOIN cases c USING(case_id) JOIN planted p ON p.ring_id=c.ring_id AND p.account=a.account)"
    return f"""WITH RECURSIVE one AS (SELECT 1), {", ".join([nd, chosen, *before, *rounds])}
      SELECT s.case_id, s.ring_id, array_to_string(list_sort(s.cut), ',') frozen, b.risk at_risk_before, s.secured, round(s.secured/CAST(greatest(b.risk,1) AS DOUBLE),4) pct_stopped, b.risk=0 nothing_at_risk
      FROM {last} s JOIN risk0 b USING(case_id)"""


@query("freeze_plan", _freeze_sql())
def freeze_plan(spark, d):
    t = Tables(spark, d)
    cases, balances, _f = _traced(t)
    p = freeze.recommend(t.ledger, cases, t.members, balances, k=3)
    return p.withColumn("frozen", F.array_join("frozen", ","))


@query("freeze_plan_excluding", _freeze_sql("TRY_CAST(substr(a.account,4) AS INT)%3=0"))
def freeze_plan_excluding(spark, d):
    """Every third account may not be frozen."""
    t = Tables(spark, d)
    cases, balances, _f = _traced(t)
    barred = balances.where(F.expr("try_cast(substring(account, 4) as int) % 3 = 0")).select("case_id", "account")
    p = freeze.recommend(t.ledger, cases, t.members, balances, k=3, exclude=barred)
    return p.withColumn("frozen", F.array_join("frozen", ","))


@query(
    "fund_flow_paths",
    """WITH RECURSIVE p AS (SELECT txn_id path_id, 1 hops, us s, us e, amount_paise a0, amount_paise a1, [src,dst] seen, dst "at", 0e0 tot FROM ledger WHERE src LIKE 'VICTIM%'
      UNION ALL SELECT concat(path_id,'>',l.txn_id), hops+1, s, l.us, a0, l.amount_paise, list_append(seen,l.dst), l.dst, p.tot+(l.us-e)/6e7 FROM p JOIN ledger l ON l.src=p."at" AND l.us>p.e AND l.us<=p.e+86400000000 AND NOT list_contains(seen,l.dst)),
      x AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.src=p."at" AND l.us>p.e AND l.us<=p.e+86400000000 AND NOT list_contains(seen,l.dst)))
      SELECT path_id, CAST(hops AS BIGINT) hops, s start_us, e end_us, round((e-s)/6e7,6) duration_minutes, a0 initial_amount_paise, a1 final_amount_paise,
        round(CASE WHEN a0>0 THEN (a0-a1)/CAST(a0 AS DOUBLE)*100 ELSE 0e0 END,6) amount_decay_pct, array_to_string(seen,'>') accounts, round(tot,6) latency_sum FROM x""",
)
def fund_flow_paths(spark, d):
    p = flows.fund_flow_paths(Tables(spark, d).ledger)
    return p.select(
        "path_id",
        "hops",
        "start_us",
        "end_us",
        F.round("duration_minutes", 6).alias("duration_minutes"),
        "initial_amount_paise",
        "final_amount_paise",
        F.round("amount_decay_pct", 6).alias("amount_decay_pct"),
        F.expr("concat_ws('>', chain[0].from_account, array_join(transform(chain, h -> h.to_account), '>'))").alias("accounts"),
        F.round(F.expr("aggregate(chain, 0D, (a, h) -> a + coalesce(h.latency_min, 0D))"), 6).alias("latency_sum"),
    )


@query(
    "two_hop_chains",
    """SELECT i.account, count(*) chained FROM acct_ev i JOIN acct_ev o ON o.account=i.account AND i.dir='C' AND o.dir='D' AND o.us>i.us AND o.us<=i.us+7200000000 GROUP BY 1""",
)
def two_hop_chains(spark, d):
    return flows.two_hop_chains(Tables(spark, d).ledger, max_gap_minutes=120)


_AS_OF_US = 1_704_240_000_000_000  # 2024-01-03 00:00 UTC

sqlviews.define(
    "recr",
    f"""SELECT ring_id, account, score, reasons, age_days FROM (
     SELECT ring_id, account, least((bp*100)//90, 100) score, round(age,1) age_days, concat_ws('; ', CASE WHEN dev IS NOT NULL THEN concat('Shares device with ring member ', dev) END,
       CASE WHEN phn IS NOT NULL THEN concat('Shares phone number with ring member ', phn) END, CASE WHEN ip IS NOT NULL THEN 'Shares IP address with a ring member' END,
       CASE WHEN age<=3 THEN concat('Account is only ', printf('%.0f', age), ' days old') WHEN age<=14 THEN concat('Account is ', printf('%.0f', age), ' days old (recently opened)') END,
       CASE WHEN txns=0 THEN 'No transactions yet — account is inactive' END,
       CASE WHEN nb>=0.5e0 THEN concat('Connected to high-risk accounts (mean risk ', printf('%.2f', nb), ')') END) reasons
     FROM (SELECT *, CASE WHEN dev IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN phn IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN ip IS NOT NULL THEN 10 ELSE 0 END
        + CASE WHEN age<=3 THEN 20 WHEN age<=14 THEN 10 ELSE 0 END + CASE WHEN txns=0 THEN 10 ELSE 0 END + CASE WHEN nb>=0.5e0 THEN 10 ELSE 0 END bp
       FROM (SELECT m.ring_id, o.account, min(m.account) FILTER (o.type='device') dev, min(m.account) FILTER (o.type='phone') phn, min(m.account) FILTER (o.type='ip') ip,
          any_value(({_AS_OF_US}-epoch_us(CAST(f.opened_on AS TIMESTAMP)))/8.64e10) age, any_value(f.txn_in+f.txn_out) txns, any_value(f.neighbour_risk_v1) nb
         FROM planted m JOIN links ml ON ml.account=m.account JOIN links o ON o.identifier_id=ml.identifier_id JOIN feat f ON f.account=o.account
         WHERE NOT EXISTS (SELECT 1 FROM planted x WHERE x.ring_id=m.ring_id AND x.account=o.account) GROUP BY 1,2))) WHERE score>=30""",
)


def _recruits(t: Tables, joined: str | None = None):
    return recruits.recruits(t.accounts, t.members, t.links, t.matrix, _AS_OF_US, joined)


@query("recruits", "SELECT ring_id, account, CAST(score AS BIGINT) score, reasons, age_days FROM recr")
def recruits_query(spark, d):
    return _recruits(Tables(spark, d), "; ")


@query(
    "recruit_probabilities",
    "SELECT ring_id, account, round(least(1e0, CASE WHEN score>1 THEN score/100e0 ELSE score END),4) probability FROM recr",
)
def recruit_probabilities(spark, d):
    r = _recruits(Tables(spark, d))
    return r.select("ring_id", "account", recruits.normalised_probability(F.col("score")).alias("probability"))


@query(
    "recruit_ranking",
    'SELECT ring_id, row_number() OVER (PARTITION BY ring_id ORDER BY score DESC, account) "rank", account, CAST(score AS BIGINT) score FROM recr',
)
def recruit_ranking(spark, d):
    t = Tables(spark, d)
    return recruits.ranking(t.accounts, t.members, t.links, t.matrix, _AS_OF_US)
