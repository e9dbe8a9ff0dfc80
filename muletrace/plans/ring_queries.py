"""Queries on given rings: roll-ups, alerts, roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from muletrace.operators import rings
from muletrace.plans import sqlviews
from muletrace.plans.registry import query
from muletrace.plans.tables import Tables

sqlviews.define(
    "sides",
    """SELECT src account, dst counterparty, false credit, amount_paise, us FROM ledger
       UNION ALL SELECT dst, src, true, amount_paise, us FROM ledger""",
)
sqlviews.define(
    "rlinks",
    """SELECT ring_id, "type", identifier_id, count(*) members_on FROM links JOIN planted USING(account) GROUP BY ALL HAVING count(*)>=2""",
)
sqlviews.define(
    "rstat",
    """SELECT p.ring_id, p.account,
  coalesce(sum(amount_paise) FILTER (credit),0) inflow, coalesce(sum(amount_paise) FILTER (credit AND q.account IS NULL),0) inflow_outside,
  coalesce(sum(amount_paise) FILTER (NOT credit),0) outflow, coalesce(sum(amount_paise) FILTER (NOT credit AND counterparty='CASH'),0) outflow_cash,
  count(DISTINCT CASE WHEN credit THEN q.account END) ring_senders, count(DISTINCT CASE WHEN NOT credit THEN q.account END) ring_receivers,
  min(us) first_us, any_value(coalesce(sh.shares,0)) shares
 FROM planted p LEFT JOIN sides s ON s.account=p.account LEFT JOIN planted q ON q.ring_id=p.ring_id AND q.account=s.counterparty
 LEFT JOIN (SELECT ring_id, account, sum(members_on-1) shares FROM rlinks JOIN links USING(identifier_id,"type") JOIN planted USING(ring_id,account) GROUP BY 1,2) sh
   ON sh.ring_id=p.ring_id AND sh.account=p.account GROUP BY 1,2""",
)
sqlviews.define(
    "rstat2",
    """SELECT r.*, outflow/CAST(greatest(v.volume_paise,1) AS DOUBLE) vol_share, f.pass_through, f.median_hold_min
  FROM rstat r JOIN (SELECT m.ring_id, coalesce(sum(i.amount_paise),0) volume_paise FROM (SELECT DISTINCT ring_id FROM planted) m LEFT JOIN internal i USING(ring_id) GROUP BY 1) v USING(ring_id) LEFT JOIN feat0 f USING(account)""",
)
sqlviews.define(
    "rsource",
    """SELECT ring_id, account source FROM (SELECT *, row_number() OVER (PARTITION BY ring_id ORDER BY first_us, account) rn FROM rstat2
  WHERE NOT (shares>=3 AND vol_share<0.1e0) AND inflow>0 AND inflow_outside/CAST(inflow AS DOUBLE)>=0.5e0) WHERE rn=1""",
)
sqlviews.define(
    "roles",
    """SELECT ring_id, account, role, CASE role
   WHEN 'coordinator' THEN concat('Shares identifiers with ', CAST(CAST(shares AS BIGINT) AS VARCHAR), ' ring members, carries only ', printf('%.0f', vol_share*100), '% of ring volume')
   WHEN 'source' THEN 'Receives majority of inflow from outside the ring and is the earliest active member'
   WHEN 'cash-out' THEN concat(printf('%.0f', outflow_cash/CAST(outflow AS DOUBLE)*100), '% of outflow goes to ATM cash-out')
   WHEN 'mule' THEN concat('Receives from source, forwards ', printf('%.0f', pass_through*100), '%, holds only ', printf('%.0f', median_hold_min), ' min')
   WHEN 'relay' THEN 'Both senders and receivers are ring members' ELSE 'Connected to ring but role not clearly determined' END role_reason
 FROM (SELECT r.*, CASE WHEN shares>=3 AND vol_share<0.1e0 THEN 'coordinator' WHEN r.account=s.source THEN 'source'
   WHEN outflow>0 AND outflow_cash/CAST(outflow AS DOUBLE)>=0.5e0 THEN 'cash-out'
   WHEN EXISTS (SELECT 1 FROM internal i WHERE i.ring_id=r.ring_id AND i.src=s.source AND i.dst=r.account) AND pass_through>=0.8e0 AND median_hold_min<30 THEN 'mule'
   WHEN ring_senders>0 AND ring_receivers>0 THEN 'relay' ELSE 'member' END role
  FROM rstat2 r LEFT JOIN rsource s USING(ring_id))""",
)


@query("ring_edges", "SELECT ring_id, src, dst, CAST(sum(amount_paise) AS BIGINT) amount_paise, count(*) transfers FROM internal GROUP BY 1,2,3")
def ring_edges(spark, d):
    t = Tables(spark, d)
    return rings.ring_edges(t.ledger, t.members)


@query(
    "ring_volumes",
    """SELECT d.ring_id, CAST(coalesce(sum(amount_paise) FILTER (s.account IS NOT NULL),0) AS BIGINT) volume_paise,
     CAST(coalesce(sum(amount_paise) FILTER (s.account IS NULL),0) AS BIGINT) external_inflow_paise, count(*) FILTER (s.account IS NOT NULL) transfers
     FROM ledger l JOIN planted d ON d.account=l.dst LEFT JOIN planted s ON s.account=l.src AND s.ring_id=d.ring_id GROUP BY 1""",
)
def ring_volumes(spark, d):
    t = Tables(spark, d)
    return rings.ring_volumes(t.ledger, t.members)


@query("ring_summary", "SELECT ring_id, members, volume_paise, transfers, risk FROM ring_summary")
def ring_summary(spark, d):
    t = Tables(spark, d)
    return rings.ring_summary(t.ledger, t.members, t.scores())


@query("ring_identity_links", 'SELECT ring_id, "type", identifier_id, members_on FROM rlinks')
def ring_identity_links(spark, d):
    t = Tables(spark, d)
    return rings.identity_links(t.links, t.members)


@query(
    "victim_deposits",
    "SELECT ring_id, txn_id, src, dst, amount_paise, ts FROM ledger JOIN planted p ON p.account=dst WHERE src LIKE 'VICTIM%'",
)
def victim_deposits(spark, d):
    t = Tables(spark, d)
    return rings.victim_deposits(t.ledger, t.members).drop("us")


@query(
    "ring_alerts",
    """SELECT alert_id, ring_id, fired_at, concat(CAST(members AS VARCHAR),' linked accounts forwarding within minutes') reason
       FROM alerts JOIN (SELECT ring_id, count(*) members FROM planted GROUP BY 1) USING(ring_id)""",
)
def ring_alerts(spark, d):
    t = Tables(spark, d)
    return rings.alerts(t.ledger, t.members).select("alert_id", "ring_id", "fired_at", "reason")


@query(
    "alerts_newest_first",
    "SELECT alert_id, ring_id, fired_at, row_number() OVER (ORDER BY fired_us DESC, alert_id DESC) AS \"position\" FROM alerts",
)
def alerts_newest_first(spark, d):
    t = Tables(spark, d)
    return rings.alerts_in_order(rings.alerts(t.ledger, t.members)).select("alert_id", "ring_id", "fired_at", "position")


@query(
    "alerts_oldest_first",
    "SELECT alert_id, ring_id, fired_at, row_number() OVER (ORDER BY fired_us, alert_id) AS \"position\" FROM alerts",
)
def alerts_oldest_first(spark, d):
    t = Tables(spark, d)
    return rings.alerts_in_order(rings.alerts(t.ledger, t.members), newest_first=False).select("alert_id", "ring_id", "fired_at", "position")


@query(
    "cashout_eta",
    """SELECT alert_id, a.ring_id, CAST(floor((min(us) FILTER (us>=fired_us)-any_value(fired_us))/6e7+0.5e0) AS BIGINT) cashout_eta_min,
       NOT coalesce(bool_or(us<=fired_us),false) before_cashout
       FROM alerts a LEFT JOIN (SELECT p.ring_id, l.us FROM ledger l JOIN planted p ON p.account=l.src WHERE dst='CASH') c ON c.ring_id=a.ring_id GROUP BY 1,2""",
)
def cashout_eta(spark, d):
    t = Tables(spark, d)
    return rings.cashout_eta(t.ledger, t.members, rings.alerts(t.ledger, t.members))


@query(
    "alert_reasons",
    """SELECT m.ring_id, concat(CAST(members AS VARCHAR), ' linked accounts moved ',
      CASE WHEN coalesce(v,0)//100>=100000 THEN concat('₹', printf('%.1f', (v//100)/100000e0), ' lakh') ELSE concat('₹', format('{:,}', CAST(coalesce(v,0)//100 AS BIGINT))) END,
      CASE WHEN coalesce(n,0)>=2 THEN CASE WHEN mins<120 THEN concat(' within ', CAST(greatest(1, CAST(round_even(mins,0) AS BIGINT)) AS VARCHAR), ' min') ELSE concat(' within ', printf('%.0f', mins/60), ' h') END ELSE '' END,
      coalesce(concat('; ', CAST(members_on AS VARCHAR), ' share one ', "type"), '')) reason
     FROM (SELECT ring_id, count(*) members FROM planted GROUP BY 1) m
     LEFT JOIN (SELECT ring_id, sum(amount_paise) v, count(*) n, (max(us)-min(us))/6e7 mins FROM internal GROUP BY 1) i USING(ring_id)
     LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ring_id ORDER BY members_on DESC, "type", identifier_id) rn FROM rlinks) w ON w.ring_id=m.ring_id AND rn=1""",
)
def alert_reasons(spark, d):
    t = Tables(spark, d)
    return rings.alert_reasons(t.ledger, t.members, t.links)


@query(
    "role_statistics",
    """SELECT ring_id, account, CAST(inflow AS BIGINT) inflow, CAST(inflow_outside AS BIGINT) inflow_outside, CAST(outflow AS BIGINT) outflow,
       CAST(outflow_cash AS BIGINT) outflow_cash, ring_senders, ring_receivers, first_us, CAST(shares AS BIGINT) shares FROM rstat""",
)
def role_statistics(spark, d):
    t = Tables(spark, d)
    return rings.role_statistics(t.ledger, t.members, t.links)


def _roles(t: Tables):
    return rings.classify_roles(t.ledger, t.members, t.links, t.money)


@query("ring_roles", "SELECT ring_id, account, role, role_reason FROM roles")
def ring_roles(spark, d):
    return _roles(Tables(spark, d))


@query("role_counts", "SELECT ring_id, role, count(*) accounts FROM roles GROUP BY 1,2")
def role_counts(spark, d):
    return rings.role_counts(_roles(Tables(spark, d)))


@query(
    "export_roles",
    "SELECT ring_id, account, CASE role WHEN 'coordinator' THEN 'controller' WHEN 'relay' THEN 'mule' ELSE role END role FROM roles",
)
def export_roles(spark, d):
    r = _roles(Tables(spark, d))
    return r.select("ring_id", "account", rings.narrow_role(F.col("role"), rings.EXPORT_ROLES, rings.EXPORT_REMAP).alias("role"))
