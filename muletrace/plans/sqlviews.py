"""The derived tables once more, as SQL over the given parquet tables, for checking results."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["e0"] = """
SELECT event_id, ts, epoch_us(ts) us, user_id u, event_type et, value,
       CAST(round(value*100) AS BIGINT) amt, CAST(json_extract_string(props,'$.k') AS INT) k,
       (SELECT max(user_id)+1 FROM events) n FROM events"""

VIEWS["e1"] = """
SELECT *, ((u - u % 10) + (k + 1 + u) % 10) % n AS v,
       (et='error' AND event_id % 50 = 0) AS victim,
       CASE WHEN event_id % 10 = 0 THEN (u+1) % 15 ELSE u % 15 END AS ci FROM e0"""

VIEWS["ev"] = """
SELECT *, 8.503e0+1.7e0*ci+((event_id%21)-10)*0.0053e0 AS lat,
       69.503e0+1.6e0*(ci*4%15)+((event_id%17)-8)*0.0053e0 AS lng,
       concat('CITY_',lpad(CAST(ci AS VARCHAR),2,'0')) AS city,
       concat('ACC', lpad(CAST(u AS VARCHAR),6,'0')) AS au,
       concat('ACC', lpad(CAST(v AS VARCHAR),6,'0')) AS av,
       lpad(CAST(event_id AS VARCHAR),9,'0') AS eid FROM e1"""

VIEWS["ledger"] = """
SELECT concat('TXN',eid) txn_id,
       CASE WHEN victim THEN concat('VICTIM_',eid) WHEN et='signup' THEN 'SALARY' WHEN et='view' THEN av ELSE au END src,
       CASE WHEN victim OR et IN ('signup','view') THEN au WHEN et='purchase' THEN 'CASH' ELSE av END dst,
       amt amount_paise, ts, us,
       CASE et WHEN 'purchase' THEN 'ATM' WHEN 'signup' THEN 'NEFT' WHEN 'view' THEN 'IMPS' ELSE 'UPI' END channel,
       CASE WHEN et='purchase' THEN city END city, CASE WHEN et='purchase' THEN lat END lat,
       CASE WHEN et='purchase' THEN lng END lng, victim is_fraud
FROM ev WHERE victim OR et IN ('signup','purchase') OR u<>v"""

VIEWS["accounts"] = """
SELECT concat('ACC', lpad(CAST(u AS VARCHAR),6,'0')) account, concat('BANK_', CAST(u%8 AS VARCHAR)) bank,
       CAST(min(ts) AS DATE) - CAST(u*13%60 AS INT) opened_on, (u*7919 % 5000)*100+10000 opening_balance_paise,
       concat('CITY_',lpad(CAST(u%15 AS VARCHAR),2,'0')) home_city,
       8.503e0+1.7e0*(u%15) home_lat, 69.503e0+1.6e0*((u%15)*4%15) home_lng
FROM e0 GROUP BY u"""

VIEWS["links"] = """
SELECT DISTINCT concat('DEV',lpad(CAST(u-u%3 AS VARCHAR),6,'0')) identifier_id, 'device' "type", concat('ACC', lpad(CAST(u AS VARCHAR),6,'0')) account FROM e0
UNION ALL SELECT DISTINCT concat('PHN',lpad(CAST(u-u%7 AS VARCHAR),6,'0')), 'phone', concat('ACC', lpad(CAST(u AS VARCHAR),6,'0')) FROM e0
UNION ALL SELECT DISTINCT concat('IP',lpad(CAST(u%11 AS VARCHAR),6,'0')), 'ip', concat('ACC', lpad(CAST(u AS VARCHAR),6,'0')) FROM e0"""

VIEWS["hits"] = """
SELECT concat('HIT',eid) hit_id, ts, lat, lng, city,
       CASE et WHEN 'purchase' THEN 'atm_cashout' WHEN 'error' THEN 'mule_activity' ELSE 'p2p_transfer' END hit_type,
       amt amount_paise, victim is_fraud, least(0.99e0, ((amt*2+40)//80)/1000e0) risk_score, au account FROM ev"""

VIEWS["planted"] = """
SELECT DISTINCT concat('RING',lpad(CAST((u-u%10)//10 AS VARCHAR),6,'0')) ring_id,
       concat('ACC', lpad(CAST(u AS VARCHAR),6,'0')) account FROM e0"""

VIEWS["truth"] = """
SELECT ring_id, account, CASE TRY_CAST(substr(ring_id,5,6) AS INT)%4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END pattern
FROM planted WHERE TRY_CAST(substr(ring_id,5,6) AS INT)%3=0"""

# account side events: one row per real endpoint of a transfer
VIEWS["acct_ev"] = """
SELECT src account, dst counterparty, 'D' dir, amount_paise, ts, us, channel, city, lat, lng, txn_id FROM ledger
 WHERE src NOT IN ('SALARY','CASH') AND src NOT LIKE 'VICTIM%'
UNION ALL
SELECT dst, src, 'C', amount_paise, ts, us, channel, city, lat, lng, txn_id FROM ledger
 WHERE dst NOT IN ('SALARY','CASH') AND dst NOT LIKE 'VICTIM%'"""

VIEWS["act"] = """
SELECT account,
  CAST(coalesce(sum(amount_paise) FILTER (dir='C'),0) AS BIGINT) amount_in,
  CAST(coalesce(sum(amount_paise) FILTER (dir='D'),0) AS BIGINT) amount_out,
  count(*) FILTER (dir='C') txn_in, count(*) FILTER (dir='D') txn_out,
  CAST(coalesce(sum(amount_paise) FILTER (dir='D' AND channel='ATM'),0) AS BIGINT) atm_out,
  count(DISTINCT CASE WHEN dir='C' THEN counterparty END) in_degree,
  count(DISTINCT CASE WHEN dir='D' THEN counterparty END) out_degree,
  count(DISTINCT counterparty) counterparties, min(us) first_us, max(us) last_us
FROM acct_ev GROUP BY account"""

# FIFO matching as the plain closed form over one ordered window per account
VIEWS["hold_pairs"] = """
SELECT d.account, d.m, (d.us - c.us) hold_us FROM (
  SELECT account, us, m, lag(m,1,0) OVER (PARTITION BY account ORDER BY j) pm FROM (
    SELECT account, us, j, j + least(0, min(cnt-j) OVER (PARTITION BY account ORDER BY j ROWS UNBOUNDED PRECEDING)) m FROM (
      SELECT account, us, dir, cnt, row_number() OVER (PARTITION BY account, dir ORDER BY us, txn_id) j FROM (
        SELECT *, count(*) FILTER (dir='C') OVER (PARTITION BY account ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) cnt FROM acct_ev))
    WHERE dir='D')) d
JOIN (SELECT account, us, row_number() OVER (PARTITION BY account ORDER BY us, txn_id) rn FROM acct_ev WHERE dir='C') c
  ON c.account=d.account AND c.rn=d.m WHERE d.m > d.pm"""

VIEWS["hold"] = """
SELECT account, count(*) matched, median(hold_us) hold_us FROM hold_pairs GROUP BY account"""

VIEWS["burst"] = """
SELECT account, max(c) burst_10min FROM (SELECT account, count(*) OVER (PARTITION BY account ORDER BY us RANGE BETWEEN CURRENT ROW AND 600000000 FOLLOWING) c FROM acct_ev) GROUP BY account"""

VIEWS["pairs"] = """
SELECT a.account, b.account other, bool_or(a.type='device') dev, bool_or(a.type='phone') phn, bool_or(a.type='ip') ip
FROM links a JOIN links b ON a.identifier_id=b.identifier_id AND a.account<>b.account GROUP BY 1,2"""

VIEWS["ident"] = """
SELECT p.account, count(*) FILTER (dev) shared_device_n, count(*) FILTER (phn) shared_phone_n, count(*) FILTER (ip) shared_ip_n,
  count(*) FILTER (abs(datediff('day', x.opened_on, y.opened_on))<=14) shared_any_new_n
FROM pairs p JOIN accounts x ON x.account=p.account JOIN accounts y ON y.account=p.other GROUP BY p.account"""

VIEWS["geo_feat"] = """
SELECT a.account, count(DISTINCT l.city) cashout_city_n,
 round(median(2*6371.0e0*asin(sqrt(greatest(0e0,least(1e0, pow(sin(radians(l.lat-a.home_lat)/2),2)+cos(radians(a.home_lat))*cos(radians(l.lat))*pow(sin(radians(l.lng-a.home_lng)/2),2)))))),1) home_cashout_km
FROM ledger l JOIN accounts a ON a.account=l.src WHERE l.channel='ATM' AND l.city IS NOT NULL GROUP BY a.account"""

VIEWS["feat0"] = """
SELECT a.account, a.opened_on, a.opening_balance_paise, a.home_city, a.home_lat, a.home_lng, a.bank,
 coalesce(t.amount_in,0) amount_in, coalesce(t.amount_out,0) amount_out, coalesce(t.txn_in,0) txn_in, coalesce(t.txn_out,0) txn_out,
 round(least(coalesce(t.amount_out,0),coalesce(t.amount_in,0))/CAST(greatest(coalesce(t.amount_in,0),1) AS DOUBLE),6) pass_through,
 round(coalesce(h.hold_us/6e7, 9999e0),2) median_hold_min,
 CASE WHEN coalesce(t.txn_in+t.txn_out,0)>=2 THEN round((t.txn_in+t.txn_out)/greatest((t.last_us-t.first_us)/3.6e9, 0.0167e0),4) ELSE 0e0 END velocity_per_hr,
 coalesce(b.burst_10min,0) burst_10min,
 round(coalesce(t.counterparties,0)/CAST(greatest(coalesce(t.txn_in+t.txn_out,0),1) AS DOUBLE),6) counterparty_div,
 coalesce(t.in_degree,0) in_degree, coalesce(t.out_degree,0) out_degree,
 CASE WHEN t.first_us IS NULL THEN 0e0 ELSE round(greatest((t.first_us-epoch_us(CAST(a.opened_on AS TIMESTAMP)))/8.64e10,0e0),2) END account_age_days,
 round(coalesce(t.atm_out,0)/CAST(greatest(coalesce(t.amount_out,0),1) AS DOUBLE),6) atm_share,
 coalesce(i.shared_device_n,0) shared_device_n, coalesce(i.shared_phone_n,0) shared_phone_n, coalesce(i.shared_ip_n,0) shared_ip_n,
 coalesce(i.shared_any_new_n,0) shared_any_new_n,
 coalesce(g.home_cashout_km,0e0) home_cashout_km, coalesce(g.cashout_city_n,0) cashout_city_n
FROM accounts a LEFT JOIN act t USING(account) LEFT JOIN hold h USING(account) LEFT JOIN burst b USING(account)
LEFT JOIN ident i USING(account) LEFT JOIN geo_feat g USING(account)"""

VIEWS["v1"] = """
SELECT account, CAST(least(10000,
   CASE WHEN pass_through>=0.8e0 THEN 2500 WHEN pass_through>=0.5e0 THEN 1200 ELSE 0 END
 + CASE WHEN median_hold_min<30e0 THEN 2000 WHEN median_hold_min<1440e0 THEN 1000 ELSE 0 END
 + CASE WHEN burst_10min>=3 THEN 2000 WHEN burst_10min>=2 THEN 1000 ELSE 0 END
 + CASE WHEN atm_share>=0.5e0 THEN 1500 WHEN atm_share>=0.2e0 THEN 800 ELSE 0 END
 + CASE WHEN account_age_days<=7e0 THEN 1000 WHEN account_age_days<=30e0 THEN 500 ELSE 0 END
 + CASE WHEN in_degree>=3 AND out_degree>=3 THEN 1000 ELSE 0 END
 + CASE WHEN velocity_per_hr>=1e0 THEN 500 ELSE 0 END) AS BIGINT) v1_bp FROM feat0"""

VIEWS["nbr"] = """
SELECT p.account, count(*) neighbour_n, CAST(sum(v1_bp) AS BIGINT) neighbour_bp FROM pairs p JOIN v1 ON v1.account=p.other GROUP BY p.account"""

VIEWS["feat"] = """
SELECT f.*, round(coalesce(n.neighbour_bp/CAST(n.neighbour_n AS DOUBLE)/10000e0,0e0),4) neighbour_risk_v1 FROM feat0 f LEFT JOIN nbr n USING(account)"""

VIEWS["scored"] = """
SELECT f.*, v1.v1_bp, CAST(least(10000, v1.v1_bp*7//10
 + CASE WHEN shared_device_n>=2 THEN 500 ELSE 0 END + CASE WHEN shared_phone_n>=3 THEN 500 ELSE 0 END
 + CASE WHEN shared_any_new_n>=5 THEN 500 ELSE 0 END + CASE WHEN neighbour_risk_v1>=0.5e0 THEN 500 ELSE 0 END
 + CASE WHEN home_cashout_km>=100e0 THEN 500 ELSE 0 END) AS BIGINT) v2_bp FROM feat f JOIN v1 USING(account)"""

VIEWS["internal"] = """
SELECT s.ring_id, l.* FROM ledger l JOIN planted s ON s.account=l.src JOIN planted d ON d.account=l.dst AND d.ring_id=s.ring_id"""

VIEWS["alerts"] = """
SELECT concat('ALT',substr(ring_id,5)) alert_id, ring_id, coalesce(max(CASE WHEN rn=3 THEN ts END), max(ts)) fired_at,
  coalesce(max(CASE WHEN rn=3 THEN us END), max(us)) fired_us
FROM (SELECT *, row_number() OVER (PARTITION BY ring_id ORDER BY us, txn_id) rn FROM internal) GROUP BY ring_id"""

VIEWS["ring_summary"] = """
SELECT m.ring_id, m.members, coalesce(i.volume_paise,0) volume_paise, coalesce(i.transfers,0) transfers, r.risk
FROM (SELECT ring_id, count(*) members FROM planted GROUP BY 1) m
LEFT JOIN (SELECT ring_id, CAST(sum(amount_paise) AS BIGINT) volume_paise, count(*) transfers FROM internal GROUP BY 1) i USING(ring_id)
LEFT JOIN (SELECT ring_id, round(avg(v2_bp)/10000e0,4) risk FROM planted JOIN scored USING(account) GROUP BY 1) r USING(ring_id)"""

# read once per recursion step: computed once
STORED = {"case_txn", "channels", "ledger"}

_NAME = {n: re.compile(rf"\b{n}\b") for n in VIEWS}


def define(name: str, sql: str) -> None:
    VIEWS[name] = sql
    _NAME[name] = re.compile(rf"\b{name}\b")


def complete(sql: str, instead: dict[str, str] | None = None) -> str:
    """Prepend the shared views that ``sql`` reaches, directly or through other views; ``instead`` replaces some."""
    views = VIEWS | (instead or {})
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for n, pat in _NAME.items():
            if n not in needed and pat.search(text):
                needed.add(n)
                todo.append(views[n])
    if not needed:
        return sql
    ctes = ", ".join(f"{n} AS {'MATERIALIZED ' if n in STORED else ''}({views[n]})" for n in views if n in needed)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
