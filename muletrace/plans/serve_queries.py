"""Queries an investigator's screen asks."""

from __future__ import annotations

from pyspark.sql import functions as F

from muletrace import schemas
from muletrace.functions import exprs as X
from muletrace.operators import events as ev
from muletrace.operators import features, freeze, rings, scoring, serve, snapshots, taint
from muletrace.plans import sqlviews
from muletrace.plans.case_queries import _recruits
from muletrace.plans.registry import query
from muletrace.plans.ring_queries import _roles
from muletrace.plans.tables import Tables
from muletrace.session import cut_lineage


@query("public_ledger", "SELECT txn_id, src, dst, amount_paise, ts, channel, city, lat, lng FROM ledger")
def public_ledger(spark, d):
    return serve.public_ledger(Tables(spark, d).ledger)


@query(
    "replay_rows",
    "SELECT txn_id, src, dst, CAST(floor(amount_paise/100e0+0.5e0) AS BIGINT) amount_rupees, ts, channel FROM ledger WHERE src<>'SALARY'",
)
def replay_rows(spark, d):
    return serve.replay_rows(Tables(spark, d).ledger)


@query(
    "export_ledger",
    """SELECT txn_id, src, dst, CAST(round_even(amount_paise/100e0,0) AS BIGINT) amount_rupees, ts, CASE WHEN channel IN ('UPI','IMPS','NEFT','ATM') THEN channel ELSE 'NEFT' END channel,
       CASE WHEN channel='ATM' THEN city END city, CASE WHEN channel='ATM' THEN lat END lat, CASE WHEN channel='ATM' THEN lng END lng FROM ledger WHERE src NOT LIKE 'SALARY%'""",
)
def export_ledger(spark, d):
    """All transfers that are not salaries, in the export form."""
    return ev.salary_free_export(Tables(spark, d).ledger)


@query("ledger_as_of", "SELECT txn_id, src, dst, amount_paise FROM ledger WHERE ts<=TIMESTAMP '2024-01-15 12:00:00'")
def ledger_as_of(spark, d):
    t = serve.up_to(Tables(spark, d).ledger, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    return t.select("txn_id", "src", "dst", "amount_paise")


@query(
    "ledger_after_anchor",
    "SELECT txn_id, src, dst FROM ledger WHERE us>(SELECT us FROM ledger WHERE txn_id='TXN000000500')",
)
def ledger_after_anchor(spark, d):
    return serve.after_transaction(Tables(spark, d).ledger, "TXN000000500").select("txn_id", "src", "dst")


@query(
    "ledger_page",
    """SELECT txn_id, seq, CAST(7 AS BIGINT) page, CAST(ceil(total/50e0) AS BIGINT) pages, total FROM (SELECT txn_id, row_number() OVER (ORDER BY us, txn_id) seq, count(*) OVER () total FROM ledger) WHERE seq BETWEEN 301 AND 350""",
)
def ledger_page(spark, d):
    return serve.page(Tables(spark, d).ledger, 7, 50).select("txn_id", "seq", "page", "pages", "total")


@query(
    "ledger_page_past_end",
    """SELECT txn_id, CAST(ceil(total/500e0) AS BIGINT) page FROM (SELECT txn_id, row_number() OVER (ORDER BY us, txn_id) seq, count(*) OVER () total FROM ledger) WHERE seq > (ceil(total/500e0)-1)*500""",
)
def ledger_page_past_end(spark, d):
    return serve.page(Tables(spark, d).ledger, 1_000_000, 500).select("txn_id", "page")


@query("ledger_first_rows", "SELECT txn_id, src, dst, amount_paise FROM ledger ORDER BY us, txn_id LIMIT 50")
def ledger_first_rows(spark, d):
    return serve.first_rows(Tables(spark, d).ledger, 50).select("txn_id", "src", "dst", "amount_paise")


@query(
    "recent_transactions",
    'SELECT account, "rank", txn_id, dir, counterparty, amount_paise FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY us DESC, txn_id DESC, dir) "rank" FROM acct_ev) WHERE "rank"<=10',
)
def recent_transactions(spark, d):
    r = serve.recent_transactions(Tables(spark, d).events)
    return r.select("account", F.col("rank").cast("bigint").alias("rank"), "txn_id", "dir", "counterparty", "amount_paise")


_IDS = ["ACC000007", "ACC000003", "ACC000999", "ACC000012", "ACC000003"]


@query(
    "accounts_in_order",
    """SELECT CAST(pos AS BIGINT) pos, account, bank, opened_on FROM (VALUES (0,'ACC000007'),(1,'ACC000003'),(2,'ACC000999'),(3,'ACC000012'),(4,'ACC000003')) v(pos, account) JOIN accounts USING(account)""",
)
def accounts_in_order(spark, d):
    r = serve.in_id_order(Tables(spark, d).accounts, _IDS)
    return r.select(F.col("pos").cast("bigint").alias("pos"), "account", "bank", F.col("opened_on"))


@query(
    "identifiers_overlapping",
    """SELECT DISTINCT identifier_id, "type" FROM links WHERE account IN ('ACC000003','ACC000010')""",
)
def identifiers_overlapping(spark, d):
    ids = spark.range(1).select(F.explode(X.parse_id_list(F.lit(" ACC000003, ,ACC000010 "))).alias("account"))
    return serve.identifiers_of_users(Tables(spark, d).links, ids)


@query(
    "member_cashouts",
    "SELECT txn_id, src, city, amount_paise FROM ledger WHERE channel='ATM' AND city IS NOT NULL AND src IN (SELECT account FROM truth)",
)
def member_cashouts(spark, d):
    t = Tables(spark, d)
    return serve.cashouts_of(t.ledger, t.truth).select("txn_id", "src", "city", "amount_paise")


@query(
    "account_detail",
    """SELECT a.account, a.bank, a.opening_balance_paise, i.ids identifiers, r.txns recent FROM accounts a
     LEFT JOIN (SELECT account, string_agg(concat("type",':',identifier_id,':',CAST(users AS VARCHAR)), ',' ORDER BY "type", identifier_id) ids FROM links JOIN (SELECT identifier_id, count(*) users FROM links GROUP BY 1) USING(identifier_id) GROUP BY 1) i USING(account)
     LEFT JOIN (SELECT account, string_agg(txn_id, ',' ORDER BY rk) txns FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY us DESC, txn_id DESC, dir) rk FROM acct_ev) WHERE rk<=10 GROUP BY 1) r USING(account)""",
)
def account_detail(spark, d):
    t = Tables(spark, d)
    r = serve.account_detail(t.accounts, t.links, t.events)
    return r.select(
        "account",
        "bank",
        "opening_balance_paise",
        F.expr("array_join(transform(identifiers, i -> concat(i.type, ':', i.identifier_id, ':', i.users)), ',')").alias("identifiers"),
        F.expr("array_join(transform(recent, r -> r.txn_id), ',')").alias("recent"),
    )


@query(
    "ring_graph_nodes",
    """SELECT ring_id, account node, 'account' "type", role, round(v2_bp/10000e0,4) risk FROM roles JOIN scored USING(account)
       UNION ALL SELECT DISTINCT ring_id, identifier_id, "type", '', 0e0 FROM rlinks""",
)
def ring_graph_nodes(spark, d):
    t = Tables(spark, d)
    return serve.ring_nodes(t.members, _roles(t), t.scores(), rings.identity_links(t.links, t.members)).withColumn("risk", F.round("risk", 4))


@query(
    "ring_graph_edges",
    """SELECT ring_id, src source, dst target, 'txn' kind, CAST(sum(amount_paise) AS BIGINT) amount_paise, count(*) transfers FROM internal GROUP BY 1,2,3
       UNION ALL SELECT ring_id, identifier_id, account, 'identity', 0, 0 FROM links JOIN planted USING(account) JOIN rlinks USING(ring_id, identifier_id, "type")""",
)
def ring_graph_edges(spark, d):
    t = Tables(spark, d)
    return serve.ring_graph_edges(rings.ring_edges(t.ledger, t.members), rings.identity_edges(t.links, t.members))


@query(
    "state_summary",
    """SELECT (SELECT count(*) FROM ledger WHERE src<>'SALARY') txns, (SELECT count(DISTINCT account) FROM acct_ev) accounts, count(*) scored, count(*) FILTER (v2_bp>=5000) high_risk,
       (SELECT count(DISTINCT ring_id) FROM planted) rings, (SELECT count(*) FROM alerts) alerts FROM scored""",
)
def state_summary(spark, d):
    t = Tables(spark, d)
    return serve.state_summary(t.ledger, t.scores(), t.members, rings.alerts(t.ledger, t.members))


_BIN = "greatest(0,least(319,CAST(floor((us-(SELECT min(us) FROM ledger))/CAST(greatest((SELECT max(us)-min(us) FROM ledger),1) AS DOUBLE)*320e0) AS INT)))"


@query(
    "activity_histogram",
    f"""WITH b AS (SELECT coalesce(p.ring_id, q.ring_id) ring_id, {_BIN} bin FROM ledger LEFT JOIN truth p ON p.account=src LEFT JOIN truth q ON q.account=dst)
     SELECT '' ring_id, bin, count(*) transfers FROM b GROUP BY 2 UNION ALL SELECT ring_id, bin, count(*) FROM b WHERE ring_id IS NOT NULL GROUP BY 1,2""",
)
def activity_histogram(spark, d):
    t = Tables(spark, d)
    return serve.activity_histogram(t.ledger, t.truth)


@query(
    "replay_ticks",
    """SELECT greatest(1,(us-(SELECT min(us) FROM ledger)+899999999)//900000000) tick, count(*) due, CAST(sum(amount_paise) AS BIGINT) amount_paise, max(us) last_us FROM ledger GROUP BY 1""",
)
def replay_ticks(spark, d):
    return serve.replay_ticks(Tables(spark, d).ledger)


def _snap_sql() -> str:
    """The feature views over the ledger as it was on each day, one after the other."""
    columns = ", ".join(features.V2_FEATURES)
    whole = sqlviews.VIEWS["ledger"]
    parts = []
    for day in snapshots.SNAPSHOT_DAYS:
        until = f"SELECT * FROM ({whole}) WHERE us<=(SELECT min(us) FROM ({whole}))+{day}*86400000000"
        one = sqlviews.complete(f"SELECT account, {columns} FROM feat WHERE txn_in+txn_out>0", {"ledger": until})
        parts.append(f'SELECT account, {day} "day", {columns} FROM ({one})')
    return f"""SELECT s.*, CASE WHEN t.account IS NULL THEN 0 ELSE 1 END label
      FROM ({" UNION ALL ".join(parts)}) s LEFT JOIN (SELECT DISTINCT account FROM truth) t ON t.account=s.account
      LEFT JOIN (SELECT a, min(us) fu FROM (SELECT src a, us FROM ledger WHERE is_fraud UNION ALL SELECT dst, us FROM ledger WHERE is_fraud) GROUP BY 1) x ON x.a=s.account
      WHERE t.account IS NULL OR x.fu<=(SELECT min(us) FROM ledger)+"day"*86400000000"""


@query("snapshot_features", _snap_sql())
def snapshot_features(spark, d):
    t = Tables(spark, d)
    return snapshots.snapshot_features(t.accounts, t.ledger, t.links, t.truth, scoring.rule_score_v1)


@query("training_labels", "SELECT account, CASE WHEN account IN (SELECT account FROM truth) THEN 1 ELSE 0 END label FROM accounts")
def training_labels(spark, d):
    from muletrace.operators import evaluate

    t = Tables(spark, d)
    return evaluate.labelled(t.accounts.select("account"), t.truth)


@query(
    "ledger_violations",
    """SELECT count(*) "rows", count(*) FILTER (amount_paise>40000) bad_amount, count(*) FILTER (channel NOT IN ('UPI','IMPS','NEFT')) bad_channel FROM ledger""",
)
def ledger_violations(spark, d):
    """The contract's counting pass, with two rules tightened so that violations occur."""
    rules = {"amount": F.col("amount_paise").between(0, 40000), "channel": F.col("channel").isin("UPI", "IMPS", "NEFT")}
    return schemas.violation_counts(Tables(spark, d).ledger, rules)


@query(
    "ledger_rejects",
    """SELECT txn_id, concat_ws(',', CASE WHEN amount_paise>40000 THEN 'amount' END, CASE WHEN channel='ATM' THEN 'channel' END) broken FROM ledger WHERE amount_paise>40000 OR channel='ATM'""",
)
def ledger_rejects(spark, d):
    rules = {"amount": F.col("amount_paise").between(0, 40000), "channel": F.col("channel") != "ATM"}
    _good, bad = schemas.split_valid(Tables(spark, d).ledger, rules)
    return bad.select("txn_id", F.array_join("broken_rules", ",").alias("broken"))


@query(
    "alerts_latest_ring",
    """SELECT alert_id, a.ring_id, CAST(m AS BIGINT) members, version FROM alerts a JOIN (SELECT ring_id, max(CASE WHEN TRY_CAST(substr(account,4) AS INT)%10<4 THEN 1 WHEN TRY_CAST(substr(account,4) AS INT)%10<7 THEN 2 ELSE 3 END) version, count(*) m FROM planted GROUP BY 1) USING(ring_id)""",
)
def alerts_latest_ring(spark, d):
    """Rings that grew over three versions; each alert shows the newest."""
    t = Tables(spark, d)
    digit = F.expr("cast(substring(account, 4) as int) % 10")
    added = F.when(digit < 4, 1).when(digit < 7, 2).otherwise(3)
    versions = (
        t.members.withColumn("version", F.explode(F.sequence(added, F.lit(3))))
        .groupBy("ring_id", "version")
        .agg(F.count(F.lit(1)).alias("members"))
    )
    newest = rings.latest_version(versions)
    return rings.alerts(t.ledger, t.members).join(newest, "ring_id").select("alert_id", "ring_id", "members", "version")


@query(
    "text_functions",
    r"""SELECT txn_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') iso, date_trunc('second', ts) parsed, CAST(round_even(amount_paise/100e0,0) AS BIGINT) half_even, CAST(floor(amount_paise/100e0+0.5e0) AS BIGINT) half_up,
       (src IN ('SALARY','CASH') OR src LIKE 'VICTIM%') outside FROM ledger""",
)
def text_functions(spark, d):
    led = Tables(spark, d).ledger
    iso = X.iso_format(F.col("ts"))
    return led.select(
        "txn_id",
        iso.alias("iso"),
        X.iso_parse(iso).alias("parsed"),
        X.paise_to_rupees(F.col("amount_paise")).alias("half_even"),
        X.paise_to_rupees(F.col("amount_paise"), "half_up").alias("half_up"),
        schemas.is_pseudo(F.col("src")).alias("outside"),
    )


@query(
    "small_set_similarity",
    """WITH s AS (SELECT ring_id, identifier_id, list(DISTINCT account) m FROM links JOIN planted USING(account) GROUP BY 1,2), r AS (SELECT ring_id, list(account) m FROM planted GROUP BY 1)
       SELECT s.ring_id, s.identifier_id, round(len(list_intersect(s.m,r.m))/CAST(len(list_distinct(list_concat(s.m,r.m))) AS DOUBLE),6) jaccard, round(len(list_intersect(s.m,r.m))/CAST(least(len(s.m),len(r.m)) AS DOUBLE),6) overlap FROM s JOIN r USING(ring_id)""",
)
def small_set_similarity(spark, d):
    t = Tables(spark, d)
    s = t.links.join(t.members, "account").groupBy("ring_id", "identifier_id").agg(F.collect_set("account").alias("m"))
    r = t.members.groupBy("ring_id").agg(F.collect_set("account").alias("all"))
    j = s.join(r, "ring_id")
    return j.select(
        "ring_id",
        "identifier_id",
        F.round(X.jaccard(F.col("m"), F.col("all")), 6).alias("jaccard"),
        F.round(X.overlap_coefficient(F.col("m"), F.col("all")), 6).alias("overlap"),
    )


@query(
    "missed_accounts",
    "SELECT account FROM truth EXCEPT SELECT account FROM scored WHERE v2_bp>=5000",
)
def missed_accounts(spark, d):
    t = Tables(spark, d)
    flagged = t.scores().where(F.col("v2_bp") >= 5000).select("account")
    return t.truth.select("account").distinct().join(flagged, "account", "left_anti")


@query("flagged_members", "SELECT account FROM truth INTERSECT SELECT account FROM scored WHERE v2_bp>=5000")
def flagged_members(spark, d):
    t = Tables(spark, d)
    flagged = t.scores().where(F.col("v2_bp") >= 5000).select("account")
    return t.truth.select("account").intersect(flagged)


sqlviews.STORED.update({"roles"})


@query("case_report")
def case_report(spark, d):
    t = Tables(spark, d)
    members = t.members
    scores = cut_lineage(t.scores())
    roles = cut_lineage(_roles(t))
    cases = cut_lineage(rings.default_cases(t.ledger, members))
    balances, _f = taint.trace(t.ledger, t.accounts, cases)
    plan = freeze.recommend(t.ledger, cases, members, balances)
    holders = taint.case_accounts(balances).withColumnRenamed("case_id", "ring_id")
    return serve.case_report(
        rings.ring_summary(t.ledger, members, scores), roles, holders, plan, _recruits(t), rings.ring_edges(t.ledger, members)
    )
