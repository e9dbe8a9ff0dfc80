"""Queries on accounts: activity, ordered computations, identity, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from muletrace.functions import exprs as X
from muletrace.operators import events as ev
from muletrace.operators import features, identity, scoring, timeline
from muletrace.plans.registry import query
from muletrace.plans.tables import Tables, rounded
from muletrace.session import cut_lineage


@query(
    "channel_totals",
    "SELECT channel, count(*) transfers, CAST(sum(amount_paise) AS BIGINT) amount_paise FROM ledger GROUP BY 1",
)
def channel_totals(spark, d):
    return ev.channel_totals(Tables(spark, d).ledger)


@query(
    "account_events",
    "SELECT account, counterparty, dir, amount_paise, us, channel, txn_id FROM acct_ev",
)
def account_events(spark, d):
    return Tables(spark, d).events.select("account", "counterparty", "dir", "amount_paise", "us", "channel", "txn_id")


@query(
    "account_activity",
    """SELECT a.account, amount_in, amount_out, txn_in, txn_out, in_degree, out_degree, b.burst_10min,
       round((txn_in+txn_out)/greatest((last_us-first_us)/3.6e9,0.0167e0),4) velocity_per_hr
       FROM act a JOIN burst b USING(account)""",
)
def account_activity(spark, d):
    e = Tables(spark, d).events
    span = (F.col("last_us") - F.col("first_us")) / F.lit(3.6e9)
    act = cut_lineage(ev.activity(e))
    n = F.col("txn_in") + F.col("txn_out")
    hot = timeline.hot_from_sizes(act.select("account", n.alias("n"), F.col("first_us").alias("lo"), F.col("last_us").alias("hi")))
    return (
        act.join(timeline.burst(e, hot), "account")
        .select(
            "account",
            "amount_in",
            "amount_out",
            "txn_in",
            "txn_out",
            "in_degree",
            "out_degree",
            "burst_10min",
            F.round((F.col("txn_in") + F.col("txn_out")) / F.greatest(span, F.lit(0.0167)), 4).alias("velocity_per_hr"),
        )
    )


@query("hold_pairs", "SELECT account, m, hold_us FROM hold_pairs")
def hold_pairs(spark, d):
    return timeline.hold_pairs(Tables(spark, d).events)


@query("hold_time", "SELECT account, round(hold_us/6e7,2) median_hold_min FROM hold")
def hold_time(spark, d):
    return features.median_hold(Tables(spark, d).events).select(
        "account", F.round(F.col("hold_us") / F.lit(6e7), 2).alias("median_hold_min")
    )


@query("burst_10min", "SELECT account, burst_10min FROM burst")
def burst(spark, d):
    return timeline.burst(Tables(spark, d).events)


@query(
    "counterparty_degree",
    """SELECT account, in_degree, out_degree, counterparties,
       round(counterparties/CAST(greatest(txn_in+txn_out,1) AS DOUBLE),6) counterparty_div FROM act""",
)
def counterparty_degree(spark, d):
    a = ev.activity(Tables(spark, d).events)
    return a.select(
        "account",
        "in_degree",
        "out_degree",
        "counterparties",
        F.round(F.col("counterparties") / F.greatest(F.col("txn_in") + F.col("txn_out"), F.lit(1)), 6).alias("counterparty_div"),
    )


@query(
    "running_balance_worst",
    """SELECT account, opening_balance_paise, CAST(opening_balance_paise+coalesce(net,0) AS BIGINT) closing_paise,
       CAST(least(opening_balance_paise, opening_balance_paise+coalesce(low,0)) AS BIGINT) worst_paise,
       CAST(CASE WHEN least(opening_balance_paise, opening_balance_paise+coalesce(low,0))<0
         THEN opening_balance_paise-least(opening_balance_paise, opening_balance_paise+coalesce(low,0))+100
         ELSE opening_balance_paise END AS BIGINT) repaired_opening_paise
       FROM accounts LEFT JOIN (SELECT account, min(run) low, max(CASE WHEN last THEN run END) net FROM (
         SELECT account, sum(CASE WHEN dir='C' THEN amount_paise ELSE -amount_paise END) OVER (PARTITION BY account ORDER BY us, txn_id ROWS UNBOUNDED PRECEDING) run,
           row_number() OVER (PARTITION BY account ORDER BY us DESC, txn_id DESC)=1 AS last FROM acct_ev) GROUP BY account) USING(account)""",
)
def running_balance_worst(spark, d):
    t = Tables(spark, d)
    return timeline.worst_balance(t.events, t.accounts)


@query(
    "ledger_numbered",
    "SELECT txn_id, row_number() OVER (ORDER BY us, txn_id) seq FROM ledger",
)
def ledger_numbered(spark, d):
    return timeline.numbered_by_time(Tables(spark, d).ledger.select("txn_id", "us"), ["us", "txn_id"]).select("txn_id", "seq")


@query(
    "identity_sharing",
    "SELECT account, shared_device_n, shared_phone_n, shared_ip_n, shared_any_new_n FROM ident",
)
def identity_sharing(spark, d):
    t = Tables(spark, d)
    attrs = features.opened_us(t.accounts).select("account", "opened_us", F.lit(None).cast("bigint").alias("score"))
    return identity.shared_profile(t.links, attrs).select(
        "account",
        F.col("device_n").alias("shared_device_n"),
        F.col("phone_n").alias("shared_phone_n"),
        F.col("ip_n").alias("shared_ip_n"),
        F.col("new_n").alias("shared_any_new_n"),
    )


@query(
    "identifier_users",
    'SELECT "type", identifier_id, count(DISTINCT account) users FROM links GROUP BY 1,2',
)
def identifier_users(spark, d):
    return identity.identifier_sizes(Tables(spark, d).links)


@query(
    "nested_identifiers",
    """SELECT identifier_id, "type", string_agg(account, ',' ORDER BY account) accounts, count(*) users FROM links GROUP BY 1,2""",
)
def nested_identifiers(spark, d):
    return identity.nested_identifiers(Tables(spark, d).links).select(
        "identifier_id",
        "type",
        F.array_join("account_ids", ",").alias("accounts"),
        F.size("account_ids").cast("bigint").alias("users"),
    )


@query("neighbour_risk", "SELECT account, neighbour_risk_v1 FROM feat")
def neighbour_risk(spark, d):
    return Tables(spark, d).matrix.select("account", "neighbour_risk_v1")


@query(
    "feature_matrix",
    "SELECT account, " + ", ".join(features.V2_FEATURES + features.GEO_FEATURES) + " FROM feat",
)
def feature_matrix(spark, d):
    return Tables(spark, d).matrix.select("account", *features.V2_FEATURES, *features.GEO_FEATURES)


@query("cashout_geo_features", "SELECT account, home_cashout_km, cashout_city_n FROM geo_feat")
def cashout_geo_features(spark, d):
    t = Tables(spark, d)
    return features.geo_features(t.accounts, t.ledger)


_BAND = "CASE WHEN {0}>=8000 THEN 'CRITICAL' WHEN {0}>=6000 THEN 'HIGH' WHEN {0}>=3500 THEN 'MEDIUM' ELSE 'LOW' END"


@query(
    "risk_bands",
    f"SELECT account, v1_bp, v2_bp, round(v2_bp/10000e0,4) risk_v2, {_BAND.format('v2_bp')} band FROM scored",
)
def risk_bands(spark, d):
    return Tables(spark, d).scored.select("account", "v1_bp", "v2_bp", rounded("risk_v2", 4), "band")


def _why_sql() -> str:
    steps = {**scoring.V1_RULES, **scoring.V2_RULES}
    label = {
        "pass_through": "concat('Forwards ', CAST(CAST(floor(pass_through*100e0) AS BIGINT) AS VARCHAR), '% of what it receives')",
        "burst_10min": "concat(CAST(burst_10min AS VARCHAR), ' transactions in 10 minutes')",
        "velocity_per_hr": "concat(printf('%.1f', velocity_per_hr), ' transactions per hour')",
        "median_hold_min": "concat('Holds money only ', printf('%.0f', median_hold_min), ' minutes before forwarding')",
        "atm_share": "concat(CAST(CAST(floor(atm_share*100e0) AS BIGINT) AS VARCHAR), '% of outflow goes to cash (ATM)')",
        "account_age_days": "concat('Account opened only ', printf('%.0f', account_age_days), ' days before first use')",
        "shared_device_n": "concat('Shares a device with ', CAST(shared_device_n AS VARCHAR), ' other accounts')",
        "shared_phone_n": "concat('Shares a phone number with ', CAST(shared_phone_n AS VARCHAR), ' other accounts')",
        "shared_any_new_n": "concat('Linked to ', CAST(shared_any_new_n AS VARCHAR), ' recently opened accounts')",
        "neighbour_risk_v1": "concat('Connected to high-risk accounts (avg risk ', printf('%.2f', neighbour_risk_v1), ')')",
        "home_cashout_km": "concat('Withdraws cash ', printf('%.0f', home_cashout_km), ' km from home branch')",
        "in_degree": "concat('Receives from ', CAST(in_degree AS VARCHAR), ' unique senders')",
    }
    parts = []
    for f, ss in steps.items():
        case = "CASE " + " ".join(f"WHEN {f}{op}{float(b)!r}e0 THEN {p}" for op, b, p in ss) + " ELSE 0 END"
        parts.append(f"SELECT account, '{f}' feature, {label[f]} label, {case} bp FROM scored WHERE v2_bp>=5000")
    deg = "CASE WHEN in_degree>=3 AND out_degree>=3 THEN 1000 ELSE 0 END"
    parts.append(f"SELECT account, 'in_degree', {label['in_degree']}, {deg} FROM scored WHERE v2_bp>=5000")
    return (
        'SELECT account, rank, feature, label, bp/10000e0 weight FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY bp DESC, feature) "rank" FROM ('
        + " UNION ALL ".join(parts)
        + ') WHERE bp>0) WHERE "rank"<=3'
    ).replace("account, rank,", 'account, "rank",')


@query("why_flagged", _why_sql())
def why_flagged(spark, d):
    return scoring.why_flagged(Tables(spark, d).scored)


@query(
    "signal_labels",
    """SELECT account, concat('Total inflow ₹', replace(format('{:,}', CAST(amount_in//100 AS BIGINT)), ' ', '')) inflow,
       concat('Total outflow ₹', format('{:,}', CAST(amount_out//100 AS BIGINT))) outflow,
       concat(CAST(txn_in AS VARCHAR), ' incoming transactions') n_in, concat(CAST(txn_out AS VARCHAR), ' outgoing transactions') n_out,
       concat('Sends to ', CAST(out_degree AS VARCHAR), ' unique receivers') receivers,
       concat('Low counterparty diversity (', printf('%.2f', counterparty_div), ')') diversity FROM feat0""",
)
def signal_labels(spark, d):
    t = Tables(spark, d)
    f = features.transaction_features(t.accounts, t.ledger)
    s = X.signal_label
    return f.select(
        "account",
        s("amount_in", F.col("amount_in")).alias("inflow"),
        s("amount_out", F.col("amount_out")).alias("outflow"),
        s("txn_in", F.col("txn_in")).alias("n_in"),
        s("txn_out", F.col("txn_out")).alias("n_out"),
        s("out_degree", F.col("out_degree")).alias("receivers"),
        s("counterparty_div", F.col("counterparty_div")).alias("diversity"),
    )


@query(
    "score_blend",
    f"""SELECT account, round(least(1e0,greatest(0e0, 0.6e0*v2_bp/10000e0+0.3e0*v1_bp/10000e0+0.1e0*a)),4) risk_combined, round(a,6) anomaly
     FROM (SELECT account, v1_bp, v2_bp, 1e0-(velocity_per_hr-min(velocity_per_hr) OVER ())/greatest(max(velocity_per_hr) OVER ()-min(velocity_per_hr) OVER (),1e-9) a FROM scored)""",
)
def score_blend(spark, d):
    s = scoring.normalised_anomaly(Tables(spark, d).scored, "velocity_per_hr")
    return s.select(
        "account",
        scoring.blend(F.col("risk_v1"), F.col("risk_v2"), F.col("anomaly")).alias("risk_combined"),
        rounded("anomaly", 6),
    )
