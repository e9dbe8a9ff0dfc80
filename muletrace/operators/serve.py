"""Investigator queries: lists, pages, details, replay, case report. Labels never leave through here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muletrace.functions.exprs import paise_to_rupees
from muletrace.operators.timeline import numbered_range
from muletrace.schemas import CASH, SALARY, check_request, drop_labels

PUBLIC_COLUMNS = ["txn_id", "src", "dst", "amount_paise", "ts", "channel", "city", "lat", "lng"]
REPLAY_COLUMNS = ["txn_id", "src", "dst", "amount_rupees", "ts", "channel"]


def public_ledger(ledger: DataFrame) -> DataFrame:
    return drop_labels(ledger).select(*PUBLIC_COLUMNS)


def replay_rows(ledger: DataFrame) -> DataFrame:
    """The six columns a replay sends, without salary rows."""
    amount = paise_to_rupees(F.col("amount_paise"), "half_up").alias("amount_rupees")
    return ledger.where(F.col("src") != SALARY).select("txn_id", "src", "dst", amount, "ts", "channel")


def up_to(ledger: DataFrame, as_of: Column) -> DataFrame:
    return ledger.where(F.col("ts") <= as_of)


def after_transaction(ledger: DataFrame, anchor_txn: str) -> DataFrame:
    """Rows strictly later than the anchor's time; an unknown anchor does not restrict."""
    at = ledger.where(F.col("txn_id") == anchor_txn).agg(F.max("us")).scalar()
    return ledger.where((F.col("us") > at) | at.isNull())


def page(ledger: DataFrame, number: int, limit: int) -> DataFrame:
    """One page in (ts, txn_id) order with total and page count; a page past the end gives the last one.

    Time buckets are counted, and only those that hold the page are ordered.
    """
    check_request(limit=limit, page=number)
    total = ledger.agg(F.count(F.lit(1))).scalar()
    pages = F.greatest(F.lit(1), F.ceil(total / F.lit(limit)))
    shown = F.least(F.lit(number), pages)
    rows = numbered_range(ledger, ["us", "txn_id"], (shown - 1) * limit + 1, shown * limit)
    return rows.withColumns({"page": shown.cast("bigint"), "pages": pages.cast("bigint"), "total": total})


def first_rows(ledger: DataFrame, limit: int) -> DataFrame:
    """First rows in ledger order; each task keeps only ``limit`` rows."""
    check_request(limit=limit)
    return ledger.orderBy("us", "txn_id").limit(limit)


def recent_transactions(events: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` rows per account, newest first. The rank filter is applied before and after the shuffle."""
    w = W.partitionBy("account").orderBy(F.desc("us"), F.desc("txn_id"), "dir")
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def in_id_order(df: DataFrame, ids: list[str], id_col: str = "account") -> DataFrame:
    """Rows of the requested ids, in request order; repeated ids repeat."""
    if len(ids) > 10_000:
        raise ValueError("at most 10000 ids per request")
    wanted = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], f"pos int, {id_col} string")
    return F.broadcast(wanted).join(df, id_col).orderBy("pos")


def cashouts_of(ledger: DataFrame, members: DataFrame) -> DataFrame:
    """Located ATM rows paid by members."""
    m = members.select(F.col("account").alias("src")).distinct()
    return ledger.where((F.col("channel") == "ATM") & F.col("city").isNotNull()).join(m, "src", "left_semi")


def account_detail(accounts: DataFrame, links: DataFrame, events: DataFrame, recent: int = 10) -> DataFrame:
    """One row per account: its columns, its identifiers with their number of users, its newest transfers.

    Only the account's own few identifiers are listed; the users of an identifier are counted, not collected.
    """
    users = links.groupBy("type", "identifier_id").agg(F.count(F.lit(1)).alias("users"))
    linked = (
        links.join(users, ["type", "identifier_id"])
        .groupBy("account")
        .agg(F.sort_array(F.collect_list(F.struct("type", "identifier_id", "users"))).alias("identifiers"))
    )
    newest = (
        recent_transactions(events, recent)
        .groupBy("account")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "txn_id", "dir", "counterparty", "amount_paise", "ts"))).alias("recent"))
    )
    return drop_labels(accounts).join(linked, "account", "left").join(newest, "account", "left")


def ring_nodes(members: DataFrame, roles: DataFrame, scores: DataFrame, identity: DataFrame) -> DataFrame:
    """Account nodes with role and risk, and identifier nodes."""
    acc = (
        members.join(roles.select("ring_id", "account", "role"), ["ring_id", "account"], "left")
        .join(scores.select("account", "risk_v2"), "account", "left")
        .select(
            "ring_id",
            F.col("account").alias("node"),
            F.lit("account").alias("type"),
            F.coalesce("role", F.lit("member")).alias("role"),
            F.coalesce("risk_v2", F.lit(0.0)).alias("risk"),
        )
    )
    ids = identity.select("ring_id", F.col("identifier_id").alias("node"), "type").distinct()
    return acc.unionByName(ids.select("*", F.lit("").alias("role"), F.lit(0.0).alias("risk")))


def ring_graph_edges(edges: DataFrame, identity: DataFrame) -> DataFrame:
    """Transfer edges and (identifier -> member) edges in one table."""
    money = edges.select(
        "ring_id", F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("txn").alias("kind"), "amount_paise", "transfers"
    )
    zero = F.lit(0).cast("bigint")
    ident = identity.select(
        "ring_id",
        F.col("identifier_id").alias("source"),
        F.col("account").alias("target"),
        F.lit("identity").alias("kind"),
        zero.alias("amount_paise"),
        zero.alias("transfers"),
    )
    return money.unionByName(ident)


def state_summary(ledger: DataFrame, scores: DataFrame, members: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of counts: transfers without salaries, accounts seen, scored, high risk, rings, alerts."""
    seen = ledger.select(F.explode(F.array("src", "dst")).alias("a")).distinct().where(~F.col("a").isin(CASH, SALARY) & ~F.col("a").startswith("VICTIM"))
    s = scores.agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("v2_bp") >= 5000).alias("high_risk"))
    return s.select(
        ledger.agg(F.count_if(F.col("src") != SALARY)).scalar().alias("txns"),
        seen.agg(F.count(F.lit(1))).scalar().alias("accounts"),
        "scored",
        "high_risk",
        members.agg(F.count_distinct("ring_id")).scalar().alias("rings"),
        alerts.agg(F.count(F.lit(1))).scalar().alias("alerts"),
    )


def activity_histogram(ledger: DataFrame, members: DataFrame, bins: int = 320) -> DataFrame:
    """Transfers per equal time bin, for the whole ledger ('') and per ring (payer's ring first, else the payee's)."""
    b = ledger.agg(F.struct(F.min("us").alias("lo"), F.max("us").alias("hi"))).scalar()
    span = F.greatest(b["hi"] - b["lo"], F.lit(1))
    pos = F.floor((F.col("us") - b["lo"]) / span * F.lit(float(bins)))
    rows = ledger.select("src", "dst", F.greatest(F.lit(0), F.least(F.lit(bins - 1), pos)).cast("int").alias("bin"))
    # bins x account pairs are reduced before the ring join
    small = rows.groupBy("src", "dst", "bin").agg(F.count(F.lit(1)).alias("n"))
    one = members.groupBy("account").agg(F.min("ring_id").alias("ring_id"))
    payer = one.select(F.col("account").alias("src"), F.col("ring_id").alias("r1"))
    payee = one.select(F.col("account").alias("dst"), F.col("ring_id").alias("r2"))
    tagged = small.join(payer, "src", "left").join(payee, "dst", "left").withColumn("ring_id", F.coalesce("r1", "r2"))
    both = tagged.select("bin", "n", F.explode(F.array_compact(F.array(F.lit(""), F.col("ring_id")))).alias("ring_id"))
    return both.groupBy("ring_id", "bin").agg(F.sum("n").alias("transfers"))


def replay_ticks(ledger: DataFrame, speed: float = 3600.0, tick_ms: int = 250) -> DataFrame:
    """Transfers due at each tick of a replay: tick k covers (start + (k-1) steps, start + k steps]."""
    step = int(tick_ms * 1000 * speed)
    t0 = ledger.agg(F.min("us")).scalar()
    return replay_ticks_from(ledger, t0, step)


def replay_ticks_from(ledger: DataFrame, t0: Column, step_us: int) -> DataFrame:
    offset = F.col("us") - t0
    tick = F.floor((offset + F.lit(step_us - 1)) / F.lit(step_us)).cast("bigint")
    return ledger.groupBy(F.greatest(F.lit(1).cast("bigint"), tick).alias("tick")).agg(
        F.count(F.lit(1)).alias("due"), F.sum("amount_paise").alias("amount_paise"), F.max("us").alias("last_us")
    )


def case_report(
    summary: DataFrame, roles: DataFrame, holders: DataFrame, plan: DataFrame, recruit_rows: DataFrame, edges: DataFrame
) -> DataFrame:
    """One nested row per ring: members with role and reason, traced money, freeze plan, recruits, edges.

    A report is one investigator's document; its lists are per ring, ordered, and built from already reduced rows.
    """

    def listed(df: DataFrame, name: str, *cols: str) -> DataFrame:
        return df.groupBy("ring_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))

    return (
        summary.join(listed(roles, "members_detail", "account", "role", "role_reason"), "ring_id", "left")
        .join(listed(holders, "taint", "account", "balance", "tainted", "lien"), "ring_id", "left")
        .join(plan.select("ring_id", "frozen", "at_risk_before", "secured", "pct_stopped", "nothing_at_risk"), "ring_id", "left")
        .join(listed(recruit_rows, "recruits", "score", "account", "reasons"), "ring_id", "left")
        .join(listed(edges, "edges", "src", "dst", "amount_paise", "transfers"), "ring_id", "left")
    )


def identifiers_of_users(links: DataFrame, accounts: DataFrame) -> DataFrame:
    """Identifiers that any of the accounts uses, without gathering their users."""
    return links.join(accounts.select("account"), "account", "left_semi").select("identifier_id", "type").distinct()


def merge_new_data(
    accounts: DataFrame, ledger: DataFrame, links: DataFrame, new_accounts: DataFrame, new_ledger: DataFrame, new_links: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add a delivery: only unknown accounts, only unknown transfers, identifiers united by member."""
    acc = accounts.unionByName(new_accounts.join(accounts.select("account"), "account", "left_anti"))
    led = ledger.unionByName(new_ledger.join(ledger.select("txn_id"), "txn_id", "left_anti"))
    both = links.select("identifier_id", "type", "account").unionByName(new_links.select("identifier_id", "type", "account"))
    return acc, led, both.distinct()


def unknown_accounts(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Real endpoints of transfers that no account row describes."""
    ends = ledger.select(F.explode(F.array("src", "dst")).alias("account")).distinct()
    real = ends.where(~F.col("account").isin(CASH, SALARY) & ~F.col("account").startswith("VICTIM"))
    return real.join(accounts.select("account"), "account", "left_anti")
