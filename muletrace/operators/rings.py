"""Ring roll-ups: internal transfers, edges, identity links, victim deposits, alerts, roles.

``members(ring_id, account)`` is the input everywhere; an account may be in several rings. Rings and ledgers are joined
on accounts and left to the optimizer: small member sets are broadcast by size, large ones shuffle with skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muletrace.functions.exprs import MICROS_PER_MINUTE, fixed_text, grouped_int
from muletrace.operators.timeline import numbered_by_time
from muletrace.schemas import CASH, VICTIM_PREFIX
from muletrace.session import cut_lineage, shuffled


def internal_transfers(ledger: DataFrame, members: DataFrame) -> DataFrame:
    """Transfers whose payer and payee are in the same ring."""
    payer = members.select("ring_id", F.col("account").alias("src"))
    payee = members.select("ring_id", F.col("account").alias("dst"))
    return ledger.join(payer, "src").join(payee, ["ring_id", "dst"])


def ring_edges(ledger: DataFrame, members: DataFrame) -> DataFrame:
    return (
        internal_transfers(ledger.select("src", "dst", "amount_paise"), members)
        .groupBy("ring_id", "src", "dst")
        .agg(F.sum("amount_paise").alias("amount_paise"), F.count(F.lit(1)).alias("transfers"))
    )


def ring_volumes(ledger: DataFrame, members: DataFrame) -> DataFrame:
    """Internal volume, and the money that came in from outside the ring."""
    payer = members.select("ring_id", F.col("account").alias("src"), F.lit(True).alias("from_inside"))
    payee = members.select("ring_id", F.col("account").alias("dst"))
    incoming = ledger.select("src", "dst", "amount_paise").join(payee, "dst").join(payer, ["ring_id", "src"], "left")
    inside = F.coalesce("from_inside", F.lit(False))
    amount = F.col("amount_paise")
    return incoming.groupBy("ring_id").agg(
        F.coalesce(F.sum(F.when(inside, amount)), F.lit(0)).cast("bigint").alias("volume_paise"),
        F.coalesce(F.sum(F.when(~inside, amount)), F.lit(0)).cast("bigint").alias("external_inflow_paise"),
        F.count_if(inside).alias("transfers"),
    )


def ring_risk(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean member risk, four decimals. ``scores(account, v2_bp)``; summed as integers."""
    return (
        members.join(scores.select("account", "v2_bp"), "account")
        .groupBy("ring_id")
        .agg(F.round(F.sum("v2_bp") / F.count("v2_bp") / F.lit(10000.0), 4).alias("risk"))
    )


def ring_summary(ledger: DataFrame, members: DataFrame, scores: DataFrame) -> DataFrame:
    sizes = members.groupBy("ring_id").agg(F.count(F.lit(1)).alias("members"))
    return (
        sizes.join(ring_volumes(ledger, members).drop("external_inflow_paise"), "ring_id", "left")
        .join(ring_risk(members, scores), "ring_id", "left")
        .na.fill(0, subset=["volume_paise", "transfers"])
    )


def identity_links(links: DataFrame, members: DataFrame, min_members: int = 2) -> DataFrame:
    """Identifiers used by at least ``min_members`` members of a ring, with the number of members on each."""
    return (
        links.join(members, "account")
        .groupBy("ring_id", "type", "identifier_id")
        .agg(F.count(F.lit(1)).alias("members_on"))
        .where(F.col("members_on") >= min_members)
    )


def identity_edges(links: DataFrame, members: DataFrame) -> DataFrame:
    """(ring, identifier, member) rows of the shared identifiers: the star form of the identity links."""
    return links.join(members, "account").join(identity_links(links, members), ["ring_id", "type", "identifier_id"])


def victim_deposits(ledger: DataFrame, members: DataFrame) -> DataFrame:
    """Deposits by outside victims into a ring, recognised by the payer's prefix, never by a label."""
    return (
        ledger.where(F.col("src").startswith(VICTIM_PREFIX))
        .join(members.select("ring_id", F.col("account").alias("dst")), "dst")
        .select("ring_id", "txn_id", "src", "dst", "amount_paise", "ts", "us")
    )


def default_cases(ledger: DataFrame, members: DataFrame) -> DataFrame:
    """One case per ring: its earliest victim deposit."""
    w = W.partitionBy("ring_id").orderBy("us", "txn_id")
    first = victim_deposits(ledger, members).withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1)
    return first.select(F.col("ring_id").alias("case_id"), "ring_id", F.col("txn_id").alias("victim_txn"))


def alerts(ledger: DataFrame, members: DataFrame, nth: int = 3) -> DataFrame:
    """An alert per ring at its ``nth`` internal transfer, or its last one when it has fewer.

    The rank filter lets each task keep only the first ``nth`` rows per ring before the shuffle.
    """
    inner = internal_transfers(ledger.select("txn_id", "src", "dst", "ts", "us"), members)
    w = W.partitionBy("ring_id").orderBy("us", "txn_id")
    early = inner.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= nth)
    fired = early.groupBy("ring_id").agg(F.max("ts").alias("fired_at"), F.max("us").alias("fired_us"))
    # with at least nth transfers the latest of the first nth is the nth; with fewer it is the last one
    sizes = members.groupBy("ring_id").agg(F.count(F.lit(1)).alias("members"))
    return fired.join(sizes, "ring_id").select(
        F.concat(F.lit("ALT"), F.expr("substring(ring_id, 5)")).alias("alert_id"),
        "ring_id",
        "fired_at",
        "fired_us",
        F.concat(F.col("members").cast("string"), F.lit(" linked accounts forwarding within minutes")).alias("reason"),
    )


def alerts_in_order(alerts_df: DataFrame, newest_first: bool = True) -> DataFrame:
    """Alerts with their ``position`` by time fired, then alert id, numbered by time buckets."""
    rows = numbered_by_time(alerts_df.withColumn("us", F.col("fired_us")), ["us", "alert_id"]).drop("us")
    last = F.lit(1) + alerts_df.agg(F.count(F.lit(1))).scalar()
    return rows.withColumn("position", (last - F.col("seq")) if newest_first else F.col("seq")).drop("seq")


def alerts_with_ring(alerts_df: DataFrame, summary: DataFrame) -> DataFrame:
    """Alerts with their ring's risk and size; an alert of an unknown ring stays, with no risk and 0 members."""
    s = summary.select("ring_id", "risk", "members", "volume_paise")
    return alerts_df.join(s, "ring_id", "left").withColumn("members", F.coalesce("members", F.lit(0).cast("bigint")))


def latest_version(versions: DataFrame) -> DataFrame:
    """Newest row per ring by ``version``."""
    w = W.partitionBy("ring_id").orderBy(F.desc("version"))
    return versions.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn")


def cashout_eta(ledger: DataFrame, members: DataFrame, alerts_df: DataFrame) -> DataFrame:
    """Minutes from an alert to the ring's first cash withdrawal at or after it (null: none), and whether the alert
    came before any withdrawal."""
    cash = (
        ledger.where(F.col("dst") == CASH)
        .select(F.col("src").alias("account"), "us")
        .join(members, "account")
        .join(alerts_df.select("ring_id", "fired_us"), "ring_id")
        .groupBy("ring_id")
        .agg(
            F.min(F.when(F.col("us") >= F.col("fired_us"), F.col("us"))).alias("next_us"),
            F.bool_or(F.col("us") <= F.col("fired_us")).alias("cashed"),
        )
    )
    minutes = (F.col("next_us") - F.col("fired_us")) / F.lit(float(MICROS_PER_MINUTE))
    return alerts_df.join(cash, "ring_id", "left").select(
        "alert_id",
        "ring_id",
        F.floor(minutes + F.lit(0.5)).cast("bigint").alias("cashout_eta_min"),
        (~F.coalesce("cashed", F.lit(False))).alias("before_cashout"),
    )


def alert_reasons(ledger: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """Long reason text: members, money moved, time span, and the widest shared identifier."""
    inner = internal_transfers(ledger.select("src", "dst", "amount_paise", "us"), members)
    moved = inner.groupBy("ring_id").agg(
        F.sum("amount_paise").alias("volume"),
        F.count(F.lit(1)).alias("transfers"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
    )
    sizes = members.groupBy("ring_id").agg(F.count(F.lit(1)).alias("members"))
    # most members first, then type and identifier so that ties are settled the same way everywhere
    widest = (
        identity_links(links, members)
        .groupBy("ring_id")
        .agg(F.min(F.struct((-F.col("members_on")).alias("n"), "type", "identifier_id")).alias("w"))
    )
    rupees = F.floor(F.coalesce("volume", F.lit(0)) / F.lit(100)).cast("bigint")
    amount = F.when(
        rupees >= 100000, F.concat(F.lit("₹"), fixed_text(rupees / F.lit(100000.0), 1), F.lit(" lakh"))
    ).otherwise(F.concat(F.lit("₹"), grouped_int(rupees)))
    minutes = (F.col("last_us") - F.col("first_us")) / F.lit(float(MICROS_PER_MINUTE))
    within = F.when(
        F.coalesce("transfers", F.lit(0)) >= 2,
        F.when(
            minutes < 120,
            F.concat(F.lit(" within "), F.greatest(F.lit(1), F.rint(minutes).cast("bigint")).cast("string"), F.lit(" min")),
        ).otherwise(F.concat(F.lit(" within "), fixed_text(minutes / F.lit(60.0), 0), F.lit(" h"))),
    ).otherwise("")
    share = F.when(
        F.col("w").isNotNull(),
        F.concat(F.lit("; "), (-F.col("w.n")).cast("string"), F.lit(" share one "), F.col("w.type")),
    ).otherwise("")
    return (
        sizes.join(moved, "ring_id", "left")
        .join(widest, "ring_id", "left")
        .select(
            "ring_id",
            F.concat(
                F.col("members").cast("string"), F.lit(" linked accounts moved "), amount, within, share
            ).alias("reason"),
        )
    )


def role_statistics(ledger: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """Per member: money in and out, split by inside/outside and cash, ring partners, first activity, shares."""
    return _statistics(_member_pairs(ledger, members), members, links)


def _statistics(pairs: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    per = pairs.groupBy("ring_id", "account").agg(
        F.sum("inflow").alias("inflow"),
        F.sum(F.when(~F.col("inside"), F.col("inflow")).otherwise(0)).alias("inflow_outside"),
        F.sum("outflow").alias("outflow"),
        F.sum(F.when(F.col("counterparty") == CASH, F.col("outflow")).otherwise(0)).alias("outflow_cash"),
        F.count_if(F.col("inside") & (F.col("n_in") > 0)).alias("ring_senders"),
        F.count_if(F.col("inside") & (F.col("n_out") > 0)).alias("ring_receivers"),
        F.min("first_us").alias("first_us"),
    )
    shares = (
        identity_edges(links, members)
        .groupBy("ring_id", "account")
        .agg(F.sum(F.col("members_on") - 1).alias("shares"))
    )
    counts = ["inflow", "inflow_outside", "outflow", "outflow_cash", "ring_senders", "ring_receivers", "shares"]
    return (
        members.join(per, ["ring_id", "account"], "left").join(shares, ["ring_id", "account"], "left").na.fill(0, subset=counts)
    )


def _member_pairs(ledger: DataFrame, members: DataFrame) -> DataFrame:
    """(ring, member, counterparty) totals: spreads a busy member over its counterparties before the final roll-up. Transfers are
    summed before rings are known, so cash and salaries are not shuffled by account; a member named twice counts twice."""
    sides = ledger.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("account"), F.col("dst").alias("counterparty"), F.lit(False).alias("credit")),
                F.struct(F.col("dst").alias("account"), F.col("src").alias("counterparty"), F.lit(True).alias("credit")),
            )
        ),
        "amount_paise",
        "us",
    )
    other = members.select("ring_id", F.col("account").alias("counterparty"), F.lit(True).alias("is_member"))
    amount, credit = F.col("amount_paise"), F.col("credit")
    totals = (
        sides.groupBy("account", "counterparty")
        .agg(
            F.sum(F.when(credit, amount).otherwise(0)).alias("inflow"),
            F.sum(F.when(~credit, amount).otherwise(0)).alias("outflow"),
            F.count_if(credit).alias("n_in"),
            F.count_if(~credit).alias("n_out"),
            F.min("us").alias("first_us"),
        )
    )
    held = members.groupBy("ring_id", "account").agg(F.count(F.lit(1)).alias("times"))
    summed = {c: F.col(c) * F.col("times") for c in ("inflow", "outflow", "n_in", "n_out")}
    totals = totals.join(shuffled(held), "account").withColumns(summed).drop("times")
    return totals.join(shuffled(other), ["ring_id", "counterparty"], "left").withColumn(
        "inside", F.coalesce("is_member", F.lit(False))
    )


def classify_roles(ledger: DataFrame, members: DataFrame, links: DataFrame, features: DataFrame) -> DataFrame:
    """Role of every ring member, first rule that holds: coordinator, source, cash-out, mule, relay, member.

    ``features(account, pass_through, median_hold_min)``. The ledger is read once: volumes and who was paid by the source come
    from the members' totals, too.
    """
    pairs = cut_lineage(_member_pairs(ledger, members))
    stats = _statistics(pairs, members, links)
    volume = pairs.where("inside").groupBy("ring_id").agg(F.sum("outflow").alias("volume"))
    f = features.select("account", "pass_through", "median_hold_min")
    s = stats.join(volume, "ring_id", "left").join(f, "account", "left")
    share = F.col("outflow") / F.greatest(F.coalesce("volume", F.lit(0)), F.lit(1))
    s = s.withColumn("vol_share", share).withColumn("coord", (F.col("shares") >= 3) & (F.col("vol_share") < 0.10))
    mostly_outside = (F.col("inflow") > 0) & (F.col("inflow_outside") / F.greatest("inflow", F.lit(1)) >= 0.5)
    s = cut_lineage(s.withColumn("source_like", ~F.col("coord") & mostly_outside & F.col("first_us").isNotNull()))
    # the earliest source-like member of the ring, by one aggregate instead of an ordered window
    source = (
        s.where("source_like")
        .groupBy("ring_id")
        .agg(F.min(F.struct("first_us", "account")).alias("m"))
        .select("ring_id", F.col("m.account").alias("source"))
    )
    paid_by_source = (
        pairs.where(F.col("inside") & (F.col("n_in") > 0))
        .join(source.select("ring_id", F.col("source").alias("counterparty")), ["ring_id", "counterparty"])
        .select("ring_id", "account", F.lit(True).alias("from_source"))
        .distinct()
    )
    s = s.join(source, "ring_id", "left").join(paid_by_source, ["ring_id", "account"], "left")
    cash_share = F.col("outflow_cash") / F.greatest("outflow", F.lit(1))
    tests = [
        ("coordinator", F.col("coord")),
        ("source", F.coalesce(F.col("account") == F.col("source"), F.lit(False))),
        ("cash-out", (F.col("outflow") > 0) & (cash_share >= 0.5)),
        (
            "mule",
            F.coalesce("from_source", F.lit(False))
            & F.coalesce((F.col("pass_through") >= 0.8) & (F.col("median_hold_min") < 30), F.lit(False)),
        ),
        ("relay", (F.col("ring_senders") > 0) & (F.col("ring_receivers") > 0)),
    ]
    role = None
    for name, cond in tests:
        role = F.when(cond, name) if role is None else role.when(cond, name)
    s = s.withColumn("role", role.otherwise("member"))
    pct = lambda c: F.concat(fixed_text(c * F.lit(100.0), 0), F.lit("%"))
    reason = (
        F.when(
            F.col("role") == "coordinator",
            F.concat(
                F.lit("Shares identifiers with "),
                F.col("shares").cast("string"),
                F.lit(" ring members, carries only "),
                pct(F.col("vol_share")),
                F.lit(" of ring volume"),
            ),
        )
        .when(
            F.col("role") == "source",
            "Receives majority of inflow from outside the ring and is the earliest active member",
        )
        .when(F.col("role") == "cash-out", F.concat(pct(cash_share), F.lit(" of outflow goes to ATM cash-out")))
        .when(
            F.col("role") == "mule",
            F.concat(
                F.lit("Receives from source, forwards "),
                pct(F.col("pass_through")),
                F.lit(", holds only "),
                fixed_text(F.col("median_hold_min"), 0),
                F.lit(" min"),
            ),
        )
        .when(F.col("role") == "relay", "Both senders and receivers are ring members")
        .otherwise("Connected to ring but role not clearly determined")
    )
    return s.select("ring_id", "account", "role", reason.alias("role_reason"))


def role_counts(roles: DataFrame) -> DataFrame:
    return roles.groupBy("ring_id", "role").agg(F.count(F.lit(1)).alias("accounts"))


def narrow_role(role, valid: tuple[str, ...], remap: dict[str, str]):
    """Roles outside ``valid`` are replaced through ``remap``, and by member when it has no entry."""
    out = F.when(role.isNull() | role.isin(*valid), role)
    for old, new in remap.items():
        out = out.when(role == old, new)
    return out.otherwise("member")


# The narrower vocabulary of the export.
EXPORT_ROLES = ("source", "mule", "controller", "cash-out", "member")
EXPORT_REMAP = {"coordinator": "controller", "relay": "mule", "cashout": "cash-out"}


def complete_ring_edges(edges: DataFrame, roles: DataFrame, deposits: DataFrame, volumes: DataFrame) -> DataFrame:
    """Ring edges plus the edges that close the picture: victims paying in, cash-out members paying CASH.

    A ring without a known deposit gets a stand-in victim paying its named sources, or, without any, the members nobody
    in the ring pays, or, without any of those, its first member.
    """
    base = edges.select("ring_id", "src", "dst", "amount_paise", F.lit("transfer").alias("kind"))
    real = deposits.select("ring_id", "src", "dst", "amount_paise", F.lit("victim").alias("kind"))
    without = roles.join(deposits.select("ring_id").distinct(), "ring_id", "left_anti")
    paid = edges.select("ring_id", F.col("dst").alias("account")).distinct().withColumn("paid", F.lit(True))
    ranked = without.join(paid, ["ring_id", "account"], "left").withColumn(
        "tier", F.when(F.col("role") == "source", 1).when(F.col("paid").isNull(), 2).otherwise(3)
    )
    best = ranked.groupBy("ring_id").agg(F.min("tier").alias("tier"), F.min("account").alias("first"))
    chosen = ranked.join(best, ["ring_id", "tier"]).where((F.col("tier") < 3) | (F.col("account") == F.col("first")))
    sent = edges.groupBy("ring_id", F.col("src").alias("account")).agg(F.sum("amount_paise").alias("sent"))
    stand_in = (
        chosen.join(sent, ["ring_id", "account"], "left")
        .join(volumes.select("ring_id", "volume_paise"), "ring_id", "left")
        .select(
            "ring_id",
            F.concat(F.lit("VICTIM:"), F.col("ring_id")).alias("src"),
            F.col("account").alias("dst"),
            F.coalesce(F.when(F.col("sent") > 0, F.col("sent")), F.col("volume_paise"), F.lit(0)).cast("bigint").alias("amount_paise"),
            F.lit("victim").alias("kind"),
        )
    )
    received = edges.groupBy("ring_id", F.col("dst").alias("account")).agg(F.sum("amount_paise").alias("received"))
    cash = (
        roles.where(F.col("role") == "cash-out")
        .join(received, ["ring_id", "account"], "left")
        .select(
            "ring_id",
            F.col("account").alias("src"),
            F.lit(CASH).alias("dst"),
            F.coalesce("received", F.lit(0)).cast("bigint").alias("amount_paise"),
            F.lit("cash").alias("kind"),
        )
    )
    return base.unionByName(real).unionByName(stand_in).unionByName(cash)
