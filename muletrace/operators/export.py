"""Export forms: money in whole rupees, roles of the receiver's vocabulary, risks with four decimals. Units are known, not guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muletrace.functions.exprs import paise_to_rupees
from muletrace.operators import rings


def _rupees(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the columns, in paise, as rupees of the same name without their ``_paise``."""
    for c in columns:
        df = df.withColumn(c, paise_to_rupees(F.col(c))).withColumnRenamed(c, c.removesuffix("_paise"))
    return df


def accounts(accounts: DataFrame, scores: DataFrame, roles: DataFrame) -> DataFrame:
    """Every account with its risks (0 without a score), and ring and role if it has any."""
    role = rings.narrow_role(F.col("role"), rings.EXPORT_ROLES, rings.EXPORT_REMAP)
    held = roles.select("account", "ring_id", role.alias("role"), "role_reason")
    all_ = accounts.select("account", "bank", "home_city", "opened_on", "opening_balance_paise").join(scores.select("account", "risk_v1", "risk_v2"), "account", "left")
    risks = {c: F.round(F.coalesce(c, F.lit(0.0)), 4) for c in ("risk_v1", "risk_v2")}
    return _rupees(all_.withColumns(risks).join(held, "account", "left"), "opening_balance_paise")


def ring_totals(ledger: DataFrame, members: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per ring; its edges are :func:`ring_edges`, its members and links rows of their own."""
    return _rupees(rings.ring_summary(ledger, members, scores).select("ring_id", "members", "volume_paise", "risk"), "volume_paise")


def ring_edges(ledger: DataFrame, members: DataFrame) -> DataFrame:
    return _rupees(rings.ring_edges(ledger, members), "amount_paise")


def taint_cases(summary: DataFrame) -> DataFrame:
    return _rupees(summary.select("case_id", "victim_amount", "lost_to_cash", "holders"), "victim_amount", "lost_to_cash")


def taint_accounts(held: DataFrame) -> DataFrame:
    return _rupees(held.select("case_id", "account", "balance", "tainted", "lien"), "balance", "tainted", "lien")


def taint_links(links: DataFrame) -> DataFrame:
    return _rupees(links.select("case_id", "src", "dst", "value"), "value")


def freeze_plans(plans: DataFrame) -> DataFrame:
    """Plans with ``frozen`` as an array; shares and flags stay."""
    return _rupees(plans, "at_risk_before", "secured")
