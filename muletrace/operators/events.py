"""Account-side view of the ledger and the per-account activity roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muletrace.schemas import is_pseudo

EVENT_FIELDS = ["amount_paise", "ts", "us", "channel", "city", "lat", "lng", "txn_id"]


def account_events(ledger: DataFrame) -> DataFrame:
    """One row per customer endpoint of every transfer: debit (D) for the payer, credit (C) for the payee.

    A single scan explodes each transfer into its two sides. Cash, salary and victim endpoints are dropped before
    anything is grouped by account, so the ledger's hottest keys never reach a shuffle.
    """

    def side(a: str, b: str, d: str):
        return F.struct(F.col(a).alias("account"), F.col(b).alias("counterparty"), F.lit(d).alias("dir"))

    both = ledger.select(F.inline(F.array(side("src", "dst", "D"), side("dst", "src", "C"))), *EVENT_FIELDS)
    return both.where(~is_pseudo(F.col("account")))


def with_us(ledger: DataFrame) -> DataFrame:
    """Add epoch microseconds where a source has only ``ts``."""
    return ledger if "us" in ledger.columns else ledger.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def activity(events: DataFrame) -> DataFrame:
    """Totals, distinct counterparties and activity span per account.

    Pre-aggregates to (account, counterparty) first. That level is spread over the whole cluster even when one
    account owns a third of the ledger, and it turns the three distinct counts into plain sums, so no row is
    expanded once per DISTINCT.
    """
    credit, debit = F.col("dir") == "C", F.col("dir") == "D"
    amount = F.col("amount_paise")
    pair = events.groupBy("account", "counterparty").agg(
        F.sum(F.when(credit, amount).otherwise(0)).alias("amount_in"),
        F.sum(F.when(debit, amount).otherwise(0)).alias("amount_out"),
        F.count_if(credit).alias("txn_in"),
        F.count_if(debit).alias("txn_out"),
        F.sum(F.when(debit & (F.col("channel") == "ATM"), amount).otherwise(0)).alias("atm_out"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
    )
    return pair.groupBy("account").agg(
        *[F.sum(c).alias(c) for c in ("amount_in", "amount_out", "txn_in", "txn_out", "atm_out")],
        F.count_if(F.col("txn_in") > 0).alias("in_degree"),
        F.count_if(F.col("txn_out") > 0).alias("out_degree"),
        F.count(F.lit(1)).alias("counterparties"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )


def channel_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("channel").agg(F.count(F.lit(1)).alias("transfers"), F.sum("amount_paise").alias("amount_paise"))


def salary_free_export(ledger: DataFrame, known_channels: tuple[str, ...] = ("UPI", "IMPS", "NEFT", "ATM")) -> DataFrame:
    """Export form: no salary payers, unknown channels become NEFT, location kept for ATM rows only, whole rupees."""
    from muletrace.functions.exprs import paise_to_rupees

    channel = F.when(F.col("channel").isin(*known_channels), F.col("channel")).otherwise("NEFT")
    atm = channel == "ATM"
    return ledger.where(~F.col("src").startswith("SALARY")).select(
        "txn_id",
        "src",
        "dst",
        paise_to_rupees(F.col("amount_paise")).alias("amount_rupees"),
        "ts",
        channel.alias("channel"),
        *[F.when(atm, F.col(c)).alias(c) for c in ("city", "lat", "lng")],
    )
