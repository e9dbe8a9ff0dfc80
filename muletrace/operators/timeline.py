"""Ordered per-account computations that stay parallel inside a hot account.

Each account's time line is cut into blocks. Rows are ordered only within (account, block); one small row per
block carries running totals across blocks. Ordinary accounts have a single block, so for them this is one window
and a join with one row per account; an account with more than ``rows_per_block`` rows is spread over as many
tasks as it has blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muletrace.session import cut_lineage

ROWS_PER_BLOCK = 1_000_000
BURST_US = 600_000_000


MAX_BROADCAST_ACCOUNTS = 200_000


@dataclass(frozen=True)
class HotAccounts:
    """Accounts that need more than one block, with their block width; ``table`` is None when there are none."""

    table: DataFrame | None
    broadcastable: bool = True


def hot_accounts(
    events: DataFrame, rows_per_block: int = ROWS_PER_BLOCK, min_width_us: int = BURST_US
) -> HotAccounts:
    """Find the accounts with more than ``rows_per_block`` rows. There are at most rows / rows_per_block of them, and
    the table is broadcast only when its counted size allows."""
    sizes = events.groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"))
    return hot_from_sizes(sizes, rows_per_block, min_width_us)


def hot_from_sizes(sizes: DataFrame, rows_per_block: int = ROWS_PER_BLOCK, min_width_us: int = BURST_US) -> HotAccounts:
    """The same from ``sizes(account, n, lo, hi)``: rows per account, first and last time."""
    span = F.col("hi") - F.col("lo") + 1
    width = (span / F.ceil(F.col("n") / F.lit(rows_per_block))).cast("bigint")
    hot = sizes.where(F.col("n") > rows_per_block).select("account", F.greatest(width, F.lit(min_width_us)).alias("width_us"))
    n = hot.count()
    return HotAccounts(cut_lineage(hot) if n else None, n <= MAX_BROADCAST_ACCOUNTS)


def with_blocks(events: DataFrame, hot: HotAccounts) -> tuple[DataFrame, list[str]]:
    """Add ``block`` and ``width_us`` (null width: one block), and name the keys of an ordered group."""
    if hot.table is None:
        whole = events.withColumns({"width_us": F.lit(None).cast("bigint"), "block": F.lit(0).cast("bigint")})
        return whole, ["account"]
    side = F.broadcast(hot.table) if hot.broadcastable else hot.table
    block = F.coalesce(F.floor(F.col("us") / F.col("width_us")), F.lit(0)).cast("bigint")
    return events.join(side, "account", "left").withColumn("block", block), ["account", "block"]


def hold_pairs(events: DataFrame, hot: HotAccounts | None = None) -> DataFrame:
    """First-in-first-out matching of debits to credits: (account, m, hold_us).

    In time order (credits first on equal times) a debit takes the earliest unused credit not later than itself, or is
    skipped. With C = credits so far and j = number of the debit, the count of matched debits is
    M(j) = j + min(0, min over i<=j of (C(i) - i)); debit j is matched exactly when M grows, and to credit number M.
    """
    hot = hot or hot_accounts(events)
    slim, keys = with_blocks(events.select("account", "us", "dir", "txn_id"), hot)
    w = W.partitionBy(*keys).orderBy("us", "dir", "txn_id").rowsBetween(W.unboundedPreceding, 0)
    is_c, is_d = F.col("dir") == "C", F.col("dir") == "D"
    local = slim.select(
        "account",
        "block",
        "us",
        "dir",
        F.count_if(is_c).over(w).alias("c"),
        F.count_if(is_d).over(w).alias("d"),
    )
    slack = F.when(is_d, F.col("c") - F.col("d"))
    order = ["us", "c", "d"]
    w2 = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = local.withColumn("low", F.min(slack).over(w2)).withColumn("low_before", F.min(slack).over(before))

    if hot.table is None:
        zero = F.lit(0).cast("bigint")
        rows = local.withColumns({"cc": zero, "cd": zero, "cl": F.lit(None).cast("bigint")})
    else:
        rows = local.join(_hold_carry(local), ["account", "block"])
    shift = F.col("cc") - F.col("cd")
    j = F.col("cd") + F.col("d")
    matched_now = j + F.least(F.lit(0), F.col("cl"), shift + F.col("low"))
    matched_before = j - 1 + F.least(F.lit(0), F.col("cl"), shift + F.col("low_before"))
    keyed = rows.select(
        "account",
        "us",
        "dir",
        F.when(is_c, F.col("cc") + F.col("c")).when(matched_now > matched_before, matched_now).alias("m"),
    ).where(F.col("m").isNotNull())
    # credit number m and the debit matched to it meet in one row: no join, and no row order inside the group
    return (
        keyed.groupBy("account", "m")
        .agg(
            F.max(F.when(is_c, F.col("us"))).alias("credit_us"),
            F.max(F.when(is_d, F.col("us"))).alias("debit_us"),
        )
        .where(F.col("debit_us").isNotNull())
        .select("account", "m", (F.col("debit_us") - F.col("credit_us")).alias("hold_us"))
    )


def _hold_carry(local: DataFrame) -> DataFrame:
    """Credits, debits and lowest C - j before each block."""
    blocks = local.groupBy("account", "block").agg(
        F.max("c").alias("bc"), F.max("d").alias("bd"), F.min("low").alias("bl")
    )
    prior = W.partitionBy("account").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return (
        blocks.withColumn("cc", F.coalesce(F.sum("bc").over(prior), F.lit(0)))
        .withColumn("cd", F.coalesce(F.sum("bd").over(prior), F.lit(0)))
        .withColumn("cl", F.min(F.col("cc") - F.col("cd") + F.col("bl")).over(prior))
        .select("account", "block", "cc", "cd", "cl")
    )


def burst(events: DataFrame, hot: HotAccounts | None = None, span_us: int = BURST_US) -> DataFrame:
    """Largest number of events of an account in any window of ``span_us``, both ends included.

    The first ``span_us`` of every block is also given to the block before it, as rows that are counted but start no
    window of their own.
    """
    hot = hot or hot_accounts(events, min_width_us=span_us)
    slim, keys = with_blocks(events.select("account", "us"), hot)
    head = (F.col("us") - F.col("block") * F.col("width_us")) <= span_us
    copies = F.when(
        F.col("width_us").isNotNull() & head,
        F.array(
            F.struct(F.col("block").alias("block"), F.lit(True).alias("starts")),
            F.struct((F.col("block") - 1).alias("block"), F.lit(False).alias("starts")),
        ),
    ).otherwise(F.array(F.struct(F.col("block").alias("block"), F.lit(True).alias("starts"))))
    if hot.table is None:
        rows = slim.select("account", "us", F.lit(True).alias("starts"))
    else:
        rows = slim.select("account", "us", F.inline(copies))
    w = W.partitionBy(*keys).orderBy("us").rangeBetween(0, span_us)
    return (
        rows.withColumn("c", F.count(F.lit(1)).over(w))
        .where("starts")
        .groupBy("account")
        .agg(F.max("c").alias("burst_10min"))
    )


def worst_balance(events: DataFrame, accounts: DataFrame, hot: HotAccounts | None = None) -> DataFrame:
    """Closing and lowest running balance per account, in (ts, txn_id) order, debits applied as they come.

    ``repaired_opening_paise`` is the opening balance that keeps the account from ever going below 100 paise short.
    """
    delta = F.when(F.col("dir") == "C", F.col("amount_paise")).otherwise(-F.col("amount_paise"))
    hot = hot or hot_accounts(events)
    slim, keys = with_blocks(events.select("account", "us", "txn_id", "dir", delta.alias("delta")), hot)
    w = W.partitionBy(*keys).orderBy("us", "txn_id", "dir").rowsBetween(W.unboundedPreceding, 0)
    run = slim.select("account", "block", "delta", F.sum("delta").over(w).alias("run"))
    blocks = run.groupBy("account", "block").agg(F.sum("delta").alias("total"), F.min("run").alias("low"))
    prior = W.partitionBy("account").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    per_account = (
        blocks.withColumn("carry", F.coalesce(F.sum("total").over(prior), F.lit(0)))
        .groupBy("account")
        .agg(F.sum("total").alias("net"), F.min(F.col("carry") + F.col("low")).alias("low"))
    )
    opening = F.col("opening_balance_paise")
    worst = F.least(opening, opening + F.coalesce("low", F.lit(0)))
    return (
        accounts.select("account", "opening_balance_paise")
        .join(per_account, "account", "left")
        .select(
            "account",
            opening.alias("opening_balance_paise"),
            (opening + F.coalesce("net", F.lit(0))).alias("closing_paise"),
            worst.alias("worst_paise"),
            F.when(worst < 0, opening - worst + 100).otherwise(opening).alias("repaired_opening_paise"),
        )
    )


def numbered_by_time(df: DataFrame, order: list[str], bucket_us: int = 3_600_000_000) -> DataFrame:
    """Global 1..n numbering by ``order`` (first column ``us``) without sorting the table in one task.

    Time buckets are numbered in parallel; the offset of each bucket is a running sum over the bucket counts.
    """
    rows = df.withColumn("_b", F.floor(F.col("us") / F.lit(bucket_us)))
    offsets = bucket_offsets(rows).drop("_n")
    w = W.partitionBy("_b").orderBy(*order)
    rows = rows.withColumn("_rn", F.row_number().over(w))
    return rows.join(offsets, "_b").withColumn("seq", (F.col("_off") + F.col("_rn")).cast("bigint")).drop("_b", "_rn", "_off")


def numbered_range(df: DataFrame, order: list[str], first, last, bucket_us: int = 3_600_000_000) -> DataFrame:
    """Rows ``first`` to ``last`` of the numbering of :func:`numbered_by_time`. Buckets are only counted; those that hold
    the range, at most one more than it has rows, are ordered."""
    rows = df.withColumn("_b", F.floor(F.col("us") / F.lit(bucket_us)))
    wanted = bucket_offsets(rows).where((F.col("_off") < last) & (F.col("_off") + F.col("_n") >= first)).drop("_n")
    w = W.partitionBy("_b").orderBy(*order)
    rows = rows.join(F.broadcast(wanted), "_b").withColumn("seq", (F.col("_off") + F.row_number().over(w)).cast("bigint"))
    return rows.where(F.col("seq").between(first, last)).drop("_b", "_off")


def bucket_offsets(rows: DataFrame) -> DataFrame:
    """(_b, _n, _off): rows of every bucket ``_b`` and of all before it."""
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # two-level running sum: buckets of buckets, so even the bucket list is not ordered in one task
    counts = counts.withColumn("_g", F.floor(F.col("_b") / F.lit(4096)))
    inner = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    groups = counts.groupBy("_g").agg(F.sum("_n").alias("_gn"))
    outer = W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)  # one row per 4096 time buckets
    groups = groups.withColumn("_out", F.coalesce(F.sum("_gn").over(outer), F.lit(0))).drop("_gn")
    return counts.join(groups, "_g").select("_b", "_n", (F.col("_in") + F.col("_out")).alias("_off"))
