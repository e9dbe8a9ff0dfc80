"""Training snapshots: every active account as it stood at each cut-off day, with the full feature matrix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muletrace.functions.exprs import MICROS_PER_DAY
from muletrace.operators.features import V2_FEATURES, feature_matrix, transaction_features
from muletrace.schemas import drop_labels, is_pseudo
from muletrace.session import cut_lineage, shuffled

# Days into the window at which accounts are snapshotted.
SNAPSHOT_DAYS = (2, 3, 5, 8, 12, 18, 30)


def _tagged(name: str) -> Column:
    """The account as it is known on a day; cash, salaries and victims are the same on all."""
    return F.when(is_pseudo(F.col(name)), F.col(name)).otherwise(F.concat(F.lpad(F.col("day").cast("string"), 4, "0"), F.lit("|"), F.col(name)))


def _each_day(df: DataFrame, days: tuple[int, ...], *names: str) -> DataFrame:
    """``df`` once per day, with the columns ``names`` as they are known on it."""
    every = F.array(*[F.lit(d) for d in sorted(days)])
    return df.withColumn("day", F.explode(every)).withColumns({n: _tagged(n) for n in names}).drop("day")


def _ledger_each_day(ledger: DataFrame, days: tuple[int, ...]) -> DataFrame:
    start = ledger.agg(F.min("us")).scalar()
    every = F.array(*[F.lit(d) for d in sorted(days)])
    seen = drop_labels(ledger).withColumn("day", F.explode(every)).where(F.col("us") <= start + F.col("day") * F.lit(MICROS_PER_DAY))
    return seen.withColumns({"src": _tagged("src"), "dst": _tagged("dst")}).drop("day")


def snapshot_money(accounts: DataFrame, ledger: DataFrame, days: tuple[int, ...] = SNAPSHOT_DAYS) -> DataFrame:
    """Money features of all accounts as they are known on each day, written once: they depend on no score.

    The transfers of every cut-off belong to accounts named after the day, so one pass of the ordinary features gives all
    days; a transfer is repeated once per later cut-off, at most ``len(days)`` times."""
    return cut_lineage(transaction_features(_each_day(accounts, days, "account"), _ledger_each_day(ledger, days)))


def labelled_rows(matrix: DataFrame, columns: list[str], ledger: DataFrame, truth: DataFrame) -> DataFrame:
    """(account, day, columns, label) of a matrix over accounts as they are known on a day.

    Accounts without a transfer so far have no row; members of known rings have one only from their first labelled transfer
    on."""
    start = ledger.agg(F.min("us")).scalar()
    rows = matrix.where(F.col("txn_in") + F.col("txn_out") > 0).select(
        F.expr("substring(account, 6)").alias("account"), F.expr("cast(substring(account, 1, 4) as int)").alias("day"), *columns
    )
    ends = ledger.where("is_fraud").select(F.explode(F.array("src", "dst")).alias("account"), "us")
    first = truth.select("account").distinct().join(shuffled(ends.groupBy("account").agg(F.min("us").alias("fraud_us"))), "account", "left")
    rows = rows.join(shuffled(first.withColumn("label", F.lit(1))), "account", "left")
    rows = rows.where(F.col("label").isNull() | (F.col("fraud_us") <= start + F.col("day") * F.lit(MICROS_PER_DAY)))
    return rows.select("account", "day", *columns, F.coalesce("label", F.lit(0)).alias("label"))


def snapshot_features(
    accounts: DataFrame,
    ledger: DataFrame,
    links: DataFrame,
    truth: DataFrame,
    score_v1: Callable[[DataFrame], DataFrame],
    days: tuple[int, ...] = SNAPSHOT_DAYS,
    money: DataFrame | None = None,
) -> DataFrame:
    """All money and identity features per (account, day) with the training label; ``money`` is :func:`snapshot_money` of the
    same tables and days, where it is at hand."""
    money = snapshot_money(accounts, ledger, days) if money is None else money
    links = _each_day(links, days, "account", "identifier_id")
    matrix = feature_matrix(_each_day(accounts, days, "account"), _ledger_each_day(ledger, days), links, score_v1, geo=False, money=money)
    return labelled_rows(matrix, V2_FEATURES, ledger, truth)
