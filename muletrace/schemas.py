"""Contracts of the tables: explicit types, sentinel accounts, validation rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accounts that stand for the outside world, and the closed vocabularies of the contract.
CASH = "CASH"
SALARY = "SALARY"
VICTIM_PREFIX = "VICTIM"
CHANNELS = ("UPI", "IMPS", "NEFT", "ATM")
IDENTIFIER_TYPES = ("device", "phone", "ip")
ROLES = ("source", "mule", "relay", "cash-out", "coordinator", "member")
LABEL_COLUMNS = ("is_fraud", "gt", "truth_ring", "planted_ring", "label")
ISO_TS_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
MAX_SAFE_INTEGER = 2**53 - 1

POINT = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
    ]
)

ACCOUNT_JSON = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("holder", T.StringType()),
        T.StructField("bank", T.StringType()),
        T.StructField("home", POINT),
        T.StructField("opened_at", T.StringType()),
        T.StructField("opening_balance", T.LongType()),
    ]
)

TRANSACTION_JSON = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("amount_paise", T.LongType()),
        T.StructField("ts", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("location", POINT),
        T.StructField("is_fraud", T.BooleanType()),
    ]
)

IDENTIFIER_JSON = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("account_ids", T.ArrayType(T.StringType())),
    ]
)

GROUND_TRUTH_JSON = T.StructType(
    [
        T.StructField("ring_id", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("member_ids", T.ArrayType(T.StringType())),
        T.StructField("victim_txn_id", T.StringType()),
        T.StructField("victim_amount_paise", T.LongType()),
    ]
)

PROFILE_SCHEMAS = {
    "accounts": ACCOUNT_JSON,
    "transactions": TRANSACTION_JSON,
    "identifiers": IDENTIFIER_JSON,
    "ground_truth": GROUND_TRUTH_JSON,
}


def is_pseudo(account: Column) -> Column:
    """True for cash, salary and victims' outside accounts."""
    return account.isin(SALARY, CASH) | account.startswith(VICTIM_PREFIX)


def drop_labels(df: DataFrame) -> DataFrame:
    """Remove ground-truth columns; every scoring and serving function passes through here."""
    return df.drop(*[c for c in LABEL_COLUMNS if c in df.columns])


def ledger_rules(with_text_ts: bool = False) -> dict[str, Column]:
    """Rule name -> condition a valid ledger row meets (null counts as a violation)."""
    rules = {
        "txn_id": F.col("txn_id").isNotNull() & (F.length("txn_id") > 0),
        "src": F.col("src").isNotNull(),
        "dst": F.col("dst").isNotNull(),
        "amount": F.col("amount_paise").between(0, MAX_SAFE_INTEGER),
        "channel": F.col("channel").isin(*CHANNELS),
    }
    rules["ts"] = F.col("ts").rlike(ISO_TS_PATTERN) if with_text_ts else F.col("ts").isNotNull()
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def identifier_rules() -> dict[str, Column]:
    rules = {
        "identifier_id": F.col("identifier_id").isNotNull(),
        "type": F.col("type").isin(*IDENTIFIER_TYPES),
        "account": F.col("account").isNotNull(),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: rows seen and, per rule, how many rows break it. One aggregate pass over the table."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(~ok).alias(f"bad_{name}") for name, ok in rules.items()]
    return df.agg(*aggs)


def assert_contract(df: DataFrame, rules: dict[str, Column], table: str) -> DataFrame:
    """Fail the whole load when any row breaks a rule, naming the rules and their counts."""
    row = violation_counts(df, rules).first()
    bad = {n: row[f"bad_{n}"] for n in rules if row[f"bad_{n}"]}
    if bad:
        raise ValueError(f"{table}: contract violated {bad}")
    return df


def split_valid(df: DataFrame, rules: dict[str, Column], seen: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); rejected rows carry the list of rules they break. ``seen`` may count the rows before they part."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in rules.items()]))
    tagged = df.withColumn("broken_rules", broken)
    tagged = seen(tagged, list(rules)) if seen else tagged
    good = tagged.where(F.size("broken_rules") == 0).drop("broken_rules")
    return good, tagged.where(F.size("broken_rules") > 0)


def check_request(k: int | None = None, limit: int | None = None, page: int | None = None) -> None:
    """Argument checks shared by the serving functions."""
    if k is not None and not 0 <= k <= 10:
        raise ValueError("k must be between 0 and 10")
    if limit is not None and not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    if page is not None and page < 1:
        raise ValueError("page must be at least 1")
