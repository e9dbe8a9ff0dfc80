"""Small hand-checkable ledgers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

LEDGER = "txn_id string, src string, dst string, amount_paise bigint, us bigint"


def minutes(hhmm: str) -> int:
    h, m = hhmm.split(":")
    return (int(h) * 60 + int(m)) * 60_000_000


def ledger(spark, rows):
    """rows: (src, dst, amount, 'HH:MM'); ids follow the given order."""
    data = [(f"T{i:03d}", s, d, a, minutes(t)) for i, (s, d, a, t) in enumerate(rows, 1)]
    df = spark.createDataFrame(data, LEDGER)
    return df.withColumns(
        {
            "ts": F.timestamp_micros("us").cast("timestamp_ntz"),
            "channel": F.when(F.col("dst") == "CASH", "ATM").otherwise("UPI"),
            "city": F.lit(None).cast("string"),
            "lat": F.lit(None).cast("double"),
            "lng": F.lit(None).cast("double"),
        }
    )


def openings(spark, amounts: dict[str, int]):
    return spark.createDataFrame(list(amounts.items()), "account string, opening_balance_paise bigint")


def random_rows(seed: int, accounts: int, n: int):
    r = random.Random(seed)
    names = [f"A{i}" for i in range(accounts)]
    out = []
    for i in range(n):
        s, d = r.sample(names, 2)
        if r.random() < 0.15:
            d = "CASH"
        elif r.random() < 0.1:
            s = "SALARY"
        out.append((s, d, r.randint(100, 9000), f"{i // 3 // 60:02d}:{i // 3 % 60:02d}"))
    out[n // 4] = ("VICTIM_1", names[0], 50_000, out[n // 4][3])
    return out


CASE_ROWS = [
    ("VICTIM_1", "S", 120_000, "10:00"),
    ("S", "M1", 60_000, "10:05"),
    ("S", "M2", 50_000, "10:07"),
    ("M1", "X", 55_000, "10:12"),
    ("M2", "X", 45_000, "10:15"),
    ("M2", "O", 5_000, "10:20"),
    ("X", "CASH", 40_000, "10:40"),
]
CASE_MEMBERS = ["S", "M1", "M2", "X", "K"]


def case_members(spark):
    return spark.createDataFrame([("R1", a) for a in CASE_MEMBERS], "ring_id string, account string")
