"""Roles read the ledger once, and count members that are named twice as before."""

from __future__ import annotations

from pyspark.sql import functions as F

from muletrace.operators import rings
from muletrace.plans import export_queries
from muletrace.plans.tables import Tables
from tests.micro import CASE_ROWS, case_members, ledger


def test_money_features_are_computed_once(spark, monkeypatch):
    from muletrace.operators import features

    calls, real = [], features.transaction_features
    monkeypatch.setattr(features, "transaction_features", lambda *a, **k: calls.append(1) or real(*a, **k))
    rows = export_queries.export_accounts(spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == 1 and len(rows) == Tables(spark, "/root/testdata/sf0.001").accounts.count()


def test_totals_before_rings_are_the_same(spark, monkeypatch):
    led = ledger(spark, [*CASE_ROWS, ("X", "X", 700, "10:50"), ("M1", "X", 300, "10:55"), ("X", "S", 90, "10:58")])
    once = case_members(spark)
    members = once.unionByName(once.where("account = 'X'")).unionByName(spark.createDataFrame([("R2", "X"), (None, "M1")], once.schema))
    links = spark.createDataFrame([("D1", "device", "S"), ("D1", "device", "M1")], "identifier_id string, type string, account string")
    got = {(r["ring_id"], r["account"], r["counterparty"]): r for r in rings._member_pairs(led, members).collect()}
    volume = led.join(members.select("ring_id", F.col("account").alias("src")), "src").join(members.select("ring_id", F.col("account").alias("dst")), ["ring_id", "dst"])
    want = {r["ring_id"]: r["v"] for r in volume.groupBy("ring_id").agg(F.sum("amount_paise").alias("v")).collect()}
    inside = rings._member_pairs(led, members).where("inside").groupBy("ring_id").agg(F.sum("outflow").alias("v"))
    assert {r["ring_id"]: r["v"] for r in inside.collect()} == want
    assert got["R1", "X", "CASH"]["outflow"] == 80_000 and got["R2", "X", "CASH"]["outflow"] == 40_000  # twice in R1, once in R2
    assert got["R1", "X", "M1"]["n_in"] == 4 and not got[None, "M1", "X"]["inside"]
    feats = spark.createDataFrame([(a, 0.9, 5.0) for a in ("S", "M1", "M2", "X", "K")], "account string, pass_through double, median_hold_min double")
    roles = {r["account"]: r["role"] for r in rings.classify_roles(led, once, links, feats).collect()}
    assert roles == {"S": "source", "M1": "mule", "M2": "mule", "X": "cash-out", "K": "member"}
