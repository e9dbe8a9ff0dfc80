"""Balances along the ledger, and stolen money followed batch by batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from muletrace.operators import balances, taint
from muletrace.streaming import tables, traces
from tests import micro


@pytest.mark.parametrize("rows_per_block", [1_000_000, 20])
def test_running_balances(spark, rows_per_block):
    """Payments to oneself, several transfers at one instant, moments between, before and after all, unknown accounts."""
    r = random.Random(5)
    names = ["A", "B", "C", "CASH", "SALARY"]
    rows = sorted((r.randrange(40) * 10**9, f"T{i:03d}", r.choice(names), r.choice(names), r.randrange(1, 500)) for i in range(150))
    ledger = spark.createDataFrame([(t, s, d, a, us) for us, t, s, d, a in rows], micro.LEDGER)
    moments = [(a, at) for a in [*names, "Z", "QUIET"] for at in (-1, 7 * 10**9, 7 * 10**9 + 1, 2**63 - 1)]
    asked = spark.createDataFrame(moments, "account string, at_us bigint")
    wanted = spark.createDataFrame([(a,) for a in ("A", "B", "CASH", "SALARY", "QUIET")], "account string")
    got, held = balances.running_balances(ledger, micro.openings(spark, {"A": 70, "QUIET": 9}), wanted, asked.unionByName(asked), rows_per_block)
    start = {"A": 70, "B": 0, "CASH": 0, "SALARY": 10**15, "QUIET": 9, "C": 0}
    now, before, at = dict(start), {}, {(a, m): start[a] for a, m in moments if a not in ("C", "Z")}
    for us, t, s, d, a in rows:
        before[t] = (s, now[s])
        now[s] -= a
        now[d] += a
        at |= {(x, m): now[x] for x, m in at if m >= us and x in (s, d)}
    assert {x["txn_id"]: (x["src"], x["src_before"]) for x in got.collect()} == {t: b for t, b in before.items() if b[0] != "C"}
    assert sorted((x["account"], x["at_us"], x["balance"]) for x in held.collect()) == sorted((a, m, b) for (a, m), b in at.items())


def _state(bal, flows):
    """Customers' balances and taint, outside accounts' taint, flows."""
    held = {(x["case_id"], x["account"]): (x["tainted"], x["account"][0] == "A" and x["balance"]) for x in bal.collect()}
    return held, {(x["case_id"], x["src"], x["dst"]): x["value"] for x in flows.collect()}


def _no_history():
    raise AssertionError("the stored ledger was asked for")


def test_live_traces_equal_the_whole_ledger(spark, tmp_path, monkeypatch):
    """Three batches in order of time, read without the ledger; then late transfers, one of them a deposit."""
    monkeypatch.setattr(tables, "COMPACT_EVERY", 2)
    rows = micro.random_rows(4, 14, 160)
    rows[20] = ("VICTIM_2", "A3", 9_000, rows[20][3])
    rows[90] = ("VICTIM_3", "A5", 20_000, rows[90][3])
    rows[120] = ("CASH", "A6", 700, rows[120][3])
    ledger = micro.ledger(spark, rows).orderBy("us", "txn_id").collect()
    schema = micro.ledger(spark, rows).schema
    openings = micro.openings(spark, {f"A{i}": 2500 * i for i in range(14)})
    late = [ledger[k] for k in (18, 20, 75)]
    rest = [x for x in ledger if x not in late]
    parts = [rest[:60], rest[60:61], rest[61:110], [*late, *rest[110:]]]
    live = traces.LiveTraces(spark, str(tmp_path), openings)
    so_far = []
    for k, part in enumerate(parts):
        so_far += part
        now = spark.createDataFrame(so_far, schema)
        live.update(k, spark.createDataFrame(part, schema), (lambda now=now: now) if k == 3 else _no_history)
        if k == 1:
            continue
        cases = now.where(F.col("src").startswith("VICTIM")).select(F.col("txn_id").alias("case_id"), F.col("txn_id").alias("victim_txn"))
        assert _state(live.balances(), live.flows()) == _state(*taint.trace(now, openings, cases))
    assert {x["case_id"] for x in live.cases().collect()} == {x["txn_id"] for x in ledger if x["src"].startswith("VICTIM")}
    assert (tmp_path / "taints_merged" / "batch=2").exists()
    # the last batch again: nothing changes
    was = _state(live.balances(), live.flows())
    live.update(3, spark.createDataFrame(parts[3], schema), lambda: spark.createDataFrame(so_far, schema))
    assert _state(live.balances(), live.flows()) == was


def test_live_traces_without_cases(spark, tmp_path):
    live = traces.LiveTraces(spark, str(tmp_path), micro.openings(spark, {"A": 5}))
    led = micro.ledger(spark, [("A", "B", 3, "10:00"), ("B", "CASH", 2, "10:05")])
    assert live.taints() is None
    assert live.update(0, led.limit(0), _no_history).count() == 0
    assert live.update(1, led, _no_history).count() == 0
    assert live.balances().count() == live.flows().count() == 0
