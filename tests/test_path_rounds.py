"""Rounds of fund-flow paths read the ledger once."""

from __future__ import annotations

import pytest

from muletrace.operators import flows
from tests import micro


@pytest.mark.parametrize("max_hops", [None, 2])
def test_rounds_meet_the_transfers_dealt_once(spark, monkeypatch, max_hops):
    plans, cut = [], flows.cut_counting
    monkeypatch.setattr(flows, "cut_counting", lambda df, c: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, c))[1])
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    rows = [("VICTIM_1", "A", 100, "10:00"), ("A", "B", 90, "10:05"), ("A", "C", 10, "10:06"), ("B", "C", 80, "10:07"), ("C", "A", 70, "10:08"), ("C", "CASH", 60, "10:09")]
    paths = flows.fund_flow_paths(micro.ledger(spark, rows), max_gap_minutes=4, max_hops=max_hops)
    got = {(r.path_id, r.truncated) for r in paths.collect()}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    assert len(plans) > 1 and all("InMemoryRelation" in p for p in plans[1:])
    assert got == {("T001", False)}
    wide = flows.fund_flow_paths(micro.ledger(spark, rows), max_gap_minutes=10, max_hops=max_hops)
    want = {("T001>T002>T004>T006", False), ("T001>T003>T006", False)} if max_hops is None else {("T001>T002", True), ("T001>T003", True)}
    assert {(r.path_id, r.truncated) for r in wide.collect()} == want
