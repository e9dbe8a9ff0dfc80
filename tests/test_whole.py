"""Queries on the full tables: no channel, deposit, ring or account is left out."""

from __future__ import annotations

import pytest

from muletrace.operators import flows, serve
from muletrace.plans import catalog, sqlviews, whole_queries
from tests import micro
from tests.compare import compare, duck
from tests.cut_cases import CASES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", ["hop_distance", "freeze_reachability", "complete_ring", "alerts_with_ring", "merged_delivery", "identifiers_overlapping"])
def test_whole_queries_equal_sql(spark, con, name):
    status, info = compare(spark, con, name, catalog.all_queries()[name], catalog.all_check_sql()[name], SF)
    assert status == "ok", info


@pytest.mark.parametrize("name", sorted(CASES))
def test_partial_tables_equal_sql(spark, con, name):
    fn, sql = CASES[name]
    status, info = compare(spark, con, name, fn, sqlviews.complete(sql), SF)
    assert status == "ok", info


def test_earlier_names_stay():
    q = catalog.all_queries()
    for name in set(CASES) - {"merged_delivery"}:
        assert q[f"{name}_whole"] is q[name]
    assert q["merged_delivery_rows"] is q["merged_delivery"]


def test_nothing_is_left_out(spark, con):
    """Every alert has its ring, every deposit is on the ring's graph, every row is delivered."""
    sql = catalog.all_check_sql()
    q = catalog.all_queries()
    assert q["alerts_with_ring"](spark, SF).where("members = 0 or risk is null").count() == 0
    n = con.sql(f"SELECT count(*) FROM ({sql["public_ledger"]}) WHERE src LIKE 'VICTIM%'").fetchall()[0][0]
    assert q["complete_ring"](spark, SF).where("kind = 'victim' and src not like 'VICTIM:%'").count() == n
    by_table = {r["table"]: r["n"] for r in CASES["merged_delivery"][0](spark, SF).collect()}
    rows = q["merged_delivery"](spark, SF).groupBy("table").count().collect()
    assert {r["table"]: r["count"] for r in rows} == by_table


def test_unknown_accounts(spark):
    """The awkward case of the registered query: an account that only the ledger knows."""
    led = micro.ledger(spark, [("VICTIM_1", "A", 5, "09:00"), ("A", "B", 4, "09:01"), ("B", "CASH", 3, "09:02")])
    known = spark.createDataFrame([("A",)], "account string")
    assert [r["account"] for r in serve.unknown_accounts(led, known).collect()] == ["B"]


def test_summary_follows_paths_to_their_end(spark, monkeypatch):
    led = micro.ledger(spark, [("VICTIM_1", "A", 90, "09:00"), ("A", "B", 80, "09:10"), ("B", "C", 70, "09:20"), ("C", "D", 60, "09:50"), ("D", "CASH", 50, "10:00")])
    cut = flows.path_summary(flows.fund_flow_paths(led, max_hops=3)).first()
    assert cut["truncated"] and cut["fastest_path_minutes"] == 20
    monkeypatch.setattr(whole_queries.Tables, "ledger", led)
    whole = whole_queries.fund_flow_summary(spark, "").first()
    assert (whole["total_paths"], whole["avg_hop_latency_min"], whole["fastest_path_minutes"], whole["truncated"]) == (1, 15, 60, False)


def test_users_of_an_identifier_are_not_gathered(spark):
    got = catalog.all_queries()["identifiers_overlapping"](spark, SF)
    assert "collect_" not in got._jdf.queryExecution().optimizedPlan().toString()
