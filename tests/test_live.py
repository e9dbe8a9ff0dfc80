"""Stream against batch, rejects, registry, sinks, profile reader."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from muletrace.operators import events as ev
from muletrace.operators import features, graph, scoring, timeline
from muletrace.schemas import ledger_rules
from muletrace.sources import derived, readers, sinks
from muletrace.streaming import live, tables
from tests import micro

SF = "/root/testdata/sf0.001"


def _lines(df):
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    txn = F.struct(F.col("txn_id").alias("id"), F.col("src").alias("from"), F.col("dst").alias("to"), "amount_paise", ts.alias("ts"), "channel")
    gt = F.struct(F.col("is_fraud"))
    return df.orderBy("us").select(F.to_json(F.struct(F.lit("txn").alias("type"), txn.alias("txn"), gt.alias("gt"))).alias("v"))


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    led = derived.ledger(spark, SF)
    rows = [r["v"] for r in _lines(led).collect()]
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(0, len(rows), 300):
        (folder / f"{i:06d}.json").write_text("\n".join(rows[i : i + 300]) + "\n")
    broken = json.loads(rows[-1])
    for i, change in enumerate([{"amount_paise": -5}, {"ts": "yesterday"}, {"channel": "POST"}]):
        doc = {**broken, "txn": {**broken["txn"], **change, "id": f"BAD{i}"}}
        (folder / f"99999{i}.json").write_text(json.dumps(doc) + "\n")
    late = [{**json.loads(r), "txn": {**json.loads(r)["txn"], "id": f"LATE{i}"}} for i, r in enumerate(rows[:10])]
    (folder / "9999999.json").write_text("\n".join(map(json.dumps, late)) + "\n")

    for i, f in enumerate(sorted(folder.iterdir())):  # files are taken in time order
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    q = live.run_live(readers.stream_lines(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(600)
    assert q.exception() is None
    got = {r["account"]: r for r in live.latest_features(spark, str(tmp_path / "out")).collect()}

    seconds = led.withColumn("us", F.floor(F.col("us") / 1_000_000) * 1_000_000)
    e = ev.account_events(seconds)
    hot = timeline.HotAccounts(None)
    # late rows count in totals, not in bursts and hold times
    again = seconds.orderBy("us").limit(10).withColumn("txn_id", F.concat(F.lit("L"), "txn_id"))
    everything = ev.account_events(seconds.unionByName(again))
    want = ev.activity(everything).join(timeline.burst(e, hot), "account").join(features.median_hold(e, hot), "account", "left").collect()
    assert len(want) == len(got)
    for r in want:
        g = got[r["account"]]
        for c in ("amount_in", "amount_out", "txn_in", "txn_out", "atm_out", "in_degree", "out_degree", "counterparties", "first_us", "last_us", "burst_10min"):
            assert g[c] == r[c], (r["account"], c)
        assert g["median_hold_us"] == r["hold_us"]
    assert sum(g["late"] for g in got.values()) > 0

    q = live.run_rejects(readers.stream_lines(spark, str(folder), 100), str(tmp_path / "rej"), str(tmp_path / "ck2"))
    q.awaitTermination(300)
    rejects = {r["txn_id"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "rej")).collect()}
    assert rejects == {"BAD0": "amount", "BAD1": "ts", "BAD2": "channel"}


def test_labels_do_not_reach_scoring(spark):
    line = json.dumps({"type": "txn", "txn": {"id": "T", "from": "A", "to": "B", "amount_paise": 1, "ts": "2024-01-01T00:00:00Z", "channel": "UPI"}, "gt": {"is_fraud": True}})
    df = spark.createDataFrame([(line,)], "value string")
    out = readers.fan_out(df)
    assert "is_fraud" not in out["txn"].columns and out["labels"].first()["is_fraud"]


def test_registry(spark, tmp_path):
    reg = live.RingRegistry(spark, str(tmp_path / "reg"))

    def sets(**kw):
        return spark.createDataFrame([(r, a) for r, m in kw.items() for a in m], "ring_id string, account string")

    first = reg.update(0, sets(R1="abcd"), 100)
    assert [r["ring_id"] for r in first.collect()] == ["R1"]
    again = reg.update(1, sets(X="cdef", Y="pqr"), 200)
    assert [r["ring_id"] for r in again.collect()] == ["Y"]
    reg.update(1, sets(X="cdef", Y="pqr"), 200)  # a repeated batch changes nothing
    m = reg.members().collect()
    assert {r["account"] for r in m if r["ring_id"] == "R1"} == set("abcdef")
    assert {(r["ring_id"], r["version"], r["first_seen_us"]) for r in m} == {("R1", 2, 100), ("Y", 1, 200)}


def test_registry_is_a_log_of_changes(spark, tmp_path, monkeypatch):
    """Versions rise when an edge or a volume changes; only changed rings are written; reads are the same after compaction."""
    monkeypatch.setattr(tables, "COMPACT_EVERY", 3)
    reg, plain = live.RingRegistry(spark, str(tmp_path / "log")), {}
    sets = spark.createDataFrame([(r, a) for r, m in (("R1", "abcd"), ("R2", "pqr"), ("R3", "xyz")) for a in m], "ring_id string, account string")
    edges = {"R1": 10, "R2": 10, "R3": 10}
    for batch, changes in enumerate(({}, {"R1": 20}, {}, {"R2": 5, "R3": 7}, {"R1": 30})):
        edges |= changes
        known = spark.createDataFrame(list(edges.items()), "ring_id string, volume long")
        reg.update(batch, sets, 100 + batch, lambda m, v=known: live.payload_digest({"members": m.select("ring_id", "account"), "volume": v}))
        for r in edges if not batch else changes:
            plain[r] = plain.get(r, 0) + 1
        got = {r["ring_id"]: (r["version"], r["first_seen_us"]) for r in reg.rings().collect()}
        assert got == {r: (v, 100) for r, v in plain.items()}
        written = spark.read.schema("ring_id string").parquet(str(tmp_path / f"log/rings/batch={batch}"))
        assert {r["ring_id"] for r in written.collect()} == set(edges if not batch else changes)
        assert {(r["ring_id"], r["account"]) for r in reg.members().collect()} == {(r["ring_id"], r["account"]) for r in sets.collect()}
    assert (tmp_path / "log/rings_merged/batch=3").exists()
    assert spark.read.parquet(str(tmp_path / "log/members")).where("batch > 0").count() == 0
    was = {r["ring_id"]: r["version"] for r in reg.rings(before=1).collect()}
    assert was == {"R1": 1, "R2": 1, "R3": 1}


def test_payload_is_members_edges_roles_and_volume(spark):
    led = micro.ledger(spark, [("VICTIM_1", "A", 90, "09:00"), ("A", "B", 80, "09:05"), ("B", "C", 70, "09:10")])
    more = led.unionByName(micro.ledger(spark, [("A", "B", 1, "11:00")]).withColumn("txn_id", F.lit("new")))
    outside = led.unionByName(micro.ledger(spark, [("X", "Y", 5, "11:00")]).withColumn("txn_id", F.lit("new")))
    accounts = spark.createDataFrame([(n, 0, 500, 18.5, 73.8) for n in "ABCXY"], "account string, opened_us bigint, opening_balance_paise bigint, home_lat double, home_lng double")
    links = spark.createDataFrame([("D", "device", n) for n in "AB"], "identifier_id string, type string, account string")
    members = spark.createDataFrame([("R", n) for n in "ABC"], "ring_id string, account string")
    digest = [live.ring_payload(members, x, accounts, links).first()["digest"] for x in (led, outside, more)]
    assert digest[0] == digest[1] != digest[2]


def test_score_suppression(spark):
    new = spark.createDataFrame([("a", 5100, 2), ("b", 6000, 9), ("c", 3000, 9), ("d", 100, 1)], "account string, v2_bp bigint, txns bigint")
    sent = spark.createDataFrame([("a", 5000, "MEDIUM"), ("b", 5990, "MEDIUM"), ("c", 2700, "LOW")], "account string, v2_bp bigint, band string")
    out = {r["account"]: r["provisional"] for r in live.worth_sending(new, sent).collect()}
    assert out == {"b": False, "c": False, "d": True}


def test_profile_and_sinks(spark, tmp_path):
    p = tmp_path / "profile"
    p.mkdir()
    (p / "accounts.json").write_text(json.dumps([{"_id": "A", "opened_at": "2024-01-01T00:00:00Z", "opening_balance": 5}, {"id": "B"}]))
    (p / "transactions.json").write_text(json.dumps([{"_id": "T1", "from": "A", "to": "B", "amount_paise": 7, "ts": "2024-01-02T00:00:00Z", "channel": "UPI"}]))
    t = readers.checked_profile(spark, str(p))
    assert {r["account"] for r in t["accounts"].collect()} == {"A", "B"} and t["links"].count() == 0
    assert readers.load_profile(spark, str(tmp_path / "none")) is None
    store = str(tmp_path / "store")
    for _ in range(2):
        sinks.append_new(t["ledger"], store, "txn_id", ledger_rules(), "ledger")
    assert spark.read.parquet(store).count() == 1
    with pytest.raises(ValueError, match="amount"):
        sinks.append_new(t["ledger"].withColumn("amount_paise", F.lit(-1).cast("bigint")), store, "txn_id", ledger_rules(), "ledger")
    snap = str(tmp_path / "snap")
    assert sinks.publish_snapshot({"ledger": t["ledger"]}, snap, "file", "demo") == 1
    with pytest.raises(ValueError):
        sinks.publish_snapshot({"ledger": t["ledger"].where("false")}, snap, "file", "demo")
    assert sinks.read_snapshot(spark, snap, "ledger").count() == 1
    assert sinks.publish_snapshot({"ledger": t["ledger"]}, snap, "file", "demo") == 2
    (p / "transactions.json").write_text("[{broken")
    with pytest.raises(Exception):  # noqa: B017  (the reader names the file)
        readers.checked_profile(spark, str(p))


def _rule_scores(accounts, ledger, links):
    m = scoring.rule_score_v2(features.feature_matrix(accounts, ledger, links, scoring.rule_score_v1))
    # the rule score rarely calls a whole ring risky; known members get what a trained score would
    return m.select("account", (F.col("txn_in") + F.col("txn_out")).alias("txns")).withColumn(
        "v2_bp", F.when(F.col("account").startswith("M") & (F.col("txns") >= 2), 8000).otherwise(500).cast("bigint")
    )


def test_monitor_finds_rings_over_a_restart(spark, tmp_path):
    """Two rings in a quiet ledger; the second appears after a restart. Registry equals discovery over everything."""
    rows, names = [], [f"M{g}{k}" for g in "ab" for k in range(4)] + [f"Q{k}" for k in range(6)]
    for g, hour in (("a", 9), ("b", 14)):
        rows += [("VICTIM_1", f"M{g}0", 90_000, f"{hour:02d}:00")]
        rows += [(f"M{g}{k}", f"M{g}{k + 1}", 80_000 - 9_000 * k, f"{hour:02d}:{5 + 4 * k:02d}") for k in range(3)]
        rows += [(f"M{g}3", f"M{g}0", 2_000, f"{hour:02d}:40"), (f"M{g}3", "CASH", 30_000, f"{hour:02d}:50")]
        rows += [(f"Q{k}", f"Q{(k + 1) % 6}", 700, f"{hour:02d}:{k * 9:02d}") for k in range(6)]
    led = micro.ledger(spark, rows)
    accounts = spark.createDataFrame([(n, 0, 50_000, 18.5, 73.8) for n in names], "account string, opened_us bigint, opening_balance_paise bigint, home_lat double, home_lng double")
    links = spark.createDataFrame([(f"D{g}", "device", f"M{g}{k}") for g in "ab" for k in range(4)], "identifier_id string, type string, account string")
    out = [r["v"] for r in _lines(led.withColumn("is_fraud", F.lit(False))).collect()]
    folder = tmp_path / "in"
    folder.mkdir()
    monitor = live.LiveMonitor(spark, str(tmp_path / "state"), accounts, links, _rule_scores)

    def feed(part, lines):
        (folder / f"{part}.json").write_text("\n".join(lines) + "\n")
        q = live.run_monitor(readers.stream_lines(spark, str(folder)), monitor, str(tmp_path / "ck"))
        q.awaitTermination(600)
        assert q.exception() is None

    feed(0, out[:12])
    first = {r["ring_id"] for r in monitor.registry.members().collect()}
    monitor = live.LiveMonitor(spark, str(tmp_path / "state"), accounts, links, _rule_scores)
    feed(1, out[10:])  # two transfers come again
    got = {(r["ring_id"], r["account"]) for r in monitor.registry.members().collect()}
    assert first == {"RING-Ma0"} and {r for r, _ in got} == {"RING-Ma0", "RING-Mb0"}
    stored = monitor.tables.until("ledger", 9)
    assert stored.count() == len(rows) == stored.select("txn_id").distinct().count()
    scores = _rule_scores(accounts, led, links)
    whole = graph.discover_rings(accounts, led, links, scores)
    assert got == {(r["ring_id"], r["account"]) for r in whole.collect()}
    alerts = {r["ring_id"]: r for r in monitor.tables.until("alerts", 9).collect()}
    assert set(alerts) == {"RING-Ma0", "RING-Mb0"} and alerts["RING-Mb0"]["reason"] == "4 linked accounts forwarding within minutes"
    assert {r["victim_amount"] for r in monitor.tables.latest("traces", 9).collect()} == {90_000}
    # a batch that runs again leaves everything as it is
    again = spark.createDataFrame(stored.where("batch = 1").drop("batch").collect(), stored.drop("batch").schema)
    monitor(again, 1)
    assert got == {(r["ring_id"], r["account"]) for r in monitor.registry.members().collect()}
    assert monitor.tables.until("ledger", 9).count() == len(rows)


def _plain_scores(accounts, ledger, links):
    m = scoring.rule_score_v2(features.feature_matrix(accounts, ledger, links, scoring.rule_score_v1))
    return m.select("account", (F.col("txn_in") + F.col("txn_out")).alias("txns"), "v2_bp")


@pytest.mark.parametrize("cut", [3, 5])
def test_monitor_scores_equal_the_whole_ledger(spark, tmp_path, cut):
    """Six new accounts on one device and two on one phone; the transfers of a risky one come batches after the others'."""
    rows = [("Q", "A", 900, "08:00"), ("A", "Q", 100, "08:30"), ("Q", "E", 50, "08:45"), ("A", "E", 60, "08:50")]
    rows += [("VICTIM_1", "B", 90_000, "09:00"), ("B", "G", 45_000, "09:02"), ("B", "CASH", 44_000, "09:04"), ("VICTIM_2", "G", 30_000, "09:05"), ("G", "CASH", 70_000, "09:07")]
    led = micro.ledger(spark, rows)
    names = ["A", "B", "C", "D", "E", "F", "G", "Q"]
    accounts = spark.createDataFrame([(n, 1_704_000_000_000_000, 50_000, 18.5, 73.8) for n in names], "account string, opened_us bigint, opening_balance_paise bigint, home_lat double, home_lng double")
    links = spark.createDataFrame([("D1", "device", n) for n in "ABCDEF"] + [("P1", "phone", n) for n in "EG"], "identifier_id string, type string, account string")
    monitor = live.LiveMonitor(spark, str(tmp_path / "state"), accounts, links, _plain_scores)
    ordered = led.orderBy("us", "txn_id").collect()
    for k, part in enumerate((ordered[:cut], ordered[cut:])):
        monitor(spark.createDataFrame(part, led.schema), k)
    got = {r["account"]: (r["v2_bp"], r["txns"]) for r in monitor.tables.latest("scores", 9).collect()}
    want = {r["account"]: (r["v2_bp"], r["txns"]) for r in _plain_scores(accounts, led, links).collect()}
    assert got == want
