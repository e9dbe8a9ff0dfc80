"""Every writer read back; snapshots survive failed loads."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from muletrace.operators import flows, geo, rings
from muletrace.sources import readers, sinks
from tests import micro


def test_outputs_and_single_rows(spark, tmp_path):
    a = spark.range(5).withColumnRenamed("id", "n")
    sinks.write_outputs({"a": a, "b": a.where("n > 2")}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "a")).count() == 5 and spark.read.parquet(str(tmp_path / "out" / "b")).count() == 2
    for n in (1, 2):
        sinks.upsert_single(spark.createDataFrame([(n,)], "n int"), str(tmp_path / "one"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "one")).collect()] == [(2,)]


def test_paths_and_feature_collections(spark, tmp_path):
    led = micro.ledger(spark, micro.CASE_ROWS)
    paths = flows.fund_flow_paths(led)
    sinks.write_paths(paths, str(tmp_path / "paths"))
    back = spark.read.parquet(str(tmp_path / "paths"))
    assert back.count() == paths.count() and dict(back.dtypes)["start_time"] == "timestamp"
    row = back.orderBy(F.desc("hops")).first()
    assert [h.to_account for h in row.chain] == ["S", "M1", "X", "CASH"]
    hits = spark.createDataFrame(
        [(f"H{k}", "Pune", "atm", 100 * k, k % 2 == 0, 0.5, f"A{k}", 18.5 + k / 100, 73.8) for k in range(25)],
        "hit_id string, city string, hit_type string, amount_paise bigint, is_fraud boolean, risk_score double, account string, lat double, lng double",
    )
    docs = geo.feature_collections(geo.geojson_features(hits), per_document=10)
    sinks.write_feature_collections(docs, str(tmp_path / "geo"))
    read = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "geo")).collect()]
    assert len(read) >= 2 and {d["type"] for d in read} == {"FeatureCollection"}
    assert sorted(f["properties"]["hit_id"] for d in read for f in d["features"]) == sorted(f"H{k}" for k in range(25))
    assert geo.geojson_features(hits, max_points=3).count() == 3


def test_paths_cut_by_a_caller_say_so(spark):
    led = micro.ledger(spark, micro.CASE_ROWS)
    whole = flows.fund_flow_paths(led)
    assert flows.path_summary(whole).first()["truncated"] is False and whole.agg(F.max("hops")).first()[0] == 4
    cut = {r.path_id: r.truncated for r in flows.fund_flow_paths(led, max_hops=2).collect()}
    assert cut == {"T001>T002": True, "T001>T003": True}
    assert flows.path_summary(flows.fund_flow_paths(led, max_hops=9)).first()["truncated"] is False
    assert flows.path_summary(flows.fund_flow_paths(led.where("false"))).first()["truncated"] is False


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "snap")
    rows = spark.range(3)
    assert sinks.snapshot_meta(spark, folder) is None
    assert sinks.publish_snapshot({"t": rows, "notes": rows.where("false")}, folder, "file", "demo", may_be_empty=("notes",)) == 1
    with pytest.raises(ValueError, match="empty"):
        sinks.publish_snapshot({"t": rows.where("false")}, folder, "file", "demo")
    assert sinks.read_snapshot(spark, folder, "t").count() == 3
    # tables of a load that never got its pointer are not seen
    spark.range(9).write.parquet(f"{folder}/v=2/t", mode="overwrite")
    assert sinks.read_snapshot(spark, folder, "t").count() == 3
    assert sinks.publish_snapshot({"t": spark.range(4)}, folder, "file", "demo") == 2
    assert sinks.read_snapshot(spark, folder, "t").count() == 4 and sinks.snapshot_meta(spark, folder)["counts"] == {"t": 4}


def test_missing_paths(spark, tmp_path):
    assert not readers.path_exists(spark, str(tmp_path / "nothing"))
    (tmp_path / "some").mkdir()
    assert readers.path_exists(spark, str(tmp_path / "some"))
    assert readers.load_profile(spark, str(tmp_path / "nothing")) is None


def test_alert_order(spark):
    rows = [("R1", "ALT1", 30), ("R2", "ALT2", 10), ("R3", "ALT3", 30), ("R4", "ALT4", 7_200_000_001)]
    df = spark.createDataFrame(rows, "ring_id string, alert_id string, fired_us bigint")
    new = {r.position: r.alert_id for r in rings.alerts_in_order(df).collect()}
    old = {r.position: r.alert_id for r in rings.alerts_in_order(df, newest_first=False).collect()}
    assert [new[k] for k in (1, 2, 3, 4)] == ["ALT4", "ALT3", "ALT1", "ALT2"] and [old[k] for k in (1, 2, 3, 4)] == ["ALT2", "ALT1", "ALT3", "ALT4"]
