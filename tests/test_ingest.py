"""Counts of what a stream accepts and rejects, per batch and over a restart."""

from __future__ import annotations

import json
import os
import time
from collections import Counter

from muletrace.schemas import ledger_rules, split_valid
from muletrace.sources import readers
from muletrace.streaming import ingest, live


def _line(k, **change):
    return json.dumps({"type": "txn", "txn": {"id": f"T{k}", "from": "A", "to": "B", "amount_paise": 5, "ts": f"2024-01-01T00:00:{k:02d}Z", "channel": "UPI"} | change})


def test_counts_of_every_batch_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    files = [
        [_line(0), _line(1, amount_paise=-1), "nonsense", json.dumps({"type": "clock", "ts": "x"})],
        [_line(2, ts="yesterday", channel="POST"), _line(3), _line(4)],
        [json.dumps({"type": "pigeon"}), _line(5, channel=None), _line(6)],
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    counts = ingest.IngestCounts(spark, str(tmp_path / "counts"))
    spark.streams.addListener(counts)
    try:
        for part in (files[:2], files[2:]):  # the query starts anew for the second part
            for lines in part:
                k = files.index(lines)
                (folder / f"{k}.json").write_text("\n".join(lines) + "\n")
                os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
            q = live.run_live(readers.stream_lines(spark, str(folder), 1), str(tmp_path / "out"), str(tmp_path / "ck"))
            assert q.awaitTermination(300) and q.exception() is None
        until = time.time() + 60
        while time.time() < until and len(list((tmp_path / "counts").glob("query=*/batch=*/_SUCCESS"))) < 3:
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(counts)
    rows = ingest.ingest_counts(spark, str(tmp_path / "counts")).collect()
    assert len({r["query"] for r in rows}) == 1
    for k, lines in enumerate(files):
        batch = readers.fan_out(spark.createDataFrame([(x,) for x in lines], "value string"))
        good, bad = split_valid(batch["txn"], ledger_rules(with_text_ts=True))
        want = Counter({"lines": len(lines), "accepted": good.count(), "rejected": bad.count(), ingest.UNKNOWN: batch["unknown"].count()})
        want += Counter(f"broken {r}" for b in bad.collect() for r in b["broken_rules"])
        assert {r["what"]: r["n"] for r in rows if r["batch"] == k} == dict(want)
