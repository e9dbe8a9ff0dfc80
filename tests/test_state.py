"""Keyed state: queues, counts by number, reads per batch, accounts that leave."""

from __future__ import annotations

import json
import os
import random
from statistics import median

import pandas as pd
import pytest

from muletrace.sources import readers
from muletrace.streaming import live
from muletrace.streaming.state import Counts, Queue, branches


class Map:
    """Map state in memory that counts what is asked of it."""

    def __init__(self):
        self.data, self.asked = {}, 0

    def getValue(self, key):
        self.asked += 1
        return self.data.get(key)

    def containsKey(self, key):
        self.asked += 1
        return key in self.data

    def updateValue(self, key, value):
        self.asked += 1
        self.data[key] = value

    def removeKey(self, key):
        self.asked += 1
        del self.data[key]

    def clear(self):
        self.data.clear()

    def iterator(self):
        raise AssertionError("reads all of the state")


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, set()

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, Map())

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


@pytest.mark.parametrize("top", [3, 100, 10**7, 10**12, 2**62 - 1])
def test_counts_find_any_place(top):
    r = random.Random(top)
    state, seen = Map(), [0, top, top]
    for x in [r.randint(0, top) for _ in range(300)]:
        seen.append(x)
    counts = Counts(state)
    for x in seen:
        counts.add(x)
    counts.flush()
    counts = Counts(state)  # as a later batch finds it
    assert [counts.kth(k + 1) for k in range(len(seen))] == sorted(seen)
    assert counts.median(len(seen)) == median(seen) or top > 2**53
    assert Counts(Map()).median(0) is None
    assert len(list(branches(top))) <= 15


def test_queue():
    q = Queue(Map(), 0, 0)
    for k in range(5):
        q.push(k)
    assert [q.pop(), q.pop(), q.first(), len(q)] == [0, 1, 2, 3] and len(q.state.data) == 3


def _rows(n, seed, start=0):
    r = random.Random(seed)
    us = start
    out = []
    for k in range(n):
        us += r.choice([0, 1_000_000, 30_000_000, 700_000_000])
        out.append((f"c{r.randint(0, 9)}", r.choice("CCD"), 100, us, "UPI", f"t{start}-{k:05d}"))
    return pd.DataFrame(out, columns=["counterparty", "dir", "amount_paise", "us", "channel", "txn_id"])


def _fed(handle, batches, idle=None):
    p = live.AccountFeatures(idle)
    p.init(handle)
    return p, [next(iter(p.handleInputRows(("A",), iter([b]), None))).iloc[0] for b in batches]


def test_a_batch_reads_state_by_its_rows():
    """Twenty rows cost the same after 100 and after 5,000 transfers with thousands of open credits."""
    handle = Handle()
    p, _ = _fed(handle, [_rows(100, 1)])

    def cost(seed, start):
        before = sum(m.asked for m in handle.maps.values())
        next(iter(p.handleInputRows(("A",), iter([_rows(20, seed, start)]), None)))
        return sum(m.asked for m in handle.maps.values()) - before

    early = cost(2, 10**12)
    for k in range(5):
        next(iter(p.handleInputRows(("A",), iter([_rows(1000, 10 + k, 2 * 10**12 + k * 10**12)]), None)))
    assert p.totals.get()[p.COLUMNS.index("matched")] > 1000 and len(handle.maps["credits"].data) > 1000
    assert cost(2, 10**14) <= 2 * early + 40 and early <= 20 * 60


def test_batches_add_up():
    """However the rows are cut, features are those of all rows at once, by plain counting."""
    rows = _rows(400, 3)
    _, whole = _fed(Handle(), [rows])
    _, parts = _fed(Handle(), [rows.iloc[k : k + 37] for k in range(0, 400, 37)])
    last = parts[-1]
    assert last.drop("late").equals(whole[0].drop("late")) or [last[c] for c in last.index] == [whole[0][c] for c in last.index]
    waiting, holds, order = [], [], rows.sort_values(["us", "dir", "txn_id"])
    for us, d in order[["us", "dir"]].itertuples(index=False):
        if d == "C":
            waiting.append(us)
        elif waiting:
            holds.append(us - waiting.pop(0))
    assert last["matched"] == len(holds) and last["median_hold_us"] == median(holds)
    times = order["us"].tolist()
    assert last["burst_10min"] == max(sum(t - live.BURST_US <= x <= t for x in times[: k + 1]) for k, t in enumerate(times))


def test_timers_follow_the_last_transfer():
    handle = Handle()
    p, _ = _fed(handle, [_rows(10, 4), _rows(10, 5, 10**12)], idle=10**9)
    assert handle.timers == {p.totals.get()[p.COLUMNS.index("last_us")] // 1000 + 1}
    assert list(p.handleExpiredTimer(("A",), None, None)) == []
    assert not p.totals.exists() and not any(m.data for m in handle.maps.values())


def test_idle_accounts_leave(spark, tmp_path):
    """A is last seen on day 1. Once the stream is past day 1 by the idle time, A starts anew; B, seen each day, does not."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    folder = tmp_path / "in"
    folder.mkdir()
    days = [[("A", "B")], [("B", "C")], [("B", "C")], [("B", "C")], [("A", "B")]]
    for k, pairs in enumerate(days):
        lines = [{"type": "txn", "txn": {"id": f"T{k}{n}", "from": a, "to": b, "amount_paise": 5, "ts": f"2024-01-{1 + 3 * k:02d}T00:00:00Z", "channel": "UPI"}} for n, (a, b) in enumerate(pairs)]
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, lines)) + "\n")
        os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    for idle, want in (("4 days", 1), (None, 2)):
        name = idle or "kept"
        q = live.run_live(readers.stream_lines(spark, str(folder), 1), str(tmp_path / name), str(tmp_path / f"ck {name}"), idle=idle)
        assert q.awaitTermination(300) and q.exception() is None
        got = {r["account"]: r["txn_out"] + r["txn_in"] for r in live.latest_features(spark, str(tmp_path / name)).collect()}
        assert got["A"] == want and got["B"] == 5
