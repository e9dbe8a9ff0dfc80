"""The parts that only run on hot keys give the same answers as the plain ones; communities and matching on small graphs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from muletrace.functions import exprs as X
from muletrace.operators import events as ev
from muletrace.operators import geo, graph, identity, timeline
from muletrace.operators.quantiles import grouped_median
from muletrace.schemas import drop_labels
from tests import micro

MIN = 60_000_000


def _events(spark, seed=5, accounts=3, n=300):
    r = random.Random(seed)
    rows = [(f"A{r.randrange(accounts)}", "D" if r.random() < 0.5 else "C", r.randrange(0, 400) * MIN, f"T{i:04d}", r.randint(1, 900)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "account string, dir string, us bigint, txn_id string, amount_paise bigint")


def _two_pointers(rows, account):
    c = sorted(us for a, d, us, *_ in rows if a == account and d == "C")
    out, i = [], 0
    for us in sorted(us for a, d, us, *_ in rows if a == account and d == "D"):
        if i < len(c) and us >= c[i]:
            out.append(us - c[i])
            i += 1
    return sorted(out)


@pytest.mark.parametrize("per_block", [10_000, 7])
def test_hold_burst_balance(spark, per_block):
    rows, df = _events(spark)
    hot = timeline.hot_accounts(df, per_block)
    assert (hot.table is None) == (per_block > 300)
    holds: dict[str, list[int]] = {}
    for r in timeline.hold_pairs(df, hot).collect():
        holds.setdefault(r["account"], []).append(r["hold_us"])
    bursts = {r["account"]: r["burst_10min"] for r in timeline.burst(df, hot).collect()}
    opening = micro.openings(spark, {f"A{i}": 1000 for i in range(3)})
    worst = {r["account"]: (r["closing_paise"], r["worst_paise"]) for r in timeline.worst_balance(df, opening, hot).collect()}
    for a in ("A0", "A1", "A2"):
        assert sorted(holds[a]) == _two_pointers(rows, a)
        times = sorted(us for x, _d, us, *_ in rows if x == a)
        assert bursts[a] == max(sum(t <= u <= t + 10 * MIN for u in times) for t in times)
        bal = low = 1000
        for _a, d, _us, _t, amt in sorted((x for x in rows if x[0] == a), key=lambda x: (x[2], x[3], x[1])):
            bal += amt if d == "C" else -amt
            low = min(low, bal)
        assert worst[a] == (bal, low)


def test_hold_ties(spark):
    m = micro.minutes
    rows = [("A", "C", m("10:00")), ("A", "C", m("10:10")), ("A", "D", m("09:50")), ("A", "D", m("10:10")), ("A", "D", m("10:10"))]
    df = spark.createDataFrame([(a, d, us, f"T{i}") for i, (a, d, us) in enumerate(rows)], "account string, dir string, us bigint, txn_id string")
    assert sorted(r["hold_us"] // MIN for r in timeline.hold_pairs(df).collect()) == [0, 10]
    times = [m("10:00"), m("10:10"), m("10:10"), m("10:21")]
    b = spark.createDataFrame([("A", t) for t in times], "account string, us bigint")
    assert timeline.burst(b).first()["burst_10min"] == 3


@pytest.mark.parametrize("busy_over,max_subset", [(64, 8), (3, 8), (3, 1), (1, 2)])
def test_shared_identifiers(spark, busy_over, max_subset):
    r = random.Random(11)
    accounts = [f"A{i:02d}" for i in range(40)]
    links = {(t, f"{t}{r.randrange(k)}", a) for a in accounts for t, k in (("device", 12), ("phone", 9), ("ip", 3)) for _ in range(r.randint(0, 3))}
    opened = {a: r.randrange(60) * X.MICROS_PER_DAY for a in accounts}
    score = {a: r.randrange(100) if r.random() < 0.8 else None for a in accounts}
    ldf = spark.createDataFrame(sorted(links), "type string, identifier_id string, account string")
    adf = spark.createDataFrame([(a, opened[a], score[a]) for a in accounts], "account string, opened_us bigint, score bigint")
    got = {x["account"]: x for x in identity.shared_profile(ldf, adf, busy_over, max_subset).collect()}
    for a in accounts:
        near = {t: {o for tt, i, o in links if tt == t and (t, i, a) in links and o != a} for t in ("device", "phone", "ip")}
        every = near["device"] | near["phone"] | near["ip"]
        if not every:
            continue
        g = got[a]
        assert (g["device_n"], g["phone_n"], g["ip_n"], g["any_n"]) == (*[len(near[t]) for t in ("device", "phone", "ip")], len(every))
        assert g["new_n"] == sum(abs(opened[o] - opened[a]) <= 14 * X.MICROS_PER_DAY for o in every)
        known = [score[o] for o in every if score[o] is not None]
        assert (g["score_n"], g["score_sum"]) == (len(known), sum(known))


def test_median_and_numbering(spark):
    r = random.Random(3)
    vals = [(f"k{r.randrange(4)}", r.randrange(1000)) for _ in range(301)]
    df = spark.createDataFrame(vals, "k string, v bigint")
    got = {x["k"]: x["m"] for x in grouped_median(df, ["k"], "v", F.floor(F.col("v") / 50), "m").collect()}
    import statistics

    assert got == {k: statistics.median([v for kk, v in vals if kk == k]) for k in got}
    t = spark.createDataFrame([(i, r.randrange(10**11)) for i in range(200)], "id bigint, us bigint")
    seq = [x["id"] for x in timeline.numbered_by_time(t, ["us", "id"], bucket_us=10**8).orderBy("seq").collect()]
    assert seq == [x["id"] for x in t.orderBy("us", "id").collect()]


def test_spread_is_exact(spark):
    r = random.Random(9)
    pts = [(f"R{i % 2}", 8 + 25 * r.random(), 68 + 25 * r.random()) for i in range(400)]
    df = spark.createDataFrame(pts, "ring_id string, lat double, lng double")
    got = {x["ring_id"]: x["spread_km"] for x in geo.point_spread(df, salts=4).collect()}
    a = df.toDF("ring_id", "lat1", "lng1")
    b = df.toDF("ring_id", "lat2", "lng2")
    km = X.haversine_km(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    want = {x["ring_id"]: x["s"] for x in a.join(b, "ring_id").groupBy("ring_id").agg(F.round(F.max(km), 2).alias("s")).collect()}
    assert got == want


def test_communities(spark):
    """Two dense groups joined by one weak edge, and one group tied only by an identifier."""
    edges = [(f"{g}{i}", f"{g}{j}", 3.0) for g in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 0.1)]
    money = spark.createDataFrame(edges, "a string, b string, weight double")
    stars = spark.createDataFrame([("device|D", f"c{i}", 4) for i in range(4)], "star string, account string, size bigint")
    found: dict[str, set[str]] = {}
    for x in graph.communities(money, stars).collect():
        found.setdefault(x["community"], set()).add(x["account"])
    assert sorted(map(sorted, found.values())) == [[f"{g}{i}" for i in range(n)] for g, n in (("a", 5), ("b", 5), ("c", 4))]


def test_no_seeds_no_rings(spark):
    accounts = spark.createDataFrame([(f"A{i}",) for i in range(5)], "account string")
    scores = accounts.withColumn("v2_bp", F.lit(100).cast("bigint"))
    links = spark.createDataFrame([], "identifier_id string, type string, account string")
    led = micro.ledger(spark, [("A0", "A1", 100, "10:00")])
    assert graph.discover_rings(accounts, led, links, scores).isEmpty()


def test_retries_lower_the_threshold(spark):
    """Risks of 0.45 are too low for the first threshold's members and enough for the second's."""
    names = [f"A{k}" for k in range(4)]
    accounts = spark.createDataFrame([(n,) for n in names], "account string")
    links = spark.createDataFrame([("D", "device", n) for n in names], "identifier_id string, type string, account string")
    led = micro.ledger(spark, [("A0", "A1", 100, "10:00")])
    scores = spark.createDataFrame([(n, bp) for n, bp in zip(names, (5200, 4500, 4500, 4500))], "account string, v2_bp bigint")
    assert graph.discover_rings(accounts, led, links, scores, min_mean_risk=0.45).isEmpty()
    found = graph.discover_with_retries(accounts, led, links, scores, min_mean_risk=0.45)
    assert {r["account"] for r in found.collect()} == set(names)


def test_labels_dropped(spark):
    df = spark.createDataFrame([(1, True)], "a int, is_fraud boolean")
    assert drop_labels(df).columns == ["a"]
    assert "is_fraud" not in ev.account_events(micro.ledger(spark, [("A", "B", 1, "10:00")]).withColumn("is_fraud", F.lit(True))).columns
