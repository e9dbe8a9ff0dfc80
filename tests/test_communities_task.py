"""Community rounds inside one task, against plain loops over all pairs and accounts, and against the rounds as joins."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest

from muletrace.operators import communities as C
from muletrace.operators.communities_task import UNIT, Rounds


def _digest(*names):
    return md5("|".join(map(str, names)).encode()).hexdigest()


def _first(rows, left):
    """The start of the rows, by (class down, digest), in which each still gains."""
    out = []
    for gain, digest, row in sorted(rows, key=lambda r: (-len(str(r[0])) * 100 - int(str(r[0])[:2]), r[1])):
        if left(gain, row, out) <= 0:
            break
        out.append(row)
    return out


def _plain(names, money, stars):
    """(labels, rounds) by looking at everything in every round."""
    deg = Counter(dict.fromkeys(names, 0))
    for a, b, w in money:
        deg[a] += w
        deg[b] += w
    size = Counter(s for s, _ in stars)
    for s, a in stars:
        deg[a] += (size[s] - 1) * UNIT
    total, c, told, round_ = sum(deg.values()), {a: a for a in names}, [], 0
    while True:
        k, on, w = Counter(), Counter(), Counter()
        for a in names:
            k[c[a]] += deg[a]
        for s, a in stars:
            on[s, c[a]] += 1
        by_star = defaultdict(dict)
        for (s, x), n in on.items():
            by_star[s][x] = n
        top = {s: max((n, x) for x, n in by_star[s].items())[1] for s in by_star}
        near = set()
        for a, b, v in money:
            if c[a] != c[b]:
                w[min(c[a], c[b]), max(c[a], c[b])] += v
        near |= set(w)
        near |= {(min(x, top[s]), max(x, top[s])) for s, x in on if x != top[s]}
        both = lambda x, y: sum(UNIT * n[x] * n[y] for n in by_star.values() if x in n and y in n)
        gains = {p: g for p in near if (g := total * (w[p] + both(*p)) - k[p[0]] * k[p[1]]) > 0}
        pick = {}
        for (x, y), g in gains.items():
            for me, to in ((x, y), (y, x)):
                pick[me] = max(pick.get(me, (0, "", "")), (g, _digest(x, y), to))
        mutual = {x: pick[p[2]][2] == x for x, p in pick.items()}
        wanted = {p[2] for x, p in pick.items() if not mutual[x]}
        joins = {x: (k[x], x) < (k[p[2]], p[2]) if mutual[x] else x not in wanted or _digest(x, round_)[0] < "8" for x, p in pick.items()}
        ready = defaultdict(list)
        for x, (g, _, to) in pick.items():
            if joins[x] and not joins[to]:
                ready[to].append((g, _digest(x, to), x))
        taken = {}
        for to, rows in ready.items():
            left = lambda g, x, ahead: g + total * sum(both(x, y) for y in ahead) - k[x] * sum(k[y] for y in ahead)
            taken |= dict.fromkeys(_first(rows, left), to)
        round_ += 1
        if taken:
            told.append(("merge", len(taken)))
            c = {a: taken.get(x, x) for a, x in c.items()}
            continue
        weight = defaultdict(Counter)
        for a, b, v in money:
            weight[a][c[b]] += v
            weight[b][c[a]] += v
        asks = defaultdict(set)
        for a in names:
            asks[a] |= set(weight[a])
        for s, a in stars:
            asks[a].add(top[s])
        best = {}
        for a in names:
            count = lambda x: weight[a][x] + UNIT * sum(by_star[s].get(x, 0) - (x == c[a]) for s, b in stars if b == a)  # noqa: B023, E731
            for x in asks[a] - {c[a]}:
                g = total * (count(x) - count(c[a])) - deg[a] * (k[x] - k[c[a]] + deg[a])
                if g > 0:
                    best[a] = max(best.get(a, (0, "", "")), (g, _digest(a, x), x))
        pair = defaultdict(int)
        for a, (g, _, x) in best.items():
            pair[c[a], x] = max(pair[c[a], x], g)
        most = {}
        for p, g in pair.items():
            for x in p:
                most[x] = max(most.get(x, (0, "", "")), (g, _digest(*p), p))
        moved = {}
        for p in pair:
            if most[p[0]][2] == p == most[p[1]][2]:
                rows = [(g, d, a) for a, (g, d, x) in best.items() if (c[a], x) == p]
                left = lambda g, a, ahead: g - 2 * deg[a] * sum(deg[b] for b in ahead)
                moved |= dict.fromkeys(_first(rows, left), p[1])
        if not moved:
            return c, told
        told.append(("move", len(moved)))
        c |= moved


def _made(seed):
    r = random.Random(seed)
    names = sorted({f"{r.choice('abé')}{r.randrange(999)}" for _ in range(r.choice([8, 30, 80]))})
    weights = [[UNIT], [UNIT, 2 * UNIT, 3 * UNIT], [r.randrange(1, 3 * UNIT) for _ in range(50)]][seed % 3]
    money = [(r.choice(names), r.choice(names), r.choice(weights)) for _ in range(r.randrange(3 * len(names)))]
    money = [e for e in money if e[0] != e[1] or seed % 4 == 0]
    stars = [(s, a) for s in range(r.randrange(len(names) // 2)) for a in r.sample(names, r.randint(1, r.choice([3, 7, len(names)])))]
    used = sorted({x for a, b, _ in money for x in (a, b)} | {a for _, a in stars})
    return used, money, stars


def _rounds(names, money, stars):
    no = {a: i for i, a in enumerate(names)}
    column = lambda values: np.array(list(values), np.int64)
    edges = column(no[a] for a, _, _ in money), column(no[b] for _, b, _ in money), column(w for _, _, w in money)
    size, k = Counter(s for s, _ in stars), np.zeros(len(names), np.int64)
    np.add.at(k, edges[0], edges[2])
    np.add.at(k, edges[1], edges[2])
    for s, a in stars:
        k[no[a]] += (size[s] - 1) * UNIT
    r = Rounds([x.encode() for x in names], edges, (column(s for s, _ in stars), column(no[a] for _, a in stars)), k, int(k.sum()))
    told = r.run()
    return {a: names[c] for a, c in zip(names, r.c.tolist(), strict=True)}, told


@pytest.mark.parametrize("part", range(8))
def test_rounds_as_by_plain_loops(part):
    moves = 0
    for seed in range(part * 40, part * 40 + 40):
        made = _made(seed)
        if made[0]:
            got = _rounds(*made)
            assert got == _plain(*made), seed
            moves += sum(kind == "move" for kind, _ in got[1])
    assert moves > 5


def test_gains_beyond_64_bits():
    """Gains of 10^34 that differ in the last digit are told apart."""
    total, w = 1 << 59, np.array([1 << 55, 1 << 55, 1 << 55])
    from muletrace.operators.communities_task import Gains

    g = Gains(total, w, np.array([1 << 57, (1 << 57) + 1, (1 << 57) - 1]), np.array([1 << 57] * 3))
    assert g.positive().tolist() == [False, False, True]
    assert g.best(np.array([0]), lambda row: b"").tolist() == [2]


def test_as_rounds_of_joins(spark, monkeypatch):
    names, money, stars = _made(1)
    size = Counter(s for s, _ in stars)
    edges = spark.createDataFrame([(a, b, w / UNIT) for a, b, w in money] + [(None, names[0], 1.0)], "a string, b string, weight double")
    on = spark.createDataFrame([(f"S{s}", a, size[s]) for s, a in stars] + [("S0", None, 3)], "star string, account string, size bigint")
    out = []
    for rows in (C.ONE_TASK_ROWS, -1):
        monkeypatch.setattr(C, "ONE_TASK_ROWS", rows)
        told = []
        out.append((sorted(map(tuple, C.communities(edges, on, told).collect())), told))
    assert out[0] == out[1] and len(out[0][1]) > 1


def test_jobs_do_not_grow_with_rounds(spark):
    """A longer chain takes more rounds, but hardly more Spark jobs."""
    jobs = []
    for n in (1, 60):
        edges = [(f"p{i:03d}", f"p{i + 1:03d}", 1.0 + i % 3) for i in range(n)]
        spark.sparkContext.setJobGroup(f"chain of {n}", "")
        told = []
        C.communities(spark.createDataFrame(edges, "a string, b string, weight double"), spark.createDataFrame([], "star string, account string, size bigint"), told).collect()
        jobs.append((len(told), len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain of {n}"))))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1][0] > jobs[0][0] and jobs[1][1] <= jobs[0][1] + 2
