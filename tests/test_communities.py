"""Communities by merging, against trying all partitions of small graphs and against written-out stars."""

from __future__ import annotations

import random

import pytest

from muletrace.operators import communities as C


def _modularity(edges, part):
    total = sum(w for _a, _b, w in edges)
    degree, inside = {}, 0.0
    for a, b, w in edges:
        for x in (a, b):
            degree[part[x]] = degree.get(part[x], 0.0) + w
        inside += w * (part[a] == part[b])
    return inside / total - sum((d / (2 * total)) ** 2 for d in degree.values())


def _partitions(names):
    if not names:
        yield {}
        return
    for rest in _partitions(names[1:]):
        groups = sorted(set(rest.values()))
        for g in [*groups, len(groups)]:
            yield {names[0]: g, **rest}


def _found(spark, edges, stars=(), rounds=None):
    money = spark.createDataFrame(edges, "a string, b string, weight double")
    rows = [(s, a, len(users)) for s, users in stars for a in users]
    return {x.account: x.community for x in C.communities(money, spark.createDataFrame(rows, "star string, account string, size bigint"), rounds).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_the_best_partition(spark, seed):
    r = random.Random(seed)
    names = list("abcdefgh")
    edges = [(a, b, float(r.choice([1, 2, 3]))) for k, a in enumerate(names) for b in names[k + 1 :] if r.random() < 0.4]
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    got = _found(spark, edges)
    assert sorted(got) == names and all(got[a] == min(x for x in names if got[x] == got[a]) for a in names)
    best = max(_modularity(edges, p) for p in _partitions(names))
    mine = _modularity(edges, got)
    assert mine >= 0.8 * best
    # no two communities gain by merging
    for c in set(got.values()):
        for d in set(got.values()) - {c}:
            assert _modularity(edges, {a: c if g == d else g for a, g in got.items()}) <= mine + 1e-12


def test_a_star_counts_as_all_its_pairs(spark):
    """Two components: a star of six beside a triangle with a tail; the star as edges gives the same groups."""
    users = [f"s{k}" for k in range(6)]
    edges = [("x", "y", 2.0), ("y", "z", 2.0), ("x", "z", 2.0), ("z", "t", 0.5), ("t", "u", 2.0), ("u", "v", 2.0), ("t", "v", 2.0)]
    pairs = [(a, b, 1.0) for k, a in enumerate(users) for b in users[k + 1 :]]
    want = {**{u: "s0" for u in users}, "x": "x", "y": "x", "z": "x", "t": "t", "u": "t", "v": "t"}
    assert _found(spark, edges, [("D", users)]) == want == _found(spark, edges + pairs)


def test_a_hub_takes_in_all_its_leaves_at_once(spark):
    rounds = []
    edges = [("hub", f"l{k:04d}", 1.0) for k in range(1000)] + [("x", "y", 2.0), ("y", "z", 2.0), ("x", "z", 1.0)]
    got = _found(spark, edges, rounds=rounds)
    assert len(rounds) <= 12
    assert sorted(map(len, _groups(got))) == [3, 1001]


def test_a_star_alone_becomes_one(spark):
    rounds = []
    got = _found(spark, [("x", "y", 2.0)], [("D", [f"s{k:03d}" for k in range(200)])], rounds)
    assert len(rounds) <= 4 and sorted(map(len, _groups(got))) == [2, 200]


def _groups(got):
    out = {}
    for a, c in got.items():
        out.setdefault(c, set()).add(a)
    return out.values()


def test_rounds_of_a_path_and_moves(spark):
    """Rounds grow with the logarithm of a path's length, and no single account gains by changing over at the end."""
    rounds = []
    edges = [(f"p{k:03d}", f"p{k + 1:03d}", 1.0 + k % 3) for k in range(60)]
    got = _found(spark, edges, rounds=rounds)
    mine = _modularity(edges, got)
    assert sum(kind == "merge" for kind, _ in rounds) <= 16
    for a, b, _ in edges:
        for x, y in ((a, b), (b, a)):
            assert _modularity(edges, {**got, x: got[y]}) <= mine + 1e-12


def test_sums_before_are_the_same_in_buckets(spark, monkeypatch):
    r = random.Random(5)
    rows = [(r.choice("ab"), r.randint(1, 3) * 100, f"{r.getrandbits(64):016x}", r.randint(1, 9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "hub string, class int, digest string, k long")
    key = lambda x: tuple(x)
    one = sorted(map(key, C._before(df, ["hub"], df.k, "ahead", 300).collect()))
    monkeypatch.setattr(C, "ONE_TASK", 10)
    cut = C._before(df, ["hub"], df.k, "ahead", 300)
    assert sorted(map(key, cut.select("hub", "class", "digest", "k", "ahead").collect())) == one


def test_no_edges(spark):
    assert _found(spark, []) == {}
