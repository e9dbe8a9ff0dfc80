"""The manifest against a plain Merkle tree."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from muletrace.llm import manifest

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(digests):
    """The root, and the siblings before and behind on every level for every leaf."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for way, (n, k) in zip(ways, enumerate(at)):
            run = level[k // 16 * 16 : k // 16 * 16 + 16]
            way.append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
            at[n] = k // 16
        level = [H(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0] if level else None, ways


def _want(rows):
    """Of (doc_id, source, leaf, shown)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[s] = (members, *_tree([r[2] for r in members]))
    root, tops = _tree([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        members, subroot, ways = trees[s]
        for (i, _, leaf, shown), way in zip(members, ways):
            at = shown
            for left, right in way + top:
                at = H(left, at, right)
            out.append((i, leaf, subroot, root, tuple(way + top), at, at == root))
    return sorted(out, key=repr)


def _got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof)), r.folded_root, r.verified) for r in df.collect()), key=repr)


def _leaves(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, leaf string, shown string, rank long, lo int").repartition(4)


def _rows(sizes, seed=1):
    r, out = random.Random(seed), []
    for source, n in sizes.items():
        for k in range(n):
            leaf = H(str(r.random()))
            out.append((k * 3, source, leaf, H("other", leaf) if r.random() < 0.2 else leaf))
    r.shuffle(out)
    return out


def test_manifest(spark):
    rows = _rows({"a": 1, "b": 16, "c": 17, "d": 300, None: 2, "": 1, "é": 33, "Z": 257})
    rows += [(None, "b", H("x"), H("x")), (None, None, H("y"), H("z")), (3, "c", H("same"), H("same")), (3, "c", H("same"), H("same"))]
    got = manifest.manifest(_leaves(spark, rows))
    assert _got(got) == _want(rows)


def test_many_small_sources_and_one(spark):
    rows = _rows({f"s{k}": 1 + (k % 3 == 0) for k in range(290)})
    assert _got(manifest.manifest(_leaves(spark, rows))) == _want(rows)
    one = _rows({"only": 1})
    assert _got(manifest.manifest(_leaves(spark, one))) == _want(one)
    assert manifest.manifest(_leaves(spark, [])).count() == 0


def test_ranks_over_partitions(spark):
    """A source over several partitions and several sources in one get ranks and numbers without gaps."""
    rows = _rows({"a": 500, "b": 1, "c": 1, "d": 40})
    spread = spark.createDataFrame(rows, "doc_id long, source string, leaf string, shown string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = manifest.ranked(spread, ["source", "doc_id", "leaf"], "source").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got.sort(key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(len(rows)))
    assert [(r.source, r.doc_id) for r in got] == sorted((r[1], r[0]) for r in rows)
    spans = {r.source: (r.group_lo, r.group_hi, r.group_no) for r in got}
    assert spans == {"a": (0, 500, 0), "b": (500, 501, 1), "c": (501, 502, 2), "d": (502, 542, 3)}


def test_leaf_hash(spark):
    """Missing fields, empty and very long texts, characters of several bytes."""
    long = "é漢" * 700_000
    rows = [(1, None, "de", 3, "ab"), (2, "s", None, None, ""), (3, "s", "é", 0, long)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = df.select("doc_id", manifest.leaf_hash({c: F.col(c) for c in manifest.FIELDS}).alias("h")).collect()
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert {r.doc_id: r.h for r in got} == {r[0]: H(*map(said, r)) for r in rows}
