"""SimHash, chunk and suffix deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from muletrace.llm import base, chunks, components, queries, simhash, suffixes
from tests.llm import fixtures


def _fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    said = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in said]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(prints):
    up = {p: p for p in prints}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    u = sorted(up)
    for k, a in enumerate(u):
        for b in u[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {a: root(a) for a in u}


def test_simhash_groups(spark, tmp_path):
    data = fixtures.rows()
    got = simhash.simhash_groups(fixtures.stored(spark, tmp_path / "d", data)).collect()
    prints = [(i, _fingerprint(t)) for i, t in data]
    comp = _components({p for _, p in prints})
    least = {}
    for i, p in prints:
        c = comp[p]
        least[c] = min([x for x in (i, least.get(c)) if x is not None], default=None)
    want = sorted(((i, f"{p:016x}", least[comp[p]]) for i, p in prints), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    assert simhash.simhash_groups(fixtures.empty(spark, tmp_path / "e")).count() == 0


@pytest.mark.parametrize("hot,room", [(4096, 128), (16, 128), (16, 1)])
def test_links_keep_all_components(spark, hot, room):
    """Dense clusters, chains and loners; small limits drive the finer cuts, the block pairs and more tables."""
    r = random.Random(hot + room)
    prints = {r.getrandbits(64) for _ in range(150)}
    centre = r.getrandbits(64)
    prints |= {centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(120)}
    x = r.getrandbits(64)
    for _ in range(60):
        prints.add(x)
        for b in r.sample(range(64), r.choice([4, 4, 5])):
            x ^= 1 << b
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    links = simhash.simhash_links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), hot, room).collect()
    up = {p: p for p in prints}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for row in links:
        a, b = row.a & (1 << 64) - 1, row.b & (1 << 64) - 1
        assert (a ^ b).bit_count() <= 4 and a != b
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert {p: root(p) for p in prints} == _components(prints)


def test_large_buckets_and_small_ones_agree():
    r = np.random.default_rng(2)
    p = np.unique((r.integers(0, 1 << 63, 20, dtype=np.uint64)[:, None] ^ (np.uint64(1) << r.integers(0, 64, (20, 40), dtype=np.uint64))).ravel())

    def comps(links):
        f = simhash._Forest(len(p))
        for a, b in links:
            f.join(a, b)
        return [f.root(k) for k in range(len(p))]

    assert comps(simhash._large_bucket(p)) == comps(simhash._small_buckets(p, np.array([len(p)])))


def test_pipeline_keeps_one_of_each_component(spark, tmp_path):
    df = fixtures.stored(spark, tmp_path / "d")
    left = simhash.without_near_copies(df)
    comp = _components({_fingerprint(t) for _, t in fixtures.rows()})
    assert left.columns == df.columns
    assert sorted(comp[_fingerprint(x.text)] for x in left.collect()) == sorted(set(comp.values()))


def test_chunks_resist_insertions():
    r = random.Random(3)
    data = bytes(r.choice(b"abcdef ") for _ in range(20_000))
    h, ref = 0, []
    for c in data[:500]:
        h = (h << 1) + int(chunks.GEAR[c]) & 0xFFFFFFFF
        ref.append(h)
    assert chunks.gear_hash(np.frombuffer(data[:500], np.uint8)).tolist() == ref
    a, b = set(chunks.cuts(data)), {x - 5 for x in chunks.cuts(b"12345" + data)}
    assert len(a & b) > 0.95 * len(a)
    text = "é漢字🙂" * 500
    ends = chunks.cuts(text.encode())
    assert "".join(text.encode()[a:z].decode() for a, z in zip([0, *ends], ends)) == text


def test_chunk_dedup(spark, tmp_path):
    data = fixtures.rows()
    got = chunks.chunk_dedup(fixtures.stored(spark, tmp_path / "d", data))
    got = {(r.doc_id, r.kept): r for r in got.collect()}
    by_id = {i: r for (i, _), r in got.items()}
    plain = dict(data)
    assert by_id[0].n_removed == 0 and by_id[0].kept.decode() == plain[0]
    first = [i for i in range(130, 136)]
    assert by_id[first[0]].n_removed == 0
    for i in first[1:]:
        assert by_id[i].n_removed > 200 and by_id[i].first_docs == [130]
    assert by_id[155].n_removed > 0.9 * len(fixtures.LONG)
    for (i, kept), r in got.items():
        kept.decode()
        assert r.n_bytes == len(kept) + r.n_removed
    assert by_id[150].n_bytes == 0
    assert chunks.chunk_dedup(fixtures.empty(spark, tmp_path / "e")).count() == 0


def _plain_cuts(data):
    """Byte by byte, every hash summed anew from the last 32 bytes."""
    gear, out, last = chunks.GEAR.tolist(), [], 0

    def boundary(end):
        h = sum(gear[data[end - 1 - k]] << k for k in range(min(32, end))) & 0xFFFFFFFF
        return h >> 32 - chunks.BITS == 0

    while last < len(data):
        end = last + 1
        while end < len(data) and end - last < chunks.MAX_CHUNK and not (end - last >= chunks.MIN_CHUNK and boundary(end)):
            end += 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append((last, end))
        last = end
    return out


def _plain_chunk_dedup(rows):
    """(doc_id, n_bytes, kept, n_removed, n_spans, first_docs) in plain Python."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    first, again = {}, {k: [] for k in order}
    for k in order:
        data = (rows[k][1] or "").encode()
        for a, z in _plain_cuts(data):
            owner = first.setdefault(data[a:z], (k, a))
            if owner != (k, a):
                again[k].append((a, z, rows[owner[0]][0]))
    out = []
    for k, (i, text) in enumerate(rows):
        data, runs = (text or "").encode(), []
        for a, z, _ in again[k]:
            if runs and runs[-1][1] == a:
                runs[-1][1] = z
            else:
                runs.append([a, z])
        runs = [r for r in runs if r[1] - r[0] >= chunks.MIN_SPAN]
        gone = {b for a, z in runs for b in range(a, z)}
        kept = bytes(c for b, c in enumerate(data) if b not in gone)
        ids = sorted({f for *_, f in again[k] if f is not None}) if runs else []
        out.append((i, len(data), kept, len(gone), len(runs), ids))
    return out


def test_chunk_dedup_equals_plain_python(spark, tmp_path):
    r = random.Random(12)
    data = [x for x in fixtures.rows() if x[0] not in (154, 155)]
    passages = ["".join(r.choice("abcdefghij é漢") for _ in range(r.randint(100, 900))) for _ in range(8)]
    for k in range(30):
        data.append((500 + k, "".join(r.choice([*passages, *("".join(r.choice("klmno ") for _ in range(150)) for _ in range(4))]) for _ in range(4))))
    got = chunks.chunk_dedup(fixtures.stored(spark, tmp_path / "d", data)).collect()
    got = sorted(((x.doc_id, x.n_bytes, bytes(x.kept), x.n_removed, x.n_spans, [f for f in x.first_docs if f is not None]) for x in got), key=repr)
    assert got == sorted(_plain_chunk_dedup(data), key=repr)
    assert sum(x[4] > 1 for x in got) > 5


def _removed(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_suffix_dedup(spark, tmp_path, hot):
    data = [x for x in fixtures.rows() if x[0] not in (154, 155)] + [(154, fixtures.LONG[:9000]), (155, "neu " + fixtures.LONG[:9001])]
    done = suffixes.substring_dedup(fixtures.stored(spark, tmp_path / "d", data), hot=hot).collect()
    got = sorted((r.doc_id or -1, r.n_bytes, sum(x.end - x.start for x in r.runs or []), len(r.runs or []), r.kept_sha256) for r in done)
    want = sorted((i or -1, *w) for (i, _), w in zip(data, _removed([t for _, t in data])))
    assert got == want
    assert sum(w[2] > 0 for w in want) > 10


def test_suffix_dedup_of_an_empty_table(spark, tmp_path):
    assert suffixes.substring_dedup(fixtures.empty(spark, tmp_path / "e")).count() == 0


def test_queries_over_a_small_folder(spark, tmp_path):
    fixtures.stored(spark, tmp_path / "documents.parquet")
    n = len(fixtures.rows())
    for name in ("op5_simhash_dedup", "op7_chunk_dedup", "op8_suffix_dedup", "op10_exact_dedup"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == n


@pytest.mark.parametrize("most", [200_000, 0])
def test_components(spark, monkeypatch, most):
    """A hub, a long path, a loop and a pair; with the label table broadcast and spread."""
    monkeypatch.setattr(components, "BROADCAST_ROWS", most)
    r = random.Random(8)
    links = [(500, k) for k in range(501, 600)] + [(k, k + 1) for k in range(100)] + [(900, 900), (-5, 7000), (-5, 7000)]
    r.shuffle(links)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 500 for k in range(500, 600)} | {k: 0 for k in range(101)} | {900: 900, -5: -5, 7000: -5}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_of_many_shingles():
    text = " ".join(f"w{k * k % 9973}" for k in range(200_000))
    assert simhash.simhash_of(text) & (1 << 64) - 1 == _fingerprint(text)


def test_contradicting_labels(spark):
    """The smaller of two labels of one document counts, whatever the order."""
    docs = fixtures.documents(spark, [(k, f"text {k}") for k in range(40)])
    rows = [(k, y, 0) for k in range(40) for y in (1, 0)]
    for labels in (rows, rows[::-1]):
        got = base.labelled_sample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "quality", 100)
        assert got and {y for _, y in got} == {0}
