"""The tagger's sums and decoding against enumeration of all tag sequences."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from muletrace.llm import pii

T = 4


def _tagger(seed=5):
    t = pii.Tagger(seed)
    r = np.random.default_rng(seed)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    t.p["A"] = r.normal(size=t.p["A"].shape)
    t.trained = True
    return t


def _score(e, a, tags):
    return sum(e[k, t] for k, t in enumerate(tags)) + sum(a[x, y] for x, y in zip(tags, tags[1:]))


def _loss(t, ids, tags):
    """Mean negative log likelihood by enumeration."""
    out = 0.0
    for n in range(len(ids)):
        e = t.emissions(ids[n : n + 1])[:, 0].astype(np.float64)
        every = [_score(e, t.p["A"], s) for s in itertools.product(range(pii.TAGS), repeat=T)]
        out += np.log(np.sum(np.exp(every))) - _score(e, t.p["A"], tags[n])
    return out / len(ids)


def test_gradient_is_that_of_the_enumerated_likelihood():
    t, r = _tagger(), np.random.default_rng(1)
    ids, tags = r.integers(0, pii.N_CHARS, (3, T)), r.integers(0, pii.TAGS, (3, T))
    grad = t._gradient(ids, tags)
    for name, g in grad.items():
        flat = t.p[name].reshape(-1)
        for k in np.argsort(-np.abs(g).reshape(-1))[:6]:
            old = flat[k]
            flat[k] = old + 1e-3
            up = _loss(t, ids, tags)
            flat[k] = old - 1e-3
            down = _loss(t, ids, tags)
            flat[k] = old
            assert (up - down) / 2e-3 == pytest.approx(float(g.reshape(-1)[k]), rel=0.02, abs=2e-4), name


def test_viterbi_is_the_best_of_all_sequences():
    t, r = _tagger(), np.random.default_rng(2)
    size = np.array([4, 1, 3, 4, 2])
    scores = r.normal(size=(size.sum(), pii.TAGS)) * 2
    got = t.viterbi(scores.copy(), size)
    at = 0
    for n in size.tolist():
        e = scores[at : at + n]
        want = max(itertools.product(range(pii.TAGS), repeat=n), key=lambda s: _score(e, t.p["A"], s))
        assert tuple(got[at : at + n].tolist()) == want
        at += n


@pytest.mark.parametrize("parts", [[400], [1] * 400, [7, 150, 3, 240]])
def test_decoding_in_parts_is_decoding_at_once(parts):
    t, r = _tagger(), np.random.default_rng(3)
    scores = r.normal(size=(400, pii.TAGS))
    chain, out, at = pii._Chain(t.p["A"]), [], 0
    for k, n in enumerate(parts):
        out += chain.feed(scores[at : at + n], k == len(parts) - 1).tolist()
        at += n
        assert len(chain.back) <= 200  # what is decided is let go
    assert out == t.viterbi(scores.copy(), np.array([400])).tolist()


def _text(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("abcd efg.@+-") if k % 20 else r.choice("0123456789") for k in range(n))


def test_spans_do_not_depend_on_the_size_of_parts(monkeypatch):
    t, text = _tagger(), _text(4, 6000)
    whole = t.spans([text])
    assert whole[0]
    for part in (5, 64, 100):
        monkeypatch.setattr(pii, "PART", part)
        assert t.spans([text]) == whole
        assert t.spans([text, "no digit", text])[2] == whole[0]


def test_spans_do_not_depend_on_the_place_in_the_text():
    """A passage far into a covered stretch of 300,000 characters is tagged like the same one near its start."""
    t = _tagger()
    period = _text(6, pii.STRIDE * 12)
    times = 300_000 // len(period)
    found = t.spans([period * times])[0]
    inner = lambda k: {(n, a - k * len(period), z - k * len(period)) for n, a, z in found if k * len(period) <= a and z < (k + 1) * len(period)}
    assert inner(3) and all(inner(k) == inner(3) for k in (4, times // 2, times - 3))
