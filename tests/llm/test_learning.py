"""The kernel pair by pair, and the attention model's sums and gradient by plain counting and differences."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from muletrace.llm import quality, toxicity


def _subsequences(word):
    """Letters of every subsequence with its weight, listed one by one; and the norm."""
    said, out, square = f"^{word}$", Counter(), 1e-9
    for step in toxicity._STEPS:
        for i in range(len(said) - step[-1]):
            out[tuple(said[i + k] for k in (0, *step))] += toxicity._WEIGHT[step]
            square += toxicity._WEIGHT[step] ** 2
    return out, math.sqrt(square)


def test_listed_subsequences_are_the_kernel_pair_by_pair():
    words = ["idiot", "id-iot", "i.d.i.o.t", "idyllic", "toidi", "aaaaaaa", "é漢é漢é", "ab", "", "blockhead", "blxockhead"]
    listed = toxicity.Listed(words)
    plain = [_subsequences(w) for w in words]
    for t in range(len(words)):
        got = listed.dot(listed.spread(np.eye(len(words))[t]))
        for s in range(len(words)):
            (a, n), (b, m) = plain[s], plain[t]
            assert got[s] == pytest.approx(sum(v * b[k] for k, v in a.items()) / (n * m), abs=1e-9), (words[s], words[t])
    # a gapped spelling is nearer than an anagram
    near = listed.dot(listed.spread(np.eye(len(words))[0]))
    assert near[0] > near[1] > near[4]


def _bags(seed=1):
    r = np.random.default_rng(seed)
    bags = [r.normal(size=(n, quality.FEATURES)) for n in (1, 3, 5, 2)]
    start = np.cumsum([0] + [len(b) for b in bags[:-1]])
    return bags, np.concatenate(bags), start, np.array([1, 0, 1, 0]), np.array([0.5, 1.5, 1.0, 1.0])


def test_attention_is_that_of_every_bag_alone():
    bags, x, start, *_ = _bags()
    m = quality.AttentionModel()
    for bag, got in zip(bags, m.score(x, start)):
        h = [np.tanh(np.clip(z, -6, 6) @ m.p["E"] + m.p["e"]) for z in bag]
        raw = [math.exp(float((np.tanh(k @ m.p["V"]) / (1 + np.exp(-(k @ m.p["U"])))) @ m.p["a"])) for k in h]
        mixed = sum(w / sum(raw) * k for w, k in zip(raw, h))
        assert got == pytest.approx(1 / (1 + math.exp(-float(mixed @ m.p["w"] + m.p["b"][0]))), abs=1e-9)


def test_gradient_equals_differences():
    _, x, start, y, weight = _bags(2)
    m = quality.AttentionModel()

    def loss():
        s = m.score(x, start)
        decay = sum(float((m.p[k] ** 2).sum()) for k in ("E", "V", "U", "w"))
        return float((-(y * np.log(s) + (1 - y) * np.log(1 - s)) * weight).sum() / len(y)) + 1e-4 / 2 * decay

    for name, g in m._gradient(x, start, y, weight).items():
        flat, g = m.p[name].reshape(-1), np.asarray(g).reshape(-1)
        for k in np.argsort(-np.abs(g))[:5]:
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-5 == pytest.approx(float(g[k]), rel=1e-4, abs=1e-8), name
