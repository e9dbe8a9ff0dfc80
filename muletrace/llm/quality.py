"""Quality classifier by attention over passages.

A document is a bag of passages. Every passage is described by counts over its bytes and words (how much of it is upper
case, punctuation, symbols, table bars or digits, how long words are, how many repeat), encoded by a small network, and
weighed by gated attention learned from document labels alone. The document's score is a logistic of the weighted
passage representation. Trained in numpy on a bounded sample of labelled texts, applied inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muletrace.llm.base import labelled_sample, portions

PASSAGE_WORDS = 48
SAMPLE_PER_CLASS = 1500
TRAIN_PASSAGES = 64  # of a training text, evenly spread; texts to be scored use all
HIDDEN = 16
ATTENTION = 8
EPOCHS = 60
THRESHOLD = 0.3

#: Byte classes: other, lower, upper, digit, space, line end, sentence mark, exclamation, bar, symbol, non-ASCII.
_CLASSES = 11


def _class_of(c: int) -> int:
    ch = chr(c)
    if c >= 128:
        return 10
    if "a" <= ch <= "z":
        return 1
    if "A" <= ch <= "Z":
        return 2
    if "0" <= ch <= "9":
        return 3
    if ch == " ":
        return 4
    if ch in "\t\n\x0b\x0c\r":
        return 5
    if ch in ".,;:'\"()-":
        return 6
    if ch in "!?":
        return 7
    if ch == "|":
        return 8
    return 9 if 32 < c < 127 else 0


_CLASS = np.array([_class_of(c) for c in range(256)], np.uint8)

FEATURES = _CLASSES + 5


def passages(text: str) -> np.ndarray:
    """One row of features per passage of ``PASSAGE_WORDS`` words; a text without words is one passage."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    out = np.zeros((max(1, -(-len(words) // PASSAGE_WORDS)), FEATURES), np.float32)
    for k in range(len(out)):
        w = words[k * PASSAGE_WORDS : (k + 1) * PASSAGE_WORDS]
        n = len(w)
        if not n:
            break
        joined = b" ".join(w)
        size = len(joined)
        out[k, :_CLASSES] = np.bincount(_CLASS[np.frombuffer(joined, np.uint8)], minlength=_CLASSES) / size
        out[k, _CLASSES:] = (
            len(set(w)) / n,
            sum(a == b for a, b in zip(w, w[1:])) / n,
            size / n / 10,
            min(n, PASSAGE_WORDS) / PASSAGE_WORDS,
            sum(x[-1:] in b"!#$%&*|" for x in w) / n,
        )
    return out


class AttentionModel:
    """Passage features -> tanh encoding -> gated attention -> logistic."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        scale = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.mean, self.spread = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {
            "E": scale(FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": scale(HIDDEN, ATTENTION), "U": scale(HIDDEN, ATTENTION),
            "a": scale(ATTENTION), "w": scale(HIDDEN), "b": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, start: np.ndarray):
        """``start``: first passage of every document, the passages of one after those of the other."""
        p = self.p
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(z @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        own = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
        raw = (v * u) @ p["a"]
        raw = np.exp(raw - np.maximum.reduceat(raw, start)[own])
        weight = raw / np.add.reduceat(raw, start)[own]
        bag = np.add.reduceat(weight[:, None] * h, start)
        score = 1 / (1 + np.exp(-np.clip(bag @ p["w"] + p["b"], -30, 30)))
        return z, h, v, u, own, weight, bag, score

    def score(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        return self._forward(x, start)[-1]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 11) -> "AttentionModel":
        if not bags or len(set(y.tolist())) < 2:
            self.p = {k: np.zeros_like(v) for k, v in self.p.items()}
            self.p["b"][0] = 0.0 if not len(y) else (30.0 if y[0] else -30.0)
            return self
        every = np.concatenate(bags)
        self.mean, self.spread = every.mean(0), every.std(0) + 1e-3
        r = np.random.default_rng(seed)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
        step = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(bags))
            for k in range(0, len(order), 128):
                pick = order[k : k + 128]
                x = np.concatenate([bags[i] for i in pick])
                start = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])[:-1]])
                step += 1
                for name, grad in self._gradient(x, start, y[pick], weight[pick]).items():
                    m, s = moment[name]
                    m *= 0.9
                    m += 0.1 * grad
                    s *= 0.999
                    s += 0.001 * grad * grad
                    self.p[name] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x, start, y, weight) -> dict[str, np.ndarray]:
        p = self.p
        z, h, v, u, own, att, bag, score = self._forward(x, start)
        d = (score - y) * weight / len(y)
        d_bag = d[:, None] * p["w"]
        d_att = (d_bag[own] * h).sum(1)
        d_raw = att * (d_att - np.add.reduceat(att * d_att, start)[own])
        d_v, d_u = d_raw[:, None] * p["a"] * u * (1 - v * v), d_raw[:, None] * p["a"] * v * u * (1 - u)
        d_h = (att[:, None] * d_bag[own] + d_v @ p["V"].T + d_u @ p["U"].T) * (1 - h * h)
        decay = 1e-4
        return {
            "E": z.T @ d_h + decay * p["E"], "e": d_h.sum(0), "V": h.T @ d_v + decay * p["V"], "U": h.T @ d_u + decay * p["U"],
            "a": (v * u).T @ d_raw, "w": bag.T @ d + decay * p["w"], "b": np.array([d.sum()]),
        }


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> AttentionModel:
    """The model fitted on at most ``per_class`` training texts of either label, ``TRAIN_PASSAGES`` passages of each."""
    bags, ys = [], []
    for text, y in labelled_sample(docs, labels, "quality", per_class):
        x = passages(text)
        bags.append(x[np.unique(np.linspace(0, len(x) - 1, min(len(x), TRAIN_PASSAGES)).astype(int))])
        ys.append(y)
    return AttentionModel().fit(bags, np.array(ys, np.float64))


def quality_scorer(spark: SparkSession, model: AttentionModel):
    """A column function: text -> score in 0 to 1, higher for likelier good. Missing and empty texts are one passage
    without words and get a score too."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in portions(batches):
            bags = [passages(t or "") for t in texts.to_pylist()]
            start = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
            yield pa.array(m.score(np.concatenate(bags), start))

    return score
