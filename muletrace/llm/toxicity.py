"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

The kernel of two short strings counts the subsequences of three or four letters they share, each weighted by ``DECAY`` for every
letter that lies between, so ``id-iot`` and ``i.d.i.o.t`` stay close to the plain word. Labels are given for texts, not
for words; training is multiple-instance: every toxic text points at its most suspicious strings, clean texts at the ones
most like them, the machine is fitted on these and points again. The machine is linear in the kernel's landmarks, and
these are linear in subsequence counts, so it folds into one weight per (hashed) subsequence: scoring a string takes as
long as listing its subsequences, whatever the number of landmarks.

A text's score is a logistic of its strongest strings and of how many are above the margin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muletrace.llm.base import labelled_sample, portions

SAMPLE_PER_CLASS = 1000
LANDMARKS = 256
THRESHOLD = 0.5
ROUNDS = 4
DECAY = 0.6
SPAN = 5  # a subsequence reaches over at most one letter more
BITS = 18
LONGEST = 24  # longer strings are cut into overlapping ones
#: Where the further letters stand: three letters with gaps, and four with one gap at most.
_STEPS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)] + [(1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)]
_WEIGHT = {s: DECAY ** (s[-1] - len(s)) for s in _STEPS}

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

_TOKEN = re.compile(r"\w+")
_EDGE = re.compile(r"^\W+|\W+$")


def _pieces(w: str) -> list[str]:
    return [w[k : k + LONGEST] for k in range(0, len(w) - LONGEST // 2, LONGEST // 2)] if len(w) > LONGEST else [w]


def strings(text: str) -> list[str]:
    """Lower-case words without punctuation at their ends, and letters spelled one by one joined to one string each.

    Between spelled letters may stand any white space, line ends and punctuation, but no word. Long ones of either kind are
    cut into overlapping pieces.
    """
    low = text.lower()
    out, spelled, run = [], [], []
    for w in low.split():
        plain = w.isalnum()
        letters = [w] if plain else _TOKEN.findall(w)
        if all(len(x) == 1 for x in letters):
            run += letters
        else:
            spelled.append(run)
            run = []
        w = w if plain else _EDGE.sub("", w)
        if len(w) > 2:
            out += _pieces(w)
    return out + [x for r in (*spelled, run) if len(r) > 2 for x in _pieces("".join(r))]


class Listed:
    """The subsequences of many strings: hashed codes by step, with the string each belongs to."""

    def __init__(self, words: list[str]):
        text = "".join(f"^{w}$" for w in words)
        self.size = np.array([len(w) + 2 for w in words], np.int64)
        letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.own = np.repeat(np.arange(len(words), dtype=np.int32), self.size)
        self.left = (np.cumsum(self.size)[self.own] - np.arange(len(letters))).astype(np.int32)
        self.mixed = [letters * np.uint64(m) >> np.uint64(7 * k) for k, m in enumerate(_MIX)]
        # long lists are gone through again each time, so that they need little memory
        self.kept = list(self._steps()) if len(letters) < 1 << 18 else None
        self.norm = np.sqrt(sum(np.maximum(0, self.size - s[-1]) * w * w for s, w in _WEIGHT.items()) + 1e-9)

    def _steps(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For every way to step: strings, codes and weight of the subsequences."""
        for step in _STEPS:
            ok = np.flatnonzero(self.left > step[-1])
            h = self.mixed[0][ok]
            for k, by in enumerate(step, 1):
                h = h ^ self.mixed[k][ok + by]
            h = h * np.uint64(0xBF58476D1CE4E5B9)
            yield self.own[ok], (h >> np.uint64(64 - BITS)).astype(np.int64), _WEIGHT[step]

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """Weighted subsequences of every string, by the string's norm."""
        out = np.zeros(len(self.size))
        for own, code, by in self.kept or self._steps():
            out += by * np.bincount(own, weights[code], len(out))
        return out / self.norm

    def spread(self, weight: np.ndarray) -> np.ndarray:
        """Sum of ``weight`` times every string's subsequence vector."""
        out = np.zeros(1 << BITS)
        w = weight / self.norm
        for own, code, by in self.kept or self._steps():
            out += by * np.bincount(code, w[own], 1 << BITS)
        return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Primal support vector machine with squared hinge, by Newton steps; the last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    sign = np.where(y > 0, 1.0, -1.0)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(20):
        open_ = sign * (x @ w) < 1
        xs = x[open_] * weight[open_, None]
        new = np.linalg.solve(xs.T @ x[open_] + np.diag(penalty), xs.T @ sign[open_])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps, halved until the loss falls."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    loss = lambda w: np.logaddexp(0, -sign * (x @ w)).sum() + ridge / 2 * (w @ w)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - (y > 0)) + ridge * w)
        by = 1.0
        while loss(w - by * step) > loss(w) and by > 1e-6:
            by /= 2
        w = w - by * step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _summary(f: np.ndarray) -> tuple[float, float, float, float]:
    """A text's strongest string, second strongest, and how many are above the margin, as such and by length."""
    if not len(f):
        return (-1.5, -1.5, 0.0, 0.0)
    top = np.sort(f)[-2:]
    n = int((f > 0).sum())
    return (max(-1.5, min(1.5, top[-1])), max(-1.5, min(1.5, top[0])) if len(top) > 1 else -1.5, np.log1p(n), 10 * n / (len(f) + 20))


class ToxicityModel:
    """One weight per subsequence, an offset, and the logistic over a text's summary."""

    def __init__(self):
        self.weights = np.zeros(1 << BITS, np.float32)
        self.offset = -1.0
        self.logistic = np.array([0.0, 0.0, 0.0, 0.0, -5.0])

    def fit(self, texts: list[str], y: list[int], seed: int = 5) -> "ToxicityModel":
        label = np.array(y)
        if len(set(y)) < 2:
            if y and y[0] == 1:
                self.logistic[-1] = 5.0
            return self
        rng = np.random.default_rng(seed)
        bags = [strings(t) for t in texts]
        index: dict[str, int] = {}
        rows = [np.array(sorted({index.setdefault(w, len(index)) for w in b}), np.int64) for b in bags]
        words = list(index)
        listed = Listed(words)
        # texts that hold a string, but no more than there are different strings before it: copies prove nothing twice
        seen, before = np.zeros((2, len(words))), np.zeros((2, len(words)))
        for r, k in zip(rows, y):
            seen[k, r] += 1
        for k in (0, 1):
            ids = [np.array([index[w] for w in bag], np.int64) for bag, c in zip(bags, y) if c == k and bag]
            if ids:
                pairs = np.unique(np.concatenate([np.roll(r, 1) << 32 | r for r in ids]))
                before[k] = np.bincount(pairs & 0xFFFFFFFF, minlength=len(words))
        seen = np.minimum(seen, before)
        share = seen / np.maximum(1, [[(label == 0).sum()], [(label == 1).sum()]])
        # where to look first: subsequences, and words, that toxic texts have and clean ones have not
        tox, clean = listed.spread(share[1] * listed.norm), listed.spread(share[0] * listed.norm)
        prior = 3.0 / (label == 1).sum()
        score = listed.dot(np.log((tox + prior) / (clean + prior))) + np.log((share[1] + prior) / (share[0] + prior))
        # strings found in toxic texts far more often than chance allows
        total, base = seen.sum(0), (label == 1).mean()
        beyond = (seen[1] - total * base) / np.sqrt(total * base * (1 - base))
        plain = {int(w) for w in np.flatnonzero((beyond > 4) & (share[1] > 5 * share[0]))}
        sick = [r for r, k in zip(rows, y) if k == 1 and len(r)]
        well = [r for r, k in zip(rows, y) if k == 0 and len(r)]
        for round_ in range(ROUNDS):
            if round_:
                pos = plain | {int(w) for r in sick for w in r[np.argsort(-score[r])[:4]] if score[w] > 0.5}
            else:
                pos = plain | {int(r[np.argmax(score[r])]) for r in sick if plain.isdisjoint(r.tolist())}
            # strings that clean texts hold as often are no witnesses
            pos = [w for w in pos if share[1][w] > 5 * share[0][w]]
            hard = {int(w) for r in well for w in r[np.argsort(-score[r])[:4]]} - set(pos)
            loose = set(rng.choice(len(words), min(len(words), 3000), replace=False, p=(share[0] + 1e-12) / (share[0] + 1e-12).sum()).tolist()) - set(pos)
            neg = sorted(hard | loose | (set(np.flatnonzero(share[0] > 0.01).tolist()) - set(pos)))
            if not pos or not neg:
                break
            pos = sorted(pos)
            chosen = [words[w] for w in pos]
            bent = [w[:k] + rng.choice(list(".-_*x")) + w[k:] for w in chosen for k in [int(rng.integers(1, len(w)))]]
            bent += [".".join(w) for w in chosen[:: max(1, len(chosen) // 200)]]
            train = chosen + bent + [words[w] for w in neg]
            target = np.array([1] * (len(chosen) + len(bent)) + [0] * len(neg))
            often = np.concatenate([np.sqrt(seen[1][pos]), np.full(len(bent), 0.5), np.sqrt(1 + seen[0][neg])])
            weight = often * np.where(target == 1, 0.5 / often[target == 1].sum(), 0.5 / often[target == 0].sum()) * len(train)
            # landmarks: the most pointed-at strings, the common clean ones most like them, and clean ones at random
            best = sorted(range(len(chosen)), key=lambda k: (-seen[1][pos[k]], chosen[k]))[: LANDMARKS // 2]
            like = sorted(range(len(neg)), key=lambda k: (-(score[neg[k]] + 3) * np.sqrt(seen[0][neg[k]]), words[neg[k]]))[: LANDMARKS // 4]
            rest = rng.choice(len(neg), min(len(neg), LANDMARKS - len(best) - len(like)), replace=False)
            marks = [chosen[k] for k in best] + [words[neg[k]] for k in sorted({*like, *rest.tolist()})]
            data, mark_list = Listed(train), Listed(marks)
            one = np.eye(len(marks))
            tables = (mark_list.spread(e) for e in one)
            kernel = np.empty((len(train), len(marks)))
            among = np.empty((len(marks), len(marks)))
            for k, table in enumerate(tables):
                kernel[:, k], among[:, k] = data.dot(table), mark_list.dot(table)
            value, vector = np.linalg.eigh((among + among.T) / 2)
            good = value > 1e-6 * value.max()
            root = vector[:, good] / np.sqrt(value[good])
            w = _machine(kernel @ root, target, weight, ridge=0.5)
            self.weights = mark_list.spread(root @ w[:-1]).astype(np.float32)
            self.offset = float(w[-1])
            score = listed.dot(self.weights) + self.offset
        again = [score[[index[w] for w in b]] if b else np.zeros(0) for b in bags]
        self.logistic = _logistic(np.array([_summary(f) for f in again]), label)
        return self

    def string_scores(self, words: list[str]) -> np.ndarray:
        return Listed(words).dot(self.weights) + self.offset if words else np.zeros(0)

    def scores(self, texts: list[str]) -> np.ndarray:
        bags = [strings(t) for t in texts]
        index: dict[str, int] = {}
        rows = [[index.setdefault(w, len(index)) for w in b] for b in bags]
        words = list(index)
        f = np.concatenate([self.string_scores(words[k : k + 20000]) for k in range(0, len(words), 20000)]) if words else np.zeros(0)
        x = np.array([_summary(f[r] if r else np.zeros(0)) for r in rows]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.logistic[:-1] + self.logistic[-1], -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """The model fitted on at most ``per_class`` training texts of either label."""
    sample = labelled_sample(docs, labels, "toxic", per_class)
    return ToxicityModel().fit([t for t, _ in sample], [y for _, y in sample])


def toxicity_scorer(spark: SparkSession, model: ToxicityModel):
    """A column function: text -> score in 0 to 1, higher for likelier toxic. Missing and empty texts have no strings and
    score as clean ones do."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in portions(batches):
            yield pa.array(m.scores([t or "" for t in texts.to_pylist()]))

    return score
