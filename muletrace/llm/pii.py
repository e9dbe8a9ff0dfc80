"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The patterns give spans that always stay, and, on a bounded sample of texts, the labelled spans the network is trained
from in numpy; some of them are written differently for training (numbers grouped otherwise, no plus sign), so that the
network learns more than the patterns know. Texts are read in overlapping windows. A window without a digit and without
an at sign cannot hold any of the kinds and is skipped. The networks of all windows give tag scores for every character;
where windows overlap, scores are averaged, those far from a window's edge counting most, and one Viterbi pass over each
whole covered stretch decides on the tags, so spans may be longer than a window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muletrace.llm.base import hash_share, portions, texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE_TEXTS = 800
SHARE = 12  # as many documents are looked through for each sampled text
WINDOW, STRIDE = 64, 48
HIDDEN = 12
TRAIN_WINDOWS = 4000
EPOCHS = 8

# -- fixed patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_HINT = re.compile(r"[0-9@]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[::-2]))
    return (odd + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, start, end) of what the patterns find, in order of start, then kind as listed."""
    if not _HINT.search(text):
        return []
    found = [(a, 0, z) for a, z in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = "".join(_DIGITS.findall(m[0]))
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], a, z) for a, k, z in sorted(found)]


# -- characters

_NAMED = "@.-_+() ,:/%\n"
_OTHER, _LOWER, _UPPER, _DIGIT, _WIDE = 1, 2, 3, 4, 5
N_CHARS = 6 + len(_NAMED)
_ASCII = np.full(129, _OTHER, np.uint8)
_ASCII[ord("a") : ord("z") + 1], _ASCII[ord("A") : ord("Z") + 1], _ASCII[ord("0") : ord("9") + 1], _ASCII[128] = _LOWER, _UPPER, _DIGIT, _WIDE
for _k, _c in enumerate(_NAMED):
    _ASCII[ord(_c)] = 6 + _k
_AT = 6


def char_ids(text: str) -> np.ndarray:
    """A number for the kind of every character; 0 is left for what is outside the text."""
    return _ASCII[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 128)]


def window_starts(ids: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit or an at sign."""
    hint = np.concatenate([[0], np.cumsum((ids == _DIGIT) | (ids == _AT))])
    start = np.arange(0, max(1, len(ids)), STRIDE)
    return start[hint[np.minimum(start + WINDOW, len(ids))] > hint[start]]


def _windows(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([ids, np.zeros(WINDOW, np.uint8)])
    return padded[starts[:, None] + np.arange(WINDOW)]


# -- the network

TAGS = 1 + len(KINDS)
PART = 4096  # windows looked at in one go
SURE = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float64)  # a window knows least at its edges


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _joined(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Overlapping spans of one kind as one."""
    out: list[tuple[str, int, int]] = []
    for k, a, z in sorted(spans):
        if out and out[-1][0] == k and a < out[-1][2]:
            out[-1] = (k, out[-1][1], max(z, out[-1][2]))
        else:
            out.append((k, a, z))
    return out


class Tagger:
    """Two LSTMs over character kinds, a linear layer to tag scores, transitions between tags."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        h = HIDDEN
        draw = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["X" + d], self.p["R" + d] = draw(N_CHARS, 4 * h), draw(h, 4 * h)
            self.p["X" + d][:, h : 2 * h] += 1.0  # remember at first
        self.p["W"], self.p["c"], self.p["A"] = draw(2 * h, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)
        self.trained = False

    def _run(self, ids: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        h = HIDDEN
        x, r = self.p["X" + d], self.p["R" + d]
        n, t = ids.shape
        out = np.empty((t, n, h), np.float32)
        hid = cell = np.zeros((n, h), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            g = x[ids[:, k]] + hid @ r
            gate, new = _sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            before, last = cell, hid
            cell = f * cell + i * new
            squashed = np.tanh(cell)
            hid = o * squashed
            out[k] = hid
            if keep is not None:
                keep.append((k, last, before, i, f, o, new, squashed))
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(characters, windows, tags)"""
        both = np.concatenate([self._run(ids, "f"), self._run(ids, "b")], axis=2)
        return both @ self.p["W"] + self.p["c"]

    def fit(self, ids: np.ndarray, tags: np.ndarray, seed: int = 9) -> "Tagger":
        r = np.random.default_rng(seed)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            rate = 0.02 * 0.7**epoch
            order = r.permutation(len(ids))
            for k in range(0, len(order), 64):
                pick = order[k : k + 64]
                step += 1
                for name, grad in self._gradient(ids[pick], tags[pick]).items():
                    m, s = moment[name]
                    grad = np.clip(grad, -1, 1)
                    m *= 0.9
                    m += 0.1 * grad
                    s *= 0.99
                    s += 0.01 * grad * grad
                    self.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        self.trained = True
        return self

    def _gradient(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        n, t = ids.shape
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(ids, d, kept[d]) for d in "fb"], axis=2)
        e = both @ self.p["W"] + self.p["c"]
        a = self.p["A"]
        # forward and backward sums of the chain
        lse = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        fw, bw = np.empty_like(e), np.zeros_like(e)
        fw[0] = e[0]
        for k in range(1, t):
            fw[k] = e[k] + lse(fw[k - 1][:, :, None] + a, 1)
        for k in range(t - 2, -1, -1):
            bw[k] = lse(a + (e[k + 1] + bw[k + 1])[:, None, :], 2)
        total = lse(fw[-1], 1)
        d_e = np.exp(fw + bw - total[:, None])
        pair = np.exp(fw[:-1, :, :, None] + a + (e[1:] + bw[1:])[:, :, None, :] - total[:, None, None])
        d_a = pair.sum(axis=(0, 1))
        gold = tags.T
        np.add.at(d_a, (gold[:-1].ravel(), gold[1:].ravel()), -1.0)
        d_e[np.arange(t)[:, None], np.arange(n)[None], gold] -= 1.0
        d_e /= n
        out = {"A": d_a / n, "W": np.einsum("tnh,tnk->hk", both, d_e), "c": d_e.sum(axis=(0, 1))}
        d_both = d_e @ self.p["W"].T
        h = HIDDEN
        for j, d in enumerate("fb"):
            x, r = np.zeros_like(self.p["X" + d]), np.zeros_like(self.p["R" + d])
            d_h = d_c = np.zeros((n, h), np.float32)
            for k, last, before, i, f, o, new, squashed in reversed(kept[d]):
                d_h = d_h + d_both[k][:, j * h : (j + 1) * h]
                d_c = d_c + d_h * o * (1 - squashed * squashed)
                g = np.concatenate([d_c * new * i * (1 - i), d_c * before * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - new * new)], axis=1)
                np.add.at(x, ids[:, k], g)
                r += last.T @ g
                d_h, d_c = g @ self.p["R" + d].T, d_c * f
            out["X" + d], out["R" + d] = x, r
        return out

    def viterbi(self, scores: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best tags of stretches that lie one after the other, each of its own transitions."""
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        out = np.zeros(len(scores), np.uint8)
        order = np.argsort(-size, kind="stable")
        a = self.p["A"].astype(np.float64)
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 2048 and (hi - lo + 1) * size[order[lo]] <= 1 << 18:
                hi += 1
            at, n = start[order[lo:hi]], size[order[lo:hi]]
            best = scores[at]
            back = np.zeros((n[0], hi - lo, TAGS), np.uint8)
            for k in range(1, n[0]):
                on = int(np.searchsorted(-n, -k))  # those longer than k
                way = best[:on, :, None] + a
                back[k, :on] = way.argmax(axis=1)
                best[:on] = way.max(axis=1) + scores[at[:on] + k]
                best[:on] -= best[:on].max(axis=1, keepdims=True)  # else sums grow with the place in the text
            tag = best.argmax(axis=1)
            for k in range(n[0] - 1, -1, -1):
                on = int(np.searchsorted(-n, -k))
                out[at[:on] + k] = tag[:on]
                if k:
                    tag[:on] = back[k, np.arange(on), tag[:on]]
            lo = hi
        return out

    def _tag_long(self, ids: np.ndarray, starts: np.ndarray) -> list[tuple[str, int, int]]:
        """A covered stretch of more windows than ``PART``: in parts, that hand on the sums of places later windows still see
        and the state of the decoding. What is decided does not depend on where the parts end."""
        chain, tags = _Chain(self.p["A"]), []
        total, weight = np.zeros((0, TAGS)), np.zeros(0)
        for a in range(0, len(starts), PART):
            s = starts[a : a + PART]
            begin, end = int(s[0]), int(min(s[-1] + WINDOW, len(ids)))
            grown = end - begin + WINDOW - len(weight)
            total, weight = np.concatenate([total, np.zeros((grown, TAGS))]), np.concatenate([weight, np.zeros(grown)])
            scores = self.emissions(_windows(ids, s))
            for j in range(WINDOW):
                total[s - begin + j] += scores[j] * SURE[j]
                weight[s - begin + j] += SURE[j]
            last = a + PART >= len(starts)
            done = end - begin if last else int(starts[a + PART]) - begin
            tags.append(chain.feed(total[:done] / weight[:done, None], last))
            total, weight = total[done : end - begin], weight[done : end - begin]
        whole, first = np.concatenate(tags).astype(np.int16), int(starts[0])
        edge = np.flatnonzero(np.diff(whole, prepend=0, append=0)).tolist()
        return [(KINDS[whole[a] - 1], first + a, first + z) for a, z in zip(edge, edge[1:]) if whole[a]]

    def spans(self, many: list[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of tagged runs of every text."""
        found: list[list[tuple[str, int, int]]] = [[] for _ in many]
        if not self.trained:
            return found
        batch: list[tuple[int, np.ndarray, np.ndarray]] = []
        waiting = 0
        for k, t in enumerate(many):
            if _HINT.search(t):
                ids = char_ids(t)
                starts = window_starts(ids)
                cut = [0, *(np.flatnonzero(np.diff(starts) > STRIDE) + 1).tolist(), len(starts)]
                for a, z in zip(cut, cut[1:]):
                    if z - a > PART:
                        found[k] += self._tag_long(ids, starts[a:z])
                        continue
                    batch.append((k, ids, starts[a:z]))
                    waiting += z - a
                    if waiting >= PART:
                        self._tag(batch, found, many)
                        batch, waiting = [], 0
        self._tag(batch, found, many)
        return [_joined(f) for f in found]

    def _tag(self, batch, found, many) -> None:
        if not batch:
            return
        scores = self.emissions(np.concatenate([_windows(ids, s) for _, ids, s in batch]))
        offset, stretches, places = 0, [], []
        for k, ids, s in batch:
            new = np.flatnonzero(np.diff(s) > STRIDE) + 1
            for a, z in zip([0, *new], [*new, len(s)]):
                length = int(min(s[z - 1] + WINDOW, len(ids)) - s[a])
                stretches.append((k, int(s[a]), length))
            first = np.repeat(s[[0, *new]], np.diff([0, *new, len(s)]))
            base = np.cumsum([0] + [x[2] for x in stretches[len(stretches) - len(new) - 1 :]][:-1]) + offset
            places.append(np.repeat(base, np.diff([0, *new, len(s)])) + s - first)
            offset += sum(x[2] for x in stretches[len(stretches) - len(new) - 1 :])
        place = np.concatenate(places)
        limit = np.repeat(np.cumsum([x[2] for x in stretches]), [1] * len(stretches))
        own = np.searchsorted(limit, place, "right")
        total, weight = np.zeros((offset + WINDOW, TAGS)), np.zeros(offset + WINDOW)
        for j in range(WINDOW):
            ok = place + j < limit[own]
            at = place[ok] + j
            np.add.at(total, at, scores[j][ok] * SURE[j])
            np.add.at(weight, at, SURE[j])
        size = np.array([x[2] for x in stretches])
        tags = self.viterbi(total[:offset] / np.maximum(weight[:offset, None], 1e-6), size)
        turn = np.flatnonzero(np.diff(tags.astype(np.int16), prepend=0, append=0))
        edge = np.union1d(turn, np.concatenate([[0], np.cumsum(size)]))
        ends = np.cumsum(size)
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if a < offset and tags[a]:
                i = int(np.searchsorted(ends, a, "right"))
                k, begin, length = stretches[i]
                shift = begin - (int(ends[i]) - length)
                found[k].append((KINDS[tags[a] - 1], a + shift, z + shift))


class _Chain:
    """Viterbi over scores that come in parts: tags are given out once every way that can still win agrees on them."""

    def __init__(self, a: np.ndarray):
        self.a, self.best, self.back = a.astype(np.float64), None, []

    def feed(self, scores: np.ndarray, last: bool) -> np.ndarray:
        for row in scores:
            if self.best is None:
                self.best = row
                continue
            way = self.best[:, None] + self.a
            self.back.append(way.argmax(axis=0).astype(np.uint8))
            self.best = way.max(axis=0) + row
            self.best = self.best - self.best.max()
        now, at, late = np.array([self.best.argmax()]) if last else np.arange(TAGS), len(self.back), []
        while at and (now != now[0]).any():
            at -= 1
            now = self.back[at][now]
        if last:
            late = [int(now[0])]
        for k in range(at - 1, -1, -1):
            now = self.back[k][now]
            late.append(int(now[0]))
        self.back = self.back[at:]
        return np.array(late[::-1], dtype=np.uint8)


_LEAST = {"email": re.compile(r"\S@\S+\.\S"), "ip": re.compile(r"(?:[0-9]+\D{1,3}){3}[0-9]"), "card": re.compile(r"(?:[0-9]\D?){12}"), "phone": re.compile(r"(?:[0-9]\D{0,2}){7}")}


def all_spans(tagger: Tagger, many: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, found by a pattern) for every text: all pattern spans, and the network's where no pattern's is
    and that hold what their kind needs at least; by start, then kind as listed."""
    out = []
    for text, tagged in zip(many, tagger.spans(many)):
        base = [(k, a, z, True) for _, k, a, z in base_spans(text)]
        more = []
        for k, a, z in tagged:
            said = text[a:z]
            a += len(said) - len(said.lstrip())
            z -= len(said) - len(said.rstrip())
            if a >= z or not _LEAST[k].search(text, a, z) or any(x[1] < z and a < x[2] for x in base):
                continue
            if k == "card" and not luhn("".join(_DIGITS.findall(text[a:z]))):
                continue
            more.append((k, a, z, False))
        out.append(sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))
    return out


def training_windows(many: list[str], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the texts with the tags of their pattern spans, and rewritten ones; at most ``TRAIN_WINDOWS``."""
    r = np.random.default_rng(seed)
    ids, tags = [], []

    def add(text: str, spans) -> None:
        i = char_ids(text)
        t = np.zeros(len(i) + WINDOW, np.uint8)
        for _, kind, a, z in spans:
            t[a:z] = 1 + KINDS.index(kind)
        s = window_starts(i)
        if len(s):
            ids.append(_windows(i, s))
            tags.append(t[s[:, None] + np.arange(WINDOW)])

    for text in many:
        spans = base_spans(text)
        add(text, spans)
        for _, kind, a, z in spans[:4]:
            said = text[a:z]
            if kind == "phone":
                said = said.lstrip("+") if r.random() < 0.5 else said.replace("-", " ").replace(".", " ")
            elif kind == "card":
                said = re.sub(r"[ -]", r.choice([".", "-", " "]), said)
            elif kind == "ip":
                said = said.replace(".", r.choice([" . ", ".", ","]))
            left, right = text[max(0, a - 40) : a], text[z : z + 40]
            add(left + said + right, [(0, kind, len(left), len(left) + len(said))])
    if not ids:
        return np.zeros((0, WINDOW), np.uint8), np.zeros((0, WINDOW), np.uint8)
    i, t = np.concatenate(ids), np.concatenate(tags)
    # windows with spans first, as many without
    has = t.any(axis=1)
    full, none = np.flatnonzero(has), np.flatnonzero(~has)
    pick = np.concatenate([r.permutation(full)[: TRAIN_WINDOWS // 2], r.permutation(none)[: TRAIN_WINDOWS // 2]])
    return i[pick], t[pick]


def fit_tagger(docs: DataFrame, sample: int = SAMPLE_TEXTS) -> Tagger:
    """The network fitted on the pattern spans of at most ``sample`` texts, chosen by a hash of the id."""
    some = hash_share(F.coalesce(F.col("doc_id"), F.lit(0)), SHARE * sample, docs.count())
    rows = texts(docs).where(some & F.col("text").rlike("[0-9@]"))
    got = rows.orderBy(F.xxhash64(F.col("doc_id")), F.col("doc_id"), F.col("text")).limit(sample).collect()
    i, t = training_windows([x.text for x in got])
    return Tagger().fit(i, t) if t.any() else Tagger()


_SPAN_TYPE = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
)
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

def pii_finder(spark: SparkSession, tagger: Tagger):
    """A column function: text -> array<struct<kind, start, end, base>>, in code points, end exclusive.

    Spans with ``base`` come from the patterns, the others from the network. Missing and empty texts have none."""
    shared = spark.sparkContext.broadcast(tagger)

    @F.arrow_udf(_SPAN_TYPE)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in portions(batches):
            out = all_spans(shared.value, [x or "" for x in b.to_pylist()])
            yield pa.array([[{"kind": k, "start": a, "end": z, "base": f} for k, a, z, f in s] for s in out], _SPAN)

    return find


def masked(text, spans):
    """The text with every span replaced by its kind in brackets; spans must not overlap."""
    parts = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.concat(a["done"], F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("done"),
            s["end"].alias("at"),
        ),
    )
    return F.concat(parts["done"], F.substring(text, parts["at"].cast("int") + 1, F.char_length(text)))
