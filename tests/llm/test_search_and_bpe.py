"""Benchmark search and byte-level BPE against brute force."""

from __future__ import annotations

import base64
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from muletrace.llm import bpe, decontaminate
from tests.llm import fixtures

ITEMS = [("1", "a b c d e f g h i j k l m n o p"), ("2", "Kurz hier"), ("2", "e f g h i j k l m n o p q r"), ("10", None), ("11", "!?"), (None, "nur ein, Wort")]


def _words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _brute(text, items):
    w, hit, found = _words(text), set(), set()
    for item, said in items:
        b = _words(said)
        size = min(13, len(b))
        for k in range(len(b) - size + 1) if size else ():
            for at in range(len(w) - size + 1):
                if w[at : at + size] == b[k : k + size]:
                    hit |= set(range(at, at + size))
                    found.add(item or "")
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("pack", [decontaminate.PACK_BYTES, 100, 20])
def test_hits(spark, tmp_path, monkeypatch, pack):
    monkeypatch.setattr(decontaminate, "PACK_BYTES", pack)
    r = random.Random(6)
    data = [x for x in fixtures.rows() if x[0] not in (154, 155)]
    letters = "a b c d e f g h i j k l m n o p q r kurz hier nur ein wort".split()
    data += [(200 + k, " ".join(r.choice(letters) for _ in range(60))) for k in range(30)]
    data += [(240, "x " * 300 + ITEMS[0][1].upper() + ", " + ITEMS[2][1]), (241, ("A-b, c " * 3 + ITEMS[0][1] + "\n") * 40), (242, "Kurz hier")]
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = decontaminate.with_hits(fixtures.stored(spark, tmp_path / "d", data), bench)
    assert docs.columns[:-1] == fixtures.documents(spark, []).columns
    got = sorted(((x.doc_id, x.text, x.hits.n_words, x.hits.n_hit, list(x.hits["items"])) for x in docs.collect()), key=repr)
    want = sorted(((i, t, *_brute(t, ITEMS)) for i, t in data), key=repr)
    assert got == want
    bad = {x.doc_id for x in docs.where(decontaminate.contaminated(F.col("hits"))).collect()}
    assert {240, 241, 242} <= bad and 0 not in bad


def test_an_empty_benchmark_hits_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.with_hits(fixtures.documents(spark), bench).select("hits.n_hit", "hits.n_words").collect()
    assert {r.n_hit for r in got} == {0} and max(r.n_words for r in got) == 30_001


def _tiktoken():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_agrees_with_the_library():
    theirs = _tiktoken()
    mine = bpe.Encoder(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    r = random.Random(8)
    said = ["".join(r.choice(r.choice(["ab", "aaaa", "theingnd ", "é漢 \n\t", "🙂 x1234", "...!!<|endoftext|>"])) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    said += ["", "a" * 20_000, "".join(r.choice("abcdeth") for _ in range(20_000)), " " * 3000]
    for k in range(0, len(said), 100):
        for text, packed in zip(said[k : k + 100], mine.encode(said[k : k + 100])):
            assert np.frombuffer(packed, "<u4").tolist() == theirs.encode_ordinary(text)
            assert mine.decode(packed) == text.encode()


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    e = bpe.Encoder(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    first = e.encode(["one two three"])
    e.encode([" ".join(f"w{k}x" for k in range(200))])
    assert len(e.known) <= 50 and e.encode(["one two three"]) == first


def test_columns(spark):
    theirs = _tiktoken()
    coder = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = fixtures.documents(spark).withColumn("ids", coder.encode(F.col("text")))
    for x in got.select("text", "ids", coder.decode(F.col("ids")).alias("back"), bpe.n_tokens(F.col("ids")).alias("n")).collect():
        ids = theirs.encode_ordinary(x.text or "")
        assert np.frombuffer(x.ids, "<u4").tolist() == ids and x.n == len(ids) and x.back.decode() == (x.text or "")
