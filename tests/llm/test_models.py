"""Patterns against brute force; trained models by held-out accuracy on labelled texts; the pipeline stage by stage."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from muletrace.llm import base, pii, quality, queries, toxicity
from tests.llm import fixtures

SF = "/root/testdata/sf0.01"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def _base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(a, pii.KINDS[k], a, z) for a, k, z in sorted(out)]


def test_patterns():
    r = random.Random(3)
    bits = ["1", "2.", "@", "a", "b.", "-", " ", "+1", "(", ")", "4111111111111111", "255.", "é", "%", "0007"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == _base(text), text
    for hostile in ("1" * 200_000, "a." * 100_000 + "@", "+1" + "(" * 200_000, "a@" * 100_000, "1.2.3." * 50_000):
        pii.base_spans(hostile)


def _private(r):
    say = lambda n: " ".join("".join(r.choice("abcdeioutrns") for _ in range(r.randint(2, 8))) for _ in range(n))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    made = {
        "email": lambda: f"{say(1)}.{digits(2)}@mail{digits(1)}.example.com",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
        "card": lambda: next(c for c in iter(lambda: digits(16), "") if _luhn(c)),
    }
    return say(15) + " " + " ".join(made[k]() + " " + say(8) for k in r.sample(sorted(made), 3)) + " in " + digits(4)


def test_tagger_learns_what_it_is_shown_and_adds_to_it():
    r = random.Random(5)
    ids, tags = pii.training_windows([_private(r) for _ in range(500)])
    tagger = pii.Tagger().fit(ids, tags)
    many = [_private(r) for _ in range(80)] + ["", "no digits here"]
    base_ = {(k, *s[1:]) for k, t in enumerate(many) for s in pii.base_spans(t)}
    got = {(k, *s) for k, f in enumerate(tagger.spans(many)) for s in f}
    assert len(base_ & got) > 0.85 * len(base_) and len(got - base_) < 0.15 * len(base_)
    assert tagger.spans(many) == [tagger.spans([t])[0] for t in many]  # whatever is read together
    spans = pii.all_spans(tagger, ["call 1 (555) 555-0199 or write " + "x" * 90 + " to me@mail.example.com now"])[0]
    assert ("email", True) in {(s[0], s[3]) for s in spans}
    joined = pii.all_spans(tagger, many)
    assert all({s[1:] for s in pii.base_spans(t)} <= {s[:3] for s in f} for t, f in zip(many, joined))


def test_very_long_texts_are_tagged_across_parts():
    r = random.Random(7)
    ids, tags = pii.training_windows([_private(r) for _ in range(300)])
    tagger = pii.Tagger().fit(ids, tags)
    one = " ".join(_private(r) for _ in range(1500))
    base_ = {s[1:] for s in pii.base_spans(one)}
    assert len(base_ & set(tagger.spans([one])[0])) > 0.8 * len(base_)


def test_pii_query_over_awkward_rows(spark, tmp_path):
    data = fixtures.rows() + [(300, "mail a.b@c.de, 10.0.0.1 and +49 30 1234567"), (301, "+49 30 1234567 a.b@c.de")]
    fixtures.stored(spark, tmp_path / "documents.parquet", data)
    got = {r.doc_id: r for r in queries.op2_pii(spark, str(tmp_path)).collect()}
    assert got[300].spans == "email:5:13,ip:15:23,phone:28:42" and got[300].n_email == 1 == got[300].n_phone
    assert got[150].spans == "" and got[150].n_card == 0
    find = pii.pii_finder(spark, pii.Tagger())
    df = fixtures.documents(spark, [(1, "mail a.b@c.de now")]).select(pii.masked("text", find("text")).alias("m"))
    assert df.first().m == "mail [email] now"


@pytest.mark.parametrize("name,label,least", [("op3_toxicity", "toxic", 0.95), ("op4_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF)
    labels = base.table(spark, SF, "labels").select("doc_id", label)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    assert got.count() == base.table(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got.collect())


def test_models_without_labels_still_score(spark, tmp_path):
    docs = fixtures.stored(spark, tmp_path / "documents.parquet")
    none = spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for model, scorer in ((quality.fit_quality(docs, none), quality.quality_scorer), (toxicity.fit_toxicity(docs, none), toxicity.toxicity_scorer)):
        got = docs.select(scorer(spark, model)(F.col("text")).alias("s")).collect()
        assert len(got) == docs.count() and all(0 <= r.s <= 1 for r in got)


def test_kernel_bridges_gaps():
    r = random.Random(2)
    say = lambda n: " ".join("".join(r.choice("abcdeioutrns") for _ in range(r.randint(3, 8))) for _ in range(n))
    bad = ["dolt", "blockhead", "nitwit", "rotter"]
    texts = [say(40) + f" {r.choice(bad)} " + say(20) + f" {r.choice(bad)} " + say(9) for _ in range(150)] + [say(70) for _ in range(300)]
    model = toxicity.ToxicityModel().fit(texts, [1] * 150 + [0] * 300)
    p = model.scores([say(20) + f" {w} and {w} " + say(20) for w in ("blockhead", "block-head", "b l o c k h e a d", "n.i.t.w.i.t", "nitwwit", "rotterish")])
    assert (p > 0.5).all(), p
    assert (model.scores([say(60) for _ in range(60)]) > 0.5).mean() < 0.1
    one, two = toxicity.Listed(["blockhead", "block-head", "window"]), np.eye(3)[0]
    near = one.dot(one.spread(two))
    assert near[0] > near[1] > near[2]


def test_spelled_runs_are_whole():
    """Letters spelled one by one: long runs, wide separators, line ends, and behind lists of single characters."""
    insult = "you are such a totally hopeless idiot"
    got = toxicity.strings(" ".join(insult.replace(" ", "")))
    assert all(any(w in s for s in got) for w in ("youare", "hopeless", "idiot"))
    assert max(map(len, got)) <= toxicity.LONGEST
    for spelled in ("i - d - i - o - t", "i\nd\ni\no\nt", "i...d...i...o...t", "(i d i o t)", "i. d. i. o. t."):
        assert "idiot" in toxicity.strings(f"well then {spelled} there"), spelled
    assert any("idiot" in s for s in toxicity.strings(" ".join("1234567890" * 3) + " i d i o t"))
    assert toxicity.strings("don't a b") == ["don't"] and toxicity.strings("") == []
    r = random.Random(2)
    say = lambda n: " ".join("".join(r.choice("abcdeioutrns") for _ in range(r.randint(3, 8))) for _ in range(n))
    bad = ["dolt", "blockhead", "nitwit", "rotter"]
    texts = [say(40) + f" {r.choice(bad)} " + say(20) + f" {r.choice(bad)} " + say(9) for _ in range(150)] + [say(70) for _ in range(300)]
    model = toxicity.ToxicityModel().fit(texts, [1] * 150 + [0] * 300)
    for way in (" ", " - ", "\n", " \n- "):
        p = model.scores([say(20) + f" {way.join('blockhead')} and {way.join('nitwit')} " + say(20)])
        assert (p > 0.5).all(), (way, p)


def test_pipeline_stages(spark, tmp_path):
    docs = base.table(spark, SF, "documents")
    columns = docs.columns
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}"))
        left = spark.read.parquet(str(tmp_path / f"{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert left.columns == columns
            assert left.join(docs, columns, "left_semi").count() == left.count()
        sizes.append(left.count())
        if name == "decontamination":
            clean = {r.doc_id for r in left.collect()}
            hits = queries.op6_decontamination(spark, SF).where("not contaminated").select("doc_id").collect()
            assert clean == {r.doc_id for r in docs.collect()} & {r.doc_id for r in hits}
        docs = left
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 500
    run = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256")
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect()))
