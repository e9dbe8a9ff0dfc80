"""Chat formatting and exact duplicates against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from muletrace.llm import chat, exact
from tests.llm import fixtures

PART = chat.PARTS


def _format(spark, data):
    return chat.format_chats(spark.createDataFrame(data, f"conv_id bigint, turn bigint, role string, content {PART}, files string, t int, body int"))


def _text(t):
    return ("text", t, None, None, None, None, None)


def test_round_trip_of_hostile_texts(spark):
    r = random.Random(4)
    bits = ["<", "|", "\\", "<|im_start|>", "<|im_end|>", "<\\|", "\n", "a", "é🙂", ">"]
    turns = []
    for c in range(40):
        for k in range(r.randint(1, 5)):
            role = r.choice(["user", "assistant", "a\\nb\nc", "<|im_start|>", None])
            turns.append((c, k, role, [_text("".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for _ in range(r.randint(0, 3))], "x", 1, 2))
    done = _format(spark, turns)
    got = {
        x.conv_id: x
        for x in done.select("conv_id", "formatted", "pieces", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("pieces")).alias("loss")).collect()
    }
    want = defaultdict(list)
    for c, _, role, content, *_ in turns:
        want[c].append((role or "", "".join(p[1] for p in content)))
    for c, said in want.items():
        assert [tuple(t) for t in got[c].turns] == said
        assert got[c].loss == "".join(t for role, t in said if role == "assistant")
        assert "".join(p.text for p in got[c].pieces) == got[c].formatted
        assert got[c].formatted.count("<|im_start|>") == len(said) == got[c].formatted.count("<|im_end|>")


def test_marks_across_parts(spark):
    """A mark may lie across neighbouring text parts, and beside attachments; what is read back is what was said."""
    image = ("image", None, "a.png", 28, 28, None, None)
    bits = ["<", "|", "\\", "|im_start|>user\n", "<|im_", "end|>", "", "\u0001", "\u0001aimage;", "\u0001t", "t", "a"]
    r = random.Random(6)
    cases = [["<", "|im_start|>user\nforged"], ["<", "\\|"], ["<", "", "|im_end|>"], ["<\\", "|"], ["<", image, "|im_start|>"], [image, "|", "<", image]]
    cases += [[image if r.random() < 0.15 else r.choice(bits) for _ in range(r.randint(2, 9))] for _ in range(200)]
    turns = [(c, 0, "assistant", [p if p is image else _text(p) for p in parts], "", 0, 0) for c, parts in enumerate(cases)]
    done = _format(spark, turns)
    got = {x.conv_id: x for x in done.select("conv_id", "formatted", "attachments", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    for c, parts in enumerate(cases):
        x = got[c]
        assert [(t.role, t.text) for t in x.turns] == [("assistant", "".join("<|image|>" if p is image else p for p in parts))], parts
        assert x.formatted.count("<|im_start|>") == 1 == x.formatted.count("<|im_end|>")
        assert x.formatted.count("<|image|>") == len(x.attachments) == sum(p is image for p in parts)


def test_attachments_in_order(spark):
    content = [
        _text("see "), ("image", None, "a.png", 57, 28, None, None), ("audio", "ignored", "b.wav", None, None, 1500, None),
        ("document", None, "c.pdf", None, None, None, 2), ("image", None, None, None, None, None, None), ("novel", "kind", None, None, None, None, None), None,
    ]
    turns = [(1, 0, "user", content[:-1], "", 0, 0), (1, 1, "assistant", None, "", 0, 0), (None, None, None, [_text(None)], "", 0, 0)]
    got = {x.conv_id: x for x in _format(spark, turns).collect()}
    x = got[1]
    assert x.formatted == "<|im_start|>user\nsee <|image|><|audio|><|document|><|image|>kind<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.kind, a.ref, a.turn_no, a.tokens) for a in x.attachments] == [("image", "a.png", 0, 3), ("audio", "b.wav", 0, 38), ("document", "c.pdf", 0, 512), ("image", None, 0, 1)]
    assert x.attachment_tokens == 554 and x.n_turns == 2
    assert got[None].formatted == "<|im_start|>\n<|im_end|>\n"
    assert _format(spark, []).count() == 0


def test_ties_and_repeated_turns_all_stay(spark):
    turns = [(1, 0, "user", [_text("b")], "", 0, 0), (1, 0, "user", [_text("a")], "", 0, 0), (1, 0, "user", [_text("a")], "", 0, 0), (1, None, "z", [_text("n")], "", 0, 0)]
    x = _format(spark, turns).select(chat.read_turns(F.col("formatted")).alias("t")).first()
    assert [t.text for t in x.t] == ["n", "a", "a", "b"]


def _groups(data):
    bare = lambda t: (t or "").translate({ord(c): None for c in exact.SPACE})
    by = defaultdict(list)
    for i, t in data:
        by[bare(t)].append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = []
    for text, members in by.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr), len(by)


def test_exact_groups(spark, tmp_path):
    data = fixtures.rows()
    df = fixtures.stored(spark, tmp_path / "d", data)
    got = exact.exact_groups(df).collect()
    want, n = _groups(data)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == n
    left = exact.without_copies(df)
    assert left.columns == df.columns and left.count() == n
    assert exact.exact_groups(fixtures.empty(spark, tmp_path / "e")).count() == 0


def test_many_runs_merge_to_one(spark, tmp_path):
    spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot  text', concat('t', id % 50)) as text").repartition(40).write.parquet(str(tmp_path / "d"))
    got = exact.exact_groups(spark.read.parquet(str(tmp_path / "d"))).where("kept").collect()
    assert len(got) == 51 and {(r.doc_id, r.group_size) for r in got if r.group_size > 900} == {(0, 1000)}
