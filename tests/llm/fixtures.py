"""Small document tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

LONG = " ".join(f"wort{k % 977}" for k in range(30_000))
PASSAGE = " ".join(f"passage{k * k % 89}" for k in range(60))


def rows(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    say = lambda n: " ".join("".join(r.choice("abcdeioutrns") for _ in range(r.randint(2, 9))) for _ in range(n))
    base = [say(r.randint(3, 120)) for _ in range(30)]
    out = [(k, t) for k, t in enumerate(base)]
    out += [(100 + k, base[k]) for k in range(5)]  # exact copies
    out += [(120 + k, base[k].replace(" ", "\n ")) for k in range(3)]  # equal but for white space
    out += [(130 + k, say(20) + " " + PASSAGE + " " + say(20)) for k in range(6)]
    out += [(150, None), (151, ""), (152, " \t\n "), (153, "ein"), (154, LONG), (155, LONG + " ende"), (None, "nameless text of no id"), (None, None)]
    out += [(156, "é漢字🙂 " * 40), (156, "é漢字🙂 " * 40), (157, "x" * 5000), (158, "aaaa " * 300)]
    r.shuffle(out)
    return out


def documents(spark, data: list[tuple] | None = None):
    """With extra columns named like the operators' own."""
    data = rows() if data is None else data
    wide = [(i, t, "r", 1, "k", 0.5, "q") for i, t in data]
    return spark.createDataFrame(wide, "doc_id bigint, text string, row string, size int, key string, score double, items string").repartition(3)


def stored(spark, folder, data: list[tuple] | None = None):
    """The same, read from files, as the operators that read a table twice need it."""
    documents(spark, data).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def empty(spark, folder):
    return stored(spark, folder, [])
