"""Every pipeline stage on awkward documents: missing, empty and long texts, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from muletrace.llm import decontaminate
from tests.llm import fixtures

STAGES = dict(corpus_pipeline.STAGES)
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    data = fixtures.rows() + [(400, ITEM), (400, ITEM), (401, ITEM + " tail" * 400)]
    fixtures.stored(spark, at / "documents.parquet", data)
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 160)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([("b", ITEM), (None, None), ("e", "")], "item_id string, text string").write.parquet(str(at / "benchmark.parquet"))
    fixtures.empty(spark, at / "none")
    return str(at)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_awkward_documents(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = STAGES[name](spark, docs, folder)
    rows = _rows(got)
    none = STAGES[name](spark, spark.read.parquet(f"{folder}/none"), folder)
    assert none.count() == 0 and none.columns == got.columns
    if name == "byte_bpe":
        assert sorted((r[0] is None, r[0] or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
        assert all(r[1] == 0 for r in rows if r[0] in (150, 151))
        return
    assert got.columns == docs.columns
    before = _rows(docs)
    assert all(before.count(r) >= rows.count(r) for r in rows)  # rows of the input, none changed, none more often
    if name == "quality":  # equal rows stay or go together
        assert all(rows.count(r) == before.count(r) for r in rows)
    if name == "exact_dedup":
        bare = lambda t: "".join((t or "").split())
        assert sorted(bare(r[1]) for r in rows) == sorted({bare(r[1]) for r in before})
    if name == "decontamination":
        assert [r for r in before if r not in rows] == [r for r in before if r[0] == 400]
        # read back, rows keep their numbers however often the table is read
        small = decontaminate.PACK_BYTES
        try:
            decontaminate.PACK_BYTES = 8
            assert _rows(STAGES[name](spark, docs, folder)) == rows
        finally:
            decontaminate.PACK_BYTES = small
    if name == "near_dedup":
        assert len({r[0] for r in rows}) == len(rows)
