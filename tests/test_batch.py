"""Many questions at once give what each question gives alone, without any task that sees all hits of one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import batch as B, retrieval as R
from lectern.plans import indexes
from lectern.plans.registry import _chunks, _vectors

FIELDS = {"section_title": 4.0, "content": 1.0}


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "re ing", [1.0] * 64, None), (2, "the of", [0.5] * 64, ["1", "2"]), (3, "  Re, RE! ", [float(i % 3) - 1 for i in range(64)], ["src1", "3"]), (4, None, None, None), (5, "nosuchword re", [0.0] * 64, []), (6, "en", [-1.0] * 64, ["src0", "src2"])]
    return spark.createDataFrame(rows, "question_id long, question string, embedding array<double>, document_ids array<string>")


def by_question(df):
    out = {}
    for r in df.orderBy("question_id", "rank").collect():
        out.setdefault(r["question_id"], []).append((r["rank"], r["chunk_id"], round(r["score"], 6)))
    return out


def test_vectors_as_one_by_one(spark, sf, asked, monkeypatch):
    monkeypatch.setattr(B, "QUESTIONS", 2)  # several scans
    monkeypatch.setattr(B, "VECTORS", 100)
    stored = _vectors(spark, sf)
    stored = stored.unionByName(stored.filter("chunk_id < '3'").withColumn("chunk_id", F.concat(F.lit("copy"), "chunk_id"))).unionByName(spark.createDataFrame([("none", "1", None)], stored.schema))
    for above in (0.0, None):
        found = by_question(B.vector_hits(stored, asked, 7, above, digits=6))
        for q in asked.filter("embedding IS NOT NULL").collect():
            alone = R.vector_search(stored, list(q["embedding"]), 7, q["document_ids"], above, 6).orderBy("rank").collect()
            assert found.get(q["question_id"], []) == [(r["rank"], r["chunk_id"], round(r["score"], 6)) for r in alone], (above, q)


def test_keywords_as_one_by_one(spark, sf, asked):
    source = R.index_source(_chunks(spark, sf))
    index = R.postings(source, list(FIELDS))
    found = by_question(B.keyword_hits(index, R.field_statistics(index), asked, 20, FIELDS, digits=6))
    for q in asked.collect():
        alone = R.bm25_search(source, q["question"] or "", 20, q["document_ids"], FIELDS, 6).orderBy("rank").collect()
        assert found.get(q["question_id"], []) == [(r["rank"], r["chunk_id"], round(r["score"], 6)) for r in alone], q


def test_keywords_from_texts_as_from_postings(spark, sf, asked):
    source = R.index_source(_chunks(spark, sf))
    index = R.postings(source, list(FIELDS))
    want = by_question(B.keyword_hits(index, R.field_statistics(index), asked, 20, FIELDS, digits=6))
    assert want and by_question(B.text_hits(source, asked, 20, FIELDS, digits=6)) == want
    free = asked.drop("document_ids")
    assert by_question(B.text_hits(source, free, 5, FIELDS, digits=6)) == by_question(B.keyword_hits(index, R.field_statistics(index), free, 5, FIELDS, digits=6))
    assert B.text_hits(source, asked.limit(0), 5, FIELDS).count() == 0


@pytest.mark.parametrize("name", ["bm25_batch", "hybrid_batch"])
def test_batches_store_and_shuffle_no_postings_and_no_texts(spark, sf, monkeypatch, name):
    kept, made = indexes.stores.kept, []

    def watched(rows, name):
        made.append(rows)
        return kept(rows, name)

    monkeypatch.setattr(indexes.stores, "kept", watched)
    made.append(getattr(indexes, name)(spark, sf))
    for rows in made:
        assert not {"text", "words", "tf", "dl"} & set(rows.columns)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan


def test_fusion_as_one_by_one(spark, sf, asked):
    chunks = _chunks(spark, sf)
    v = B.vector_hits(_vectors(spark, sf).drop("document_id").join(chunks.select("chunk_id", "document_id"), "chunk_id"), asked.drop("document_ids"), 20, digits=6)
    index = R.postings(R.index_source(chunks), list(FIELDS))
    k = B.keyword_hits(index, R.field_statistics(index), asked.drop("document_ids"), 20, FIELDS, 6)
    found = B.hybrid_hits(v, k, chunks, 5, digits=6).orderBy("question_id", "rank").collect()
    for q in (1, 2, 3):
        side = lambda df: df.filter(F.col("question_id") == q).drop("question_id", "document_id").join(chunks, "chunk_id")  # noqa: E731, B023
        alone = R.hybrid_search(side(v), side(k), 5, digits=6).orderBy("rank").collect()
        assert [(r["rank"], r["chunk_id"], r["score"], r["retrieval_mode"]) for r in found if r["question_id"] == q] == [(r["rank"], r["chunk_id"], r["score"], r["retrieval_mode"]) for r in alone]


def test_no_task_sees_all_hits_of_a_question(spark, sf):
    """Ranks are limited before rows travel: no full window, no single partition."""
    plan = indexes.hybrid_batch(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") > 0 and "WindowGroupLimit" in plan and "SinglePartition" not in plan


def test_empty_sides(spark, sf, asked):
    none = asked.limit(0)
    index = R.postings(R.index_source(_chunks(spark, sf)), list(FIELDS))
    v, k = B.vector_hits(_vectors(spark, sf), none), B.keyword_hits(index, R.field_statistics(index), none)
    assert v.count() == k.count() == B.hybrid_hits(v, k, _chunks(spark, sf), 5).count() == 0
    best = B._Best(3)
    best.meet(np.array([0.5, 0.5, 0.5, 0.7]), np.array(["c", "b", "d", "z"], object))
    best.meet(np.array([0.5, 0.1]), np.array(["a", "e"], object))
    assert best.ids.tolist() == ["z", "a", "b"]
