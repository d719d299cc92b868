import corpus_pipeline
import pytest
from lectern.llm import stages
from lectern.llm.common import word_count
from pyspark.sql import functions as F


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    known = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns and docs.count() > 0
        if name in ("quality", "near_dedup"):
            assert docs.count() <= before and all(known[r.doc_id] is not None for r in docs.collect())
        if name == "line_dedup":
            assert docs.count() == before and docs.filter("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    whole = packed.agg(F.sum("length")).first()[0]
    assert whole >= docs.select(word_count(F.col("text")).alias("w")).agg(F.sum("w")).first()[0]


def test_clean_documents_stay(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = stages.keep_good(spark, docs, sf)
    good = labels.filter("quality = 1")
    assert kept.join(good, "doc_id").count() >= 0.97 * docs.join(good, "doc_id").count()


def test_near_duplicates_leave_one(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(80))
    out = stages.keep_one_of_near(spark, make_docs(text, text, text + " more", "other words entirely in this one", ids=[4, 2, 9, 1]), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_mixing_repeats_and_drops(spark, make_docs):
    docs = make_docs(*["a b c"] * 10, *["x y z"] * 30, sources=["a"] * 10 + ["b"] * 30)
    out = stages.mix_sources(spark, docs, "")
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("n")).collect()}
    assert words["a"] == 60 and out.columns == docs.columns and max(r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()) <= 2


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


NAMES = "score predicted held_out n_lines n_removed_lines n_removed_chunks node digest known id class_id kept copies rows alike nth copy share text_hash c_id of h size row carried".split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_with_nulls_repeats_long_texts_clashes_and_nothing(spark, make_docs, sf, name):
    """Names of an operator's own columns pass by unchanged; an empty table gives no rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    texts = [None, "", "some words that stand here, and more of them.", "some words that stand here, and more of them.", "long words of a text " * 20_000, "one\ntwo\nthree", "one\ntwo\nthree", "x"]
    docs = make_docs(*texts, sources=["a", None, "a", "b", "b", None, "a", "a"], ids=[1, None, 3, 3, 5, 6, 7, None]).withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES})
    out = stage(spark, docs, sf)
    rows = out.collect()
    assert stage(spark, docs.limit(0), sf).count() == 0
    if name == "packing":
        assert {r.doc_id for r in rows} == {1, None, 3, 5, 6, 7}
        return
    assert out.columns == docs.columns and rows
    for r in rows:
        assert all(r[n] == n + ("-" if r.doc_id is None else str(r.doc_id)) for n in NAMES)
        assert r.text is None or name == "line_dedup" or r.text in texts
    if name == "line_dedup":
        assert len(rows) == len(texts) and sum(r.text is None for r in rows) == 1
    if name == "near_dedup":
        assert sorted((r.text or "")[:5] for r in rows) == ["", "long ", "one\nt", "some ", "x"]
    if name == "mixing":
        assert {r.text for r in rows} <= set(texts)
