import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import identity, retrieval as R
from lectern.functions import patterns as P, text as T

HIT = "rank int, score double, text string, chunk_id string, document_id string, chunk_index int, section_title string"
A = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def hits(spark, *ids, text=None):
    return spark.createDataFrame([(i + 1, 1.0 - i / 10, text or f"text of {c} alone", c, f"doc{c}", i * 10, "") for i, c in enumerate(ids)], HIT)


def test_fusion_order(spark):
    out = R.hybrid_search(hits(spark, "A", "B", "C"), hits(spark, "C", "A", "F"), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["A", "C", "B"] and (out[0].vector_rank, out[0].keyword_rank) == (1, 2) and out[0].score <= 1


def test_redundant_neighbours_are_left_out(spark):
    v = spark.createDataFrame([(1, 0.9, A, "A", "d", 0, ""), (2, 0.8, A + " nu", "A2", "d", 1, ""), (3, 0.7, "something else entirely in this one", "B", "d", 9, "")], HIT)
    out = R.hybrid_search(v, hits(spark, "A"), 2).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["A", "B"]


def test_fallback(spark):
    v = spark.createDataFrame([(1, 0.91, "t", "A", "d", 0, "")], HIT)
    out = R.hybrid_search(v, v.limit(0), 1).collect()
    assert len(out) == 1 and out[0].retrieval_mode == "vector" and out[0].score == 0.91


def test_requests():
    for bad in (0, 21):
        with pytest.raises(ValueError):
            R.checked_top_k(bad)
    assert R.checked_top_k(None) == 5
    for ids in ([], ["a", "b", "c", "d"], ["a", "a"], [None]):
        with pytest.raises(ValueError):
            R.checked_document_ids(ids)
    with pytest.raises(ValueError):
        R.checked_question("  ")


def test_overlap(spark):
    df = spark.createDataFrame([(A, A + " nu"), ("a b", "A  b!"), ("a b", "a c"), (A, "x")], "a string, b string")
    assert [r[0] for r in df.select(T.text_overlap(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0, 0.0]


def test_lexical_failure_and_stop_words(spark):
    schema = "chunk_id string, document_id string, score double, rank int"

    def broken():
        raise RuntimeError

    assert R.degraded(broken, schema, spark).isEmpty()
    assert R.query_terms("The of AND") == []


def test_hits_are_parsed(spark):
    body = '{"hits":{"hits":[{"_id":"x","_score":2.5,"_source":{"content":"c","metadata":{"k":"v"}}},{"_id":"y","_score":1.0,"_source":{"chunk_id":"z","content":"d"}}]}}'
    out = R.parsed_hits(spark.createDataFrame([(body,)], "response string")).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["x", "z"] and out[0].metadata == {"k": "v"}


def test_uuid_is_the_name_based_one(spark):
    import hashlib
    import uuid

    h = bytearray(hashlib.md5(b"fp:0:cfp").digest())
    h[6], h[8] = h[6] & 0x0F | 0x30, h[8] & 0x3F | 0x80
    assert spark.range(1).select(identity.name_uuid(F.lit("fp:0:cfp"))).first()[0] == str(uuid.UUID(bytes=bytes(h)))


def test_backfill(spark):
    stored = spark.createDataFrame([("a", "1", "t", "s"), ("b", "1", "t", "s"), ("c", "2", "t", "s")], "chunk_id string, document_id string, text string, section_title string")
    index = R.index_source(stored.filter("chunk_id <> 'b'"))
    assert [r.document_id for r in R.backfill_plan(stored, index).collect()] == ["1"]
    assert sorted(r.chunk_id for r in R.backfilled(stored, index).collect()) == ["a", "b", "c"]
    assert R.without_document(index, "1").count() == 1


def test_a_search_that_fails_when_it_runs_costs_its_hits_only(spark):
    schema = "chunk_id string, document_id string, score double, rank int"
    broken = R.index_source(spark.createDataFrame([("a", "d", "words", "s")], "chunk_id string, document_id string, text string, section_title string")).withColumn("content", F.raise_error(F.lit("gone")))
    assert R.degraded(lambda: R.bm25_search(broken, "words"), schema, spark).isEmpty()


def test_chunks_without_ids_are_fused_by_document_and_fingerprint(spark):
    row = "rank int, score double, text string, chunk_id string, document_id string, chunk_fingerprint string, chunk_index int, section_title string"
    v = spark.createDataFrame([(1, 0.9, "t", " ", "d", "f", 0, "")], row)
    k = spark.createDataFrame([(1, 2.0, "t", None, "d", "f", 0, ""), (2, 1.0, "u", None, "d", "g", 5, "")], row)
    assert [r.chunk_id for r in R.hybrid_search(v, k, 5).orderBy("rank").collect()] == ["d:f", "d:g"]


def test_stored_postings_are_read_pruned(spark, tmp_path):
    from lectern.sources import stores

    source = R.index_source(spark.createDataFrame([(str(i), "d", f"alpha w{i} beta", "s") for i in range(50)], "chunk_id string, document_id string, text string, section_title string"))
    stores.write_postings(R.postings(source, ["content"]), str(tmp_path / "p"))
    mine = stores.read_postings(spark, str(tmp_path / "p"), ["w7", "w8"])
    assert sorted(r.term for r in mine.collect()) == ["w7", "w8"]
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(term", plan)
    # files are ranges of terms, and the statistics are stored beside them
    bounds = spark.read.parquet(str(tmp_path / "p/postings")).groupBy(F.input_file_name().alias("file")).agg(F.min("term").alias("lo"), F.max("term").alias("hi")).orderBy("lo").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(bounds, bounds[1:], strict=False))
    assert stores.read_statistics(spark, str(tmp_path / "p")).collect() == R.field_statistics(R.postings(source, ["content"])).collect()


@pytest.mark.parametrize(("text", "words"), [
    ("Don't stop O’Neill's 3.5 1,000.50 a.b x:y", ["don't", "stop", "o’neill's", "3.5", "1,000.50", "a.b", "x:y"]), ("end. Next, one;two a,b 1:2", ["end", "next", "one", "two", "b", "1", "2"]),
    ("snake_case _x_ __ 4x x4 v1.2", ["snake_case", "_x_", "4x", "x4", "v1.2"]), ("mail j.d@site.com", ["mail", "j.d", "site.com"]), ("日本語 ひら カタカナ", ["日", "本", "語", "ひ", "ら", "カタカナ"]), ("한국어 текст", ["한국어", "текст"]),
    ("naïve café été", ["naïve", "café", "été"]), ("'quoted' it''s a..b 1.a a.1", ["quoted", "s", "b", "1", "1"]), ("THE The a", []), ("٣٤ x²", ["٣٤", "x"]), ("", []),
])
def test_words_by_unicode_boundaries(spark, text, words):
    found = spark.createDataFrame([(text,)], "t string").select(R.analyzed(F.col("t"))).first()[0]
    assert found == words and R.query_terms(text) == list(dict.fromkeys(words))


_PLAIN_WORD = (
    r"[\p{IsHan}\p{IsHiragana}]\p{M}*|[\p{IsKatakana}ー]+|"
    r"(?:[_‿]|(?:[\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]]\p{M}*)(?:[:·.'’](?:[\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]]\p{M}*))*|\p{Nd}\p{M}*(?:[,;.'’]\p{Nd}\p{M}*)*)+"
)


def test_words_are_those_of_the_plain_pattern_and_may_be_long(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("abzéßß漢かカーｱ_‿12٣.:,;'’·- ́̈Ωя") for _ in range(r.randrange(40))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    both = rows.select(*[F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0)).alias(n) for n, p in (("own", P.WORD), ("plain", _PLAIN_WORD))])
    assert both.filter("own != plain").count() == 0 and both.filter("size(own) > 3").count() > 1000
    long = spark.createDataFrame([("ab" * 50_000 + " x" + "é1" * 50_000,)], "text string")
    assert long.select(F.size(R.analyzed(F.col("text")))).first()[0] == 2


def test_one_search_finds_what_its_words_are_whatever_stands_beside_them(spark):
    rows = [("a", "re ing"), ("b", "Re. ING,漢ing"), ("c", "pre ing"), ("d", "re ingx"), ("e", "漢re漢 1 ing"), ("f", "re_ ing"), ("g", None), ("h", "reé ing"), ("i", "re:ing re"), ("j", "re1 ing")]
    source = spark.createDataFrame([(i, "d", t) for i, t in rows], "chunk_id string, document_id string, content string")
    index = R.postings(source, ["content"])
    one = R.bm25_search(source, "re ing", 20, boosts={"content": 1.0}, digits=6)
    other = R.bm25_indexed(index, R.field_statistics(index), "re ing", 20, boosts={"content": 1.0}, digits=6)
    assert [tuple(x) for x in one.select("rank", "chunk_id", "score").collect()] == [tuple(x) for x in other.select("rank", "chunk_id", "score").collect()]
    assert {x.chunk_id for x in one.collect()} == {"a", "b", "e"}
    counts = {x.term: x.n for x in R.term_counts(source).collect()}
    assert counts == {x.term: x.n for x in index.groupBy("term").agg(F.sum("tf").alias("n")).collect()}
