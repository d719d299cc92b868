"""Retrieval for a table of questions at once: each question gets what the search for one question gives it.

Questions are rows (question_id, question, embedding, and document_ids where each has its own scope). Their terms are joined to
the postings, or looked up in the texts, where there is no index; their vectors meet all stored ones in blocks, as matrix products. Every top-k is taken in part by each
task before rows travel (a window limited to k ranks), so no task holds all hits of a question. Fusion and the choice
without redundant chunks work per question on forty candidates at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions import text as T
from lectern.operators import retrieval

#: question vectors of one scan over the stored ones, and stored vectors of one matrix product
QUESTIONS, VECTORS = 1024, 2048


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each question by score, then chunk_id, with rank from 1."""
    order = W.partitionBy("question_id").orderBy(F.col("score").desc(), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Best:
    """The k best (score, id) of one question among the vectors seen so far."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, object)

    def meet(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.ids) == self.k:
            near = scores >= self.scores[-1]
            scores, ids = scores[near], ids[near]
        if len(ids):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]


def _units(embeddings: list, width: int) -> np.ndarray:
    """Vectors at length one; not-a-number where there is no direction."""
    rows = np.array([np.full(width, np.nan) if x is None else x for x in embeddings], float).reshape(len(embeddings), width)
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _nearest(questions: list[tuple], k: int, above: float | None, digits: int | None):
    """Per task: the k best chunks of each of these questions (id, vector, documents or None)."""
    width = len(questions[0][1])
    units = _units([q[1] for q in questions], width)
    scopes = [None if q[2] is None else set(q[2]) for q in questions]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [_Best(k) for _ in questions]
        for rows in batches:
            for at in range(0, len(rows), VECTORS):
                part = rows.iloc[at : at + VECTORS]
                scores = _units(list(part["embedding"]), width) @ units.T
                scores = np.where(np.isnan(scores), 0.0 if above is None else -np.inf, scores if digits is None else np.round(scores, digits))
                ids, documents = part["chunk_id"].to_numpy(object), part["document_id"].to_numpy(object)
                for j, scope in enumerate(scopes):
                    own = np.full(len(part), True) if above is None else scores[:, j] > above
                    if scope is not None:
                        own &= np.array([d in scope for d in documents], bool)
                    best[j].meet(scores[own, j], ids[own])
        for (name, *_), b in zip(questions, best, strict=True):
            if len(b.ids):
                yield pd.DataFrame({"question_id": name, "chunk_id": b.ids, "score": b.scores})

    return run


def vector_hits(chunks: DataFrame, questions: DataFrame, top_k: int = P.CANDIDATES, above: float | None = 0.0, digits: int | None = None) -> DataFrame:
    """question_id, chunk_id, score, rank: the nearest chunks (chunk_id, document_id, embedding) of each question.

    One scan of the chunks for every ``QUESTIONS`` questions, whose vectors the tasks hold; each task passes on k hits a question.
    """
    schema = f"question_id {questions.schema['question_id'].dataType.simpleString()}, chunk_id string, score double"
    scope = F.col("document_ids") if "document_ids" in questions.columns else F.lit(None)
    stored = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"), "embedding")
    found, held = questions.sparkSession.createDataFrame([], schema), []
    scan = lambda: stored.mapInPandas(_nearest(held, top_k, above, digits), schema)
    for row in questions.filter("embedding IS NOT NULL").select("question_id", "embedding", scope.alias("scope")).toLocalIterator():
        held.append(tuple(row))
        if len(held) == QUESTIONS:
            found, held = found.unionByName(scan()), []
    return ranked(found.unionByName(scan()) if held else found, top_k)


def question_terms(questions: DataFrame) -> DataFrame:
    """question_id, term, n_terms: each term of a question once, and how many it has."""
    terms = questions.withColumn("terms", F.array_distinct(retrieval.analyzed(F.col("question"))))
    return terms.select("question_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def keyword_hits(index: DataFrame, statistics: DataFrame, questions: DataFrame, top_k: int = P.CANDIDATES, boosts: dict[str, float] | None = None, digits: int | None = None) -> DataFrame:
    """question_id, chunk_id, document_id, score, rank from postings (as ``retrieval.postings``) and their ``field_statistics``.

    A field matches with all terms of a question. So only the postings of its rarest term in a field are candidates, and
    each is then looked up for the other terms: a frequent term costs one join row per candidate, not per posting and question.
    """
    boosts = boosts or P.FIELD_BOOSTS
    boost = F.coalesce(*[F.when(F.col("field") == f, float(b)) for f, b in boosts.items()])
    terms = question_terms(questions)
    mine = index.filter(F.col("field").isin(list(boosts))).join(terms.select("term").distinct(), "term", "left_semi")
    counts = mine.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    asked = terms.join(counts, "term").select("question_id", "n_terms", "field", "term", "df")
    rarest = asked.groupBy("question_id", "field", "n_terms").agg(F.min(F.struct("df", "term")).alias("least"), F.count(F.lit(1)).alias("known")).filter("known = n_terms")
    first = rarest.select("question_id", "field", F.col("least.term").alias("term"))
    candidates = mine.join(first, ["field", "term"]).select("question_id", "field", "chunk_id", "document_id", "dl")
    if "document_ids" in questions.columns:
        candidates = candidates.join(questions.select("question_id", "document_ids"), "question_id").filter(F.col("document_ids").isNull() | F.array_contains("document_ids", F.col("document_id"))).drop("document_ids")
    wanted = candidates.join(asked, ["question_id", "field"])
    met = wanted.join(mine.select("field", "term", "chunk_id", "tf"), ["field", "term", "chunk_id"]).join(statistics, "field")
    k1, b = P.BM25_K1, P.BM25_B
    one = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    fields = met.groupBy("question_id", "field", "chunk_id", "document_id", "n_terms").agg(F.count(F.lit(1)).alias("met"), F.sum(one).alias("score")).filter("met = n_terms")
    best = fields.groupBy("question_id", "chunk_id", "document_id").agg(F.max(boost * F.col("score")).alias("score"))
    return ranked(best.withColumn("score", F.round("score", digits)) if digits is not None else best, top_k)


def text_hits(source: DataFrame, questions: DataFrame, top_k: int = P.CANDIDATES, boosts: dict[str, float] | None = None, digits: int | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """As :func:`keyword_hits`, from the texts of ``source`` (as ``retrieval.index_source``), without postings.

    The texts are read for the counts of the terms asked for, again for the chunks that have a question's rarest term in
    a field, and once more for these chunks' own words. Postings and texts stay in their tasks as long as the questions'
    side is small enough to be broadcast; counts and candidates travel. ``keep`` may write a table and read it back, so
    that its size is known: of terms, of counts, of the rarest terms, and of candidates.
    """
    boosts = boosts or P.FIELD_BOOSTS
    boost = F.coalesce(*[F.when(F.col("field") == f, float(b)) for f, b in boosts.items()])
    fields = lambda of: source.select("chunk_id", "document_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), of(F.col(f)).alias("x")) for f in boosts])).alias("f")).select("chunk_id", "document_id", "f.field", "f.x")
    words = fields(retrieval.analyzed).filter(F.size("x") > 0)
    terms = keep(question_terms(questions))
    # the empty term, which no text has, stands for the field itself
    asked = terms.select("term").union(questions.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    every = words.select("field", F.size("x").alias("dl"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("x"))).alias("term"))
    counted = keep(every.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.avg("dl").alias("avgdl")).join(asked, "term", "left_semi"))
    statistics = counted.filter("term = ''").select("field", F.col("df").alias("n"), "avgdl")
    known = terms.join(counted.select("field", "term", "df"), "term").groupBy("question_id", "field", "n_terms").agg(F.min(F.struct("df", "term")).alias("least"), F.array_sort(F.collect_list(F.struct("term", "df"))).alias("asked"))
    known = keep(known.filter(F.size("asked") == F.col("n_terms")).select("question_id", "field", F.col("least.term").alias("term"), "asked"))
    found = words.select("chunk_id", "document_id", "field", F.explode(F.array_distinct("x")).alias("term")).join(known.select("question_id", "field", "term"), ["field", "term"])
    if "document_ids" in questions.columns:
        found = found.join(questions.select("question_id", "document_ids"), "question_id").filter(F.col("document_ids").isNull() | F.array_contains("document_ids", F.col("document_id")))
    found = keep(found.select("question_id", "field", "chunk_id").distinct())
    texts = fields(lambda c: c).join(found, ["field", "chunk_id"]).join(known.drop("term"), ["question_id", "field"])
    # where a text has all terms: its length, and how often it has each
    met = lambda w: F.when(F.size(F.array_except(F.transform("asked", lambda t: t["term"]), w)) == 0, F.struct(F.size(w).alias("dl"), F.transform("asked", lambda t: F.struct(t["df"].alias("df"), F.size(F.filter(w, lambda x: x == t["term"])).alias("tf"))).alias("ts")))
    hits = texts.select("question_id", "field", "chunk_id", "document_id", T.let(retrieval.analyzed(F.col("x")), met).alias("c")).filter("c IS NOT NULL").join(statistics, "field")
    k1, b = P.BM25_K1, P.BM25_B
    norm = k1 * (1 - b + b * F.col("c.dl") / F.col("avgdl"))
    one = lambda t: F.log1p((F.col("n") - t["df"] + 0.5) / (t["df"] + 0.5)) * t["tf"] / (t["tf"] + norm)
    scored = hits.withColumn("score", boost * F.aggregate("c.ts", F.lit(0.0), lambda s, t: s + one(t)))
    best = scored.groupBy("question_id", "chunk_id", "document_id").agg(F.max("score").alias("score"))
    return ranked(best.withColumn("score", F.round("score", digits)) if digits is not None else best, top_k)


def fused(vector: DataFrame, keyword: DataFrame, rrf_k: int = P.RRF_K, digits: int | None = None) -> DataFrame:
    """Both rankings on one row per question and chunk, with the fused score; ``alone``: the question has no keyword hit."""
    side = lambda df, name: df.select("question_id", "chunk_id", *[(F.col(c) if name == own else F.lit(None).cast(t)).alias(f"{own}_{c}") for own in ("vector", "keyword") for c, t in (("rank", "int"), ("score", "double"))])
    ranks = [f"{own}_{c}" for own in ("vector", "keyword") for c in ("rank", "score")]
    both = side(vector, "vector").unionByName(side(keyword, "keyword")).groupBy("question_id", "chunk_id").agg(*[F.max(c).alias(c) for c in ranks])
    part = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    score = part("vector_rank") + part("keyword_rank")
    both = both.withColumns({"rrf_score": score if digits is None else F.round(score, digits), "best_rank": F.least("vector_rank", "keyword_rank")})
    return both.withColumn("alone", F.max("keyword_rank").over(W.partitionBy("question_id")).isNull())


def _chosen(k: int, threshold: float) -> Column:
    """The greedy choice among ``cs``, the candidates of one question in order."""
    return F.aggregate("cs", F.slice("cs", 1, 0), lambda s, c: F.when((F.size(s) < k) & ~F.exists(s, lambda x: ~c["alone"] & retrieval.redundant(x, c, threshold)), F.concat(s, F.array(c))).otherwise(s))


def hybrid_hits(vector: DataFrame, keyword: DataFrame, chunks: DataFrame, k: int, rrf_k: int = P.RRF_K, threshold: float = P.OVERLAP_THRESHOLD, digits: int | None = None) -> DataFrame:
    """question_id, rank, chunk_id, score, retrieval_mode and both sides' ranks: :func:`retrieval.hybrid_search` per question.

    ``chunks`` (chunk_id, document_id, section_title, chunk_index, text): hits that it does not have are left out.
    """
    known = chunks.select("chunk_id", "document_id", "section_title", F.col("chunk_index").cast("int").alias("chunk_index"), "text")
    both = fused(vector, keyword, rrf_k, digits).join(known, "chunk_id")
    place = F.row_number().over(W.partitionBy("question_id").orderBy(F.col("rrf_score").desc(), "best_rank", "chunk_id"))
    both = both.withColumn("order_no", place).filter(F.col("order_no") <= 2 * P.CANDIDATES)
    held = F.struct("order_no", "alone", "chunk_id", "document_id", "section_title", "chunk_index", T.shingles(F.col("text")).alias("shingles"), T.normalized_words(F.col("text")).alias("words"), "vector_rank", "vector_score", "keyword_rank", "rrf_score")
    every = both.groupBy("question_id").agg(F.array_sort(F.collect_list(held)).alias("cs"))
    out = every.select("question_id", F.posexplode(_chosen(k, threshold)).alias("place", "c"))
    score = F.least(F.lit(1.0), F.col("c.rrf_score") / (2.0 / (rrf_k + 1)))
    score = F.when(F.col("c.alone"), F.col("c.vector_score")).otherwise(score if digits is None else F.round(score, digits))
    mode = F.when(F.col("c.alone"), "vector").otherwise("hybrid")
    return out.select("question_id", (F.col("place") + 1).alias("rank"), "c.chunk_id", score.alias("score"), mode.alias("retrieval_mode"), "c.vector_rank", "c.keyword_rank")
