"""Retrieval: exact cosine top-k, fielded BM25, reciprocal rank fusion and redundancy suppression.

Scoring is an expression over a filtered scan; a top-k is one TakeOrdered, so only k rows per task
travel. The query side (one vector, a few terms) is literal, never a joined table. Ties are broken by chunk id.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions import text as T

# ---- requests --------------------------------------------------------------------------------


def checked_top_k(top_k: int | None, default: int = P.DEFAULT_TOP_K, most: int = P.MAX_TOP_K) -> int:
    k = default if top_k is None else top_k
    if not 1 <= k <= most:
        raise ValueError(f"topK must be between 1 and {most}")
    return k


def checked_question(question: str | None) -> str:
    if question is None or not question.strip():
        raise ValueError("question must not be blank")
    return question.strip()


def checked_document_ids(ids: list[str] | None, canonical: bool = False) -> list[str]:
    """One to three different ids; with ``canonical``, UUIDs in canonical form."""
    import uuid

    if not ids:
        raise ValueError("at least one document id is required")
    if len(ids) > P.MAX_DOCUMENTS:
        raise ValueError(f"at most {P.MAX_DOCUMENTS} documents can be searched")
    if any(i is None or not str(i).strip() for i in ids):
        raise ValueError("document id must not be blank")
    found = [str(uuid.UUID(str(i).strip())) if canonical else str(i).strip() for i in ids]
    if len(set(found)) < len(found):
        raise ValueError("document ids must be distinct")
    return found


# ---- vectors ----------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a side is null or has no direction."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def ranked(hits: DataFrame, k: int, score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best by score, then tie, with rank from 1. The window runs over k rows only."""
    best = hits.withColumn(score, F.coalesce(score, F.lit(0.0))).orderBy(F.col(score).desc(), tie).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col(score).desc(), tie)))


def vector_search(chunks: DataFrame, query: list[float], top_k: int | None = None, document_ids: list[str] | None = None, above: float | None = 0.0, digits: int | None = None) -> DataFrame:
    """Chunks (chunk_id, document_id, embedding, …) by cosine to ``query``; documents are filtered before any scoring.

    ``above``: only scores over it (None: all). ``digits``: scores rounded before they are ranked.
    """
    k = checked_top_k(top_k)
    scoped = chunks.filter(F.col("document_id").isin(document_ids)) if document_ids is not None else chunks
    score = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    hits = scoped.withColumn("score", F.round(score, digits) if digits is not None else score)
    return ranked(hits if above is None else hits.filter(F.col("score") > above), k).drop("embedding")


# ---- lexical index -----------------------------------------------------------------------------


def analyzed(text: Column) -> Column:
    """Lower-case words by Unicode word boundaries, without stop words; repeats stay, they are the term frequency."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(P.WORD), F.lit(0))
    joined = lambda w: w.startswith("_") | w.startswith("‿")
    return F.filter(words, lambda w: ~w.isin(*P.ENGLISH_STOP_WORDS) & (~joined(w) | w.rlike(r"[^_‿]")))


def query_terms(question: str) -> list[str]:
    """The terms of one question, as :func:`analyzed` has them."""
    import regex

    words = regex.findall(regex.sub(r"\\p\{Is(\w+)\}", r"\\p{\1}", P.WORD), question.lower(), regex.V1)
    return list(dict.fromkeys(w for w in words if w.strip("_‿") and w not in P.ENGLISH_STOP_WORDS))


def index_source(chunks: DataFrame) -> DataFrame:
    """What the lexical index holds of a chunk: its fields as texts, and its metadata without missing keys."""
    meta = [c for c in ("document_id", "chunk_index", "page_number", "section_title", "source_file_name", "structural_boundary") if c in chunks.columns]
    have = chunks.columns
    many = lambda c: F.array_join(c, " ") if c in have else F.lit("")
    return chunks.select(
        "chunk_id", "document_id", F.col("text").alias("content"), (F.col("section_title") if "section_title" in have else F.lit("")).alias("section_title"),
        many("subsection_titles").alias("subsection_titles"), many("heading_path").alias("heading_path"), F.to_json(F.struct(*meta)).alias("metadata"),
    )


def postings(source: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """chunk_id, document_id, field, term, tf, dl: one row per term of a field."""
    fields = fields or list(P.FIELD_BOOSTS)
    per_field = F.array(*[F.struct(F.lit(f).alias("field"), analyzed(F.col(f)).alias("terms")) for f in fields])
    long = source.select("chunk_id", "document_id", F.explode(per_field).alias("x")).select("chunk_id", "document_id", "x.field", "x.terms", F.size("x.terms").alias("dl"))
    return long.select("chunk_id", "document_id", "field", "dl", F.explode("terms").alias("term")).groupBy("chunk_id", "document_id", "field", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(source: DataFrame, field: str = "content") -> DataFrame:
    """term, n: how often each term stands in a field of all chunks. Counted as they are read: only counts travel, never postings."""
    return source.select(F.explode(analyzed(F.col(field))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _may_hold(text: Column, term: str) -> Column:
    """Whether ``term`` can be a word of the text; a look that costs little before the words are taken apart.

    A word goes on over a to z, so one that starts or ends with such a letter has none beside it.
    """
    before, after = (r"(?<![a-z])" if "a" <= term[0] <= "z" else ""), (r"(?![a-z])" if "a" <= term[-1] <= "z" else "")
    return F.lower(F.coalesce(text, F.lit(""))).rlike(before + re.escape(term) + after)


def _frequency(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25_search(source: DataFrame, question: str, top_k: int = P.CANDIDATES, document_ids: list[str] | None = None, boosts: dict[str, float] | None = None, digits: int | None = None) -> DataFrame:
    """chunk_id, document_id, score, rank: a field matches with all terms, the best boosted field counts.

    Statistics cover the whole corpus, whatever documents are asked for: it is read for them and again for the
    matches. Only the query's terms are counted, on the map side, so it is never exploded into all its words; for the
    matches, only texts that can hold every term are taken apart.
    """
    boosts = boosts or P.FIELD_BOOSTS
    terms = query_terms(question)
    schema = "chunk_id string, document_id string, score double, rank int"
    if not terms:
        return source.sparkSession.createDataFrame([], schema)
    texts = source.select("chunk_id", "document_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(b)).alias("boost"), F.col(f).alias("text")) for f, b in boosts.items()])).alias("x"))

    def counted(texts: DataFrame) -> DataFrame:
        rows = texts.select("chunk_id", "document_id", "x.field", "x.boost", T.let(analyzed(F.col("x.text")), lambda w: F.struct(F.size(w).alias("dl"), *[_frequency(w, t).alias(f"tf{i}") for i, t in enumerate(terms)])).alias("c"))
        return rows.select("chunk_id", "document_id", "field", "boost", "c.*")

    rows = counted(texts)
    stats = rows.groupBy("field").agg(
        F.sum(F.when(F.col("dl") > 0, 1)).alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]
    )
    if document_ids is not None:
        texts = texts.filter(F.col("document_id").isin(document_ids))
    may = [_may_hold(F.col("x.text"), t) for t in terms]
    every = counted(texts.filter(reduce(Column.__and__, may))).filter(" AND ".join(f"tf{i} > 0" for i in range(len(terms))))
    k1, b = P.BM25_K1, P.BM25_B
    scored = every.join(F.broadcast(stats), "field")  # one row per field
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    score = sum((F.log1p((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") / (F.col(f"tf{i}") + norm) for i in range(len(terms))), F.lit(0.0))
    best = scored.withColumn("score", F.col("boost") * score).groupBy("chunk_id", "document_id").agg(F.max("score").alias("score"))
    if digits is not None:
        best = best.withColumn("score", F.round("score", digits))
    return ranked(best, top_k)


def field_statistics(index: DataFrame) -> DataFrame:
    """field, n, avgdl of postings: how many chunks have the field, and its mean length."""
    return index.select("chunk_id", "field", "dl").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def bm25_indexed(index: DataFrame, statistics: DataFrame, question: str, top_k: int = P.CANDIDATES, document_ids: list[str] | None = None, boosts: dict[str, float] | None = None, digits: int | None = None) -> DataFrame:
    """As :func:`bm25_search`, from stored postings: only the rows of the query's terms are read.

    Stored by term (``postings(...).write.partitionBy`` or sorted by term), a query prunes to those
    terms; the joined sides have one row per field and term.
    """
    boosts = boosts or P.FIELD_BOOSTS
    terms = query_terms(question)
    mine = index.filter(F.col("term").isin(terms) & F.col("field").isin(list(boosts)))
    counts = mine.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))  # as many rows as fields and terms
    scoped = mine.filter(F.col("document_id").isin(document_ids)) if document_ids is not None else mine
    boost = F.coalesce(*[F.when(F.col("field") == f, float(b)) for f, b in boosts.items()])
    k1, b = P.BM25_K1, P.BM25_B
    one = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    rows = scoped.join(F.broadcast(counts), ["field", "term"]).join(F.broadcast(statistics), "field").withColumn("one", one)
    fields = rows.groupBy("chunk_id", "document_id", "field").agg(F.count(F.lit(1)).alias("met"), F.sum("one").alias("score")).filter(F.col("met") == len(terms))
    best = fields.withColumn("score", boost * F.col("score")).groupBy("chunk_id", "document_id").agg(F.max("score").alias("score"))
    return ranked(best.withColumn("score", F.round("score", digits)) if digits is not None else best, top_k)


def degraded(search, schema: str, spark) -> DataFrame:
    """A lexical search whose failure, when planned or when run, costs its results only: an empty table stands for them.

    The search runs here; its hits are few (top-k) and go on as a table of their own.
    """
    try:
        rows = search().collect()
    except Exception:  # the index is an optional part of retrieval, whatever went wrong with it
        rows = []
    return spark.createDataFrame([tuple(r) for r in rows], schema)


# ---- fusion --------------------------------------------------------------------------------------


def fuse(vector: DataFrame, keyword: DataFrame, rrf_k: int = P.RRF_K) -> DataFrame:
    """Both rankings on one row per chunk, with the fused score; the vector side's columns win.

    A chunk without an id is known by its document and fingerprint (:func:`text.chunk_key`).
    """
    def key(df: DataFrame) -> Column:
        has = lambda c, other="": F.col(c) if c in df.columns else F.lit(other or None).cast("string")
        return T.chunk_key(F.col("chunk_id"), has("document_id"), has("chunk_fingerprint"), F.coalesce(has("text"), F.lit("")))

    v = vector.select(key(vector).alias("chunk_id"), *[F.col(c).alias(f"v_{c}") for c in vector.columns if c != "chunk_id"])
    k = keyword.select(key(keyword).alias("k_chunk_id"), *[F.col(c).alias(f"k_{c}") for c in keyword.columns if c != "chunk_id"])
    both = v.join(k, F.col("chunk_id") == F.col("k_chunk_id"), "full").withColumn("chunk_id", F.coalesce("chunk_id", "k_chunk_id"))
    passed = [c for c in dict.fromkeys([*vector.columns, *keyword.columns]) if c not in ("chunk_id", "rank", "score")]
    sides = {c: [x for x in (f"v_{c}" if c in vector.columns else None, f"k_{c}" if c in keyword.columns else None) if x] for c in passed}
    part = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    return both.select(
        "chunk_id", *[F.coalesce(*s).alias(c) for c, s in sides.items()],
        F.col("v_rank").alias("vector_rank"), F.col("v_score").alias("vector_score"), F.col("k_rank").alias("keyword_rank"), F.col("k_score").alias("keyword_score"),
        (part("v_rank") + part("k_rank")).alias("rrf_score"), F.least("v_rank", "k_rank").alias("best_rank"),
    )


def redundant(a: Column, b: Column, threshold: float = P.OVERLAP_THRESHOLD) -> Column:
    """Same document, same section or neighbouring chunks, and mostly the same words."""
    near = T.equal_and_present(a["section_title"], b["section_title"]) | F.coalesce(F.abs(a["chunk_index"] - b["chunk_index"]) <= 1, F.lit(False))
    same = F.coalesce(a["document_id"] == b["document_id"], F.lit(False))
    return same & near & (T.overlap_coefficient(a["shingles"], b["shingles"], a["words"] == b["words"]) >= threshold)


def without_redundant(candidates: DataFrame, k: int, threshold: float = P.OVERLAP_THRESHOLD) -> DataFrame:
    """Greedy choice in order (order_no): a candidate joins unless it repeats one chosen before; k at most.

    The candidates of one query (forty at most) are folded as one array.
    """
    for name, kind in (("document_id", "string"), ("section_title", "string"), ("chunk_index", "int"), ("text", "string")):
        if name not in candidates.columns:  # what is not known makes nothing redundant
            candidates = candidates.withColumn(name, F.lit(None).cast(kind))
    held = candidates.select(F.struct("order_no", "alone", "chunk_id", "document_id", "section_title", F.col("chunk_index").cast("int").alias("chunk_index"), T.shingles(F.col("text")).alias("shingles"), T.normalized_words(F.col("text")).alias("words")).alias("c"))
    one = held.agg(F.array_sort(F.collect_list("c")).alias("all"))
    empty = F.slice("all", 1, 0)
    chosen = F.aggregate("all", empty, lambda s, c: F.when((F.size(s) < k) & ~F.exists(s, lambda x: ~c["alone"] & redundant(x, c, threshold)), F.concat(s, F.array(c))).otherwise(s))
    ids = one.select(F.posexplode(F.transform(chosen, lambda c: c["chunk_id"])).alias("place", "chunk_id")).select((F.col("place") + 1).alias("rank"), "chunk_id")
    return candidates.join(F.broadcast(ids), "chunk_id")  # k rows at most


def hybrid_search(vector: DataFrame, keyword: DataFrame, k: int, rrf_k: int = P.RRF_K, threshold: float | None = P.OVERLAP_THRESHOLD, digits: int | None = None) -> DataFrame:
    """Fused, without redundant chunks, score scaled to 1 for a chunk first in both rankings.

    Without any keyword hit the first k vector hits stand as they are, mode ``vector``. Which of the two holds is told
    by the fused rows themselves (forty at most), so each side is searched once.
    """
    both = fuse(vector, keyword, rrf_k)
    if digits is not None:
        both = both.withColumn("rrf_score", F.round("rrf_score", digits))
    order = [F.col("rrf_score").desc(), F.col("best_rank"), F.col("chunk_id")]
    both = both.orderBy(*order).limit(2 * P.CANDIDATES).withColumn("order_no", F.row_number().over(W.orderBy(*order)))
    both = both.withColumn("alone", F.max("keyword_rank").over(W.partitionBy()).isNull())
    chosen = both.filter(F.col("order_no") <= k).withColumn("rank", F.col("order_no")) if threshold is None else without_redundant(both, k, threshold)
    score = F.least(F.lit(1.0), F.col("rrf_score") / (2.0 / (rrf_k + 1)))
    score = F.when(F.col("alone"), F.col("vector_score")).otherwise(F.round(score, digits) if digits is not None else score)
    return chosen.withColumns({"score": score, "retrieval_mode": F.when(F.col("alone"), "vector").otherwise("hybrid")}).drop("order_no", "best_rank", "alone")


def search_response(hits: DataFrame, question: str, document_ids: list[str], top_k: int) -> DataFrame:
    """One row: the question, what was asked for, and the results in rank order."""
    rows = hits.agg(F.array_sort(F.collect_list(F.struct("rank", "score", "chunk_id"))).alias("results"))
    return rows.select(F.lit(checked_question(question)).alias("question"), F.lit(document_ids).alias("document_ids"), F.lit(top_k).alias("top_k"), F.size("results").alias("result_count"), "results")


# ---- index upkeep -----------------------------------------------------------------------------------


def backfill_plan(stored: DataFrame, indexed: DataFrame) -> DataFrame:
    """document_id, stored_count, indexed_count of the documents whose index must be built again."""
    s = stored.groupBy("document_id").agg(F.count(F.lit(1)).alias("stored_count"))
    i = indexed.groupBy("document_id").agg(F.count(F.lit(1)).alias("indexed_count"))
    both = s.join(i, "document_id", "left").withColumn("indexed_count", F.coalesce("indexed_count", F.lit(0)))
    return both.filter((F.col("stored_count") > 0) & (F.col("stored_count") != F.col("indexed_count")))


def backfilled(stored: DataFrame, indexed: DataFrame) -> DataFrame:
    """The index with every wanting document replaced by what is stored of it."""
    wanting = backfill_plan(stored, indexed).select("document_id")
    return indexed.join(wanting, "document_id", "left_anti").unionByName(index_source(stored.join(wanting, "document_id", "left_semi")))


def without_document(indexed: DataFrame, document_id: str) -> DataFrame:
    return indexed.filter(~F.col("document_id").eqNullSafe(F.lit(document_id)))


def document_chunks(stored: DataFrame, document_id: str) -> DataFrame:
    return stored.filter(F.col("document_id") == document_id).orderBy("chunk_id")


HITS_SCHEMA = "hits struct<hits: array<struct<_id: string, _score: double, _source: struct<chunk_id: string, content: string, metadata: map<string,string>>>>>"


def parsed_hits(responses: DataFrame, column: str = "response") -> DataFrame:
    """chunk_id, score, text, metadata of the hits in a search response; a broken response stops the query."""
    h = responses.select(F.from_json(column, HITS_SCHEMA, {"mode": "FAILFAST"}).alias("r")).select(F.posexplode("r.hits.hits").alias("place", "h"))
    return h.select((F.col("place") + 1).alias("rank"), F.coalesce("h._source.chunk_id", "h._id").alias("chunk_id"), F.col("h._score").alias("score"), F.col("h._source.content").alias("text"), F.col("h._source.metadata").alias("metadata"))
