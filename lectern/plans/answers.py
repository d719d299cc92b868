"""Whole requests, on the driver: ingestion of a document, a grounded answer, a chat turn.

Tables and models are handed in; nothing here runs inside a plan. A ``model`` takes (role, text)
messages and returns (text, (prompt, completion, total) tokens); ``embed`` is that of ``sources.stores``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.operators import catalog, chunking, cleaning, identity, memory, retrieval
from lectern.sources import stores
from lectern.streaming import ingest

Tokens = tuple[int | None, int | None, int | None]
Model = Callable[[list[tuple[str, str]]], tuple[str, Tokens]]
Embed = Callable[[list[str], str], list[list[float]]]


@dataclass
class Library:
    """The tables of a library; requests replace them."""

    spark: SparkSession
    documents: DataFrame = field(default=None)
    chunks: DataFrame | None = None
    index: DataFrame | None = None
    chats: DataFrame = field(default=None)
    chat_documents: DataFrame = field(default=None)
    messages: DataFrame = field(default=None)
    sources: DataFrame = field(default=None)
    summaries: DataFrame = field(default=None)

    def __post_init__(self) -> None:
        for name, schema in (("documents", catalog.DOCUMENTS), ("chats", catalog.CHATS), ("chat_documents", catalog.CHAT_DOCUMENTS), ("messages", catalog.MESSAGES), ("sources", catalog.SOURCES), ("summaries", catalog.SUMMARIES)):
            if getattr(self, name) is None:
                setattr(self, name, self.spark.createDataFrame([], schema))


def sum_tokens(a: Tokens, b: Tokens) -> Tokens:
    return tuple(None if x is None and y is None else (x or 0) + (y or 0) for x, y in zip(a, b, strict=True))


def ingest_document(library: Library, pages: DataFrame, file_name: str, embed: Embed, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict:
    """Register, chunk, identify, store what is new, drop what is superseded, index, and mark ready (or failed).

    ``pages`` holds one document, whose key is its fingerprint. ``keep`` may write a table and read it back.
    """
    at = F.lit(datetime.now(UTC))  # one time for the whole request
    key = pages.select("document_key").first()[0]
    new = library.spark.createDataFrame([(str(uuid.uuid5(uuid.NAMESPACE_OID, key)), key, file_name)], "document_id string, content_fingerprint string, original_file_name string")
    library.documents = keep(catalog.register(library.documents, new, at))
    document_id = library.documents.filter(F.col("content_fingerprint") == key).first().document_id
    try:
        chunks = keep(ingest.ingest(pages, max_chunks=P.MAX_CHUNKS).withColumn("document_id", F.lit(document_id)).withColumn("source_file_name", F.lit(file_name)))
        count = chunks.count()
        if not count:
            refused = chunking.refused_documents(cleaning.clean_pages(pages)).first()
            raise ValueError(refused.problem if refused else "the document has no text")
        expected = chunks.groupBy("document_id", "ingestion_fingerprint").agg(F.count(F.lit(1)).alias("n_chunks"))
        stored = library.chunks if library.chunks is not None else chunks.withColumn("embedding", F.array().cast("array<float>")).limit(0)
        plan = identity.ingestion_plan(expected, stored).first()
        if not plan.skipped:
            fresh = stores.embedded(identity.new_chunks(chunks, stored), embed)
            stored = keep(identity.without_superseded(stored.unionByName(fresh), expected))
        library.chunks = stored
        index = library.index if library.index is not None else retrieval.index_source(stored).limit(0)

        def replace() -> None:
            own = retrieval.index_source(retrieval.document_chunks(stored, document_id))
            new = keep(retrieval.without_document(index, document_id).unionByName(own))
            new.write.format("noop").mode("overwrite").save()  # what fails, fails here
            library.index = new

        stores.replace_document_safely(replace)
        library.documents = keep(catalog.mark_ready(library.documents, document_id, count, at))
    except (RuntimeError, ValueError):
        library.documents = keep(catalog.mark_failed(library.documents, document_id, at))
        raise
    return {"document_id": document_id, "file_name": file_name, "ingestion_fingerprint": plan.ingestion_fingerprint, "chunk_count": count, "stored_chunk_count": 0 if plan.skipped else count, "skipped": plan.skipped}


def find_sources(library: Library, semantic: str, keyword: str, document_ids: list[str], top_k: int | None, embed: Embed) -> list:
    """Hybrid hits for a contextual and a bare question; wanting index entries are filled in first."""
    k = retrieval.checked_top_k(top_k)
    chunks = library.chunks.filter(F.col("document_id").isin(document_ids))
    vector = retrieval.vector_search(library.chunks, stores.embed_query(semantic, embed), P.CANDIDATES, document_ids)
    schema = "chunk_id string, document_id string, score double, rank int"

    def lexical() -> DataFrame:
        library.index = retrieval.backfilled(chunks, library.index)
        return retrieval.bm25_search(library.index, keyword, P.CANDIDATES, document_ids)

    words = retrieval.degraded(lexical, schema, library.spark)
    side = chunks.select("chunk_id", "text", "chunk_index", "section_title", "source_file_name", "page_numbers")
    return retrieval.hybrid_search(vector, words.join(side, "chunk_id"), k).orderBy("rank").collect()


def _context(library: Library, hits: list, chat: bool) -> str:
    columns = ("rank", "text", "document_id", "section_title", "source_file_name")
    rows = library.spark.createDataFrame([("q", *[h[c] for c in columns], list(h["page_numbers"] or [])) for h in hits], "k string, rank int, text string, document_id string, section_title string, source_file_name string, page_numbers array<int>")
    return memory.grounded_contexts(rows, "k", with_document=chat).first().context


def _grounded(library: Library, question: str, hits: list, chat: bool) -> str:
    one = library.spark.range(1).select(memory.grounded_message(F.lit(question), F.lit(_context(library, hits, chat)), chat))
    return one.first()[0]


def answer_question(library: Library, question: str, document_id: str, top_k: int | None, embed: Embed, model: Model, system: str = "Answer from the sources only.") -> dict:
    """An answer from one ready document with the sources that ground it."""
    q = retrieval.checked_question(question)
    ids = retrieval.checked_document_ids([document_id], canonical=True)
    if not catalog.is_ready(library.documents, ids[0]):
        raise ValueError("the document is not ready")
    hits = find_sources(library, q, q, ids, top_k, embed)
    if not hits:
        raise ValueError("no passage was found")
    text, tokens = model([("system", system), ("user", _grounded(library, q, hits, chat=False))])
    return {"document_id": ids[0], "question": q, "answer": text, "retrieved_chunk_count": len(hits), "sources": hits, "tokens": tokens}


def chat_turn(library: Library, chat_id: str, message: str, top_k: int | None, embed: Embed, model: Model, stage: Callable[[str], None] = lambda _: None, system: str = "Answer from the sources only.") -> dict:
    """Understand, search, generate, save. A summary is kept even where the answer then fails."""
    at = F.lit(datetime.now(UTC))  # one time for the whole request
    q = retrieval.checked_question(message)
    stage("UNDERSTANDING")
    context = catalog.chat_context(library.chats, library.chat_documents).filter(F.col("chat_id") == chat_id).first()
    if context is None:
        raise LookupError("chat was not found")
    ids = retrieval.checked_document_ids(context.document_ids)
    own = library.chats.filter(F.col("chat_id") == chat_id)
    used: Tokens = (None, None, None)
    state = memory.split_memory(memory.memory_state(own, library.messages, library.summaries))
    due = memory.summary_inputs(state).first()
    if due is not None:
        summary, used = model([("system", "Summarize the conversation."), ("user", due.summary_input)])
        new = library.spark.createDataFrame([(chat_id, context.context_version, memory.checked_summary(summary), due.marker)], "chat_id string, context_version int, summary string, summarized_through_order long").withColumn("updated_at", at)
        library.summaries = catalog.save_summary(library.summaries, new)
        state = memory.split_memory(memory.memory_state(own, library.messages, library.summaries))
    asked = library.spark.createDataFrame([(chat_id, q)], "chat_id string, question string")
    contextual = memory.retrieval_queries(state, asked).first().query
    stage("SEARCHING")
    hits = find_sources(library, contextual, q, ids, top_k, embed)
    if not hits:
        raise ValueError("no passage was found")
    stage("GENERATING")
    grounded = asked.select("chat_id", F.lit(_grounded(library, q, hits, chat=True)).alias("grounded"))
    prompt = [(m.role, m.text) for m in memory.prompts(system, state, grounded).first().prompt]
    text, tokens = model(prompt)
    saved = library.spark.createDataFrame([(h["rank"], float(h["score"]), h["text"], None) for h in hits], "rank int, score double, text string, metadata string")
    library.chats, library.messages, library.sources = catalog.save_turn(library.chats, library.messages, library.sources, chat_id, context.context_version, q, text, saved, tokens, (str(uuid.uuid4()), str(uuid.uuid4())), at)
    return {"chat_id": chat_id, "context_version": context.context_version, "document_ids": ids, "message": q, "answer": text, "retrieved_chunk_count": len(hits), "sources": hits, "tokens": sum_tokens(used, tokens)}
