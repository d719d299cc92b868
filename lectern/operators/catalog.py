"""The catalog of documents and chats as table-to-table functions.

Tables are immutable, so an upsert is a join, a delete an anti-join and an update a conditional
projection; each function returns the new table. Child tables are aggregated before they are
joined, never fanned out and counted distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions import text as T

DOCUMENTS = "document_id string, content_fingerprint string, original_file_name string, status string, chunk_count int, created_at timestamp, updated_at timestamp"
CHATS = "chat_id string, title string, context_version int, created_at timestamp, updated_at timestamp"
CHAT_DOCUMENTS = "chat_id string, document_id string, attached_at timestamp"
MESSAGES = "message_id string, message_order long, chat_id string, role string, content string, context_version int, prompt_tokens int, completion_tokens int, total_tokens int, created_at timestamp"
SOURCES = "message_id string, source_rank int, score double, chunk_text string, metadata string"
SUMMARIES = "chat_id string, context_version int, summary string, summarized_through_order long, updated_at timestamp"


# ---- documents --------------------------------------------------------------------------------
def register(documents: DataFrame, new: DataFrame, at) -> DataFrame:
    """Upsert by content fingerprint: a known document keeps its id and count, and is processed again."""
    n = new.select(F.col("content_fingerprint").alias("f"), F.col("document_id").alias("new_id"), F.col("original_file_name").alias("new_name")).dropDuplicates(["f"])
    both = documents.join(n, F.col("content_fingerprint") == F.col("f"), "full")
    touched = F.col("f").isNotNull()
    return both.select(
        F.coalesce("document_id", "new_id").alias("document_id"), F.coalesce("content_fingerprint", "f").alias("content_fingerprint"), F.coalesce("new_name", "original_file_name").alias("original_file_name"),
        F.when(touched, "PROCESSING").otherwise(F.col("status")).alias("status"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.coalesce("created_at", at).alias("created_at"), F.when(touched, at).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def _update(table: DataFrame, condition, values: dict, at) -> DataFrame:
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in (values | {"updated_at": at}).items()})


def mark_ready(documents: DataFrame, document_id: str, chunk_count: int, at) -> DataFrame:
    return _update(documents, F.col("document_id") == document_id, {"status": F.lit("READY"), "chunk_count": F.lit(chunk_count)}, at)


def mark_failed(documents: DataFrame, document_id: str, at) -> DataFrame:
    """A document that has chunks of an earlier ingestion stays usable."""
    return _update(documents, F.col("document_id") == document_id, {"status": F.when(F.col("chunk_count") > 0, "READY").otherwise("FAILED")}, at)


def ready(documents: DataFrame) -> DataFrame:
    return documents.filter((F.col("status") == "READY") & (F.col("chunk_count") > 0))


def is_ready(documents: DataFrame, document_id: str) -> bool:
    return not ready(documents).filter(F.col("document_id") == document_id).isEmpty()


def list_documents(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.col("created_at").desc(), "document_id")


# ---- chats --------------------------------------------------------------------------------------
def create_chat(chats: DataFrame, chat_id: str, title: str | None, at) -> DataFrame:
    row = chats.sparkSession.range(1).select(F.lit(chat_id).alias("chat_id"), T.title(F.lit(title).cast("string")).alias("title"), F.lit(1).alias("context_version"), at.alias("created_at"), at.alias("updated_at"))
    return chats.unionByName(row)


def chat_summaries(chats: DataFrame, chat_documents: DataFrame, messages: DataFrame) -> DataFrame:
    """Chats with the number of their documents and messages, the last used first."""
    d = chat_documents.groupBy("chat_id").agg(F.count_distinct("document_id").alias("document_count"))
    m = messages.groupBy("chat_id").agg(F.count_distinct("message_id").alias("message_count"))
    both = chats.join(d, "chat_id", "left").join(m, "chat_id", "left")
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("document_count", "message_count")}
    return both.withColumns(counts).orderBy(F.col("updated_at").desc(), "chat_id")


def chat_attached(chat_documents: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents of each chat, in the order they were attached."""
    return chat_documents.join(documents, "document_id").orderBy("chat_id", "attached_at", "document_id")


def messages_with_sources(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages in order, each with its sources by rank, in one join."""
    s = sources.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("source_rank", "score", "chunk_text", "metadata"))).alias("sources"))
    out = messages.join(s, "message_id", "left").withColumn("role", F.lower("role"))
    return out.withColumn("sources", F.coalesce("sources", F.array().cast(s.schema["sources"].dataType))).orderBy("chat_id", "message_order")


def chat_detail(chats: DataFrame, chat_documents: DataFrame, documents: DataFrame, messages: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per chat with its documents and messages nested, each in order."""
    d = chat_documents.join(documents, "document_id").groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("attached_at", "document_id", "original_file_name", "status"))).alias("documents"))
    m = messages_with_sources(messages, sources).groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("message_order", "message_id", "role", F.col("content").alias("text"), "context_version", "sources"))).alias("messages"))
    return chats.join(d, "chat_id", "left").join(m, "chat_id", "left")


def _known(chats: DataFrame, chat_id: str) -> None:
    if chats.filter(F.col("chat_id") == chat_id).isEmpty():
        raise LookupError("chat was not found")


def rename_chat(chats: DataFrame, chat_id: str, title: str, at) -> DataFrame:
    if not title or not title.strip():
        raise ValueError("title must not be blank")
    _known(chats, chat_id)
    return _update(chats, F.col("chat_id") == chat_id, {"title": T.title(F.lit(title))}, at)


def delete_chats(gone: DataFrame, chats: DataFrame, chat_documents: DataFrame, messages: DataFrame, sources: DataFrame, summaries: DataFrame) -> dict[str, DataFrame]:
    """All tables without the chats in ``gone`` (chat_id) and what hangs on them; library documents stay."""
    g = gone.select("chat_id").distinct()
    left = messages.join(g, "chat_id", "left_anti")
    return {
        "chats": chats.join(g, "chat_id", "left_anti"), "chat_documents": chat_documents.join(g, "chat_id", "left_anti"), "messages": left,
        "sources": sources.join(messages.join(g, "chat_id", "left_semi").select("message_id"), "message_id", "left_anti"), "summaries": summaries.join(g, "chat_id", "left_anti"),
    }


def chat_context(chats: DataFrame, chat_documents: DataFrame) -> DataFrame:
    """chat_id, title, context_version, document_ids in attachment order."""
    d = chat_documents.groupBy("chat_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("attached_at", "document_id"))), lambda x: x["document_id"]).alias("document_ids"))
    return chats.join(d, "chat_id", "left").select("chat_id", "title", "context_version", F.coalesce("document_ids", F.array().cast("array<string>")).alias("document_ids"))


def bump_version(chats: DataFrame, chat_id: str, at) -> DataFrame:
    return _update(chats, F.col("chat_id") == chat_id, {"context_version": F.col("context_version") + 1}, at)


def attach_documents(chats: DataFrame, chat_documents: DataFrame, documents: DataFrame, chat_id: str, ids: list[str], at) -> tuple[DataFrame, DataFrame]:
    """(chats, chat_documents): new links only; the version goes up once if there are any."""
    if len(set(ids)) < len(ids):
        raise ValueError("document ids must be distinct")
    _known(chats, chat_id)
    if ready(documents).filter(F.col("document_id").isin(ids)).count() < len(ids):
        raise ValueError("every document must be ready")
    own = {r["document_id"] for r in chat_documents.filter(F.col("chat_id") == chat_id).select("document_id").limit(P.MAX_DOCUMENTS + 1).collect()}
    new = [i for i in ids if i not in own]
    if len(own) + len(new) > P.MAX_DOCUMENTS:
        raise ValueError(f"a chat has at most {P.MAX_DOCUMENTS} documents")
    if not new:
        return chats, chat_documents
    rows = chats.sparkSession.createDataFrame([(chat_id, i) for i in new], "chat_id string, document_id string").withColumn("attached_at", at)
    return bump_version(chats, chat_id, at), chat_documents.unionByName(rows)


def detach_document(chats: DataFrame, chat_documents: DataFrame, chat_id: str, document_id: str, at) -> tuple[DataFrame, DataFrame]:
    link = (F.col("chat_id") == chat_id) & (F.col("document_id") == document_id)
    if chat_documents.filter(link).isEmpty():
        return chats, chat_documents
    return bump_version(chats, chat_id, at), chat_documents.filter(~link)


def save_turn(chats: DataFrame, messages: DataFrame, sources: DataFrame, chat_id: str, version: int, question: str, answer: str, hits: DataFrame, tokens: tuple[int | None, int | None, int | None], ids: tuple[str, str], at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chats, messages, sources) with a question and its answer; an older context version is refused."""
    if chats.filter((F.col("chat_id") == chat_id) & (F.col("context_version") == version)).isEmpty():
        raise RuntimeError("chat context changed while the answer was made")
    last = messages.agg(F.coalesce(F.max("message_order"), F.lit(0)).alias("last"))
    two = chats.sparkSession.createDataFrame([(ids[0], 1, "USER", question, None, None, None), (ids[1], 2, "ASSISTANT", answer, *tokens)], "message_id string, n int, role string, content string, prompt_tokens int, completion_tokens int, total_tokens int")
    two = two.join(F.broadcast(last)).select("message_id", (F.col("last") + F.col("n")).alias("message_order"), F.lit(chat_id).alias("chat_id"), "role", "content", F.lit(version).alias("context_version"), "prompt_tokens", "completion_tokens", "total_tokens", at.alias("created_at"))
    new_sources = hits.select(F.lit(ids[1]).alias("message_id"), F.col("rank").alias("source_rank"), "score", F.col("text").alias("chunk_text"), "metadata")
    own_title = F.when(F.col("title") == P.DEFAULT_TITLE, T.title(F.lit(question), P.QUESTION_TITLE_LENGTH)).otherwise(F.col("title"))
    return _update(chats, F.col("chat_id") == chat_id, {"title": own_title}, at), messages.unionByName(two), sources.unionByName(new_sources)


def save_summary(summaries: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by chat and version."""
    return summaries.join(new.select("chat_id", "context_version"), ["chat_id", "context_version"], "left_anti").unionByName(new)


def in_message_order(messages: DataFrame) -> DataFrame:
    """message_order: unique and rising over all chats by creation, then id, with gaps as any sequence has; no task sees all rows."""
    return messages.orderBy("created_at", "message_id").withColumn("message_order", F.monotonically_increasing_id())
