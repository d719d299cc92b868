"""Queries over the stored catalog; each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lectern.plans.library import _CATALOG_SQL, _CHATS_SQL, _catalog
from lectern.plans.registry import _CHUNKS_SQL, _LINKS_SQL, _MESSAGES_SQL, ORACLE_SQL, _chats, _links, _messages, _summaries, query
from lectern.sources import bulk, ledger, stores
from lectern.sources.pages import paged, table
from lectern.streaming import progress

_LATER = datetime(2024, 2, 2)
_FILE_DOCUMENTS = 512


def _ledger(spark, d, *tables: str) -> ledger.Ledger:
    """The driver's tables as a stored catalog."""
    none = F.lit(None).cast("int")
    made = {
        "documents": lambda: _catalog(spark, d), "chats": lambda: _chats(spark, d), "chat_documents": lambda: _links(spark, d), "summaries": lambda: _summaries(spark, d),
        "messages": lambda: _messages(spark, d).withColumns({"prompt_tokens": none, "completion_tokens": none, "total_tokens": none}),
    }
    out = ledger.Ledger(spark, stores.scratch_path(spark, "ledger"))
    out.load(**{t: made[t]() for t in tables})
    return out


@query(ORACLE_SQL["saved_turn"])
def stored_turn(spark, d):
    """As ``saved_turn``, in stored tables: the order of the new messages comes from the version, not from a scan."""
    store = _ledger(spark, d, "chats", "messages")
    hits = spark.createDataFrame([(1, 0.5, "text 1", None), (2, 0.25, "text 2", None)], "rank int, score double, text string, metadata string")
    ledger.save_turn(store, "2", 1, "What now?", "This.", hits, (1, 2, 3), ("q", "a"), _LATER)
    view = store.view()
    row = lambda kind, *c: [F.lit(kind).alias("kind"), *[x.alias(n) for x, n in zip(c, ("chat_id", "place", "a", "b"), strict=True)]]
    out = view.table("messages").select(*row("message", F.col("chat_id"), F.col("message_order").cast("string"), F.col("role"), F.col("content")))
    out = out.union(view.table("sources").select(*row("source", F.col("message_id"), F.col("source_rank").cast("string"), F.col("score").cast("string"), F.col("chunk_text"))))
    return out.union(view.table("chats").select(*row("chat", F.col("chat_id"), F.lit(""), F.col("title"), F.lit(""))))


@query(f"""WITH {_CHATS_SQL}, {_CATALOG_SQL}, m AS ({_MESSAGES_SQL}), links AS (SELECT CAST(conv_id AS VARCHAR) AS chat_id, CAST(doc_id AS VARCHAR) AS document_id FROM {_LINKS_SQL}),
    fresh AS (SELECT min(document_id) AS id FROM catalog WHERE status = 'READY' AND chunk_count > 0 AND CAST(document_id AS INT) > 20)
    SELECT 'chat' AS kind, chat_id AS k, CASE WHEN chat_id = '3' THEN 'A new name 1' WHEN chat_id = '7' THEN 'New chat 3' ELSE 'New chat 1' END AS v FROM chats WHERE chat_id <> '5' UNION ALL SELECT 'chat', 'made', 'My title 1'
    UNION ALL SELECT 'link', chat_id, document_id FROM links WHERE chat_id <> '5' AND NOT (chat_id = '7' AND document_id = '6') UNION ALL SELECT 'link', '7', id FROM fresh
    UNION ALL SELECT 'messages', chat_id, CAST(count(*) AS VARCHAR) FROM m WHERE chat_id <> '5' GROUP BY chat_id
    UNION ALL SELECT 'summary', chat_id, CASE WHEN chat_id = '2' THEN 'second' ELSE 'system: set' END FROM (SELECT CAST(conv_id AS VARCHAR) AS chat_id FROM conversations WHERE turn = 0 AND role = 'system' UNION SELECT '2') WHERE chat_id <> '5'
    UNION ALL SELECT 'document', document_id, CASE document_id WHEN '4' THEN 'READY 9' WHEN '5' THEN CASE WHEN chunk_count > 0 THEN 'READY ' ELSE 'FAILED ' END || chunk_count WHEN '8' THEN 'PROCESSING ' || chunk_count ELSE status || ' ' || chunk_count END FROM catalog
    UNION ALL SELECT 'document', 'brand new', 'PROCESSING 0' UNION ALL SELECT 'refused', x, '' FROM (SELECT unnest(['attach', 'delete', 'rename', 'turn']) AS x)""")
def stored_library(spark, d):
    """A day of a stored catalog: chats made, renamed, deleted with all that hangs on them, documents attached, detached, registered and
    marked, a summary written twice, two tables folded; four requests are refused and leave nothing."""
    store = _ledger(spark, d, "documents", "chats", "chat_documents", "messages", "summaries")
    at = _LATER
    fresh = _catalog(spark, d).filter("status = 'READY' AND chunk_count > 0 AND CAST(document_id AS INT) > 20").agg(F.min("document_id")).first()[0]
    ledger.create_chat(store, "made", "  My \n title ", at)
    ledger.rename_chat(store, "3", " A  new name", at)
    ledger.attach_documents(store, "7", [fresh], at)
    ledger.attach_documents(store, "7", [fresh], at)  # it is there
    ledger.detach_document(store, "7", "6", at)
    ledger.detach_document(store, "7", "6", at)  # it is gone
    ledger.save_summary(store, "2", 1, "first", 1, at)
    ledger.save_summary(store, "2", 1, "second", 2, at)
    ledger.delete_chat(store, "5")
    store.compact("chats")
    store.compact("documents")
    ledger.mark_document(store, "4", 9, at)
    ledger.mark_document(store, "5", None, at)
    known = F.md5(F.lit("8"))
    ledger.register_documents(store, spark.range(2).select(F.when(F.col("id") == 0, "brand new").otherwise("unused").alias("document_id"), F.when(F.col("id") == 0, "f").otherwise(known).alias("content_fingerprint"), F.lit("n.pdf").alias("original_file_name")), at)
    refused = []
    hits = spark.createDataFrame([], "rank int, score double, text string, metadata string")
    tried = {
        "attach": lambda: ledger.attach_documents(store, "7", ["none"], at), "delete": lambda: ledger.delete_chat(store, "5"), "rename": lambda: ledger.rename_chat(store, "5", "x", at),
        "turn": lambda: ledger.save_turn(store, "7", 1, "q", "a", hits, (None, None, None), ("x", "y"), at),
    }
    for name, request in tried.items():
        try:
            request()
        except (LookupError, RuntimeError, ValueError):
            refused.append(name)
    view = store.view()
    row = lambda kind, df, k, v: df.select(F.lit(kind).alias("kind"), k.alias("k"), v.alias("v"))
    out = row("chat", view.table("chats"), F.col("chat_id"), F.concat_ws(" ", "title", F.col("context_version").cast("string")))
    out = out.union(row("link", view.table("chat_documents"), F.col("chat_id"), F.col("document_id")))
    out = out.union(row("messages", view.table("messages").groupBy("chat_id").agg(F.count(F.lit(1)).cast("string").alias("n")), F.col("chat_id"), F.col("n")))
    out = out.union(row("summary", view.table("summaries"), F.col("chat_id"), F.col("summary")))
    out = out.union(row("document", view.table("documents"), F.col("document_id"), F.concat_ws(" ", "status", F.col("chunk_count").cast("string"))))
    return out.union(row("refused", spark.createDataFrame([(x,) for x in refused], "x string"), F.col("x"), F.lit("")))


# ---- ingestion out of a stream ----------------------------------------------------------------------
@query(f"""{_CHUNKS_SQL} SELECT 'progress' AS event, 3 AS batches, true AS rising, (SELECT count(*) FROM documents) AS documents, count(*) AS completed, CAST(sum(n + overlap) AS BIGINT) AS tokens FROM chunks""")
def stream_progress(spark, d):
    """All documents through a file stream of three batches: what its progress events tell, and that they rise."""
    inbox, store, checkpoint = (stores.scratch_path(spark, n) for n in ("inbox", "store", "checkpoint"))
    documents = table(spark, d, "documents")
    # so many files a batch, with hundreds of documents in each: none is empty, so there are three batches
    files = max(1, documents.agg(F.approx_count_distinct("doc_id")).first()[0] // (3 * _FILE_DOCUMENTS))
    pages = paged(documents)
    for i in range(3):  # a document's pages lie in one file
        pages.filter(F.pmod(F.xxhash64("document_key"), F.lit(3)) == i).repartition(files, "document_key").write.mode("append").parquet(inbox)
    events = list(progress.stream_events(spark, inbox, store, checkpoint, files))
    told = [e["data"] for e in events if e["event"] == "progress"]
    rising = all(a["completed"] < b["completed"] and a["tokens"] < b["tokens"] for a, b in zip(told, told[1:], strict=False)) and events[-1]["event"] == "result"
    last = told[-1]
    return spark.createDataFrame([("progress", len(told), rising, last["documents"], last["completed"], last["tokens"])], "event string, batches int, rising boolean, documents long, completed long, tokens long")


# ---- bulk sink ------------------------------------------------------------------------------------------
@query("""WITH rows AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE CAST(doc_id AS VARCHAR) END AS chunk_id, CASE WHEN doc_id % 11 <> 0 THEN source END AS document_id, text, CASE WHEN doc_id % 13 = 0 THEN 3 WHEN doc_id % 19 = 0 THEN NULL ELSE 4 END AS dims, doc_id % 17 = 0 AS odd FROM documents),
    judged AS (SELECT *, CASE WHEN trim(chunk_id) = '' THEN 'chunk_id is missing' WHEN coalesce(trim(document_id), '') = '' THEN 'document_id is missing' WHEN coalesce(regexp_replace(text, '\\s', '', 'g'), '') = '' THEN 'text is missing'
        WHEN dims IS NULL THEN 'embedding is missing' WHEN dims <> 4 THEN 'embedding does not have 4 dimensions' WHEN odd THEN 'embedding has a value that is no number' END AS reason FROM rows)
    SELECT 'rejected' AS kind, chunk_id, document_id, reason AS what FROM judged WHERE reason IS NOT NULL UNION ALL SELECT 'accepted', chunk_id, document_id, CAST(length(text) AS VARCHAR) FROM judged WHERE reason IS NULL""")
def rejected_items(spark, d):
    """All documents into the sink, many with a fault: good rows stored, refused ones listed; a second job that may not refuse any leaves nothing."""
    path = stores.scratch_path(spark, "bulk")
    n = F.col("doc_id")
    value = F.when(n % 17 == 0, F.lit(float("nan"))).otherwise(F.lit(0.5))
    vector = F.when(n % 13 == 0, F.array(value, value, value)).when(n % 19 == 0, F.lit(None)).otherwise(F.array(F.lit(1.0), value, value, value))
    rows = table(spark, d, "documents").select(F.when(n % 7 == 0, "  ").otherwise(n.cast("string")).alias("chunk_id"), F.when(n % 11 != 0, F.col("source")).alias("document_id"), "text", vector.alias("embedding"))
    bulk.write(rows, path, dimensions=4)
    try:
        bulk.write(rows, path, dimensions=4, fail_fast=True)
    except Exception as refused:
        if "were refused" not in str(refused):
            raise
    good = bulk.read(spark, path, "accepted", "chunk_id string, document_id string, text string, embedding array<double>")
    bad = bulk.read(spark, path, "rejected", bulk.REJECTED)
    out = good.select(F.lit("accepted").alias("kind"), "chunk_id", "document_id", F.length("text").cast("string").alias("what"))
    return out.unionByName(bad.select(F.lit("rejected").alias("kind"), "chunk_id", "document_id", F.col("reason").alias("what")))
