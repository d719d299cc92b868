"""Queries for what a library does besides retrieval: uploads, stores, catalog, chats, prompts; each with its SQL."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions import text as T
from lectern.operators import catalog, chunking, cleaning, identity, memory, preview, retrieval
from lectern.plans import structure
from lectern.plans.registry import _AT, _LINKS_SQL, _MESSAGES_SQL, _STATE_SQL, _TWO_FIELDS, _VECTOR_SQL, QUESTION, _bm25_sql, _chats, _chunks, _documents, _first_vector, _links, _memory, _messages, _per_row, _summaries, _vectors, cosine_topk, query
from lectern.sources import pages, pdf, stores
from lectern.sources.pages import table

LATER = "TIMESTAMP '2024-02-02 00:00:00'"


# ---- uploads and stores -------------------------------------------------------------------------
@query("""WITH u AS (SELECT doc_id, source || '/' || doc_id || CASE lang WHEN 'en' THEN '.PDF' WHEN 'fr' THEN '.pdf' ELSE '.txt' END AS path, CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 11 = 0 THEN 20971521 ELSE n_chars END AS n FROM documents)
    SELECT doc_id, n > 0 AND n <= 20971520 AND lower(path) LIKE '%.pdf' AS valid FROM u""")
def upload_checks(spark, d):
    doc = table(spark, d, "documents")
    path = F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".PDF").when(F.col("lang") == "fr", ".pdf").otherwise(".txt"))
    length = F.when(F.col("doc_id") % 7 == 0, 0).when(F.col("doc_id") % 11 == 0, P.MAX_UPLOAD_BYTES + 1).otherwise(F.col("n_chars"))
    return doc.select("doc_id", pages.valid_upload(path, length).alias("valid"))


@query(f"WITH {structure.pages_sql(40)} SELECT document_key AS file_name, page_number, length(text) AS n_chars, sha256(text) AS fingerprint FROM paged")
def pdf_page_scan(spark, d):
    """Every document written as a PDF of forty lines a page, and its pages read from the file's bytes."""
    made = F.pandas_udf(lambda texts: pd.Series([pdf.pdf_bytes(["\n".join(ls[i : i + 40]) for ls in [t.split("\n")] for i in range(0, len(ls), 40)]) for t in texts]), "binary")
    doc = _documents(spark, d).select(F.col("doc_id").cast("string").alias("file_name"), made(F.coalesce("text", F.lit(""))).alias("content"))
    read = pdf.scanned(doc.withColumn("document_key", F.sha2("content", 256)))
    return read.select("file_name", "page_number", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("fingerprint"))


@query("SELECT source AS document_id, count(*) AS n, sum(doc_id) AS ids FROM documents WHERE (source = 'src1' AND doc_id % 40 = 1) OR source = 'src2' GROUP BY source")
def stored_chunks(spark, d):
    """All chunks stored, one document then replaced by half of its chunks, two documents read back."""
    path = stores.scratch_path(spark, "store")
    chunks = _chunks(spark, d)
    stores.write_chunks(chunks, path)
    stores.write_chunks(chunks.filter("document_id = 'src1' AND chunk_index % 40 = 1"), path)
    stores.write_chunks(chunks.limit(0), path)  # nothing to store changes nothing
    found = stores.read_chunks(spark, path, ["src1", "src2"])
    return found.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("chunk_index").cast("long")).alias("ids"))


@query(_bm25_sql(_TWO_FIELDS) + " SELECT rank, chunk_id, score FROM keyword")
def bm25_stored_topk(spark, d):
    """As ``bm25_indexed_topk``, from postings written by term and read pruned."""
    path = stores.scratch_path(spark, "postings")
    index = retrieval.postings(retrieval.index_source(_chunks(spark, d)), list(_TWO_FIELDS))
    stores.write_postings(index, path)
    statistics = stores.read_statistics(spark, path)
    mine = stores.read_postings(spark, path, retrieval.query_terms(QUESTION))
    return retrieval.bm25_indexed(mine, statistics, QUESTION, 20, boosts={f: P.FIELD_BOOSTS[f] for f in _TWO_FIELDS}, digits=6).select("rank", "chunk_id", "score")


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS document_id FROM documents WHERE source <> 'src1'")
def without_document(spark, d):
    return retrieval.without_document(retrieval.index_source(_chunks(spark, d)), "src1").select("chunk_id", "document_id")


@query("SELECT CAST(row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS INTEGER) AS place, CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE source = 'src1'")
def document_chunks(spark, d):
    return stores.placed(retrieval.document_chunks(_chunks(spark, d), "src1").select("chunk_id"))


@query("SELECT doc_id, lang, source, source AS path_value, lang <> 'en' AS has_extra FROM documents")
def metadata_json(spark, d):
    """To JSON and back; a missing value has no key."""
    doc = table(spark, d, "documents").withColumn("extra", F.when(F.col("lang") != "en", 1))
    j = doc.select("doc_id", stores.to_metadata("lang", "source", "extra").alias("metadata"))
    back = stores.from_metadata("metadata", "lang string, source string, extra int")
    return j.select("doc_id", back["lang"].alias("lang"), back["source"].alias("source"), F.get_json_object("metadata", "$.source").alias("path_value"), F.col("metadata").contains('"extra"').alias("has_extra"))


@query("""SELECT CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS rank, conv_id || '-' || turn AS chunk_id, turn + 0.5::DOUBLE AS score, coalesce(text, '') AS text, role AS role FROM conversations""")
def parsed_hits(spark, d):
    """A response per conversation; every other hit names its chunk only by the hit's own id."""
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    source = F.struct(F.when(F.col("turn") % 2 == 0, key).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"), F.struct("role").alias("metadata"))
    hit = F.struct(F.col("turn"), key.alias("_id"), (F.col("turn") + 0.5).alias("_score"), source.alias("_source"))
    response = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(hit)).alias("hits")).alias("hits"))).alias("response"))
    return retrieval.parsed_hits(response).select("rank", "chunk_id", "score", "text", F.col("metadata")["role"].alias("role"))


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, length(text) AS characters, n_chars AS task FROM documents")
def embedded_chunks(spark, d):
    """An injected model: here a vector of the text's length and of the task's name's length."""
    chunks = _chunks(spark, d).select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    out = stores.embedded(chunks, lambda texts, task: [[float(len(t)), float(len(task))] for t in texts])
    task = len("RETRIEVAL_DOCUMENT")
    return out.select("chunk_id", F.col("embedding")[0].cast("long").alias("characters"), (F.length("text") * F.col("embedding")[1] / task).cast("long").alias("task"))


# ---- scalars ------------------------------------------------------------------------------------
@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND turn % 2 = 0 THEN NULL ELSE coalesce(CASE WHEN turn % 3 <> 0 THEN length(text) END, 0) + coalesce(CASE WHEN turn % 2 <> 0 THEN turn END, 0) END AS tokens,
      CASE turn % 4 WHEN 0 THEN 12 WHEN 1 THEN NULL WHEN 2 THEN -3 END AS number, coalesce(trim(CASE WHEN turn % 5 = 0 THEN ' ' ELSE role END) <> '' AND turn % 3 <> 0 AND turn % 5 <> 0, FALSE) AS same,
      lower(substr(md5(role), 1, 8) || '-' || substr(md5(role), 9, 4) || '-' || substr(md5(role), 13, 4) || '-' || substr(md5(role), 17, 4) || '-' || substr(md5(role), 21, 12)) AS id,
      CASE WHEN turn % 2 = 0 THEN 'c' || turn ELSE CASE WHEN turn % 3 = 0 THEN 'unknown' ELSE CAST(conv_id AS VARCHAR) END || ':' || CASE WHEN turn % 5 = 0 THEN md5(coalesce(text, '')) ELSE 'fp' END END AS key FROM conversations""")
def scalar_rules(spark, d):
    """Sums with missing counts, lenient numbers, equality of what is there, canonical ids, fallback keys."""
    c = table(spark, d, "conversations")
    turn, h = F.col("turn"), F.upper(F.md5("role"))
    number = F.when(turn % 4 == 0, " 12 ").when(turn % 4 == 1, "x1").when(turn % 4 == 2, "-3")
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return c.select(
        "conv_id", "turn", T.add_tokens(F.when(turn % 3 != 0, F.length("text").cast("long")), F.when(turn % 2 != 0, turn)).alias("tokens"), T.lenient_int(number).alias("number"),
        T.equal_and_present(F.when(turn % 5 == 0, " ").otherwise(F.col("role")), F.when(turn % 3 != 0, F.col("role"))).alias("same"), T.canonical_uuid(F.concat(F.lit(" "), F.concat_ws("-", *parts))).alias("id"),
        T.chunk_key(F.when(turn % 2 == 0, F.concat(F.lit(" c"), turn.cast("string"))).otherwise(F.lit(" ")), F.when(turn % 3 != 0, F.col("conv_id").cast("string")), F.when(turn % 5 != 0, "fp"), F.coalesce("text", F.lit(""))).alias("key"),
    )


@query("SELECT conv_id, turn + 1 AS rank, CAST(floor(((turn * 37 + conv_id) % 101) / 101.0 * 100 + 0.5) AS INTEGER) AS relevance FROM conversations WHERE turn < 2")
def visible_sources(spark, d):
    hits = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("rank"), (((F.col("turn") * 37 + F.col("conv_id")) % 101) / F.lit(101.0)).alias("score"))
    return preview.visible_sources(hits).select("conv_id", "rank", "relevance")


# ---- code blocks: pages made of the tables, as their texts hold no code ----------------------------
@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS ws FROM documents),
    lines AS (SELECT doc_id, list_transform(ws, lambda w, i: CASE (i - 1) % 5 WHEN 0 THEN 'public void ' || w || '() {{' WHEN 1 THEN 'int ' || w || ' = call(' || w || ', ' || i || ');' WHEN 2 THEN 'call(' || w || ',' WHEN 3 THEN w || ');'
        ELSE CASE WHEN doc_id % 3 = 0 THEN 'int ' || w || ' = ' || w || ';' ELSE '}}' END END) AS ls, CASE WHEN doc_id % 7 = 0 THEN 'String s = "' || array_to_string(ws, ' ') || '";' || chr(10) ELSE '' END AS long FROM w),
    blocks AS (SELECT doc_id, 'public class Made {{' || chr(10) || long || array_to_string(ls, chr(10)) || chr(10) || '}}' AS b FROM lines),
    parts AS (SELECT doc_id, {structure.code("b")} AS ps FROM blocks)
    SELECT doc_id, 'CODE' AS kind, len(ps) AS n, md5(array_to_string(ps, chr(31))) AS digest FROM parts""")
def code_parts(spark, d):
    """Every document's words as a class of methods (some never closed, some with a very long line), recognized as code and cut into parts."""
    doc = _documents(spark, d).select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)).alias("ws"))

    def line(w, i):
        last = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("int "), w, F.lit(" = "), w, F.lit(";"))).otherwise("}")
        number = (i + 1).cast("string")
        call = F.concat(F.lit("int "), w, F.lit(" = call("), w, F.lit(", "), number, F.lit(");"))
        return F.when(i % 5 == 0, F.concat(F.lit("public void "), w, F.lit("() {"))).when(i % 5 == 1, call).when(i % 5 == 2, F.concat(F.lit("call("), w, F.lit(","))).when(i % 5 == 3, F.concat(w, F.lit(");"))).otherwise(last)

    long = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('String s = "'), F.array_join("ws", " "), F.lit('";\n'))).otherwise("")
    block = F.concat(F.lit("public class Made {\n"), long, F.array_join(F.transform("ws", line), "\n"), F.lit("\n}"))
    cut = chunking.Chunker()
    parts = doc.select("doc_id", block.alias("b")).select("doc_id", _per_row(chunking.kind_of, "string", "b").alias("kind"), _per_row(cut.code, "array<string>", "b").alias("ps"))
    return parts.select("doc_id", "kind", F.size("ps").cast("long").alias("n"), F.md5(F.array_join("ps", chr(31))).alias("digest"))


@query("""WITH n AS (SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS m FROM documents),
    braces AS (SELECT doc_id, m, array_to_string(list_concat(list_transform(range(0, m + 1), lambda j: repeat(' ', 4 * CAST(j AS INTEGER)) || 'if (a' || j || ' > 0) {'), [repeat(' ', 4 * (m + 1)) || 'run("{", ' || doc_id || ');', repeat(' ', 4 * (m + 1)) || 'call(', repeat(' ', 4 * (m + 2)) || 'last);'],
        list_transform(range(0, m + 1), lambda j: repeat(' ', 4 * (m - CAST(j AS INTEGER))) || '}')), chr(10)) AS t FROM n),
    steps AS (SELECT doc_id, array_to_string(list_transform(range(0, m + 2), lambda j: repeat(' ', 4 * CAST(j AS INTEGER)) || 'step' || j || '(x);'), chr(10)) AS t FROM n)
    SELECT doc_id, md5(b.t || chr(10) || chr(10) || s.t || chr(10) || chr(10) || 'Some prose at the end.') AS digest FROM braces b JOIN steps s USING (doc_id)""")
def code_indentation(spark, d):
    """Blocks with braces (some in quotes, some lines in open parentheses) and without, at indentations that are all wrong."""
    def page(doc_id: int) -> str:
        m = doc_id % 4
        lines = [f"{' ' * (doc_id % 5)}if (a{j} > 0) {{" for j in range(m + 1)] + [f'   run("{{", {doc_id});', "call(", "last);"] + ["  }"] * (m + 1)
        return "\n".join([*lines, "", *[" " * (2 + 3 * j) + f"step{j}(x);" for j in range(m + 2)], "", "Some prose at", "the end."])

    made = F.pandas_udf(lambda ids: pd.Series([page(i) for i in ids]), "string")
    p = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_key"), F.lit(1).alias("page_number"), F.lit("p").alias("page_id"), made("doc_id").alias("text"))
    return cleaning.clean_pages(p).select(F.col("document_key").cast("long").alias("doc_id"), F.md5("text").alias("digest"))


# ---- retrieval --------------------------------------------------------------------------------------
@query((_VECTOR_SQL % "WHERE e.label IN (4)").replace("WHERE score > 0 ", ""))
def cosine_accept_all(spark, d):
    return retrieval.vector_search(_vectors(spark, d), _first_vector(spark, d), 20, ["4"], above=None, digits=6).select("rank", "chunk_id", "score")


@query(f"SELECT rank, chunk_id, score, 'vector' AS retrieval_mode FROM ({_VECTOR_SQL % ''}) WHERE rank <= 5")
def lexical_degraded(spark, d):
    """A lexical index that fails while it is read costs its hits only."""
    schema = "chunk_id string, document_id string, score double, rank int"
    broken = retrieval.index_source(_chunks(spark, d)).withColumn("content", F.raise_error(F.lit("the index is broken")))
    words = retrieval.degraded(lambda: retrieval.bm25_search(broken, QUESTION, 20), schema, spark)
    return retrieval.hybrid_search(cosine_topk(spark, d), words, 5).select("rank", "chunk_id", "score", "retrieval_mode")


@query(f"SELECT 'Why?' AS question, 'a,b' AS document_ids, 20 AS top_k, CAST(count(*) AS INTEGER) AS result_count, string_agg(chunk_id, ',' ORDER BY rank) AS results FROM ({_VECTOR_SQL % ''})")
def search_response(spark, d):
    out = retrieval.search_response(cosine_topk(spark, d), " Why? ", ["a", "b"], 20)
    return out.select("question", F.array_join("document_ids", ",").alias("document_ids"), "top_k", "result_count", F.array_join(F.transform("results", lambda r: r["chunk_id"]), ",").alias("results"))


@query("""SELECT source AS document_id, 'file of ' || source AS file_name, lang AS ingestion_fingerprint, CAST(length(source) AS INTEGER) AS source_page_count, count(*) AS chunk_count,
      CASE WHEN count(*) = count(*) FILTER (lang <> 'de' OR n_chars > 500) THEN 0 ELSE count(*) END AS stored_chunk_count, count(*) = count(*) FILTER (lang <> 'de' OR n_chars > 500) AS skipped, 0 AS embedding_tokens FROM documents GROUP BY source, lang""")
def ingestion_responses(spark, d):
    doc = table(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("lang").alias("ingestion_fingerprint"), "n_chars")
    expected = doc.groupBy("document_id", "ingestion_fingerprint").agg(F.count(F.lit(1)).alias("n_chunks"))
    names = doc.select("document_id").distinct().select("document_id", F.concat(F.lit("file of "), "document_id").alias("file_name"), F.length("document_id").alias("source_page_count"))
    return identity.ingestion_response(identity.ingestion_plan(expected, doc.filter("ingestion_fingerprint <> 'de' OR n_chars > 500")), names)


# ---- catalog ------------------------------------------------------------------------------------------
def _catalog(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the catalog: status by language, a count, times that repeat."""
    doc = table(spark, d, "documents")
    status = F.when(F.col("lang") == "en", "READY").when(F.col("lang") == "fr", "FAILED").otherwise("PROCESSING")
    return doc.select(
        F.col("doc_id").cast("string").alias("document_id"), F.md5(F.col("doc_id").cast("string")).alias("content_fingerprint"), F.col("source").alias("original_file_name"), status.alias("status"), (F.col("doc_id") % 3).cast("int").alias("chunk_count"),
        F.timestamp_seconds(1_704_067_200 + F.col("doc_id") % 10).alias("created_at"), F.expr(_AT).alias("updated_at"),
    )


_CATALOG_SQL = """catalog AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE lang WHEN 'en' THEN 'READY' WHEN 'fr' THEN 'FAILED' ELSE 'PROCESSING' END AS status, CAST(doc_id % 3 AS INTEGER) AS chunk_count, doc_id % 10 AS created FROM documents)"""


@query(f"""WITH {_CATALOG_SQL} SELECT 'ready' AS op, document_id, CASE WHEN document_id = '4' THEN 'READY' ELSE status END AS status, CASE WHEN document_id = '4' THEN 9 ELSE chunk_count END AS chunk_count, document_id = '4' AS touched FROM catalog
    UNION ALL SELECT 'failed', document_id, CASE WHEN document_id = '5' THEN CASE WHEN chunk_count > 0 THEN 'READY' ELSE 'FAILED' END ELSE status END, chunk_count, document_id = '5' FROM catalog
    UNION ALL SELECT 'failed anew', document_id, CASE WHEN document_id = '6' THEN CASE WHEN chunk_count > 0 THEN 'READY' ELSE 'FAILED' END ELSE status END, chunk_count, document_id = '6' FROM catalog""")
def marked_documents(spark, d):
    docs, at = _catalog(spark, d), F.expr(LATER)
    out = [("ready", catalog.mark_ready(docs, "4", 9, at)), ("failed", catalog.mark_failed(docs, "5", at)), ("failed anew", catalog.mark_failed(docs, "6", at))]
    rows = [x.select(F.lit(op).alias("op"), "document_id", "status", "chunk_count", (F.col("updated_at") == at).alias("touched")) for op, x in out]
    return rows[0].union(rows[1]).union(rows[2])


@query(f"WITH {_CATALOG_SQL} SELECT document_id FROM catalog WHERE status = 'READY' AND chunk_count > 0")
def ready_documents(spark, d):
    return catalog.ready(_catalog(spark, d)).select("document_id")


@query(f"WITH {_CATALOG_SQL} SELECT CAST(row_number() OVER (ORDER BY created DESC, document_id) AS INTEGER) AS place, document_id FROM catalog")
def listed_documents(spark, d):
    return stores.placed(catalog.list_documents(_catalog(spark, d)).select("document_id"))


# ---- chats --------------------------------------------------------------------------------------------
_CHATS_SQL = "chats AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS chat_id FROM conversations)"


@query(f"""WITH {_CHATS_SQL} SELECT chat_id, CASE WHEN chat_id = '3' THEN 'A new name' ELSE 'New chat' END AS title, CAST(CASE WHEN chat_id = '4' THEN 2 ELSE 1 END AS INTEGER) AS context_version FROM chats
    UNION ALL SELECT 'made', 'My title', 1 UNION ALL SELECT 'bare', 'New chat', 1""")
def changed_chats(spark, d):
    """Chats created, renamed, and with a version gone up."""
    at = F.expr(LATER)
    chats = catalog.create_chat(catalog.create_chat(_chats(spark, d), "made", "  My \n title ", at), "bare", None, at)
    return catalog.bump_version(catalog.rename_chat(chats, "3", " A  new name", at), "4", at).select("chat_id", "title", "context_version")


@query(f"""WITH {_CHATS_SQL} SELECT chat_id, coalesce(ids, '') AS ids FROM chats LEFT JOIN (SELECT CAST(conv_id AS VARCHAR) AS chat_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS ids FROM {_LINKS_SQL} GROUP BY 1) USING (chat_id)""")
def chat_contexts(spark, d):
    return catalog.chat_context(_chats(spark, d), _links(spark, d)).select("chat_id", F.array_join("document_ids", ",").alias("ids"))


@query(f"""WITH links AS (SELECT CAST(conv_id AS VARCHAR) AS chat_id, CAST(doc_id AS VARCHAR) AS document_id FROM {_LINKS_SQL}), first AS (SELECT min(CAST(doc_id AS VARCHAR)) AS id FROM documents WHERE lang = 'en' AND doc_id % 3 > 0 AND doc_id > 20)
    SELECT 'attached' AS op, * FROM links UNION ALL SELECT 'attached', '7', id FROM first UNION ALL SELECT 'detached', * FROM links WHERE NOT (chat_id = '7' AND document_id = '6')
    UNION ALL SELECT 'version', '7', '2' UNION ALL SELECT 'version after', '7', '2' UNION ALL SELECT 'version unchanged', '7', '1'""")
def attached_documents(spark, d):
    """A ready document attached to a chat, one detached, one detached that was not there; the version goes up with each change."""
    at, chats, links, docs = F.expr(LATER), _chats(spark, d), _links(spark, d), _catalog(spark, d)
    new = catalog.ready(docs).filter("CAST(document_id AS INT) > 20").agg(F.min("document_id")).first()[0]
    one, with_new = catalog.attach_documents(chats, links, docs, "7", [new], at)
    two, without = catalog.detach_document(chats, links, "7", "6", at)
    three, _ = catalog.detach_document(chats, links, "7", "none", at)
    rows = [t.select(F.lit(op).alias("op"), "chat_id", "document_id") for op, t in (("attached", with_new), ("detached", without))]
    rows += [t.filter("chat_id = '7'").select(F.lit(op).alias("op"), "chat_id", F.col("context_version").cast("string").alias("document_id")) for op, t in (("version", one), ("version after", two), ("version unchanged", three))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(f"""WITH m AS ({_MESSAGES_SQL}), last AS (SELECT max(message_order) AS n FROM m)
    SELECT 'message' AS kind, chat_id, CAST(message_order AS VARCHAR) AS place, role AS a, content AS b FROM m UNION ALL SELECT 'message', '2', CAST(n + 1 AS VARCHAR), 'USER', 'What now?' FROM last
    UNION ALL SELECT 'message', '2', CAST(n + 2 AS VARCHAR), 'ASSISTANT', 'This.' FROM last UNION ALL SELECT 'source', 'a', '1', '0.5', 'text 1' UNION ALL SELECT 'source', 'a', '2', '0.25', 'text 2'
    UNION ALL SELECT DISTINCT 'chat', chat_id, '', CASE WHEN chat_id = '2' THEN 'What now?' ELSE 'New chat' END, '' FROM m""")
def saved_turn(spark, d):
    """A question, its answer and two sources saved in a chat, which gets its title."""
    none = F.lit(None).cast("int")
    messages = _messages(spark, d).withColumns({"prompt_tokens": none, "completion_tokens": none, "total_tokens": none})
    hits = spark.createDataFrame([(1, 0.5, "text 1", None), (2, 0.25, "text 2", None)], "rank int, score double, text string, metadata string")
    chats, messages, sources = catalog.save_turn(_chats(spark, d), messages, spark.createDataFrame([], catalog.SOURCES), "2", 1, "What now?", "This.", hits, (1, 2, 3), ("q", "a"), F.expr(LATER))
    row = lambda kind, *c: [F.lit(kind).alias("kind"), *[x.alias(n) for x, n in zip(c, ("chat_id", "place", "a", "b"), strict=True)]]
    out = messages.select(*row("message", F.col("chat_id"), F.col("message_order").cast("string"), F.col("role"), F.col("content")))
    out = out.union(sources.select(*row("source", F.col("message_id"), F.col("source_rank").cast("string"), F.col("score").cast("string"), F.col("chunk_text"))))
    return out.union(chats.select(*row("chat", F.col("chat_id"), F.lit(""), F.col("title"), F.lit(""))))


@query("""WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS chat_id, 'system: set' AS summary FROM conversations WHERE turn = 0 AND role = 'system')
    SELECT chat_id, 1 AS context_version, 'new ' || chat_id AS summary FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS chat_id FROM conversations WHERE conv_id % 2 = 0) UNION ALL SELECT chat_id, 1, summary FROM s WHERE CAST(chat_id AS BIGINT) % 2 <> 0""")
def saved_summaries(spark, d):
    new = _chats(spark, d).filter("CAST(chat_id AS BIGINT) % 2 = 0").select("chat_id", "context_version", F.concat(F.lit("new "), "chat_id").alias("summary"), F.lit(1).cast("long").alias("summarized_through_order"), F.expr(LATER).alias("updated_at"))
    return catalog.save_summary(_summaries(spark, d), new).select("chat_id", "context_version", "summary")


@query("SELECT conv_id || '-' || turn AS message_id, CAST(row_number() OVER (ORDER BY conv_id % 5, conv_id || '-' || turn) AS INTEGER) AS place FROM conversations")
def message_orders(spark, d):
    m = _messages(spark, d).drop("message_order").withColumn("created_at", F.timestamp_seconds(F.col("chat_id").cast("long") % 5))
    return stores.placed(catalog.in_message_order(m).orderBy("message_order").select("message_id"))


@query("""SELECT conv_id || '-' || turn AS message_id, lower(role) AS role, CASE WHEN role = 'assistant' THEN array_to_string(list_transform(range(1, turn % 3 + 2), lambda i: i || ':' || conv_id), ',') ELSE '' END AS sources FROM conversations""")
def messages_with_sources(spark, d):
    """Every answer has one to three sources, stored in no order."""
    answers = table(spark, d, "conversations").filter("role = 'assistant'")
    n = (F.col("turn") % 3 + 1).cast("int")
    s = answers.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"), F.col("conv_id").cast("string").alias("chunk_text"), F.explode(F.reverse(F.sequence(F.lit(1), n))).alias("source_rank"))
    sources = s.select("message_id", "source_rank", F.lit(0.5).alias("score"), "chunk_text", F.lit(None).cast("string").alias("metadata"))
    out = catalog.messages_with_sources(_messages(spark, d), sources)
    return out.select("message_id", "role", F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["source_rank"].cast("string"), x["chunk_text"])), ",").alias("sources"))


# ---- prompts --------------------------------------------------------------------------------------------
_NOTE = memory.SUMMARY_NOTE.replace("'", "''").replace("\n", "' || chr(10) || '")


@query(f"""WITH {_STATE_SQL}, h AS (SELECT chat_id, any_value(summary) AS summary, string_agg(CASE WHEN role = 'USER' THEN 'user' ELSE 'assistant' END || chr(31) || content, chr(30) ORDER BY message_order) AS h FROM memory WHERE NOT to_summary GROUP BY chat_id),
    c AS (SELECT DISTINCT chat_id FROM messages)
    SELECT chat_id, md5('system' || chr(31) || 'Rules.' || chr(30) || CASE WHEN trim(coalesce(summary, '')) <> '' THEN 'system' || chr(31) || replace('{_NOTE}', '%s', summary) || chr(30) ELSE '' END || coalesce(h || chr(30), '') || 'user' || chr(31) || 'Ask ' || chat_id) AS digest FROM c LEFT JOIN h USING (chat_id)""")
def prompt_messages(spark, d):
    """Instructions, the summary's note, history with its roles, the grounded question."""
    asked = _chats(spark, d).select("chat_id", F.concat(F.lit("Ask "), "chat_id").alias("grounded"))
    p = memory.prompts("Rules.", _memory(spark, d), asked)
    return p.select("chat_id", F.md5(F.array_join(F.transform("prompt", lambda m: F.concat_ws("\x1f", m["role"], m["text"])), "\x1e")).alias("digest"))


@query("""SELECT conv_id, 'Answer this question about the selected document:' || chr(10) || 'Why?' || chr(10) || chr(10) || 'Retrieved document sources:' || chr(10) || string_agg(chr(10) || '[Source ' || (turn + 1) || ']' || chr(10) || 'Section: ' || role || chr(10) || 'Pages: Unknown'
    || chr(10) || 'Content:' || chr(10) || coalesce(text, '') || chr(10) || '[/Source ' || (turn + 1) || ']' || chr(10), '' ORDER BY turn) || chr(10) AS message FROM conversations GROUP BY conv_id""")
def grounded_answer(spark, d):
    hits = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("rank"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("section_title"))
    context = memory.grounded_contexts(hits, "conv_id", with_document=False)
    return context.select("conv_id", memory.grounded_message(F.lit("Why?"), F.col("context"), chat=False).alias("message"))


@query("SELECT source AS file_name, 3 AS source_document_count, count(*) AS total_chunk_count, CAST(least(4, count(*)) AS INTEGER) AS preview_count, array_to_string(list(CAST(doc_id AS VARCHAR) ORDER BY doc_id)[1:4], ',') AS ids FROM documents WHERE source = 'src1' GROUP BY source")
def preview_responses(spark, d):
    out = preview.preview_response(_chunks(spark, d).filter("document_id = 'src1'"), "src1", 3, 4)
    return out.select("file_name", "source_document_count", "total_chunk_count", "preview_count", F.array_join(F.transform("chunks", lambda c: c["chunk_index"].cast("string")), ",").alias("ids"))


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE lang <> 'en'")
def new_chunks(spark, d):
    chunks = _documents(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "lang")
    return identity.new_chunks(chunks, chunks.filter("lang = 'en'")).select("chunk_id")


# ---- requests and compatibility forms -----------------------------------------------------------------
@query("""WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS q, turn * 7 % 30 - 1 AS k, list_transform(range(0, turn % 5), lambda i: CASE WHEN turn % 3 = 0 AND i > 0 THEN 'd0' WHEN turn % 7 = 6 AND i = 1 THEN ' ' ELSE 'd' || i END) AS ids FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_matches(q, '\\S') THEN CAST(length(regexp_replace(q, '^\\s+|\\s+$', '', 'g')) AS VARCHAR) ELSE 'question must not be blank' END AS question,
      CASE WHEN k = -1 THEN '5' WHEN k BETWEEN 1 AND 20 THEN CAST(k AS VARCHAR) ELSE 'topK must be between 1 and 20' END AS top_k,
      CASE WHEN len(ids) = 0 THEN 'at least one document id is required' WHEN len(ids) > 3 THEN 'at most 3 documents can be searched' WHEN len(list_filter(ids, lambda x: trim(x) = '')) > 0 THEN 'document id must not be blank'
        WHEN len(list_distinct(ids)) < len(ids) THEN 'document ids must be distinct' ELSE array_to_string(ids, ',') END AS ids FROM r""")
def request_checks(spark, d):
    """Every conversation turn as a request: its question, its number of results and its documents as they are accepted, or why not."""
    c = table(spark, d, "conversations")
    n = (F.col("turn") % 5).cast("int")
    named = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when((F.col("turn") % 3 == 0) & (i > 0), "d0").when((F.col("turn") % 7 == 6) & (i == 1), " ").otherwise(F.concat(F.lit("d"), i.cast("string"))))
    rows = c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("q"), (F.col("turn") * 7 % 30 - 1).cast("int").alias("k"), F.slice(named, F.lit(1), n).alias("ids"))

    def told(rule):
        def run(x):
            try:
                return rule(x)
            except ValueError as refused:
                return str(refused)

        return run

    question = _per_row(told(lambda q: str(len(retrieval.checked_question(q)))), "string", "q")
    top_k = _per_row(told(lambda k: str(retrieval.checked_top_k(None if k == -1 else int(k)))), "string", "k")
    ids = _per_row(told(lambda i: ",".join(retrieval.checked_document_ids(list(i)))), "string", "ids")
    return rows.select("conv_id", "turn", question.alias("question"), top_k.alias("top_k"), ids.alias("ids"))


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(replace(coalesce(text, '') || chr(10) || 'fine 1 A2 1/4 km Angstrom Å ガ x' || chr(10) || 'end', chr(160), ' '), '\\r\\n?', chr(10), 'g'), '\\n$', '') AS t FROM documents),
    n AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda l: {structure.NORMAL_LINE}) AS ls FROM t)
    SELECT doc_id, len(ls) AS n_lines, md5(array_to_string(ls, chr(10))) AS digest FROM n""")
def compatibility_forms(spark, d):
    """Ligatures, circled and wide characters, squared units, composed marks, hard blanks and carriage returns behind every text."""
    odd = "\r\n\ufb01ne \u2460 \uff21\u00b2 1\u20444 \u339e \u212bngstrom A\u030a \uff76\uff9e\u00a0x\rend".replace("\u20444", "/4").replace("\u212bngstrom", "Angstrom")
    doc = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(odd)).alias("text"))
    lines = doc.select("doc_id", cleaning.normalized_lines(F.col("text")).alias("ls"))
    return lines.select("doc_id", F.size("ls").cast("long").alias("n_lines"), F.md5(F.array_join("ls", "\n")).alias("digest"))
