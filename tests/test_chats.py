import datetime

import pytest
from pyspark.sql import functions as F

from lectern.operators import catalog as C, memory as M
from lectern.streaming import ingest as S



@pytest.fixture(autouse=True)
def moment(spark):
    global AT
    AT = F.lit(datetime.datetime(2024, 1, 1))


def chat(spark, *ids):
    out = spark.createDataFrame([], C.CHATS)
    for i in ids:
        out = C.create_chat(out, i, None, AT)
    return out


def documents(spark, *rows):
    return spark.createDataFrame([(i, i, i, s, n, None, None) for i, s, n in rows], C.DOCUMENTS)


def messages(spark, n, first=1, chat_id="c"):
    return spark.createDataFrame([(f"m{i}", first + i, chat_id, "USER" if i % 2 == 0 else "ASSISTANT", f"text {first + i}", 1, None, None, None, None) for i in range(n)], C.MESSAGES)


@pytest.mark.parametrize("n,kept,marker", [(12, list(range(101, 113)), None), (14, list(range(107, 115)), 106)])
def test_memory_is_compacted_above_its_limit(spark, n, kept, marker):
    m = M.split_memory(M.memory_state(chat(spark, "c"), messages(spark, n, 101), spark.createDataFrame([], C.SUMMARIES)))
    assert sorted(r.message_order for r in m.filter("not to_summary").collect()) == kept
    made = M.summary_inputs(m).collect()
    assert [r.marker for r in made] == ([marker] if marker else [])
    if made:
        assert made[0].summary_input.startswith("Existing rolling summary:\n(none)\n\nNew conversation messages to incorporate:\n\n--- USER message ---\ntext 101")


def test_summary_hides_what_it_covers(spark):
    s = spark.createDataFrame([("c", 1, "old talk", 104, None)], C.SUMMARIES)
    m = M.split_memory(M.memory_state(chat(spark, "c"), messages(spark, 6, 101), s))
    assert sorted(r.message_order for r in m.collect()) == [105, 106]
    q = M.retrieval_queries(m, spark.createDataFrame([("c", "Now?"), ("d", "New?")], "chat_id string, question string"))
    assert dict(q.collect()) == {"c": "Older conversation context: old talk\nPrevious question: text 105\nCurrent question: Now?", "d": "New?"}


def test_attach_detach_and_versions(spark):
    chats, links, docs = chat(spark, "c"), spark.createDataFrame([], C.CHAT_DOCUMENTS), documents(spark, ("a", "READY", 1), ("b", "READY", 2), ("x", "FAILED", 0), ("e", "READY", 1), ("f", "READY", 1))
    chats, links = C.attach_documents(chats, links, docs, "c", ["a", "b"], AT)
    again, _ = C.attach_documents(chats, links, docs, "c", ["a"], AT)
    assert chats.first().context_version == again.first().context_version == 2 and links.count() == 2
    for bad in (["x"], ["a", "a"], ["e", "f"]):
        with pytest.raises(ValueError):
            C.attach_documents(chats, links, docs, "c", bad, AT)
    with pytest.raises(LookupError):
        C.attach_documents(chats, links, docs, "none", ["a"], AT)
    chats, links = C.detach_document(chats, links, "c", "a", AT)
    assert chats.first().context_version == 3 and [r.document_id for r in links.collect()] == ["b"]
    assert C.chat_context(chats, links).first().document_ids == ["b"]


def test_turns(spark):
    chats, hits = chat(spark, "c"), spark.createDataFrame([(1, 0.5, "t", "{}")], "rank int, score double, text string, metadata string")
    chats, m, s = C.save_turn(chats, messages(spark, 2), spark.createDataFrame([], C.SOURCES), "c", 1, "  What   is it? ", "It is.", hits, (1, 2, 3), ("q", "a"), AT)
    assert chats.first().title == "What is it?" and m.agg(F.max("message_order")).first()[0] == 4
    nested = C.messages_with_sources(m, s).collect()
    assert [len(r.sources) for r in nested] == [0, 0, 0, 1]
    with pytest.raises(RuntimeError):
        C.save_turn(chats, m, s, "c", 9, "q", "a", hits, (None, None, None), ("q", "a"), AT)
    left = C.delete_chats(chats.select("chat_id"), chats, spark.createDataFrame([], C.CHAT_DOCUMENTS), m, s, spark.createDataFrame([], C.SUMMARIES))
    assert all(t.isEmpty() for t in left.values())


def test_documents(spark):
    docs = documents(spark, ("a", "READY", 3))
    new = spark.createDataFrame([("n", "a", "A2"), ("b", "b", "B")], "document_id string, content_fingerprint string, original_file_name string")
    out = {r.content_fingerprint: r for r in C.register(docs, new, AT).collect()}
    assert out["a"].document_id == "a" and out["a"].chunk_count == 3 and out["a"].status == "PROCESSING" and out["b"].document_id == "b"
    assert C.mark_failed(docs, "a", AT).first().status == "READY" and C.mark_failed(documents(spark, ("a", "PROCESSING", 0)), "a", AT).first().status == "FAILED"
    assert C.is_ready(C.mark_ready(documents(spark, ("a", "PROCESSING", 0)), "a", 2, AT), "a") and not C.is_ready(docs, "zzz")
    with pytest.raises(ValueError):
        C.rename_chat(chat(spark, "c"), "c", " ", AT)


def test_prompts(spark):
    m = M.split_memory(M.memory_state(chat(spark, "c"), messages(spark, 2), spark.createDataFrame([("c", 1, "sum", 0, None)], C.SUMMARIES)))
    hits = spark.createDataFrame([("c", 1, "body", "f.pdf", "d1", "Sec", [1, 2])], "chat_id string, rank int, text string, source_file_name string, document_id string, section_title string, page_numbers array<int>")
    g = M.grounded_contexts(hits, "chat_id").select("chat_id", M.grounded_message(F.lit("Q?"), F.col("context")).alias("grounded"))
    p = M.prompts("Be exact.", m, g).first().prompt
    assert [x.role for x in p] == ["system", "system", "user", "assistant", "user"] and "sum" in p[1].text
    assert "[Source 1]\nDocument: f.pdf\nDocument ID: d1\nSection: Sec\nPages: [1, 2]\nContent:\nbody\n[/Source 1]" in p[-1].text


def test_events():
    def turn(stage):
        stage("SEARCHING")
        yield "sources", 1
        stage("GENERATING")
        yield "token", "a"
        raise ValueError("no answer")

    out = list(S.chat_events(turn))
    assert [(e["event"], e["data"].get("stage") if isinstance(e["data"], dict) else e["data"]) for e in out] == [("progress", "UNDERSTANDING"), ("progress", "SEARCHING"), ("sources", 1), ("progress", "GENERATING"), ("token", "a"), ("failure", "GENERATING")]
    assert S.safe_message(ValueError("x")) == "x" and S.safe_message(RuntimeError("secret")) != "secret"
    assert S.decode_event('event: token\ndata: {"a":\ndata: 1}') == {"event": "token", "data": {"a": 1}}
    assert S.answer_text(iter([("a", None), ("b", {"t": 1}), ("", {"t": 2})])) == ("ab", {"t": 2})
    with pytest.raises(RuntimeError):
        S.answer_text(iter([]))


def test_progress(spark):
    b = spark.createDataFrame([("d", 1, 3, 120, 5), ("d", 2, 3, 80, 5)], "document_id string, batch int, chunks int, tokens int, total int")
    assert [(r.completed, r.tokens) for r in S.embedding_progress(b).orderBy("batch").collect()] == [(3, 120), (5, 200)]


def test_stream_ingest_replaces_documents(spark, tmp_path):
    inbox, store = str(tmp_path / "in"), str(tmp_path / "store")
    page = lambda key, text: spark.createDataFrame([(key, 1, f"{key}:1", text, "f.pdf")], S.PAGES)
    page("a", "First words here.").union(page("b", "Other words here.")).coalesce(1).write.parquet(inbox)
    S.stream_ingest(spark, inbox, store, str(tmp_path / "cp")).awaitTermination(120)
    page("a", "New words here.").coalesce(1).write.mode("append").parquet(inbox)
    S.stream_ingest(spark, inbox, store, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r.document_id, r.text) for r in spark.read.parquet(store).collect()) == [("a", "New words here."), ("b", "Other words here.")]
