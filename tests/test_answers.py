import math

import pytest
from pyspark.sql import functions as F

from lectern.operators import catalog, preview
from lectern.plans import answers as A
from lectern.streaming.ingest import PAGES


def made_embed():  # a nested function travels to the workers by value
    def embed(texts, task):
        out = []
        for t in texts:
            v = [float(t.lower().count(w)) for w in ("hash", "tree", "queue")] + [0.1]
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v])
        return out

    return embed


embed = made_embed()


def model(messages):
    return f"answer to {len(messages)}", (1, 2, 3)


def pages(spark, key, *texts):
    return spark.createDataFrame([(key, i + 1, f"{key}:{i + 1}", t, "f.pdf") for i, t in enumerate(texts)], PAGES)


@pytest.fixture
def library(spark, tmp_path):
    n = iter(range(1000))

    def keep(df):
        path = str(tmp_path / str(next(n)))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    lib = A.Library(spark)
    lib.made = A.ingest_document(lib, pages(spark, "k1", "1. Hash Maps\n\nA hash map keeps keys by hash.\n\n2. Trees\n\nA tree keeps keys in order."), "a.pdf", embed, keep)
    lib.keep = keep
    return lib


def test_ingest_twice_and_anew(spark, library):
    made = library.made
    assert made["chunk_count"] == 2 and not made["skipped"] and catalog.is_ready(library.documents, made["document_id"])
    again = A.ingest_document(library, pages(spark, "k1", "1. Hash Maps\n\nA hash map keeps keys by hash.\n\n2. Trees\n\nA tree keeps keys in order."), "a.pdf", embed, library.keep)
    assert again["skipped"] and again["stored_chunk_count"] == 0 and again["document_id"] == made["document_id"]
    new = A.ingest_document(library, pages(spark, "k1", "1. Queues\n\nA queue keeps order."), "a.pdf", embed, library.keep)
    assert library.chunks.count() == 1 and library.index.count() == 1 and new["ingestion_fingerprint"] != made["ingestion_fingerprint"]
    with pytest.raises(ValueError):
        A.ingest_document(library, pages(spark, "k2", ""), "b.pdf", embed, library.keep)
    assert library.documents.filter("content_fingerprint = 'k2'").first().status == "FAILED"


def test_answer(library):
    out = A.answer_question(library, " How does a hash map work? ", library.made["document_id"], 1, embed, model)
    assert out["retrieved_chunk_count"] == 1 and "hash map" in out["sources"][0].text and out["answer"] == "answer to 2"
    with pytest.raises(ValueError):
        A.answer_question(library, "x", "00000000-0000-0000-0000-000000000000", 1, embed, model)


def test_chat_turn(library):
    at, stages = F.current_timestamp(), []
    library.chats = catalog.create_chat(library.chats, "c", None, at)
    library.chats, library.chat_documents = catalog.attach_documents(library.chats, library.chat_documents, library.documents, "c", [library.made["document_id"]], at)
    out = A.chat_turn(library, "c", "What is a tree?", 2, embed, model, stages.append)
    assert stages == ["UNDERSTANDING", "SEARCHING", "GENERATING"] and out["tokens"] == (1, 2, 3)
    assert library.chats.first().title == "What is a tree?" and library.messages.count() == 2 and library.sources.count() == out["retrieved_chunk_count"]
    assert A.sum_tokens((40, 10, 50), (100, 25, 125)) == (140, 35, 175) and A.sum_tokens((None,) * 3, (None, 1, None)) == (None, 1, None)
    with pytest.raises(LookupError):
        A.chat_turn(library, "none", "q", 1, embed, model)


def test_previews(spark):
    c = spark.createDataFrame([(1, "b", None), (0, "a", "s")], "chunk_index int, text string, section_title string")
    assert [(r.chunk_index, r.section_title, r.page_number, r.heading_path) for r in preview.preview(c, 1).collect()] == [(0, "s", -1, [])]
    r = preview.preview_response(c, "f.pdf", 3).first()
    assert (r.total_chunk_count, r.preview_count, r.chunks[1].section_title) == (2, 2, "")
    with pytest.raises(ValueError):
        preview.preview(c, 0)
    hits = spark.createDataFrame([(1, 0.725), (3, 0.1)], "rank int, score double")
    assert [x.relevance for x in preview.visible_sources(hits).collect()] == [73]


def test_streams_end_in_time():
    from lectern.streaming.ingest import chat_events, ingestion_events

    now = iter(range(0, 10_000, 100))
    late = list(chat_events(lambda enter: iter([("token", str(i)) for i in range(9)]), clock=lambda: next(now)))
    assert late[-1]["event"] == "failure" and len(late) == 2
    attached = []
    out = list(ingestion_events(lambda: iter([(2, 5, 10), (4, 5, 20)]), lambda: {"document_id": "d"}, attached.append))
    assert [e["data"] for e in out] == [{"completed": 2, "total": 5, "tokens": 10}, {"completed": 5, "total": 5, "tokens": 30}, {"document_id": "d"}] and attached == [{"document_id": "d"}]

    def refuse():
        raise ValueError("not a PDF")

    assert list(ingestion_events(lambda: iter([]), refuse)) == [{"event": "failure", "data": {"message": "not a PDF"}}]
    now = iter(range(0, 10_000, 400))
    assert list(ingestion_events(lambda: iter([(1, 9, 1)] * 9), dict, clock=lambda: next(now)))[-1]["event"] == "failure"
