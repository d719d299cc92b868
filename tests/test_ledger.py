"""The stored catalog: writers that race, requests that are refused, tables that are folded meanwhile."""

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lectern.sources import commits, ledger as L, stores

AT = datetime(2024, 3, 3)
HITS = "rank int, score double, text string, metadata string"


@pytest.fixture
def store(spark):
    s = L.Ledger(spark, stores.scratch_path(spark, "ledger"))
    s.load(documents=spark.createDataFrame([(f"d{i}", f"f{i}", "n", "READY", 1, AT, AT) for i in range(5)], L.SCHEMAS["documents"]))
    L.create_chat(s, "c", None, AT)
    return s


def turn(store, k, version=1):
    return L.save_turn(store, "c", version, f"question {k}", f"answer {k}", store.spark.createDataFrame([(1, 0.5, f"text {k}", None)], HITS), (1, 1, 2), (f"q{k}", f"a{k}"), AT)


def test_turns_of_racing_writers_all_count_in_one_order(spark, store):
    threads = [threading.Thread(target=turn, args=(store, k)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = store.table("messages").orderBy("message_order").collect()
    assert [r["message_order"] for r in rows] == list(range(1, 7))
    assert [r["message_id"][1:] for r in rows[::2]] == [r["message_id"][1:] for r in rows[1::2]]  # an answer follows its question
    assert store.view().find("chats", chat_id="c")["title"] == f"question {rows[0]['message_id'][1:]}" and store.table("sources").count() == 3


def test_a_turn_for_an_older_context_is_refused_and_leaves_nothing(spark, store, monkeypatch):
    turn(store, 1)
    # another writer attaches a document between the check and the commit: the check is made again
    real, once = commits.commit, []

    def late(s, path, base, state):
        if not once:
            once.append(1)
            L.attach_documents(store, "c", ["d1"], AT)
        return real(s, path, base, state)

    monkeypatch.setattr(commits, "commit", late)
    with pytest.raises(RuntimeError, match="context changed"):
        turn(store, 2)
    view = store.view()
    assert view.find("chats", chat_id="c")["context_version"] == 2 and view.table("messages").count() == 2 and view.table("sources").count() == 1
    assert turn(store, 3, version=2) and store.table("messages").agg(F.max("message_order")).first()[0] == 4


def test_requests_that_are_refused(spark, store):
    before = commits.current(spark, store.path)
    for error, request in (
        (LookupError, lambda: L.delete_chat(store, "unknown")), (LookupError, lambda: L.rename_chat(store, "unknown", "x", AT)), (ValueError, lambda: L.rename_chat(store, "c", "  ", AT)), (LookupError, lambda: L.save_summary(store, "unknown", 1, "s", 1, AT)),
        (ValueError, lambda: L.attach_documents(store, "c", ["d1", "d1"], AT)), (ValueError, lambda: L.attach_documents(store, "c", ["d1", "none"], AT)), (ValueError, lambda: L.attach_documents(store, "c", ["d0", "d1", "d2", "d3"], AT)), (LookupError, lambda: L.mark_document(store, "none", 1, AT)),
    ):
        with pytest.raises(error):
            request()
    assert commits.current(spark, store.path) == before


def test_folding_keeps_what_comes_meanwhile_and_deletes_cascade(spark, store):
    for k in range(3):
        turn(store, k)
    old = store.view()
    L.create_chat(store, "other", "Other", AT)
    store.compact("chats")
    store.compact("messages")
    assert len(store.view().state["tables"]["chats"]) == 1 and store.table("messages").count() == 6
    L.delete_chat(store, "c")
    assert [r["chat_id"] for r in store.table("chats").collect()] == ["other"]
    assert store.table("messages").count() == store.table("sources").count() == 0 and store.table("documents").count() == 5
    store.compact("messages")
    assert store.table("messages").count() == 0 and old.table("messages").count() == 6  # an older version can still be read
