"""Progress events of a stream that runs: rising counts, a result, failures, and the deadline."""

import itertools
import shutil

import pytest
from pyspark.sql import functions as F

from lectern.plans import stored as queries
from lectern.sources import stores
from lectern.streaming import ingest as I, progress


@pytest.fixture
def inbox(spark, tmp_path):
    path = str(tmp_path / "in")
    for i in range(3):  # a file a batch
        rows = [(f"doc{i}{j}", p, f"doc{i}{j}:{p}", f"Words of document {j} on page {p}. " * 30, f"f{i}.pdf") for j in range(i + 1) for p in (1, 2)]
        spark.createDataFrame(rows, I.PAGES).coalesce(1).write.mode("append").parquet(path)
    return path


def test_counts_rise_with_each_batch_and_end_in_a_result(spark, inbox, tmp_path):
    attached = []
    events = list(progress.stream_events(spark, inbox, str(tmp_path / "store"), str(tmp_path / "cp"), 1, lambda t: t | {"name": "x"}, attached.append))
    told = [e["data"] for e in events if e["event"] == "progress"]
    assert [e["event"] for e in events] == ["progress"] * 3 + ["result"] and [t["batch"] for t in told] == [0, 1, 2]
    assert all(a["completed"] < b["completed"] and a["tokens"] < b["tokens"] and a["pages"] < b["pages"] for a, b in itertools.pairwise(told))
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert stored.agg(F.count(F.lit(1)), F.sum("estimated_token_count"), F.count_distinct("document_id")).first()[:] == (told[-1]["completed"], told[-1]["tokens"], 6)
    assert told[-1]["pages"] == 12 and told[-1]["documents"] == 6
    assert attached == [events[-1]["data"]] and attached[0]["name"] == "x"
    # nothing is new: no progress, a result
    again = list(progress.stream_events(spark, inbox, str(tmp_path / "store"), str(tmp_path / "cp"), 1))
    assert [e["event"] for e in again] == ["result"] and again[0]["data"]["completed"] == 0


def test_the_deadline_stops_the_stream_and_a_later_start_goes_on(spark, inbox, tmp_path):
    late = [0.0]
    events = progress.stream_events(spark, inbox, str(tmp_path / "store"), str(tmp_path / "cp"), 1, seconds=600, clock=lambda: late[0])
    assert next(events)["data"]["batch"] == 0
    late[0] = 601.0
    rest = list(events)
    assert [e["event"] for e in rest] == ["failure"] and not [q for q in spark.streams.active if (q.name or "").startswith("ingestion-")]
    after = list(progress.stream_events(spark, inbox, str(tmp_path / "store"), str(tmp_path / "cp"), 1))
    assert after[-1]["event"] == "result"
    assert spark.read.parquet(str(tmp_path / "store")).select("document_id").distinct().count() == 6


def test_failures_are_told_without_what_is_inside(spark, inbox, tmp_path):
    def broken(text):
        raise RuntimeError("secret")

    events = list(progress.stream_events(spark, inbox, str(tmp_path / "store"), str(tmp_path / "cp"), 1, estimate=broken))
    assert [e["event"] for e in events] == ["failure"] and "secret" not in events[0]["data"]["message"]
    events = list(progress.stream_events(spark, inbox, str(tmp_path / "s2"), str(tmp_path / "cp2"), 5, finish=lambda t: (_ for _ in ()).throw(ValueError("refused"))))
    assert [e["event"] for e in events] == ["progress", "failure"] and events[-1]["data"]["message"] == "refused"


def test_a_batch_of_many_documents_is_stored_in_one_folder(spark, tmp_path):
    rows = [(f"{i:03}", 1, f"{i:03}:1", f"Words of document {i}. " * 5, "f.pdf") for i in range(60)]
    spark.createDataFrame(rows, I.PAGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert list(progress.stream_events(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")))[-1]["event"] == "result"
    assert len([x for x in (tmp_path / "store").iterdir() if x.is_dir()]) == 1
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "store")).select("document_id").distinct().collect()) == [r[0] for r in rows]


def test_documents_are_replaced_within_folders_and_a_call_cut_short_is_healed(spark, tmp_path):
    path = str(tmp_path / "store")
    put = lambda *rows: stores.replace_documents(spark.createDataFrame(rows, "document_id string, chunk_index int, text string"), path)
    held = lambda: sorted(((r.document_id or "", r.chunk_index, r.text) for r in spark.read.parquet(path).collect()))
    folders = lambda: {x for x in (tmp_path / "store").iterdir() if x.is_dir()}
    put(("a", 0, "a0"), ("a", 1, "a1"), ("b", 0, "b0"), (None, 0, "n0"))
    (first,) = folders()
    put(("c", 0, "c0"), ("d", 0, "d0"))
    other = folders() - {first}
    shutil.copytree(first, tmp_path / "kept")
    change = [("a", 0, "new"), (None, 0, "n1")]
    after = [("", 0, "n1"), ("a", 0, "new"), ("b", 0, "b0"), ("c", 0, "c0"), ("d", 0, "d0")]
    put(*change)
    assert held() == after and other < folders() and first not in folders()
    shutil.move(tmp_path / "kept", first)  # as if the call had ended before it deleted what it replaced
    put(*change)
    assert held() == after and len(folders()) == 2
    stores.replace_documents(spark.createDataFrame([], "document_id string, chunk_index int, text string"), path)
    assert held() == after and len(folders()) == 2


def test_batches_of_several_files_are_three_all_the_same(spark, sf, monkeypatch):
    one = queries.stream_progress(spark, sf).first()
    monkeypatch.setattr(queries, "_FILE_DOCUMENTS", 8)
    asked = []
    events = progress.stream_events
    monkeypatch.setattr(progress, "stream_events", lambda *a: asked.append(a[4]) or events(*a))
    assert queries.stream_progress(spark, sf).first() == one and one["batches"] == 3 and asked[0] > 1


def test_pages_count_once_however_often_a_batch_is_worked_out(spark, inbox, tmp_path, monkeypatch):
    frame = type(spark.range(1))  # nothing is kept, as where another executor has what was kept
    monkeypatch.setattr(frame, "persist", lambda self, *a: self)
    monkeypatch.setattr(frame, "unpersist", lambda self, *a: self)
    write = stores.replace_documents
    monkeypatch.setattr(stores, "replace_documents", lambda chunks, store: (chunks.count(), write(chunks, store)))
    last = list(progress.stream_events(spark, inbox, str(tmp_path / "store"), str(tmp_path / "cp"), 1))[-1]
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert last["event"] == "result" and (last["data"]["pages"], last["data"]["documents"]) == (12, 6)
    assert stored.agg(F.count(F.lit(1)), F.sum("estimated_token_count")).first()[:] == (last["data"]["completed"], last["data"]["tokens"])
