"""Versions, and the lexical index that is kept up under them."""

import threading

import pytest

from lectern.operators import retrieval as R
from lectern.sources import commits, segments, stores

ROW = "chunk_id string, document_id string, content string, section_title string"
FIELDS = {"content": 1.0, "section_title": 4.0}


def test_two_writers_of_one_version_one_is_refused(spark):
    path = stores.scratch_path(spark, "versions")
    assert commits.current(spark, path) == (0, {})
    commits.commit(spark, path, 0, {"n": 0})
    ready, won, refused = threading.Barrier(4), [], []

    def write(k):
        base, _ = commits.current(spark, path)
        ready.wait()
        try:
            won.append((k, commits.commit(spark, path, base, {"n": k})))
        except commits.Conflict:
            refused.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(refused) == 3
    assert commits.current(spark, path) == (2, {"n": won[0][0]})
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, 1, {"n": 9})


def test_racing_changes_are_all_kept(spark):
    path = stores.scratch_path(spark, "versions")
    threads = [threading.Thread(target=lambda k=k: commits.change(spark, path, lambda s: s | {str(k): k}, attempts=20)) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    version, state = commits.current(spark, path)
    assert version == 5 and state == {str(k): k for k in range(5)}


def source(spark, *rows):
    return spark.createDataFrame([(c, d, t, h) for c, d, t, h in rows], ROW)


@pytest.fixture
def path(spark):
    p = stores.scratch_path(spark, "segments")
    segments.create(spark, p, list(FIELDS))
    segments.create(spark, p)  # there is one
    return p


def same(spark, path, live, question="red fox", ids=None):
    found = [(r["rank"], r["chunk_id"], r["score"]) for r in segments.search(spark, path, question, 20, ids, FIELDS, 9).orderBy("rank").collect()]
    assert found == [(r["rank"], r["chunk_id"], r["score"]) for r in R.bm25_search(live, question, 20, ids, FIELDS, 9).orderBy("rank").collect()]
    return [c for _, c, _ in found]


def test_changes_give_what_a_fresh_search_gives(spark, path):
    assert segments.search(spark, path, "red fox").count() == 0
    a = source(spark, ("a1", "a", "red fox red", ""), ("a2", "a", "a blue fox", "red"), ("b1", "b", "the red fox", "fox red"))
    c = source(spark, ("c1", "c", "fox fox red", None), ("n1", None, "red red fox", ""), ("e1", "e", None, ""))
    segments.add(spark, path, a)
    segments.add(spark, path, c)
    both = a.unionByName(c)
    assert same(spark, path, both)[0] == "b1"
    assert set(same(spark, path, both, ids=["a", "c"])) == {"a1", "c1"}
    old = commits.current(spark, path)[1]
    new = source(spark, ("a1", "a", "nothing here", ""), ("a9", "a", "red red red fox", ""))
    segments.replace(spark, path, new)
    live = both.filter("document_id IS NULL OR document_id <> 'a'").unionByName(new)
    assert "a9" in same(spark, path, live) and "a1" not in same(spark, path, live)
    segments.delete(spark, path, ["b", "unknown"])
    live = live.filter("document_id IS NULL OR document_id <> 'b'")
    before = same(spark, path, live)
    # the totals are those of the live rows, and an older version can still be read
    assert {r["field"]: (r["n"], r["avgdl"]) for r in segments.statistics(spark, path).collect()} == {r["field"]: (r["n"], r["avgdl"]) for r in R.field_statistics(segments.live_postings(spark, path)).collect()}
    assert {r["chunk_id"] for r in segments.live_postings(spark, path, old).select("chunk_id").collect()} == {"a1", "a2", "b1", "c1", "n1"}
    segments.merge(spark, path)
    state = commits.current(spark, path)[1]
    assert len(state["segments"]) == 1 and not state["marks"] and same(spark, path, live) == before
    # what was deleted before the merge may come again
    segments.add(spark, path, a.filter("document_id = 'b'"))
    assert same(spark, path, live.unionByName(a.filter("document_id = 'b'")))[0] == "b1"


def test_a_search_reads_its_terms_only(spark, path):
    segments.add(spark, path, source(spark, *[(f"c{i}", f"d{i % 7}", f"word{i} red fox", "") for i in range(300)]))
    segments.delete(spark, path, ["d3"])
    plan = segments.search(spark, path, "red fox")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [part for part in plan.split("\n\n") if "Location:" in part]
    postings = [x for x in scans if "/postings]" in x]
    assert postings and all("In(term" in x for x in postings)
    assert all("/postings]" in x or "/gone/" in x for x in scans)  # no statistics are read
