"""A lexical index that is kept up: segments of postings, delete marks and a merge, under versions.

A segment holds the postings of the chunks added at once, in ranges of (term, chunk_id), so that a frequent term is spread over
files and a reader skips the row groups of other terms; beside them, per document and field, how many chunks it has and how long
they are. Nothing that is written is changed: a document is deleted by a mark (its rows up to a segment's number count
no more), and replaced by a mark and a new segment in one version. The totals that ranking needs are kept in the version itself, added
up when documents come and taken off when they go, so a search reads postings of its terms and nothing else. A merge
writes all live postings as one segment.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.operators import retrieval
from lectern.sources import commits

_POSTINGS = "chunk_id string, document_id string, field string, dl int, term string, tf long"
_STATISTICS = "document_id string, field string, n long, total long"


def create(spark: SparkSession, path: str, fields: list[str] | None = None) -> None:
    """An empty index, unless there is one."""
    if commits.current(spark, path)[0] == 0:
        try:
            commits.commit(spark, path, 0, {"fields": fields or list(P.FIELD_BOOSTS), "next": 1, "segments": [], "marks": [], "totals": {}})
        except commits.Conflict:
            return  # another writer made it just now


def _write_segment(postings: DataFrame, path: str, name: str) -> None:
    """The files of a segment: postings by ranges of their term, and what each document adds to the totals."""
    folder = f"{path}/segments/{name}"
    # a term of many chunks lies in several ranges; how many ranges there are follows the data
    postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.parquet(f"{folder}/postings")
    chunks = postings.sparkSession.read.schema(_POSTINGS).parquet(f"{folder}/postings").select("chunk_id", "document_id", "field", "dl").distinct()
    statistics = chunks.groupBy("document_id", "field").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").cast("long").alias("total"))
    statistics.sort("document_id").write.parquet(f"{folder}/statistics")


def _totals(statistics: DataFrame) -> dict[str, list[int]]:
    """Per field the number of chunks and their length: as many rows as fields."""
    return {r["field"]: [r["n"], r["total"]] for r in statistics.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}


def _plus(a: dict[str, list[int]], b: dict[str, list[int]], sign: int = 1) -> dict[str, list[int]]:
    both = {f: [x + sign * y for x, y in zip(a.get(f, [0, 0]), b.get(f, [0, 0]), strict=True)] for f in {*a, *b}}
    return {f: v for f, v in sorted(both.items()) if v[0]}


def _read(spark: SparkSession, path: str, state: commits.State, kind: str, schema: str) -> DataFrame:
    """Rows of all segments that no mark takes away. A merge bounds the number of segments and marks."""
    rows = [spark.read.schema(schema).parquet(f"{path}/segments/{s['name']}/{kind}").withColumn("seq", F.lit(s["seq"]).cast("long")) for s in state["segments"]]
    if not rows:
        return spark.createDataFrame([], schema)
    every = reduce(DataFrame.unionByName, rows)
    if state["marks"]:
        marks = [spark.read.schema("document_id string").parquet(f"{path}/gone/{m['name']}").select(F.col("document_id").alias("gone"), F.lit(m["upto"]).cast("long").alias("upto")) for m in state["marks"]]
        last = reduce(DataFrame.unionByName, marks).groupBy("gone").agg(F.max("upto").alias("upto"))
        every = every.join(last, F.col("document_id").eqNullSafe(F.col("gone")) & (F.col("seq") <= F.col("upto")), "left_anti")
    return every.drop("seq")


def live_postings(spark: SparkSession, path: str, state: commits.State | None = None) -> DataFrame:
    """chunk_id, document_id, field, dl, term, tf of all that the newest (or the given) version holds."""
    return _read(spark, path, state or commits.current(spark, path)[1], "postings", _POSTINGS)


def _change(spark: SparkSession, path: str, gone: DataFrame | None, source: DataFrame | None) -> int:
    """One version: the documents in ``gone`` (document_id) go, the chunks of ``source`` come. Files first, then the version."""
    name = uuid.uuid4().hex
    come: dict[str, list[int]] = {}
    if source is not None:
        fields = commits.current(spark, path)[1]["fields"]
        own = source.select("chunk_id", F.col("document_id").cast("string").alias("document_id"), *fields)
        _write_segment(retrieval.postings(own, fields).select("chunk_id", "document_id", "field", "dl", "term", "tf"), path, name)
        come = _totals(spark.read.schema(_STATISTICS).parquet(f"{path}/segments/{name}/statistics"))
    if gone is not None:
        gone.select(F.col("document_id").cast("string").alias("document_id")).distinct().write.parquet(f"{path}/gone/{name}")

    def step(state: commits.State) -> commits.State:
        seq = state["next"]
        if gone is not None:  # what goes is looked up in the version that this one follows
            ids = spark.read.schema("document_id string").parquet(f"{path}/gone/{name}").withColumnRenamed("document_id", "gone")
            theirs = _read(spark, path, state, "statistics", _STATISTICS).join(ids, F.col("document_id").eqNullSafe(F.col("gone")), "left_semi")
            state["totals"] = _plus(state["totals"], _totals(theirs), -1)
            state["marks"].append({"name": name, "upto": seq - 1})
        if source is not None:
            state["segments"].append({"name": name, "seq": seq})
            state["totals"] = _plus(state["totals"], come)
        return state | {"next": seq + 1}

    return commits.change(spark, path, step)[0]


def add(spark: SparkSession, path: str, source: DataFrame) -> int:
    """Chunks (as ``retrieval.index_source``) of documents that are not in the index yet."""
    return _change(spark, path, None, source)


def replace(spark: SparkSession, path: str, source: DataFrame) -> int:
    """The documents of ``source`` hold exactly its chunks from now on; one without any chunk is to be deleted."""
    return _change(spark, path, source.select("document_id"), source)


def delete(spark: SparkSession, path: str, document_ids: list[str]) -> int:
    return _change(spark, path, spark.createDataFrame([(str(i),) for i in document_ids], "document_id string"), None)


def merge(spark: SparkSession, path: str) -> int:
    """All live postings as one segment. A change that comes between stays valid: only what was merged is taken off the list."""
    _, old = commits.current(spark, path)
    name = uuid.uuid4().hex
    _write_segment(live_postings(spark, path, old), path, name)
    done, last = {s["name"] for s in old["segments"]}, max((s["seq"] for s in old["segments"]), default=0)
    settled = {m["name"] for m in old["marks"]}

    def step(state: commits.State) -> commits.State:
        if done - {s["name"] for s in state["segments"]}:
            raise commits.Conflict("another merge was first")
        rest = [s for s in state["segments"] if s["name"] not in done]
        return state | {"segments": [{"name": name, "seq": last}, *rest], "marks": [m for m in state["marks"] if m["name"] not in settled]}

    return commits.change(spark, path, step)[0]


def statistics(spark: SparkSession, path: str, state: commits.State | None = None) -> DataFrame:
    """field, n, avgdl as ``retrieval.field_statistics``, from the version alone."""
    totals = (state or commits.current(spark, path)[1])["totals"]
    return spark.createDataFrame([(f, n, total / n) for f, (n, total) in totals.items()], "field string, n long, avgdl double")


def search(spark: SparkSession, path: str, question: str, top_k: int = P.CANDIDATES, document_ids: list[str] | None = None, boosts: dict[str, float] | None = None, digits: int | None = None) -> DataFrame:
    """As ``retrieval.bm25_search`` over all chunks that the newest version holds; one version serves the whole search."""
    _, state = commits.current(spark, path)
    boosts = boosts or {f: P.FIELD_BOOSTS[f] for f in state["fields"]}
    return retrieval.bm25_indexed(live_postings(spark, path, state), statistics(spark, path, state), question, top_k, document_ids, boosts, digits)
