"""The bulk sink: rows judged one by one, jobs that leave all or nothing."""

import pyarrow as pa
import pytest

from lectern.sources import bulk, stores

ROWS = "chunk_id string, document_id string, text string, embedding array<float>"


def test_reasons_row_by_row():
    vectors = [[1.0, 2.0], [1.0], None, [float("nan"), 1.0], [1.0, None], [float("inf"), 0.0], [0.0, 0.0], [1.0, 2.0]]
    rows = pa.record_batch([pa.array(["a", "b", "c", "d", "e", "f", " \t", None]), pa.array(["x"] * 8), pa.array(["t"] * 7 + [None]), pa.array(vectors, pa.list_(pa.float32()))], ["chunk_id", "document_id", "text", "embedding"])
    no = "embedding has a value that is no number"
    assert bulk.reasons(rows, 2).to_pylist() == [None, "embedding does not have 2 dimensions", "embedding is missing", no, no, no, "chunk_id is missing", "chunk_id is missing"]
    assert bulk.reasons(rows.select(["chunk_id", "document_id", "text"])).to_pylist() == [None] * 6 + ["chunk_id is missing"] * 2
    assert bulk.reasons(rows.slice(3, 2), 2).to_pylist() == [no, no]  # a slice keeps its own rows
    assert bulk.reasons(rows.slice(0, 0), 2).to_pylist() == []


def test_jobs_add_up_and_a_refused_one_leaves_nothing(spark):
    path = stores.scratch_path(spark, "bulk")
    made = lambda *ids: spark.createDataFrame([(i, "d", "text" if i != "bad" else "", [1.0]) for i in ids], ROWS).repartition(3)
    assert bulk.read(spark, path, "accepted", ROWS).count() == 0 and bulk.counts(spark, path) == {}
    bulk.write(made("a", "b", "bad"), path)
    bulk.write(made("c"), path, fail_fast=True)
    bulk.write(made().limit(0), path)
    with pytest.raises(Exception, match="1 rows were refused"):
        bulk.write(made("e", "bad"), path, fail_fast=True)
    assert sorted(r["chunk_id"] for r in bulk.read(spark, path, "accepted", ROWS).collect()) == ["a", "b", "c"]
    assert [tuple(r) for r in bulk.read(spark, path, "rejected", bulk.REJECTED).collect()] == [("bad", "d", "text is missing")]
    assert bulk.counts(spark, path) == {"": 3, "text is missing": 1}


def test_a_failed_task_leaves_nothing(spark):
    from pyspark.sql import functions as F

    path = stores.scratch_path(spark, "bulk")
    rows = spark.range(100, numPartitions=4).select(F.col("id").cast("string").alias("chunk_id"), F.lit("d").alias("document_id"), F.when(F.col("id") < 99, "t").otherwise(F.raise_error(F.lit("lost"))).alias("text"))
    with pytest.raises(Exception, match="lost"):
        bulk.write(rows, path)
    assert bulk.read(spark, path, "accepted", ROWS).count() == 0 and bulk.counts(spark, path) == {}
