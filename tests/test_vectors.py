"""The vector index: the result of a full scan, whatever the data, and a scan of few cells where vectors form groups."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import retrieval as R
from lectern.plans import indexes
from lectern.plans.registry import _vectors
from lectern.sources import stores, vectors


def rows(df):
    return [(r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(12, 16))
    made = [(f"c{i}", str(i % 5), [float(x) for x in centers[i % 12] + 0.05 * rng.normal(size=16)]) for i in range(1200)]
    made += [("null", "1", None), ("zero", "2", [0.0] * 16), *[(f"same{i}", "3", [1.0] * 16) for i in range(300)]]
    df = spark.createDataFrame(made, "chunk_id string, document_id string, embedding array<float>").persist()
    path = stores.scratch_path(spark, "vectors")
    vectors.write_index(df.filter("chunk_id < 'c5'"), path, cells=12)
    vectors.add_vectors(df.filter("NOT chunk_id < 'c5'"), path)
    return df, path


def test_same_hits_as_a_full_scan(spark, grouped):
    df, path = grouped
    query = [float(x) for x in np.random.default_rng(2).normal(size=16)]
    for q in (query, [1.0] * 16, list(df.first()["embedding"]), [0.0] * 16):
        for k, ids, above, digits in ((1, None, 0.0, None), (20, ["1", "3"], 0.0, 6), (20, None, None, 4), (7, ["none"], 0.0, None)):
            assert rows(vectors.indexed_search(spark, path, q, k, ids, above, digits)) == rows(R.vector_search(df, q, k, ids, above, digits))


def test_scan_lists_only_the_cells_read(spark, grouped):
    df, path = grouped
    found = vectors.indexed_search(spark, path, list(df.first()["embedding"]), 10)
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    cells = re.search(r"PartitionFilters: \[.*?cell#\d+ IN \(([-\d,]+)\)", plan)[1].split(",") if " IN (" in plan else re.findall(r"cell#\d+ = (-?\d+)", plan)
    assert 1 <= len(set(cells)) <= 3 and "to_centroid" in re.search(r"PushedFilters: \[(.*)\]", plan)[1]
    every = spark.read.parquet(f"{path}/vectors")
    assert every.filter(F.col("cell").isin([int(c) for c in cells])).count() < 0.3 * every.count()


def test_no_member_lies_outside_its_bound(spark, grouped):
    df, path = grouped
    query = [float(x) for x in np.random.default_rng(9).normal(size=16)]
    bound = {c: b for c, _, b in vectors.bounds(spark, path, query)}
    scored = spark.read.parquet(f"{path}/vectors").withColumn("s", R.cosine(F.col("embedding"), F.array(*map(F.lit, query))))
    assert all(r["s"] <= bound[r["cell"]] for r in scored.groupBy("cell").agg(F.max("s").alias("s")).filter("s IS NOT NULL").collect())


def test_tables_without_groups_and_empty_ones(spark, sf):
    every = _vectors(spark, sf)
    path = indexes._indexed(spark, sf)
    query = list(every.first()["embedding"])
    assert rows(vectors.indexed_search(spark, path, query, 5)) == rows(R.vector_search(every, query, 5))
    empty = stores.scratch_path(spark, "vectors")
    vectors.write_index(every.limit(0), empty)
    assert rows(vectors.indexed_search(spark, empty, query, 5)) == []
    vectors.add_vectors(every, empty)  # without centroids all vectors share one cell
    assert rows(vectors.indexed_search(spark, empty, query, 5)) == rows(R.vector_search(every, query, 5))
    with pytest.raises(ValueError):
        vectors.indexed_search(spark, path, query, 21)
