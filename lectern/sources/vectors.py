"""A stored vector index: cells around coarse centroids, read in part, with an exact top-k.

All vectors are taken at length one, so that the nearest has the largest cosine. A cell keeps its centroid and how
near and how far its members are from it. By the triangle inequality a member of a cell can't be nearer to a
query than the cell's ring is; cells whose bound is below the k-th score found so far are not read, and within
those read only the rows of a ring around the query's distance are (they are sorted by distance, so row groups are skipped).
Centroids, one row per cell, are all that the driver sees. How much is skipped depends on the data: vectors without any
clusters lie about equally far from everything, and no exact index can leave much of them unread.

The folder holds ``centroids``, ``layout`` (no rows, the columns), ``vectors`` (by cell) and ``rings`` (a row per cell and write: vectors are added without
rewriting anything). A vector that has no direction (null, of length zero) is in cell -1, which is always read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import retrieval

#: vectors that the centroids are fitted on, at most; every vector is indexed
SAMPLE = 20_000
#: what rounding may add to a distance
SLACK = 1e-6


def _unit(vectors: DataFrame) -> DataFrame:
    """With ``unit``: the vector at length one, null without a direction."""
    length = F.sqrt(retrieval.dot(F.col("embedding"), F.col("embedding")))
    return vectors.withColumn("length", length).withColumn("unit", F.when(F.col("length") > 0, F.transform("embedding", lambda x: x.cast("double") / F.col("length")))).drop("length")


def fit_centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """cell, centroid: k-means over at most ``sample`` vectors (chunk_id, embedding), picked by a hash of their ids."""
    spark = vectors.sparkSession
    picked = _unit(vectors).filter("unit IS NOT NULL").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select(array_to_vector("unit").alias("features"))
    picked = picked.persist()  # of bounded size
    try:
        n = picked.count()
        centers = KMeans(k=min(cells, n), seed=seed, maxIter=10).fit(picked).clusterCenters() if n > 1 else [r["features"].toArray() for r in picked.collect()]
    finally:
        picked.unpersist()
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cell int, centroid array<double>")


def _placed(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Vectors with their nearest cell and the distance to its centroid, by one matrix product a batch."""
    table = np.array([r["centroid"] for r in centroids.orderBy("cell").select("centroid").collect()])  # one row per cell

    @F.pandas_udf("cell int, to_centroid double")
    def place(embedding: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cell": np.full(len(embedding), -1, np.int32), "to_centroid": np.full(len(embedding), np.nan)})
        given = np.flatnonzero([x is not None and len(table) > 0 for x in embedding])
        if len(given):
            x = np.stack(embedding.iloc[given].to_numpy()).astype(float)
            length = np.sqrt((x * x).sum(1))
            given, x = given[length > 0], x[length > 0] / length[length > 0, None]
            cell = ((table * table).sum(1) - 2 * x @ table.T).argmin(1) if len(given) else np.zeros(0, int)
            out.loc[given, "cell"] = cell.astype(np.int32)
            out.loc[given, "to_centroid"] = np.sqrt(((x - table[cell]) ** 2).sum(1))
        return out

    return vectors.withColumn("placed", place("embedding")).withColumns({"cell": F.col("placed.cell"), "to_centroid": F.nanvl("placed.to_centroid", F.lit(None).cast("double"))}).drop("placed")


def add_vectors(vectors: DataFrame, path: str) -> None:
    """Add vectors (chunk_id, embedding, …) to an index; what it holds stays as it is."""
    spark = vectors.sparkSession
    part = uuid.uuid4().hex
    placed = _placed(vectors, spark.read.parquet(f"{path}/centroids")).withColumn("part", F.lit(part))
    # rows of a cell meet, but a cell that holds much of all vectors is split over tasks
    placed.hint("rebalance", "cell").sortWithinPartitions("cell", "to_centroid").write.mode("append").partitionBy("part", "cell").parquet(f"{path}/vectors")
    written = _vectors(spark, path).filter(F.col("part") == part)
    rings = written.groupBy("cell").agg(F.min("to_centroid").alias("nearest"), F.max("to_centroid").alias("radius"), F.count(F.lit(1)).alias("n"))
    rings.coalesce(1).write.mode("append").parquet(f"{path}/rings")


def write_index(vectors: DataFrame, path: str, cells: int = 64, sample: int = SAMPLE) -> None:
    """A new index of vectors (chunk_id, embedding, …) in an empty folder."""
    fit_centroids(vectors, cells, sample).coalesce(1).write.parquet(f"{path}/centroids")
    vectors.limit(0).write.parquet(f"{path}/layout")
    add_vectors(vectors, path)


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    """All that is stored, also where that is nothing yet."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/layout").schema)
    return spark.read.schema(f"{own}, to_centroid double, part string, cell int").parquet(f"{path}/vectors")


def bounds(spark: SparkSession, path: str, query: list[float]) -> list[tuple[int, float, float]]:
    """(cell, distance to its centroid, largest cosine a member can have), the best bound first."""
    rings = spark.read.parquet(f"{path}/rings").groupBy("cell").agg(F.min("nearest").alias("nearest"), F.max("radius").alias("radius"))
    rows = rings.join(spark.read.parquet(f"{path}/centroids"), "cell", "left").collect()  # one row per cell
    length = sum(x * x for x in query) ** 0.5
    found = []
    for r in rows:
        if r["cell"] < 0 or not length:
            found.append((r["cell"], 0.0, 1.0))
            continue
        d = sum((x / length - y) ** 2 for x, y in zip(query, r["centroid"], strict=True)) ** 0.5
        off = max(0.0, d - r["radius"], r["nearest"] - d) - SLACK
        found.append((r["cell"], d, 1 - max(0.0, off) ** 2 / 2))
    return sorted(found, key=lambda x: (x[0] >= 0, -x[2], x[0]))


def indexed_search(spark: SparkSession, path: str, query: list[float], top_k: int | None = None, document_ids: list[str] | None = None, above: float | None = 0.0, digits: int | None = None) -> DataFrame:
    """As :func:`retrieval.vector_search`, from an index, with the same result.

    Cells are probed, best bound first, until the k-th score is above the bound of all others; the table returned is a
    scan of the cells that may hold a hit. A probe returns k scores at most.
    """
    k = retrieval.checked_top_k(top_k)
    order = [b for b in bounds(spark, path, query) if above is None or b[2] > above - SLACK or b[0] < 0]
    every = _vectors(spark, path)
    scores: list[float] = []
    at, wave = 0, 1
    round_off = SLACK + (10.0**-digits if digits is not None else 0)
    least = lambda: sorted(scores, reverse=True)[k - 1] - round_off if len(scores) >= k else float("-inf")
    while at < len(order) and (at == 0 or order[at][2] >= least()):
        cells = [c for c, _, _ in order[at : at + wave]]
        hits = retrieval.vector_search(every.filter(F.col("cell").isin(cells)), query, k, document_ids, above, digits)
        scores = sorted([*scores, *[r["score"] for r in hits.select("score").collect()]], reverse=True)[:k]
        at, wave = at + wave, 2 * wave
    floor = least()
    kept = [b for b in order[:at] if b[2] >= floor or b[0] < 0]
    rows = every.filter(F.col("cell").isin([c for c, _, _ in kept]))
    if floor > -1 and kept:
        reach = (2 - 2 * max(floor, -1.0)) ** 0.5 + SLACK
        lo, hi = min(d for c, d, _ in kept) - reach, max(d for c, d, _ in kept) + reach
        rows = rows.filter(F.col("to_centroid").isNull() | F.col("to_centroid").between(lo, hi))
    return retrieval.vector_search(rows, query, k, document_ids, above, digits).drop("cell", "to_centroid", "part")
