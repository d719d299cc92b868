"""Chunk stores and JSON: partitioned tables in place of vector and index services; embedding models are injected."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Store chunks in a folder per document, for few documents; the folders of the documents at hand are replaced, others stay."""
    if chunks.isEmpty():
        return
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)


def replace_documents(chunks: DataFrame, path: str) -> None:
    """Store chunks of any number of documents in one folder a call; what is stored of these documents already goes.

    For many documents, as a folder for each takes longer to make than its rows to write. Only folders that hold a document at
    hand are written again, without it; to find them, the stored ``document_id`` alone is read. The new folder is published by one rename
    before old ones go, so a call that failed at any point and is made again leaves each row once. One writer at a time.
    """
    spark, name = chunks.sparkSession, f"p{uuid.uuid4().hex}"
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{p}".rstrip("/"))
    fs = at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    draft, part = f"_{name}", f"part={name}"  # readers pass over the first, as long as it has no "=" in it
    chunks.write.parquet(f"{path}/{draft}")
    new = spark.read.schema(chunks.schema).parquet(f"{path}/{draft}")
    touched: list[str] = []
    if new.isEmpty():  # nothing replaces nothing
        fs.delete(at(draft), True)
        return
    if fs.globStatus(at("part=*")):
        stored = spark.read.schema(f"{chunks.schema.toDDL()}, part string").parquet(path)
        ids = new.select(F.col("document_id").alias("_id")).distinct()
        same = F.col("document_id").eqNullSafe(F.col("_id"))
        touched = [r["part"] for r in stored.join(ids, same, "left_semi").select("part").distinct().collect()]
        if touched:  # rows are there twice where an earlier call ended between its rename and its deletions
            stored.filter(F.col("part").isin(touched)).join(ids, same, "left_anti").drop("part").dropDuplicates().write.mode("append").parquet(f"{path}/{draft}")
    if not fs.rename(at(draft), at(part)):
        raise OSError(f"{path}/{part} could not be published")
    for old in touched:
        fs.delete(at(f"part={old}"), True)


def read_chunks(spark: SparkSession, path: str, document_ids: list[str] | None = None) -> DataFrame:
    """Stored chunks; only the folders (or row groups) of the documents asked for are read."""
    found = spark.read.parquet(path)
    return found.filter(F.col("document_id").isin(document_ids)) if document_ids else found


def index_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def replace_document_safely(replace: Callable[[], None], enabled: bool = True) -> bool:
    """Whether the index was replaced: its failure never makes an ingestion fail."""
    if not enabled:
        return False
    try:
        replace()
    except Exception:  # the index can be filled again from the store
        return False
    return True


def to_metadata(*columns: str) -> Column:
    """A JSON object of columns; missing values have no key."""
    return F.to_json(F.struct(*columns))


def from_metadata(column: str, schema: str) -> Column:
    return F.from_json(column, schema, {"mode": "FAILFAST"})


def embedded(chunks: DataFrame, embed: Callable[[list[str], str], list[list[float]]], task: str = "RETRIEVAL_DOCUMENT", batch: int = 100) -> DataFrame:
    """Chunks with ``embedding``. Documents and queries are different tasks of one model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = list(rows["text"])
            vectors = [v for at in range(0, len(texts), batch) for v in embed(texts[at : at + batch], task)]
            yield rows.assign(embedding=vectors)

    return chunks.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in chunks.schema)}, embedding array<float>")


def embed_query(question: str, embed: Callable[[list[str], str], list[list[float]]]) -> list[float]:
    return embed([question], "RETRIEVAL_QUERY")[0]


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where they are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/checkpoints/lectern-store"
    return root.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below :func:`scratch_dir`; it goes when the session's Python process ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        with suppress(Exception):  # the session may have ended; the other folders are still tried
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(_clean)


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written into a fresh folder and read back: what several plans read is worked out once."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def placed(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Rows that stand in order, with their place from 1. No task sees all rows: only their number per partition meets on the driver."""
    spark = ordered.sparkSession
    path = scratch_path(spark, "ordered")
    ordered.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    before, sizes = 0, []
    for r in rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        sizes.append((r["_part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(sizes, "_part long, _before long")
    return rows.withColumn("_part", part).join(offsets, "_part").withColumn(name, (F.col("_before") + within + 1).cast("int")).drop("_id", "_part", "_before")


def write_postings(index: DataFrame, path: str) -> None:
    """Store postings in ranges of term and chunk, as many as the data ask for, and the fields' statistics beside them."""
    from lectern.operators import retrieval

    index.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    retrieval.field_statistics(index.sparkSession.read.parquet(f"{path}/postings")).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")


def read_postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """Postings of the terms: only the row groups that can hold them are read."""
    return spark.read.parquet(f"{path}/postings").filter(F.col("term").isin(terms))


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The statistics that were stored with the postings: a row per field."""
    return spark.read.parquet(f"{path}/statistics")
