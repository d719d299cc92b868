"""Content-derived identity and idempotent ingestion, in hash expressions, grouped counts and anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions import text as T


def fingerprint(content: Column) -> Column:
    """SHA-256 of bytes, or of a text's UTF-8."""
    return F.sha2(content, 256)


def name_uuid(name: Column) -> Column:
    """The version 3 UUID of a name: its MD5 with version and variant set."""

    def of(h: Column) -> Column:
        variant = F.element_at(F.array(*[F.lit(c) for c in "89ab89ab89ab89ab"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1)
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))

    return T.let(F.md5(name), of)


def with_chunk_identity(chunks: DataFrame, embedding_model: str = "", dimensions: int = P.EMBEDDING_DIMENSIONS) -> DataFrame:
    """chunk_fingerprint and chunk_id of chunks (document_fingerprint, chunk_index, text), and the model they are embedded by."""
    c = chunks.withColumn("chunk_fingerprint", fingerprint(F.col("text")))
    name = F.concat_ws(":", "document_fingerprint", F.col("chunk_index").cast("string"), "chunk_fingerprint")
    return c.withColumns({"chunk_id": name_uuid(name), "embedding_model": F.lit(embedding_model), "embedding_dimensions": F.lit(dimensions)})


def ingestion_fingerprints(chunks: DataFrame) -> DataFrame:
    """document_fingerprint, ingestion_fingerprint, n_chunks: the hash of a document's chunk texts in order; metadata do not alter it."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"])
    whole = F.concat(F.col("document_fingerprint"), F.array_join(F.transform("texts", lambda t: F.concat(F.lit("\u001f"), t)), ""))
    return chunks.groupBy("document_fingerprint").agg(texts.alias("texts"), F.count(F.lit(1)).alias("n_chunks")).select("document_fingerprint", fingerprint(whole).alias("ingestion_fingerprint"), "n_chunks")


def ingestion_plan(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """expected (document_id, ingestion_fingerprint, n_chunks) with stored_count and skipped: nothing to do where all chunks are there."""
    there = stored.groupBy("document_id", "ingestion_fingerprint").agg(F.count(F.lit(1)).alias("stored_count"))
    return expected.join(there, ["document_id", "ingestion_fingerprint"], "left").withColumn("stored_count", F.coalesce("stored_count", F.lit(0))).withColumn("skipped", (F.col("stored_count") == F.col("n_chunks")) & (F.col("n_chunks") > 0))


def new_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose id is not stored yet."""
    return chunks.join(stored.select("chunk_id"), "chunk_id", "left_anti")


def without_superseded(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored chunks less those of an earlier ingestion of a document in ``current`` (document_id, ingestion_fingerprint).

    A stored chunk without an ingestion fingerprint is not known to be older, and stays.
    """
    now = current.select(F.col("document_id").alias("now_id"), F.col("ingestion_fingerprint").alias("now_fingerprint"))
    old = (F.col("document_id") == F.col("now_id")) & (F.col("ingestion_fingerprint") != F.col("now_fingerprint"))
    return stored.join(now, old, "left_anti")


def ingestion_response(plan: DataFrame, names: DataFrame) -> DataFrame:
    """What a caller learns of each ingestion."""
    return plan.join(names.select("document_id", "file_name", "source_page_count"), "document_id", "left").select(
        "document_id", "file_name", "ingestion_fingerprint", "source_page_count", F.col("n_chunks").alias("chunk_count"),
        F.when(F.col("skipped"), 0).otherwise(F.col("n_chunks")).alias("stored_chunk_count"), "skipped", F.lit(0).alias("embedding_tokens"),
    )
