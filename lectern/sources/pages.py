"""Sources of page text and validation of uploads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.sources import pdf


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches, by rows and bytes: a worker's memory is taken by its work, however large a partition is.

    For the queries, which own their session; operators leave its settings alone and work with any.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of fewer files than the session has shuffle partitions are dealt by ``key``, so that work on each row finds all cores.

    A table of many files is read as it lies: no corpus of any size is shuffled for this.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key) if len(rows.inputFiles()) < min(n, 8) else rows


def paged(documents: DataFrame, lines_per_page: int = 40) -> DataFrame:
    """document_key, page_number, page_id, text, file_name: pages of so many lines, by expressions on each row."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    d = documents.select(F.col("doc_id").cast("string").alias("document_key"), F.col("source").alias("file_name"), lines.alias("lines"))
    count = F.ceil(F.size("lines") / lines_per_page).cast("int")
    p = d.select("document_key", "file_name", "lines", F.explode(F.sequence(F.lit(1), count)).alias("page_number"))
    text = F.array_join(F.slice("lines", (F.col("page_number") - 1) * lines_per_page + 1, F.lit(lines_per_page)), "\n")
    return p.select("document_key", "page_number", F.concat_ws(":", "document_key", F.col("page_number").cast("string")).alias("page_id"), text.alias("text"), "file_name")


def valid_upload(path: Column, length: Column) -> Column:
    """Not empty, within the size limit, and named as a PDF."""
    return (length > 0) & (length <= P.MAX_UPLOAD_BYTES) & F.lower(path).endswith(".pdf")


def pdf_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Pages of the PDF files below ``path``: document_key (the fingerprint of the bytes), page_number, page_id, text, file_name.

    ``extract`` gives a file's page texts where the reader of ``sources.pdf`` is not wanted; it runs where the file is read. That
    reader adds ``problem``: a file that cannot be read is one row that says why.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(valid_upload(F.col("path"), F.col("length")))
    files = files.select(F.sha2("content", 256).alias("document_key"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
    if extract is None:
        return pdf.scanned(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for key, name, content in zip(rows.document_key, rows.file_name, rows.content, strict=True):
                texts = extract(content)
                yield pd.DataFrame({"document_key": key, "page_number": range(1, len(texts) + 1), "page_id": [f"{key}:{i}" for i in range(1, len(texts) + 1)], "text": texts, "file_name": name})

    return files.mapInPandas(run, "document_key string, page_number int, page_id string, text string, file_name string")
