"""Previews of chunks and sources for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: the columns of a preview with what stands for a missing value
DEFAULTS = {
    "chunk_index": -1, "text": "", "content_token_count": -1, "estimated_token_count": -1, "chunk_character_count": -1, "page_number": -1, "start_page_number": -1, "end_page_number": -1,
    "section_title": "", "subsection_titles": [], "heading_path": [], "page_numbers": [], "structural_boundary": "", "contains_code": False, "contains_list": False, "spans_pages": False,
    "starts_new_topic": False, "overlap_applied": False,
}


def preview(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """The first chunks of a document in order, all without a limit, with a default for every missing value."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")

    def typed(name: str, default):
        empty = F.array().cast("array<int>" if name == "page_numbers" else "array<string>") if default == [] else F.lit(default)
        return (F.coalesce(F.col(name), empty) if name in chunks.columns else empty).alias(name)

    first = chunks.orderBy("chunk_index") if limit is None else chunks.orderBy("chunk_index").limit(limit)
    return first.select(*[typed(k, v) for k, v in DEFAULTS.items()])


def preview_response(chunks: DataFrame, file_name: str, source_document_count: int, limit: int | None = None) -> DataFrame:
    """One row: the file, how many pages and chunks it has, and the previewed chunks in order."""
    shown = preview(chunks, limit).agg(F.array_sort(F.collect_list(F.struct(*DEFAULTS))).alias("chunks"))
    total = chunks.agg(F.count(F.lit(1)).alias("total_chunk_count"))
    return shown.join(F.broadcast(total)).select(F.lit(file_name).alias("file_name"), F.lit(source_document_count).alias("source_document_count"), "total_chunk_count", F.size("chunks").alias("preview_count"), "chunks")


def visible_sources(hits: DataFrame, count: int = 2) -> DataFrame:
    """The sources shown at first, with relevance in per cent."""
    from lectern.functions.text import relevance_percent

    return hits.filter(F.col("rank") <= count).withColumn("relevance", relevance_percent(F.col("score")))
