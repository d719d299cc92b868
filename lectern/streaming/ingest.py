"""Incremental ingestion and progress: file streams into partitioned stores, event rows, safe errors."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.operators import chunking, cleaning, identity
from lectern.sources import stores

PAGES = "document_key string, page_number int, page_id string, text string, file_name string"


def ingest(pages: DataFrame, estimate=chunking.default_estimate, max_chunks: int | None = None) -> DataFrame:
    """Pages to identified chunks, as a batch; all chunks of all documents, but for a limit that a request sets."""
    chunks = chunking.chunk_pages(cleaning.clean_pages(pages), estimate, max_chunks)
    chunks = chunks.withColumns({"document_id": F.col("document_key"), "document_fingerprint": F.col("document_key")})
    return identity.with_chunk_identity(chunks)


def stream_ingest(spark: SparkSession, inbox: str, store: str, checkpoint: str, max_files: int = 100):
    """A query that ingests page files as they come. A document is the unit of writing: a file holds whole documents.

    Each micro-batch replaces its documents, so a batch run twice after a failure changes nothing.
    """
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).parquet(inbox)

    def write(batch: DataFrame, _: int) -> None:
        stores.replace_documents(ingest(batch), store)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embedding_progress(batches: DataFrame) -> DataFrame:
    """document_id, batch, completed, tokens so far, for batches (document_id, batch, chunks, tokens, total)."""
    upto = W.partitionBy("document_id").orderBy("batch").rowsBetween(W.unboundedPreceding, 0)
    return batches.select("document_id", "batch", F.least("total", F.sum("chunks").over(upto)).cast("long").alias("completed"), F.sum("tokens").over(upto).alias("tokens"))


def stage_event(stage: str) -> dict:
    for name, done, total in P.CHAT_STAGES:
        if name == stage:
            return {"stage": name, "completed": done, "total": total}
    raise ValueError(f"unknown stage {stage}")


def safe_message(error: Exception, general: str = "The request could not be completed.") -> str:
    """The message of a refused request; anything else stays inside."""
    return str(error) if isinstance(error, ValueError) else general


#: fixed: seconds after which a stream of a chat turn, and of an ingestion, ends
CHAT_SECONDS, INGESTION_SECONDS = 180, 600


def _until(events: Iterator[dict], late: Callable[[], dict], seconds: float, clock: Callable[[], float]) -> Iterator[dict]:
    """Events up to the deadline, looked at before each is passed on; a late one gives way to a failure."""
    end = clock() + seconds
    for event in events:
        if clock() > end:
            events.close()
            yield late()
            return
        yield event


def chat_events(run: Callable[[Callable[[str], None]], Iterator[tuple[str, object]]], seconds: float = CHAT_SECONDS, clock: Callable[[], float] = time.monotonic) -> Iterator[dict]:
    """progress, sources and token events of a chat turn, then one result or failure.

    ``run`` gets a callback for stages and yields ("sources" | "token" | "result", data).
    """
    stage = [P.CHAT_STAGES[0][0]]
    pending = [stage[0]]

    def made() -> Iterator[dict]:
        try:
            events = run(pending.append)
            while True:
                event = next(events, None)
                while pending:
                    stage[0] = pending.pop(0)
                    yield {"event": "progress", "data": stage_event(stage[0])}
                if event is None:
                    return
                yield {"event": event[0], "data": event[1]}
        except Exception as e:  # whoever reads the stream gets one last event
            yield {"event": "failure", "data": {"stage": stage[0], "message": safe_message(e)}}

    yield from _until(made(), lambda: {"event": "failure", "data": {"stage": stage[0], "message": safe_message(TimeoutError())}}, seconds, clock)


def ingestion_events(run: Callable[[], Iterator[tuple[int, int, int]]], finish: Callable[[], dict], attach: Callable[[dict], None] = lambda _: None, seconds: float = INGESTION_SECONDS, clock: Callable[[], float] = time.monotonic) -> Iterator[dict]:
    """progress events of an ingestion, then one result or failure.

    ``run`` yields (chunks, total, tokens) of each embedded batch, ``finish`` gives the response, and ``attach`` may
    link the document to a chat before the result is told.
    """
    def made() -> Iterator[dict]:
        completed = tokens = 0
        try:
            for chunks, total, used in run():
                completed, tokens = min(total, completed + chunks), tokens + used
                yield {"event": "progress", "data": {"completed": completed, "total": total, "tokens": tokens}}
            response = finish()
            attach(response)
            yield {"event": "result", "data": response}
        except Exception as e:  # whoever reads the stream gets one last event
            yield {"event": "failure", "data": {"message": safe_message(e)}}

    yield from _until(made(), lambda: {"event": "failure", "data": {"message": safe_message(TimeoutError())}}, seconds, clock)


def answer_text(fragments: Iterator[tuple[str, dict | None]], token: Callable[[str], None] = lambda _: None) -> tuple[str, dict | None]:
    """(text, usage) of a streamed answer: the last usage counts, an answer without text is an error."""
    text, usage = [], None
    for fragment, used in fragments:
        if fragment:
            text.append(fragment)
            token(fragment)
        usage = used or usage
    if not "".join(text).strip():
        raise RuntimeError("the model gave no answer")
    return "".join(text), usage


def decoded_events(lines: DataFrame, column: str = "body") -> DataFrame:
    """event, data of server-sent event bodies, one row per event that has data."""
    block = F.explode(F.split(column, r"\r?\n\r?\n"))
    b = lines.select(*[c for c in lines.columns if c != column], block.alias("b")).withColumn("ls", F.split("b", r"\r?\n"))
    data = F.filter("ls", lambda x: x.startswith("data:"))
    name = F.element_at(F.concat(F.array(F.lit("event:message")), F.filter("ls", lambda x: x.startswith("event:"))), -1)
    return b.filter(F.size(data) > 0).select(*[c for c in lines.columns if c != column], F.trim(F.substring(name, F.lit(7), F.length(name))).alias("event"), F.array_join(F.transform(data, lambda x: F.ltrim(F.substring(x, F.lit(6), F.length(x)))), "\n").alias("data"))


def decode_event(block: str) -> dict | None:
    """One event of a body, as a caller in Python reads it."""
    lines = re.split(r"\r?\n", block)
    data = [x[5:].lstrip() for x in lines if x.startswith("data:")]
    name = next((x[6:].strip() for x in reversed(lines) if x.startswith("event:")), "message")
    return {"event": name, "data": json.loads("\n".join(data))} if data else None
