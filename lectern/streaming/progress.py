"""Progress of an ingestion out of the running stream.

What a micro-batch read is counted from its rows by a query of its own: metrics observed in the stream's plan count a partition again
wherever it is worked out again, as by two executors at once. What it stored is observed while it is written, by the last stage, which
counts each partition once. Spark's own progress event tells that the batch is done. Events end with a result, a failure of the stream, or the deadline, at
which the stream is stopped: what is stored stays, and the checkpoint lets the next start go on from there.
"""

from __future__ import annotations

import queue
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lectern.operators import chunking
from lectern.sources import stores
from lectern.streaming import ingest as I


class _Listener(StreamingQueryListener):
    """Hands the events of one query on; ``tell`` is called from the session's listener thread."""

    def __init__(self, name: str, tell: Callable[[tuple], None]) -> None:
        self.name, self.tell, self.run = name, tell, None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name:
            self.tell(("batch", event.progress.batchId, None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.tell(("end", -1, event.exception))


def observed_ingest(spark: SparkSession, inbox: str, store: str, checkpoint: str, name: str, stored: dict[int, tuple[int, int, int, int]], max_files: int = 100, estimate=chunking.default_estimate) -> StreamingQuery:
    """As ``ingest.stream_ingest``, with its metrics: ``stored`` gets (pages, documents, chunks, tokens) of each batch before its progress is told."""
    pages = spark.readStream.schema(I.PAGES).option("maxFilesPerTrigger", max_files).parquet(inbox)
    # the files of a batch hold whole documents, so a document is counted in one batch
    first = F.when(F.col("page_number") == 1, F.col("document_key"))

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)  # as large as its files
        tokens = F.coalesce(F.sum("estimated_token_count"), F.lit(0)).cast("long")
        chunks = I.ingest(batch, estimate).observe(seen, F.count(F.lit(1)).alias("chunks"), tokens.alias("tokens"))
        try:
            read = batch.agg(F.count(F.lit(1)), F.count(first)).first()
            stores.replace_documents(chunks, store)
        finally:
            batch.unpersist()
        stored[number] = (*read, seen.get["chunks"], seen.get["tokens"])

    return pages.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_events(
    spark: SparkSession, inbox: str, store: str, checkpoint: str, max_files: int = 100, finish: Callable[[dict], dict] = lambda totals: totals, attach: Callable[[dict], None] = lambda _: None,
    seconds: float = I.INGESTION_SECONDS, clock: Callable[[], float] = time.monotonic, estimate=chunking.default_estimate,
) -> Iterator[dict[str, Any]]:
    """progress events (batch, pages, documents, completed chunks and tokens so far) while the stream runs, then one result or failure.

    ``finish`` makes the response of the totals; ``attach`` may link documents to a chat before it is told.
    """
    name, told, stored = f"ingestion-{uuid.uuid4().hex}", queue.Queue(), {}
    listener = _Listener(name, told.put)
    end, totals = clock() + seconds, {"pages": 0, "documents": 0, "completed": 0, "tokens": 0}
    running = None
    spark.streams.addListener(listener)
    try:
        running = observed_ingest(spark, inbox, store, checkpoint, name, stored, max_files, estimate)
        while True:
            try:
                kind, batch, what = told.get(timeout=0.2)
            except queue.Empty:
                kind, batch, what = "", -1, None
            if clock() > end:
                raise TimeoutError
            if kind == "batch" and batch in stored:
                pages, documents, chunks, tokens = stored.pop(batch)
                totals = {"pages": totals["pages"] + pages, "documents": totals["documents"] + documents, "completed": totals["completed"] + chunks, "tokens": totals["tokens"] + tokens}
                yield {"event": "progress", "data": {"batch": batch, **totals}}
            if kind == "end":
                if what:
                    raise RuntimeError(what)
                response = finish(totals)
                attach(response)
                yield {"event": "result", "data": response}
                return
    except Exception as e:  # whoever reads the stream gets one last event
        yield {"event": "failure", "data": {"message": I.safe_message(e)}}
    finally:
        if running is not None and running.isActive:
            running.stop()
        spark.streams.removeListener(listener)
