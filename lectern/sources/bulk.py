"""A bulk sink that takes what it can and says why it refused the rest: ``df.write.format("bulk_chunks")``.

Each task checks its batches, column by column, and writes the good rows and the refused ones (with their reason) to files of its
own. Its message to the driver holds the files' names and how many rows each reason has, never rows. The commit
publishes one manifest that names all files of the job; without it none of them is read, so a job that failed, was
refused or lost its driver leaves nothing. A task that ran twice is counted once: only the messages of committed tasks are named.

Options: ``path`` (a store that pyarrow reaches), ``dimensions`` of an embedding (0: any), ``failFast`` (one refused row
refuses the job). Rows need chunk_id, document_id and text; an embedding is checked where there is such a column.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

REJECTED = "chunk_id string, document_id string, reason string"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _missing(column: pa.Array) -> pa.Array:
    return pc.fill_null(pc.equal(pc.utf8_trim_whitespace(column), ""), True)


def reasons(rows: pa.RecordBatch, dimensions: int = 0) -> pa.Array:
    """Why each row is refused, the first reason that holds; null for a good one."""
    checks = [(f"{c} is missing", _missing(rows.column(c))) for c in ("chunk_id", "document_id", "text")]
    if "embedding" in rows.schema.names:
        vectors = rows.column("embedding")
        length = pc.list_value_length(vectors)
        checks.append(("embedding is missing", pc.is_null(vectors)))
        if dimensions:
            checks.append((f"embedding does not have {dimensions} dimensions", pc.fill_null(pc.not_equal(length, dimensions), False)))
        values = pc.list_flatten(vectors)
        bad = pc.or_(pc.is_null(values), pc.invert(pc.fill_null(pc.is_finite(values), True)))
        owners = pc.unique(pc.filter(pc.list_parent_indices(vectors), bad))
        checks.append(("embedding has a value that is no number", pc.is_in(pa.array(range(len(rows)), owners.type), owners)))
    out = pa.nulls(len(rows), pa.string())
    for reason, holds in reversed(checks):
        out = pc.if_else(holds, reason, out)
    return out


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: files, and the number of rows per reason (empty: good)."""

    files: dict[str, str]
    counts: dict[str, int]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options) -> None:
        self.path, self.dimensions, self.strict = options["path"], int(options.get("dimensions", 0)), str(options.get("failFast", "false")).lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        store, root = _store(self.path)
        name, files, counts, writers = uuid.uuid4().hex, {}, Counter(), {}
        try:
            for rows in iterator:
                why = reasons(rows, self.dimensions)
                counts.update(x or "" for x in why.to_pylist())
                good, refused = pc.is_null(why), pc.is_valid(why)
                parts = {"accepted": rows.filter(good), "rejected": pa.record_batch([rows.column("chunk_id"), rows.column("document_id"), why], ["chunk_id", "document_id", "reason"]).filter(refused)}
                for kind, part in parts.items():
                    if not len(part):
                        continue
                    if kind not in writers:
                        files[kind] = f"{kind}/{name}.parquet"
                        store.create_dir(f"{root}/{kind}", recursive=True)
                        writers[kind] = pq.ParquetWriter(f"{root}/{files[kind]}", part.schema, filesystem=store)
                    writers[kind].write_batch(part)
        finally:
            for w in writers.values():
                w.close()
        return Written(files, dict(counts))

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        counts = sum((Counter(m.counts) for m in done), Counter())
        refused = sum(n for reason, n in counts.items() if reason)
        if self.strict and refused:
            raise ValueError(f"{refused} rows were refused")
        store, root = _store(self.path)
        store.create_dir(f"{root}/manifests", recursive=True)
        draft = f"{root}/manifests/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"files": [m.files for m in done if m.files], "counts": counts}).encode())
        store.move(draft, f"{root}/manifests/{uuid.uuid4().hex}.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            for f in m.files.values() if m is not None else ():
                store.delete_file(f"{root}/{f}")


class BulkSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bulk_chunks"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("rows are only added")
        return _Writer(self.options)


def write(rows: DataFrame, path: str, dimensions: int = 0, fail_fast: bool = False) -> None:
    rows.sparkSession.dataSource.register(BulkSink)
    rows.write.format("bulk_chunks").mode("append").option("dimensions", dimensions).option("failFast", fail_fast).save(path)


def _manifests(spark: SparkSession, path: str) -> list[dict]:
    """One small file per job."""
    from lectern.sources.stores import index_exists

    if not index_exists(spark, f"{path}/manifests"):
        return []
    return [json.loads(r[0]) for r in spark.read.text(f"{path}/manifests/*.json", wholetext=True).collect()]


def read(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The ``accepted`` or ``rejected`` rows of all committed jobs."""
    files = [f"{path}/{f[kind]}" for m in _manifests(spark, path) for f in m["files"] if kind in f]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def counts(spark: SparkSession, path: str) -> dict[str, int]:
    """Rows per reason over all committed jobs; those without one are stored."""
    return dict(sum((Counter(m["counts"]) for m in _manifests(spark, path)), Counter()))
