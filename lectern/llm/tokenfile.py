"""Token ids as binary files: one concatenated id array, document boundaries in Elias-Fano form.

Texts are dealt by ranges of doc_id and sorted, each range is tokenized where it lies and written as one
file, in order. Spark's own writer commits the files, so a lost task leaves none behind, and any
store that Spark writes to will do. File names rise with the ranges: the files, read one after the other, are the array.

A file is a sequence of blocks. A block (all numbers little-endian):

    magic "EFT1", bytes per id (1 byte), open (1 byte), documents that end here, ids, null doc_ids (3 x u32),
    least doc_id (i64), sizes of the two sections below (2 x u32)
    ids         u16 each where the vocabulary allows, else u32
    ends        Elias-Fano: where each document ends, counted in ids from the block's first
    doc_ids     Elias-Fano: distances from the least, rising; null ids come last and have none
    newline     the writer's

The first ids of a block go on with the last document of the block before where that one is ``open``;
so a document of any length takes several blocks, and neither side holds more than one.

Elias-Fano keeps n rising numbers below u in about ``2 + log2(u / n)`` bits each: the low bits as they are, the
high ones in unary, and the place of every 64th one of the unary part, so that ``select`` reads a few
bytes. No table of 64-bit offsets is written; the only wide numbers are one base per file, summed from the files' totals.

Defined cases: null or empty text has the end id only; doc_id is an integer of any size, negative or null (null
ids come last); rows of one id stand in the order of their text's hash, and equal rows are written each; such rows may
fall into several files; a very long text is tokenized in pieces between words; columns but doc_id and text are
not read; an empty table gives one file or none, and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.llm.common import shared_dir, spool, text_or_empty, track
from lectern.llm.packing import word_cache

MAGIC = b"EFT1"
HEAD = struct.Struct("<4sBBIIIqII")
FANO = struct.Struct("<IBII")
#: every so many ones the place of one is kept
STEP = 64
#: ids of a block, at most
BLOCK_IDS = 1 << 21
#: bytes of text per file, about
FILE_BYTES = 64 << 20
#: bytes of text that a worker tokenizes at a time, about, and words that it knows in a generation
SLICE, KNOWN = 4 << 20, 100_000


@dataclass(frozen=True)
class EliasFano:
    """Rising numbers from 0 on, in two parts: ``low`` bits of each in full, the rest in unary."""

    n: int
    low: int
    lows: bytes
    highs: bytes
    places: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        low = max(0, int(values[-1]) // n).bit_length() - 1 if int(values[-1]) >= n else 0
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        return cls(n, low, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes(), ones[::STEP].astype("<u4").tobytes())

    def to_bytes(self) -> bytes:
        return FANO.pack(self.n, self.low, len(self.lows), len(self.highs)) + self.lows + self.highs + self.places

    @classmethod
    def from_bytes(cls, raw: bytes | memoryview) -> EliasFano:
        n, low, a, b = FANO.unpack_from(raw)
        at = FANO.size
        return cls(n, low, bytes(raw[at : at + a]), bytes(raw[at + a : at + a + b]), bytes(raw[at + a + b :]))

    def select(self, i: int) -> int:
        """The i-th number: from the nearest kept place on, ones are counted byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int.from_bytes(self.places[4 * (i // STEP) : 4 * (i // STEP) + 4], "little")
        left = i % STEP
        at = place >> 3
        byte = self.highs[at] & (0xFF << (place & 7))
        while left >= byte.bit_count():
            left -= byte.bit_count()
            at += 1
            byte = self.highs[at]
        for _ in range(left):
            byte &= byte - 1
        high = 8 * at + (byte & -byte).bit_length() - 1 - i
        first = i * self.low
        last = first + self.low
        low = int.from_bytes(self.lows[first >> 3 : (last + 7) >> 3], "little") >> (first & 7) & ((1 << self.low) - 1)
        return (high << self.low) | low

    def values(self) -> np.ndarray:
        """All numbers, as unsigned 64-bit ones."""
        if not self.n:
            return np.zeros(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
            out |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out


@dataclass(frozen=True)
class Block:
    """One block as read: ids, where documents end, their doc_ids (None: null) and whether the last ids' document goes on."""

    ids: np.ndarray
    ends: EliasFano
    keys: EliasFano
    least: int
    open: bool

    def doc_id(self, i: int) -> int | None:
        return self.least + self.keys.select(i) if i < self.keys.n else None

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document that ends here, as far as they lie in this block: two selects and a slice."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def block_bytes(ids: bytes, width: int, ends: list[int], keys: list[int | None], is_open: bool) -> bytes:
    """A block without its newline. ``ids``: little-endian numbers of ``width`` bytes; ``ends`` and ``keys``: per document that ends here."""
    known = [k for k in keys if k is not None]
    least = known[0] if known else 0
    fano = EliasFano.encode(np.array(ends, np.uint64)).to_bytes()
    names = EliasFano.encode(np.array([k - least for k in known], np.uint64)).to_bytes()
    head = HEAD.pack(MAGIC, width, is_open, len(ends), len(ids) // width, len(keys) - len(known), least, len(fano), len(names))
    return head + ids + fano + names


def read_blocks(raw: bytes | memoryview) -> Iterator[Block]:
    """The blocks of a file."""
    view, at = memoryview(raw), 0
    while at < len(view):
        magic, width, is_open, _, n, _, least, a, b = HEAD.unpack_from(view, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEAD.size
        ids = np.frombuffer(view, "<u2" if width == 2 else "<u4", n, at)
        at += n * width
        yield Block(ids, EliasFano.from_bytes(view[at : at + a]), EliasFano.from_bytes(view[at + a : at + a + b]), least, bool(is_open))
        at += a + b + 1


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """Texts as Python strings, some megabytes at a time."""
    at = size = 0
    sizes = pc.binary_length(texts).to_pylist()
    for to, n in enumerate(sizes):
        if to > at and size + n > SLICE:
            yield texts.slice(at, to - at).to_pylist()
            at, size = to, 0
        size += n
    if at < len(sizes):
        yield texts.slice(at).to_pylist()


def _blocks(tokenizer_path: str, end_id: int, width: int, block_ids: int):
    """Rows in order in, blocks as strings out."""
    mark = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer_path, KNOWN)
        held: list[bytes] = []
        ends: list[int] = []
        keys: list[int | None] = []
        size = 0

        def flush(is_open: bool) -> pa.RecordBatch:
            nonlocal held, ends, keys, size
            ids = np.frombuffer(b"".join(held), "<u4").astype("<u2" if width == 2 else "<u4").tobytes()
            out = pa.record_batch([pa.array([block_bytes(ids, width, ends, keys, is_open)], pa.binary())], ["value"])
            held, ends, keys, size = [], [], [], 0
            return out

        for rows in batches:
            names = iter(rows.column("doc_id").to_pylist())
            for texts in _slices(rows.column("text")):
                for x, k in zip(cache.encode(texts), names, strict=False):
                    x += mark
                    while size + len(x) // 4 > block_ids:  # a document goes on in the next block
                        cut = 4 * (block_ids - size)
                        held.append(x[:cut])
                        x = x[cut:]
                        yield flush(True)
                    held.append(x)
                    size += len(x) // 4
                    ends.append(size)
                    keys.append(k)
        if ends:
            yield flush(False)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, file_bytes: int = FILE_BYTES, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all ``docs`` (doc_id, text), in ascending doc_id, as files below ``path``."""
    if docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("doc_id must be an integer column")
    from tokenizers import Tokenizer

    width = 2 if max(max(Tokenizer.from_file(tokenizer_path).get_vocab().values()), end_id) < 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-total // file_bytes), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total >> 20), 1)
    # the row's number parts rows of one id and text, so that no range is one key's
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *order, "row").sortWithinPartitions(*order)
    blocks = dealt.select("doc_id", "text").mapInArrow(_blocks(tokenizer_path, end_id, width, block_ids), "value binary")
    # the text writer puts bytes out as they are
    blocks.select(F.col("value").cast("string").alias("value")).write.text(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files in, one row per document out: file, doc_id, place and first id within the file, number of ids, checksum."""
    for rows in batches:
        for name, raw in zip(rows.column("file"), rows.column("content"), strict=True):
            place = start = n = crc = 0
            for block in read_blocks(raw.as_buffer()):
                ends = block.ends.values().astype(np.int64)
                wide = block.ids.astype("<u4")
                keys = [block.least + int(k) for k in block.keys.values()] + [None] * (block.ends.n - block.keys.n)
                counts, sums = [], []
                edges = [0, *ends.tolist()]
                for a, b in zip(edges, edges[1:], strict=False):
                    counts.append(n + b - a)
                    sums.append(zlib.crc32(wide[a:b], crc))
                    n = crc = 0
                first = start + np.r_[0, np.cumsum(counts)[:-1]] if counts else np.zeros(0, np.int64)
                k = len(counts)
                columns = {"file": pa.array([name.as_py()] * k, pa.string()), "doc_id": pa.array(keys, pa.int64()), "place": pa.array(range(place, place + k), pa.int64()), "first": pa.array(first.astype(np.int64)), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
                if k:
                    yield pa.record_batch(columns)
                place, start = place + k, start + sum(counts)
                rest = wide[int(ends[-1]) if k else 0 :]
                n, crc = n + len(rest), zlib.crc32(rest, crc)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file, place per document, all from the files below ``path``.

    ``start``: ids of all documents before it; ``file`` (number) and ``place`` (document within the file) tell where it lies.
    """
    number = F.regexp_extract(F.col("path"), r"/part-(\d+)[^/]*$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(number.alias("file"), "content")
    found = spool(files.mapInArrow(_documents, "file string, doc_id long, place long, first long, n_tokens long, ids_crc32 long").withColumn("file", F.col("file").cast("int")))
    # one row per file, far fewer than documents
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("file", before.alias("base"))
    return found.join(bases, "file").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "file", "place")


def new_path(spark: SparkSession) -> str:
    """A fresh folder for token files in the shared folder, deleted with the session."""
    return track(spark, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
