"""Alignment of two tokenizers' tokens over a corpus, and how often each pair of ids is linked.

Tokens of one text by two tokenizers are the two sides of a graph, with a link wherever their byte
ranges overlap. Union-find over that graph gives its connected components, which are exactly the minimal groups
of tokens that cover the same bytes. Links are then counted by pair of ids, over all texts.

Neither tokenizer joins bytes across a single blank between two characters that are no white space (a property
of their pre-tokenization and vocabulary; :meth:`Aligner.align` proves it on each run of words it aligns, and goes word by word
where it does not hold). So components never cross such a blank: each distinct piece between two of them is
aligned once per worker, in numpy, and a text's graph is the union of its pieces' graphs.

Texts are read and tokenized once, in blocks of a bounded number of links. A block gives one row per document,
with its distinct pairs and how often each stands in it, and one row of the block's distinct pairs. Spark sums the
blocks' counts, finds each B id's highest, joins the sums back to the blocks, and a second pass over the blocks' rows (no text,
no tokenizer) adds them up per document. No pair has more than one row per block, so no pair is hot; no group is larger than a block.

Defined cases: null and empty texts, and texts whose bytes either side does not give back, have no tokens: zeros and an
empty digest; a very long text is aligned piece by piece; rows of equal or null ids are rows of their own, repeated rows count each
time; columns but doc_id and text are not read; an empty table gives no rows. doc_id may be of any type.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import spool

#: a single blank between characters that are no white space; only here a text is cut
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: a blank beside white space, or white space at an end: here ``str.split`` would cut elsewhere
_ODD = re.compile(r" \s|\s(?: |\Z)|\A\s")
#: texts are cut into pieces of about so many characters before their words are looked up
PIECE = 1 << 18
#: links of a block, and of the pieces that a worker knows, at most (about)
BLOCK_LINKS, KNOWN_LINKS, KNOWN_WORDS = 1 << 21, 1 << 22, 250_000


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` nodes' connected components, for links a-b: union-find, all links of a round at once."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: str) -> None:
        self.held, self.n = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.empty_like(self.held)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class Aligner:
    """What is known of pieces of text: numbers of tokens, groups and links, the groups as text, the linked pairs."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocabulary = self.a.get_vocab()
        back = byte_of_letter()
        self.bytes_a: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.len_a, self.len_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        digits = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.written = [digits, *[[mark + d for d in digits] for mark in ",|;"]]
        self.size_b = len(self.bytes_b)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        #: per piece: A tokens, B tokens, groups, links; a piece that is not given back has -1 A tokens
        self.counts, self.pairs, self.first = _Grown("(4,)i8"), _Grown("i8"), _Grown("i8")
        self.first.add(np.zeros(1, np.int64))

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = " ".join(words)
        return np.array(self.a.encode_batch_fast([" " + whole], add_special_tokens=False)[0].ids, np.int64), np.array(self.b.encode(whole), np.int64)

    def align(self, words: list[str]) -> None:
        """Learn ``words``, each of which stands after a blank."""
        raw = (" " + " ".join(words)).encode()
        a, b = self._ids(words)
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.cumsum([1 + len(w.encode()) for w in words])
        given_back = b"".join([self.bytes_a[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw
        if not given_back or not (np.isin(ends, ends_a).all() and np.isin(ends, ends_b).all()):
            if len(words) > 1:
                for w in words:
                    self.align([w])
                return
            self.index[words[0]] = len(self.groups)
            self.groups.append("")
            self.counts.add(np.array([[-1, 0, 0, 0]]))
            self.first.add(np.array([self.pairs.n]))
            return
        # between two neighbouring ends of either side lies one link, and no pair of tokens has two
        points = np.union1d(ends_a, ends_b)
        x, y = np.searchsorted(ends_a, points), np.searchsorted(ends_b, points)
        root = components(len(a) + len(b), x, y + len(a))
        word_a, word_b, word_link = (np.searchsorted(ends, e) for e in (ends_a, ends_b, points))
        heads = np.flatnonzero(root[: len(a)] == np.arange(len(a)))  # a component's least member is its first A token
        k = len(words)
        links = np.bincount(word_link, minlength=k)
        self.counts.add(np.stack([np.bincount(word_a, minlength=k), np.bincount(word_b, minlength=k), np.bincount(word_a[heads], minlength=k), links], 1))
        self.first.add(self.pairs.n + np.cumsum(links))
        self.pairs.add(a[x] * self.size_b + b[y])
        # the members of each component: its A tokens, then its B tokens, in order
        order = np.argsort(root, kind="stable")
        side = (order >= len(a)).astype(int)
        own, word = root[order], np.concatenate([word_a, word_b])[order]
        new = np.r_[True, own[1:] != own[:-1]]
        fresh = np.r_[True, word[1:] != word[:-1]]
        mark = np.where(fresh, 0, np.where(new, 3, np.where(np.r_[False, side[1:] != side[:-1]], 2, 1)))
        parts = [self.written[m][i] for m, i in zip(mark.tolist(), np.concatenate([a, b])[order].tolist(), strict=True)]
        cuts = [*np.flatnonzero(fresh).tolist(), len(parts)]
        for w, lo, hi in zip(words, cuts, cuts[1:], strict=False):
            self.index[w] = len(self.groups)
            self.groups.append("".join(parts[lo:hi]))

    def look_up(self, words: list[str]) -> np.ndarray:
        """The numbers of ``words``, new ones learned."""
        if len(self.index) > KNOWN_WORDS or self.pairs.n > KNOWN_LINKS:
            self.forget()
        new = list(set(words).difference(self.index))
        at = size = 0
        for to, w in enumerate(new):
            if size > 1 << 16:
                self.align(new[at:to])
                at, size = to, 0
            size += len(w)
        if at < len(new):
            self.align(new[at:])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as it is, the rest from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def cut(text: str) -> Iterator[list[str]]:
    """The pieces of a text between lone blanks, in lists of about ``PIECE`` characters."""
    at = 0
    while at < len(text):
        m = _CUT.search(text, at + PIECE) if len(text) - at > 2 * PIECE else None
        end = m.start() if m else len(text)
        part = text[at:end]
        yield _CUT.split(part) if _ODD.search(part) else part.split(" ")
        at = end + 1


class Measured:
    """One document as far as its pieces have been seen."""

    def __init__(self) -> None:
        self.counts, self.pairs, self.digest, self.whole = np.zeros(4, np.int64), [], hashlib.sha256(), True

    def add(self, known: Aligner, i: np.ndarray) -> None:
        """The next pieces, by their numbers."""
        counts = known.counts.held[i]
        if (counts[:, 0] < 0).any():
            self.whole = False
        if self.whole:
            lead = ";" if self.counts[0] else ""
            self.digest.update((lead + ";".join(map(known.groups.__getitem__, i))).encode())
            self.counts += counts.sum(0)
            n = counts[:, 3]
            at = np.repeat(known.first.held[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
            self.pairs.append(np.unique(known.pairs.held[at], return_counts=True))

    def result(self) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        """(numbers, digest, distinct pairs, how often each)."""
        if not self.whole or not self.pairs:
            return np.zeros(4, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.pairs) == 1:
            pairs, times = self.pairs[0]
        else:
            pairs, times = summed(*[np.concatenate(x) for x in zip(*self.pairs, strict=True)])
        return self.counts, self.digest.hexdigest(), pairs, times


def measure(known: Aligner, texts: list[str]) -> Iterator[Measured]:
    """Each text; pieces of short ones are looked up together."""
    at = 0
    while at < len(texts):
        to, size, words, edges = at, 0, [], [0]
        while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE) and len(texts[to]) <= PIECE:
            size += len(texts[to])
            words += next(cut(texts[to]), [])
            edges.append(len(words))
            to += 1
        if to > at:
            i = known.look_up(words)
            for lo, hi in zip(edges, edges[1:], strict=False):
                m = Measured()
                if hi > lo:
                    m.add(known, i[lo:hi])
                yield m
            at = to
        else:
            m = Measured()
            for words in cut(texts[at]):
                m.add(known, known.look_up(words))
            yield m
            at += 1


def slices(texts: pa.Array) -> Iterator[list[str]]:
    """Texts as Python strings, null ones empty, so many at a time that they don't pile up."""
    at = size = 0
    for to, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if to > at and size + n > 4 * PIECE:
            yield [t or "" for t in texts.slice(at, to - at).to_pylist()]
            at, size = to, 0
        size += n
    if at < len(texts):
        yield [t or "" for t in texts.slice(at).to_pylist()]


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, rising, and the sums of their times."""
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, int)
    return pairs[starts], np.add.reduceat(times, starts) if len(starts) else times


#: of one document: its block, numbers, digest, distinct pairs and times (little-endian bytes)
_ROW = "block long, {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, known array<long>, counts array<long>"


def small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold the largest, which stand first."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _measure(path_a: str, path_b: str, id_type: pa.DataType, block_links: int):
    """Texts in; rows of documents out, and after each block of them the block's pairs."""
    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "known", "counts"]
    kinds = [pa.int64(), id_type, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, context = aligner(path_a, path_b), TaskContext.get()
        block, links = (context.partitionId() if context else 0) << 32, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows: list[tuple] = []

        def closed() -> pa.RecordBatch:
            nonlocal block, links, held
            pairs, times = summed(*[np.concatenate(x) for x in zip(*held, strict=True)])
            out = batch([(block, *[None] * 8, pairs, times)])
            block, links, held = block + 1, 0, []
            return out

        for b in batches:
            for k, m in zip(b.column("doc_id"), (m for texts in slices(b.column("text")) for m in measure(known, texts)), strict=True):
                counts, digest, pairs, times = m.result()
                rows.append((block, k.as_py(), *counts.tolist(), digest, small(np.diff(pairs, prepend=0)), small(times), None, None))
                held.append((pairs, times))
                links += len(pairs)
                if links > block_links:
                    yield batch(rows)
                    yield closed()
                    rows = []
            if rows:
                yield batch(rows)
                rows = []
        if held:
            yield closed()

    return run


def _add_up(id_type: pa.DataType):
    """Rows sorted by block, its pairs (rising) before its documents: each document's sums."""
    outs = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        held: list[tuple[np.ndarray, ...]] = []
        table: tuple[np.ndarray, ...] | None = None
        for rows in batches:
            block = rows.column("block").to_numpy()
            is_pair = rows.column("pair").is_valid().to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (is_pair[1:] != is_pair[:-1])]) if len(block) else np.zeros(0, int)
            for lo, hi in zip(edge, np.r_[edge[1:], len(block)], strict=True):
                part = rows.slice(lo, hi - lo)
                if block[lo] != at:
                    at, held, table = block[lo], [], None
                if is_pair[lo]:
                    held.append(tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")))
                    continue
                if table is None:
                    table = tuple(np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
                pair, count, best = table
                n_best, total = [], []
                for pairs, times in zip(part.column("pairs").to_pylist(), part.column("times").to_pylist(), strict=True):
                    i, n = np.searchsorted(pair, np.cumsum(unpacked(pairs))), unpacked(times)
                    n_best.append(int(n[best[i].astype(bool)].sum()))
                    total.append(int((n * count[i]).sum()))
                columns = [part.column("doc_id").cast(id_type), *[part.column(c) for c in outs[1:]], pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), part.column("groups_sha256")]
                yield pa.record_batch(columns, [*outs, "n_best", "count_sum", "groups_sha256"])

    return run


def measured(docs: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """A row per document and one per block of documents, as :data:`_ROW` has them; written out, as blocks are known by their task."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = _ROW.format(id=f"doc_id {kind.simpleString()}")
    return spool(docs.select("doc_id", "text").mapInArrow(_measure(path_a, path_b, to_arrow_type(kind), block_links), schema))


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """pair (A id times ``size_b`` plus B id), a, b, count (links of all texts), best (no pair of its B id has more)."""
    pairs = rows.filter("known IS NOT NULL").select(F.explode(F.arrays_zip("known", "counts")).alias("x"))
    sums = spool(pairs.groupBy(F.col("x.known").alias("pair")).agg(F.sum("x.counts").alias("count")))
    named = sums.select("pair", F.floor(F.col("pair") / size_b).alias("a"), (F.col("pair") % size_b).alias("b"), "count")
    highest = named.groupBy("b").agg(F.max("count").alias("highest"))
    # at most one row per entry of B's vocabulary
    return named.join(F.broadcast(highest), "b").select("pair", "a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of ``docs`` (doc_id, text).

    ``path_a``: a byte-level vocabulary of the tokenizers library, ``path_b``: a sentencepiece model; both see a blank before the text.
    """
    import sentencepiece
    from pyspark.sql.pandas.types import to_arrow_type

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = measured(docs, path_a, path_b, block_links)
    of_block = rows.filter("known IS NOT NULL").select("block", F.explode("known").alias("pair"))
    told = of_block.join(pair_counts(rows, size_b).select("pair", "count", "best"), "pair")
    own = rows.filter("known IS NULL").drop("known", "counts")
    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stream = own.unionByName(told, allowMissingColumns=True).repartition(n, "block").sortWithinPartitions("block", F.col("pair").asc_nulls_last())
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return stream.mapInArrow(_add_up(to_arrow_type(kind)), schema)
