"""Packing token pieces into sequences by vector bin packing.

A piece needs three things at once: tokens, one segment, and loss-bearing tokens. Each bin has a
limit on every one. Bins are filled one after the other; the next piece for the open bin is the
one with the largest dot product between its needs and the room left (both as shares of the
limits), and when nothing whole fits any more, one document is cut so that the bin is filled.

Documents are tokenized and packed where they are read: no id is shuffled, a lost task is simply
run again, and memory is bounded by ``group_tokens`` ids at a time. What is left at the end of a group
that does not fill a bin goes out in pieces of powers of two, which need no padding.

Defined cases: null or empty text has only the end id; a document longer than a sequence gives
full pieces, and a very long one is tokenized piece by piece between words; repeated rows are packed each on
its own; columns but doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


#: Letters that lower-casing and composing leave as single letters; marks after them are separate tokens (but for the apostrophe's).
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Python's str.split parts words at these four too; they are no white space in Unicode.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACE = re.compile("[ \t\n]")
#: A text of twice as many characters is tokenized in pieces of about so many.
PIECE = 1 << 20


class WordCache:
    """Token ids, as little-endian unsigned 32-bit bytes, of white-space separated words.

    The tokenizer sees each new word once. Exact for tokenizers that drop white space and never
    join words across it. Two generations of at most ``room`` words each, and two of the letters of two and
    a half times as many, keep the memory bounded and the frequent words known.
    """

    def __init__(self, path: str, room: int = 300_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.room, self.new, self.old, self.cores, self.past, self.marks = room, {}, {}, {}, {}, {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # words may be learned by their letters only where the tokenizer itself lower-cases them
        self.by_letters = bool(self.closes.any()) and self._direct(["Ab ÉÀ ZEBRA, ok!"]) == self._direct(["ab éà zebra, ok!"])

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: letters and the marks after them are known apart, and far fewer."""
        if not self.by_letters:
            self.new.update(zip(words, self._direct(words), strict=True))
            return
        new, cores, past, marks = self.new, self.cores, self.past, self.marks
        fresh, odd = [], []
        for w in words:
            c = w.rstrip(_MARKS)
            low = c.lower()
            ids = cores.get(low)
            if ids is None and low in past:
                ids = cores[low] = past[low]
            if ids is not None and (low == c or c.isascii()):  # known letters with other marks or cases
                p = w[len(c) :]
                if p in marks:
                    new[w] = ids + marks[p]
                else:
                    fresh.append((w, low, p))
            elif _PLAIN.fullmatch(c):
                fresh.append((w, low, w[len(c) :]))
            else:
                odd.append(w)
        new.update(zip(odd, self._direct(odd), strict=True))
        unknown = list({p for _, _, p in fresh}.difference(marks))
        marks.update(zip(unknown, self._direct(unknown), strict=True))
        unknown = list({c for _, c, _ in fresh}.difference(cores))
        if unknown:  # one call for all: a token that closes a word tells where the next begins
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(unknown)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            raw, at = ids.tobytes(), 0
            for c, end in zip(unknown, ends, strict=True):
                cores[c] = raw[at:end]
                at = end
        for w, c, p in fresh:
            new[w] = cores[c] + marks[p]
        if len(self.cores) > 5 * self.room // 2:
            self.past, self.cores = cores, {}
        if len(self.marks) > 10_000:
            self.marks = {"": b""}

    def _lowered(self, text: str) -> str:
        """The text in lower case where that is what the tokenizer makes of it, letter by letter: fewer words to know."""
        if not self.by_letters:
            return text
        try:
            return text.lower() if text.isascii() or text.encode("latin-1") else text
        except UnicodeEncodeError:
            return text

    def encode(self, texts: list[str]) -> list[bytes]:
        if any(len(t) > 2 * PIECE for t in texts):
            return [b"".join(x for p in pieces(t) for x in self._encode([p])) for t in texts]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        words = [self._lowered(t).split() for t in texts]
        missing = set().union(*words).difference(self.new)
        known = [w for w in missing if w in self.old]
        self.new.update((w, self.old[w]) for w in known)
        missing.difference_update(known)
        unknown = list(missing)
        for at in range(0, len(unknown), 4096):
            self._learn(unknown[at : at + 4096])
        ids = self.new.__getitem__
        out = [b"".join(map(ids, ws)) for ws in words]
        if len(self.new) > self.room:
            self.old, self.new = self.new, {}
        for i, t in enumerate(texts):
            if any(c in t for c in _SEPARATORS):
                out[i] = self._direct([t])[0]
        return out


def pieces(text: str) -> Iterator[str]:
    """A long text in pieces of whole words, so that its words are not all held at once."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + PIECE)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def word_cache(path: str, room: int = 300_000) -> WordCache:
    return WordCache(path, room)


def place(tokens: np.ndarray, loss_share: np.ndarray, limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, bin, offset) for documents of so many tokens.

    ``loss_share`` is the part of a document's tokens that bears loss; a piece carries its share, rounded up.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss], float)
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0
    whole = np.minimum(limits.tokens, np.where(loss_share > 0, np.floor(limits.loss / np.maximum(loss_share, 1e-9)), limits.tokens)).astype(np.int64)
    whole = np.maximum(whole, 1)
    start = np.zeros(len(tokens), np.int64)
    for i in np.flatnonzero(tokens >= whole):  # full bins of one document each
        for _ in range(int(tokens[i] // whole[i])):
            out.append((int(i), int(start[i]), int(whole[i]), bins, 0))
            bins, start[i] = bins + 1, start[i] + whole[i]
    left = tokens - start
    live = np.flatnonzero(left > 0)
    # grouped by size: of equal needs one stands for all, so a choice costs the number of sizes
    need = np.ceil(left * loss_share).astype(np.int64)
    keys, which = np.unique(np.stack([left[live], need[live]], 1), axis=0, return_inverse=True) if len(live) else (np.zeros((0, 2), np.int64), np.zeros(0, int))
    stock: list[list[int]] = [[] for _ in keys]
    for i, k in zip(live[::-1], np.ravel(which)[::-1], strict=True):
        stock[k].append(int(i))
    shares = np.stack([keys[:, 0] / cap[0], np.full(len(keys), 1 / cap[1]), keys[:, 1] / cap[2]], 1)
    there = np.array([len(s) for s in stock])
    remaining = len(live)
    tails: dict[int, int] = {}
    while remaining:
        room_t, room_s, room_l, offset = limits.tokens, limits.segments, limits.loss, 0
        while remaining and room_t and room_s and room_l:
            fits = (there > 0) & (keys[:, 0] <= room_t) & (keys[:, 1] <= room_l)
            if fits.any():
                score = np.where(fits, shares @ (np.array([room_t, room_s, room_l]) / cap), -1)
                k = int(score.argmax())
                i = stock[k].pop()
                there[k] -= 1
                remaining -= 1
                length = int(left[i])
            else:  # cut one document of the largest size to fill the bin
                k = int(np.flatnonzero(there > 0)[-1])
                i = stock[k][-1]
                length = int(min(room_t, left[i], np.floor(room_l / loss_share[i]) if loss_share[i] > 0 else room_t))
                if length < 1:
                    break
                stock[k].pop()
                there[k] -= 1
                left[i] -= length
                rest = (int(left[i]), int(np.ceil(left[i] * loss_share[i])))
                at = np.flatnonzero((keys[:, 0] == rest[0]) & (keys[:, 1] == rest[1]))
                if len(at):
                    stock[int(at[0])].append(i)
                    there[int(at[0])] += 1
                else:
                    keys = np.vstack([keys, [rest]])
                    shares = np.vstack([shares, [rest[0] / cap[0], 1 / cap[1], rest[1] / cap[2]]])
                    there, stock = np.append(there, 1), [*stock, [i]]
                    order = np.lexsort((keys[:, 1], keys[:, 0]))
                    keys, shares, there, stock = keys[order], shares[order], there[order], [stock[j] for j in order]
            begin = tails.get(i, int(start[i]))
            out.append((i, begin, length, bins, offset))
            tails[i] = begin + length
            offset += length
            room_t, room_s = room_t - length, room_s - 1
            room_l -= int(np.ceil(length * loss_share[i]))
        bins += 1
    return halve_open(out, limits)


def halve_open(pieces: list[tuple[int, int, int, int, int]], limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """Sequences short of the limit are cut into sequences of powers of two, largest first."""
    fill: dict[int, int] = {}
    for _, _, n, b, _ in pieces:
        fill[b] = fill.get(b, 0) + n
    bins = max(fill, default=-1) + 1
    out = []
    edges: dict[int, list[tuple[int, int]]] = {}  # bin -> (first token, new bin)
    for b, n in fill.items():
        if n < limits.tokens and n & (n - 1):
            at, parts = 0, []
            for bit in range(n.bit_length() - 1, -1, -1):
                if n >> bit & 1:
                    parts.append((at, b if not parts else bins))
                    bins += len(parts) > 1
                    at += 1 << bit
            edges[b] = [*parts, (n, -1)]
    for i, s, n, b, o in pieces:
        if b not in edges:
            out.append((i, s, n, b, o))
            continue
        for (lo, new), (hi, _) in zip(edges[b], edges[b][1:], strict=False):
            x, y = max(o, lo), min(o + n, hi)
            if x < y:
                out.append((i, s + x - o, y - x, new, x - lo))
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits = Limits(), group_tokens: int = 1 << 21, known: int = 300_000) -> DataFrame:
    """One row per piece of every document of ``docs`` (doc_id, text).

    A worker knows so many words in a generation (:class:`WordCache`): fewer take less memory and more time, with the same rows.

    All tokens of a document bear loss here; :func:`place` takes other shares, for instruction data.
    A sequence_id holds the number of the input split above and the number within it below.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = word_cache(tokenizer_path, known)
        context = TaskContext.get()
        base, made = (context.partitionId() if context else 0) << 40, 0
        ids: list[bytes] = []
        end = np.array([end_id], "<u4").tobytes()
        names: list[object] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal made, held, ids, names
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            pieces = place(sizes, np.ones(len(ids)), limits)
            rows = {
                "doc_id": [names[p[0]] for p in pieces],
                "start": [p[1] for p in pieces],
                "length": [p[2] for p in pieces],
                "ids_crc32": [zlib.crc32(ids[p[0]][4 * p[1] : 4 * (p[1] + p[2])]) for p in pieces],
                "doc_tokens": [int(sizes[p[0]]) for p in pieces],
                "sequence_id": [base + made + p[3] for p in pieces],
                "offset": [p[4] for p in pieces],
            }
            made += max((p[3] for p in pieces), default=-1) + 1
            ids, names, held = [], [], 0
            return pd.DataFrame(rows).astype({"doc_id": "Int64"} if id_type in ("bigint", "int") else {})

        for rows in batches:
            texts, keys = [t or "" for t in rows["text"]], [None if pd.isna(k) else k for k in rows["doc_id"]]
            at = 0
            while at < len(texts):  # in slices, so that the ids of long texts don't pile up
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 2 * group_tokens):
                    size += len(texts[to])
                    to += 1
                for k, x in zip(keys[at:to], cache.encode(texts[at:to]), strict=True):
                    ids.append(x + end)
                    names.append(k)
                    held += len(ids[-1]) // 4
                at = to
                if held >= group_tokens:
                    yield flush()
        if ids:
            yield flush()

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInPandas(run, schema)
