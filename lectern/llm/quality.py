"""Document quality by a byte-level convolutional network in numpy.

A document is read as UTF-8 bytes, whole. Learned filters of ``WIDTH`` bytes slide over every
byte. Their responses are max-pooled over overlapping chunks of ``2 * HALF`` bytes that cover the
document, a small dense layer turns each chunk into one junk logit, the logits are max-pooled over
the chunks and a sigmoid gives the probability of label 1.

Fitting uses a bounded sample of labelled rows (``max_rows`` rows of ``max_chars`` characters in
all), chosen by hash, without the held-out fifth; scoring covers every document. Only the text is
an input of a score.

Defined cases: null or empty text scores as a document of one empty chunk; a very long text is read
block by block; without labels, or with one class only, every score is the mean label (1 without
labels); a null id is not held out; repeated rows are scored each; an empty table gives no rows; a
column named as one of the results gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, FILTERS, HIDDEN, HALF = 4, 32, 24, 64
BLOCK = 1 << 17


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Network:
    """Weights, forward pass and training of the network."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {
            "conv": r.normal(0, 0.5, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "dense": r.normal(0, 0.3, (FILTERS + 1, HIDDEN)).astype(np.float32),
            "hidden": np.zeros(HIDDEN, np.float32),
            "out": r.normal(0, 0.3, HIDDEN).astype(np.float32),
            "shift": np.full(1, -1.0, np.float32),
        }
        self.constant: float | None = None
        self.tables: list[np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"tables": None}  # large, and quick to make again

    def prepare(self) -> None:
        """Tables of the response to two bytes at once, for scoring: half of the look-ups, no multiplication."""
        c = self.w["conv"]
        self.tables = [(c[j][:, None, :] + c[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def responses(self, raw: np.ndarray) -> np.ndarray:
        """(positions, filters) of zero-padded bytes."""
        n = len(raw) - WIDTH + 1
        if self.tables is None:
            out = self.w["conv"][0][raw[:n]]
            for j in range(1, WIDTH):
                out += self.w["conv"][j][raw[j : j + n]]
            return out
        two = (raw[:-1].astype(np.int32) << 8) | raw[1:]
        out = self.tables[0][two[:n]]
        for j in range(1, WIDTH // 2):
            out += self.tables[j][two[2 * j : 2 * j + n]]
        return out

    def pooled(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Filter maxima of each half chunk, with the share of it that is text."""
        n = max(1, len(raw))
        halves = -(-n // HALF)
        parts = []
        for at in range(0, halves * HALF, BLOCK):  # memory stays bounded for a text of any length
            end = min(n, at + BLOCK)
            piece = np.zeros(max(1, end - at) + WIDTH - 1, np.uint8)
            there = np.frombuffer(raw[at : end + WIDTH - 1], np.uint8)
            piece[: len(there)] = there
            parts.append(np.maximum.reduceat(self.responses(piece), np.arange(0, max(1, end - at), HALF), axis=0))
        share = np.full(halves, 1.0, np.float32)
        share[-1] = (len(raw) - (halves - 1) * HALF) / HALF
        return np.concatenate(parts), share, np.arange(halves) * HALF

    @staticmethod
    def chunks(maxima: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk is two neighbouring halves, so chunks overlap by half."""
        if len(maxima) == 1:
            return maxima, share / 2
        return np.maximum(maxima[:-1], maxima[1:]), (share[:-1] + share[1:]) / 2

    def logits(self, pool: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.concatenate([np.maximum(pool + self.w["bias"], 0), share[:, None]], axis=1)
        h = np.tanh(x @ self.w["dense"] + self.w["hidden"])
        return h @ self.w["out"] + self.w["shift"], x, h

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if self.tables is None:
            self.prepare()
        out, batch, held = np.empty(len(texts)), [], 0
        for i, t in enumerate(texts):
            batch.append((i, (t or "").encode("utf-8", "replace")))
            held += len(batch[-1][1]) + HALF
            if held >= BLOCK or i == len(texts) - 1:
                self._score_batch(batch, out)
                batch, held = [], 0
        return out

    def _score_batch(self, batch: list[tuple[int, bytes]], out: np.ndarray) -> None:
        small = [x for x in batch if len(x[1]) <= BLOCK]
        for i, raw in (x for x in batch if len(x[1]) > BLOCK):
            maxima, share, _ = self.pooled(raw)
            out[i] = self._combine(self.logits(*self.chunks(maxima, share))[0])
        if not small:
            return
        # small texts share one array; each starts on a half-chunk border, with zeros between them
        sizes = np.array([max(1, len(x[1])) for x in small])
        halves = -(-sizes // HALF)
        gap = halves * HALF - sizes < WIDTH - 1
        room = (halves + gap) * HALF
        start = np.concatenate([[0], np.cumsum(room)])
        raw = np.zeros(start[-1] + WIDTH, np.uint8)
        for (_, b), s in zip(small, start, strict=False):
            raw[s : s + len(b)] = np.frombuffer(b, np.uint8)
        r = self.responses(raw)[: start[-1]]
        maxima = r.reshape(-1, HALF, FILTERS).max(axis=1)
        # positions past the end of a text are no positions of it
        last = start[:-1] // HALF + halves - 1
        for (_, b), s, k in zip(small, start, last, strict=False):
            end = s + max(1, len(b))
            maxima[k] = r[k * HALF : end].max(axis=0)
        share = np.ones(len(maxima), np.float32)
        share[last] = (np.array([len(x[1]) for x in small]) - (halves - 1) * HALF) / HALF
        first = start[:-1] // HALF
        both = np.maximum(maxima[:-1], maxima[1:]) if len(maxima) > 1 else maxima
        both_share = (share[:-1] + share[1:]) / 2 if len(maxima) > 1 else share / 2
        one = halves == 1
        index = np.concatenate([np.arange(f, f + max(1, h - 1)) for f, h in zip(first, halves, strict=True)])
        owner = np.repeat(np.arange(len(small)), np.maximum(1, halves - 1))
        pool, fill = np.empty((len(index), FILTERS), np.float32), np.empty(len(index), np.float32)
        alone = one[owner]
        pool[alone], fill[alone] = maxima[index[alone]], share[index[alone]] / 2
        pool[~alone], fill[~alone] = both[index[~alone]], both_share[index[~alone]]
        z = self.logits(pool, fill)[0]
        top = np.maximum.reduceat(z, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))
        out[[x[0] for x in small]] = self._combine(top, False)

    @staticmethod
    def _combine(z: np.ndarray, reduce: bool = True):
        top = z.max() if reduce else z
        return 1.0 / (1.0 + np.exp(np.clip(top, -30, 30)))

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 14, rate: float = 0.02, batch: int = 48, seed: int = 3) -> Network:
        """Adam on the log loss; the gradient follows the maxima down to the winning bytes."""
        if len(texts) == 0 or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(texts) else 1.0
            return self
        raws, self.tables = [t.encode("utf-8", "replace") for t in texts], None
        junk = 1.0 - labels
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, steps = 0, epochs * -(-len(raws) // batch)
        epochs = max(epochs, -(-300 * batch // len(raws)))
        steps = epochs * -(-len(raws) // batch)
        for _ in range(epochs):
            order = r.permutation(len(raws))
            for at in range(0, len(order), batch):
                g = {k: np.zeros_like(v) for k, v in self.w.items()}
                for i in order[at : at + batch]:
                    self._gradient(raws[i], junk[i], g)
                step += 1
                lr = rate * (1 - step / (steps + 1))
                for k, p in self.w.items():
                    d = g[k] / batch
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v2[k] = 0.98 * v2[k] + 0.02 * d * d
                    p -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
        self.prepare()
        return self

    def _gradient(self, raw: bytes, junk: float, g: dict[str, np.ndarray]) -> None:
        maxima, share, starts = self.pooled(raw)
        pool, fill = self.chunks(maxima, share)
        z, x, h = self.logits(pool, fill)
        c = int(z.argmax())
        d = 1.0 / (1.0 + np.exp(-np.clip(z[c], -30, 30))) - junk
        g["shift"] += d
        g["out"] += d * h[c]
        dh = d * self.w["out"] * (1 - h[c] ** 2)
        g["hidden"] += dh
        g["dense"] += np.outer(x[c], dh)
        dx = (self.w["dense"] @ dh)[:FILTERS] * (x[c][:FILTERS] > 0)
        g["bias"] += dx
        # where in the chunk each filter had its maximum
        lo = starts[c]
        hi = min(max(1, len(raw)), lo + 2 * HALF)
        piece = np.zeros(hi - lo + WIDTH - 1, np.uint8)
        there = np.frombuffer(raw[lo : hi + WIDTH - 1], np.uint8)
        piece[: len(there)] = there
        place = self.responses(piece).argmax(axis=0)
        f = np.arange(FILTERS)
        for j in range(WIDTH):
            np.add.at(g["conv"][j], (piece[place + j], f), dx)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_chars: int = 8_000_000, seed: int = 7) -> Network:
    """Fit on labelled, not held-out documents: in the order of a hash of their ids, as many as have ``max_chars`` characters in all, ``max_rows`` at most.

    Ids and lengths of ``max_rows`` rows, and those characters, are all that reaches the driver, whatever the size of the corpus.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = F.xxhash64("doc_id", F.lit(seed))
    # the sample is drawn from ids and lengths alone, so that only its texts travel
    rows = texts.select("doc_id", F.length("text").alias("n")).join(known, "doc_id").withColumn("h", order).orderBy("h", "doc_id", "n").limit(max_rows).collect()
    chosen, left = {}, max_chars
    for r in rows:
        if r["n"] <= left:
            chosen[r["doc_id"]] = r["quality"]
            left -= r["n"]
    if not chosen:
        return Network(seed).fit([], np.zeros(0))
    ids = F.broadcast(docs.sparkSession.createDataFrame(list(chosen.items()), labels.select("doc_id", "quality").schema))
    sample = texts.join(ids, "doc_id").orderBy(order, "doc_id", "text").limit(max_rows).collect()
    return Network(seed).fit([r["text"] for r in sample], np.array([float(r["quality"] > 0) for r in sample]))


def score_quality(docs: DataFrame, network: Network, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted, of every whole text."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(network.score(list(texts)))

    return docs.withColumns({"held_out": held_out(F.col("doc_id")), "score": score(F.coalesce("text", F.lit("")))}).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
