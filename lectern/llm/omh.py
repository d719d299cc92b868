"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence number, so that
all labelled shingles of a text differ. For each of ``TABLES`` hash functions the ``PICK``
smallest labelled shingles are kept *in text order*; texts that agree on one such tuple, order
included, meet in a bucket. A bucket is streamed; 256-byte sketches tell each row its closest
partner among those before it, and that pair is aligned: this finds most classes at little cost.
Then every pair of a bucket whose classes still differ, and that sketch and sizes do not rule out,
is aligned as well. A bucket is dealt in blocks, and blocks are compared with blocks over the tasks,
so that pairs are never rows and no task holds a large bucket; a pair is compared in the first bucket
it shares only, and not once its classes are joined: links inside a class need no proof. Aligning
means the longest run of common labelled shingles that rise in both texts within a band around the
diagonal; the similarity is ``aligned / (n1 + n2 - aligned)``, and 0.8 or more is a link.
Classes are the connected components of the links.

Exact copies are collapsed first (one representative per distinct text). Leaders with many
followers are split over tasks, and components are found by distributed label propagation; nothing is gathered on the driver.

Defined cases: null text is empty; empty texts are exact copies of each other; a text of one to
four words is one shingle; a very long text is hashed piece by piece; texts are told apart by content, whatever
their ids: rows of one id with different texts are different documents, rows with a null id are compared as
all others and come last in their class; repeated rows are one document and one of them is kept; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import spool, text_digest, text_or_empty

SHINGLE, TABLES, PICK, SKETCH, GROUPS = 5, 16, 3, 256, 64
#: how far below the threshold a sketch may estimate a pair that is still aligned: 6.4 standard errors of sqrt(0.16 / 256) at 0.8
MARGIN = 0.16
#: a block of a bucket has about so many rows, and so many labels, at most
ROWS, LABELS = 512, 1 << 20
U = np.uint64
LARGEST = U(0xFFFFFFFFFFFFFFFF)
ODD = U(0x9E3779B97F4A7C15)
BLOCK = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _seed(j: int) -> np.uint64:
    return U((j * int(ODD)) & int(LARGEST))


_power = {"up": np.ones(1, U), "down": np.ones(1, U)}
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n, U(base))
            x[0] = 1
            _power[name] = np.multiply.accumulate(x)
    return _power["up"][:n], _power["down"][:n]


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of words per text)."""
    data = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=total[1:])
    word = mix((total[stop] - total[start]) * down[start])
    return word, np.diff(np.searchsorted(start, np.concatenate([[0], ends]), side="right")) if len(raws) else np.zeros(0, int)


def pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces of whole words."""
    at = 0
    while at < len(raw):
        m = _SPACE.search(raw, at + BLOCK)
        end = m.start() if m else len(raw)
        yield raw[at:end]
        at = end


def labelled_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labelled shingle hashes in text order, number per text, word count per text), for all texts at once."""
    raws = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    if sum(map(len, raws)) <= 2 * BLOCK:
        word, words = word_hashes(raws)
    else:
        parts = [[word_hashes([p])[0] for p in pieces(r)] for r in raws]
        words = np.array([sum(map(len, ps)) for ps in parts])
        word = np.concatenate([x for ps in parts for x in ps] or [np.zeros(0, U)])
    first = np.concatenate([[0], np.cumsum(words)])
    count = np.where(words >= SHINGLE, words - SHINGLE + 1, (words > 0).astype(int))
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    padded = np.concatenate([word, np.zeros(SHINGLE, U)])
    h = np.zeros(len(at), U)
    for j in range(SHINGLE):
        inside = at + j < first[owner + 1]
        h = h * ODD + np.where(inside, padded[at + j], U(0))
    h = mix(h)
    # occurrence numbers: equal shingles of one text stand together after a sort
    key = h + owner.astype(U) * U(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    rank = np.arange(len(k)) - np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else np.zeros(0, int)
    occurrence = np.empty(len(k), U)
    occurrence[order] = rank.astype(U)
    return mix(h + occurrence * ODD), count, words


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ordered tuples (texts, TABLES), sketches (texts, SKETCH), shingle counts)."""
    label, count, _ = labelled_shingles(texts)
    n = len(texts)
    sigs, sketch = np.zeros((n, TABLES), U), np.zeros((n, SKETCH), np.uint8)
    live = np.flatnonzero(count)
    if not len(live):
        return sigs, sketch, count
    starts = (np.cumsum(count) - count)[live]
    sizes = count[live]
    owner = np.repeat(np.arange(len(live)), sizes)
    bins = np.full(len(live) * SKETCH, LARGEST)
    np.minimum.at(bins, owner * SKETCH + (label >> U(56)).astype(np.int64), label << U(8))
    filled = bins != LARGEST
    sketch[live] = np.where(filled, 1 + (mix(bins) % U(255)).astype(np.int64), 0).astype(np.uint8).reshape(-1, SKETCH)
    for j in range(TABLES):
        v = mix(label ^ mix(np.full(1, _seed(j + 1))))
        places = []
        for _ in range(PICK):
            least = np.minimum.reduceat(v, starts)
            place = np.flatnonzero(v == np.repeat(least, sizes))
            # labels of a text differ, so each text has one place; none is left once all are taken
            p = np.full(len(live), -1, np.int64)
            p[owner[place]] = place
            p[least == LARGEST] = -1
            places.append(p)
            v[p[p >= 0]] = LARGEST
        in_order = np.sort(np.stack(places, 1), axis=1)
        s = np.full(len(live), _seed(j + 101))
        for i in range(PICK):
            p = in_order[:, i]
            s = mix(s * ODD + np.where(p >= 0, label[np.maximum(p, 0)], U(0)))
        sigs[live, j] = s
    return sigs, sketch, count


def sliced(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < BLOCK):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def sketch_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        texts = list(rows["text"])
        for at, end in sliced(texts):
            sigs, sketch, n = signatures(texts[at:end])
            own = {c: rows[c].iloc[at:end].to_numpy() for c in ("known", "id", "digest")}
            yield pd.DataFrame(own | {"n": n, "sigs": list(sigs.view(np.int64)), "sketch": [x.tobytes() for x in sketch]})


def resemblance(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of one sketch to many."""
    either = (many | one) != 0
    return ((many == one) & either).sum(1) / np.maximum(1, either.sum(1))


class Bucket:
    """The rows of one block of a bucket, as streamed so far."""

    def __init__(self) -> None:
        self.ids, self.sizes = np.empty(16, np.int64), np.empty(16, np.int64)
        self.sketches, self.count = np.empty((16, SKETCH), np.uint8), 0

    def add(self, node: int, n: int, sketch: np.ndarray) -> None:
        if self.count == len(self.ids):
            for name in ("ids", "sizes", "sketches"):
                x = getattr(self, name)
                setattr(self, name, np.concatenate([x, np.empty_like(x)]))
        k = self.count
        self.ids[k], self.sizes[k], self.sketches[k] = node, n, sketch
        self.count += 1

    def meet(self, node: int, n: int, sketch: np.ndarray, floor: float, threshold: float) -> list[int]:
        """The closest earlier row, if any is in reach."""
        sizes = self.sizes[: self.count]
        ok = np.flatnonzero(np.minimum(sizes, n) >= threshold * np.maximum(sizes, n))
        found: list[int] = []
        if len(ok):
            near = resemblance(sketch, self.sketches[ok])
            k = near.argmax()
            found = [int(self.ids[ok[k]])] if near[k] >= floor else []
        self.add(node, n, sketch)
        return found


def sweep_buckets(floor: float, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, bucket = None, Bucket()
        for rows in batches:
            a, b = [], []
            for key, block, node, n, sketch in zip(*(rows[c] for c in ("key", "block", "node", "n", "sketch")), strict=True):
                if (key, block) != at:
                    at, bucket = (key, block), Bucket()
                found = bucket.meet(node, n, np.frombuffer(sketch, np.uint8), floor, threshold)
                a += found
                b += [node] * len(found)
            # texts that share several buckets often meet in one batch
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)}).drop_duplicates()

    return run


def groups(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each two blocks (key, p, q), which stand together in the stream."""
    held: list[dict[str, np.ndarray]] = []
    at = None
    whole = lambda: {c: np.concatenate([h[c] for h in held]) for c in held[0]}
    for rows in batches:
        columns = {c: rows[c].to_numpy() for c in rows.columns}
        k = rows[["key", "p", "q"]].to_numpy(np.int64)
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1)]) if len(k) else np.zeros(0, int)
        for lo, hi in zip(starts, np.r_[starts[1:], len(k)], strict=True):
            if held and tuple(k[lo]) != at:
                yield whole()
                held = []
            at = tuple(k[lo])
            held.append({c: v[lo:hi] for c, v in columns.items()})
    if held:
        yield whole()


def candidates(g: dict[str, np.ndarray], floor: float, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places x, y of the pairs to compare here, and their estimates: of different classes, in reach, and in no earlier bucket."""
    label, n, t = g["class"], g["n"], g["t"][0]
    x, y, near = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    if (label == label[0]).all():
        return x[0], y[0], near[0]
    sketch = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(-1, SKETCH)
    sigs = np.stack(list(g["sigs"]))
    first = int((g["side"] == 0).sum())  # rows of block p come first
    for i in range(first):
        js = np.arange(i + 1 if g["p"][0] == g["q"][0] else first, len(n))
        js = js[(label[js] != label[i]) & (np.minimum(n[js], n[i]) >= threshold * np.maximum(n[js], n[i]))]
        js = js[(sigs[js] == sigs[i]).argmax(1) == t]
        if len(js):
            e = resemblance(sketch[i], sketch[js])
            js, e = js[e >= floor], e[e >= floor]
            x.append(np.full(len(js), i))
            y.append(js)
            near.append(e)
    return np.concatenate(x), np.concatenate(y), np.concatenate(near)


def open_rows(floor: float, threshold: float):
    """The rows of two blocks that have a pair to compare; only their texts are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches):
            x, y, _ = candidates(g, floor, threshold)
            if len(x):
                k = np.union1d(x, y)
                yield pd.DataFrame({c: g[c][k] for c in ("key", "t", "p", "q", "side", "node", "class")})

    return run


def common_labels(parts: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Shared labels of each pair, exactly, all at once; None where pair by pair is less work."""
    xs, ys = np.unique(x), np.unique(y)
    used = np.union1d(xs, ys)
    every, column, times = np.unique(np.concatenate([parts[i] for i in used]), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # labels of one text are shared with none
    width = int(number[-1]) + 1 if len(number) else 0
    sizes = np.array([len(p) for p in parts])
    if len(xs) * len(ys) * width > 1000 * (sizes[x] + sizes[y]).sum():
        return None
    row = np.repeat(np.arange(len(used)), sizes[used])
    row, column = row[times[column] > 1], number[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(xs), len(ys)), np.float32)
    step = max(1, (1 << 22) // len(used))
    for lo in range(0, width, step):
        i, j = np.searchsorted(column, [lo, lo + step])
        has = np.zeros((len(used), min(step, width - lo)), np.float32)
        has[row[i:j], column[i:j] - lo] = 1
        total += has[np.searchsorted(used, xs)] @ has[np.searchsorted(used, ys)].T
    return total[np.searchsorted(xs, x), np.searchsorted(ys, y)]


def align_blocks(floor: float, threshold: float):
    """Links between the classes of two blocks: every candidate is aligned, unless links so far join its classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches):
            x, y, order = candidates(g, floor, threshold)
            if not len(x):
                continue
            parts: list[np.ndarray] = []
            texts = list(g["text"])
            for lo, hi in sliced(texts):
                label, count, _ = labelled_shingles(texts[lo:hi])
                parts += np.split(label, np.cumsum(count)[:-1])
            shared = common_labels(parts, x, y)
            if shared is not None:
                both = g["n"][x] + g["n"][y]
                ok = shared >= threshold / (1 + threshold) * both - 1e-3
                x, y, order = x[ok], y[ok], (shared / (both - shared))[ok]
            up: dict[int, int] = {}

            def find(c: int) -> int:
                while c in up:
                    c = up[c]
                return c

            a, b, s = [], [], []
            for k in np.argsort(-order, kind="stable"):
                i, j = x[k], y[k]
                one, two = find(int(g["class"][i])), find(int(g["class"][j]))
                if one != two and (similarity := aligned_similarity(parts[i], parts[j], threshold)) >= threshold:
                    up[max(one, two)] = min(one, two)
                    a.append(g["node"][i])
                    b.append(g["node"][j])
                    s.append(similarity)
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64), "similarity": np.array(s, float)})

    return run


def aligned_similarity(x: np.ndarray, y: np.ndarray, threshold: float) -> float:
    """Banded alignment of two sequences of distinct labels; 0 where the threshold is out of reach."""
    n, m = len(x), len(y)
    if not n or not m:
        return float(n == m)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    need = threshold / (1 + threshold) * (n + m)
    if len(i) < need - 1e-9:
        return 0.0
    order = np.argsort(i)
    i, j = i[order], j[order]
    band = int(n + m - 2 * need) + 1  # a path this far off the diagonal leaves too many unaligned
    j = j[np.abs(i - j) <= band]
    if len(j) and not (np.diff(j) > 0).all():
        tails: list[int] = []
        for v in j.tolist():
            k = bisect_left(tails, v)
            if k == len(tails):
                tails.append(v)
            else:
                tails[k] = v
        common = len(tails)
    else:
        common = len(j)
    return common / (n + m - common)


def verify_rows(threshold: float):
    """Streams sorted by (leader, salt, leader first): keeps one leader's labels, aligns each follower with them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, lead = None, None
        for rows in batches:
            a, b, s = [], [], []
            texts = list(rows["text"])
            for lo, hi in sliced(texts):
                label, count, _ = labelled_shingles(texts[lo:hi])
                parts = np.split(label, np.cumsum(count)[:-1])
                for k, (x, salt, turn, y) in enumerate(zip(*(rows[c].iloc[lo:hi] for c in ("a", "salt", "turn", "b")), strict=True)):
                    if not turn:
                        at, lead = (x, salt), parts[k].copy()
                    elif at == (x, salt):
                        similarity = aligned_similarity(lead, parts[k], threshold)
                        if similarity >= threshold:
                            a.append(x)
                            b.append(y)
                            s.append(similarity)
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64), "similarity": np.array(s, float)})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, class) for the connected components of links (a, b): least label, with pointer jumping.

    Every round is a few joins and a written table; the driver sees one flag per round.
    """
    both = spool(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = spool(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("class")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("seen"))
        step = label.join(near, "node").select("node", "class", F.least("class", "seen").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("class").alias("above"))
        top = label.select(F.col("node").alias("above"), F.col("class").alias("top"))
        jumped = step.join(up, "low", "left").withColumn("above", F.coalesce("above", "low")).join(top, "above", "left")
        least = F.least("low", "above", F.coalesce("top", "above"))
        new = spool(jumped.select("node", least.alias("class"), (least != F.col("class")).alias("moved")))
        label = new.select("node", "class")
        if new.filter("moved").isEmpty():
            return label


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs that align.

    A leader's text (a) goes once to each group of its followers; a leader of many has up to ``GROUPS`` groups.
    """
    n = max(8, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(GROUPS)).cast("int"))
    followers = salted.select(F.col("b").alias("node"), "a", "salt", F.lit(1).alias("turn"))
    leaders = salted.select(F.col("a").alias("node"), "a", "salt", F.lit(0).alias("turn")).distinct()
    stream = followers.unionByName(leaders).join(texts, "node").withColumnRenamed("node", "b")
    stream = stream.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "turn")
    return spool(stream.mapInPandas(verify_rows(threshold), "a long, b long, similarity double"))


def link_near(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of ``docs`` (doc_id, text).

    members: known, id, digest, c (rows) per distinct pair of id and text (known: the id is not null). classes, one row
    per distinct text: digest, first (unknown, id, digest: the least row of its class, null ids last), class_size.
    """
    spark = docs.sparkSession
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = {"known": F.col("doc_id").isNotNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "digest": text_digest()}
    rows = docs.select(text_or_empty().alias("text"), *[v.alias(k) for k, v in key.items()])
    sketched = spool(rows.mapInPandas(sketch_rows, "known boolean, id long, digest binary, n long, sigs array<long>, sketch binary"))
    # tables that are joined to what they were counted from are written out first: then a hot key's partition can be split
    members = spool(sketched.groupBy("known", "id", "digest").agg(F.count(F.lit(1)).alias("c")))
    least = F.min(F.struct((~F.col("known")).alias("unknown"), "id")).alias("least")
    nodes = spool(members.groupBy("digest").agg(least, F.sum("c").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    # one row of hashes per distinct text
    of_node = nodes.select("digest", "node", (~F.col("least.unknown")).alias("known"), F.col("least.id").alias("id"))
    live = spool(sketched.filter("n > 0").join(of_node, ["digest", "known", "id"]).select("node", "digest", "known", "id", "n", "sigs", "sketch").dropDuplicates(["node"]))

    keys = live.select("node", "n", F.posexplode("sigs").alias("t", "key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("labels")).filter("c > 1")
    shared = spool(shared.select("key", F.greatest(F.ceil(F.col("c") / ROWS), F.ceil(F.col("labels") / LABELS)).cast("int").alias("blocks")))
    met = spool(keys.join(shared, "key").select("node", "t", "key", "blocks", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int").alias("block")))
    # texts that share no bucket are not read again
    held = spool(met.select("node").distinct().join(live, "node"))
    texts = spool(rows.join(held.select("digest", "known", "id", "node"), ["digest", "known", "id"]).dropDuplicates(["node"]).select("node", "text"))

    stream = met.select("node", "key", "block").join(held.select("node", "n", "sketch"), "node").repartition(n, "key", "block").sortWithinPartitions("key", "block", "node")
    pairs = spool(stream.mapInPandas(sweep_buckets(threshold - MARGIN / 2, threshold), "a long, b long").distinct())
    classes = components(verified(pairs, texts, threshold))

    # what is left: all pairs of a bucket that are of different classes
    at = spool(met.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")))
    mixed = spool(at.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("key"))
    two = at.join(mixed, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    two = two.select("key", "t", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "class")
    hashes = held.select("node", "n", "sigs", "sketch")
    dealt = lambda df: df.repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q", "side", "node")
    left = spool(dealt(two.join(hashes, "node")).mapInPandas(open_rows(threshold - MARGIN, threshold), "key long, t int, p int, q int, side int, node long, class long"))
    found = spool(dealt(left.join(hashes, "node").join(texts, "node")).mapInPandas(align_blocks(threshold - MARGIN, threshold), "a long, b long, similarity double"))
    if not found.isEmpty():
        # new links between classes merge them
        x, y = classes.select(F.col("node").alias("a"), F.col("class").alias("ca")), classes.select(F.col("node").alias("b"), F.col("class").alias("cb"))
        between = found.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = components(between).withColumnRenamed("node", "old").withColumnRenamed("class", "new")
        every = classes.unionByName(found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node", "left_anti").withColumn("class", F.col("node")))
        classes = spool(every.join(merged, F.col("class") == F.col("old"), "left").select("node", F.coalesce("new", "class").alias("class")))
    # a class's size and first row are counted over texts, before they fan out to their copies
    whole = spool(nodes.join(classes, "node", "left").select("digest", "least", "copies", F.coalesce("class", "node").alias("class")))
    first = F.min(F.struct("least.unknown", "least.id", "digest")).alias("first")
    of_class = spool(whole.groupBy("class").agg(first, F.sum("copies").alias("class_size")))
    return members, spool(whole.join(of_class, "class").select("digest", "first", "class_size"))


def near_members(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, digest, rows_alike, class_id, class_size, kept for each distinct pair of id and text of ``docs``."""
    members, classes = link_near(docs, threshold)
    real = lambda known, x: F.when(known, x)
    out = members.join(classes, "digest")
    kept = (F.col("known") != F.col("first.unknown")) & (F.col("id") == F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    return out.select(real(F.col("known"), F.col("id")).alias("doc_id"), "digest", F.col("c").alias("rows_alike"), real(~F.col("first.unknown"), F.col("first.id")).alias("class_id"), "class_size", kept.alias("kept"))


def near_representatives(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, digest, rows_alike of the one document of each class that stays."""
    return spool(near_members(docs, threshold).filter("kept").select("doc_id", "digest", "rows_alike"))


def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (least doc_id of the class; null if none has one), class_size (rows), kept (one row per class), per row of ``docs``."""
    rows = near_members(docs, threshold).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "rows_alike")))
    return rows.select("doc_id", "class_id", "class_size", (F.col("kept") & (F.col("nth") == 1)).alias("kept"))
