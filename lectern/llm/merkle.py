"""Document fingerprints: a Merkle tree over paragraphs and sections, in Column expressions only.

Paragraphs are the lines of a text. A paragraph's leaves are short content-defined runs of words (of
characters, in scripts without blanks): a 64-bit hash each, with the run's length in its lowest bits. A
paragraph's digest is the SHA-256 of its text and its leaves, a section's that of its paragraphs' digests, the
root's (the fingerprint) that of its sections' digests with their number: equal texts, and only they, have
equal roots. A section ends after a paragraph whose digest starts with one of four hex digits, so an edit moves
no border but its own. Where two roots differ, the first and the last differing branch locate the edit, section by
section and then, inside these, paragraph by paragraph.

The likeness of two trees is found on the way down: 1 where the roots agree, else equal sections are paired (the first of a kind
with the first, and so on) and only the others are opened; their paragraphs are paired likewise, and only the paragraphs without a
partner are opened to their leaves. A pair counts with all its text where it stands after the pair before it in both
trees, with half of it where its place has changed; leaves count with their lengths, as often as both sides have
them. The sum, twice, by the text of both is the likeness. The tree is returned beside the root, so likenesses can be worked out from it.

Defined cases: null text is empty and has a root of its own; two empty texts are alike (1), an
empty and another are not (0); a text without line breaks is one paragraph, and a very long one is a row as any other (its
leaves are half as large as itself); of rows with one doc_id the next is the one of the next text hash; a null id
comes first; the next of a single document is itself; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lectern.llm.common import cuts_up_to, let, own_partitions, text_or_empty


def _ranges(low: int, high: int, width: int, every: int) -> str:
    """Blocks of ``width`` code points, one in ``every``, as part of a character class."""
    return "".join(f"\\u{c:04x}-\\u{min(c + width, high + 1) - 1:04x}" for c in range(low - low % width, high + 1, width) if c // width % every == 0 and c >= low)


#: A leaf ends at a blank after a word whose last character is of one third of its alphabet (Latin-1's classes are the
#: engine's fastest, so other letters are only looked at where the character is beyond them) ...
_LATIN = "".join(f"\\u{c:04x}" for c in range(0x21, 0x100) if c % 3 == 0)
_LETTERS = "".join(f"\\u{c:04x}" for c in range(0x100, 0x250) if c % 3 == 0) + _ranges(0x250, 0xDFF, 4, 3) + _ranges(0x10A0, 0x2DFF, 8, 3) + _ranges(0xA000, 0xD7FF, 64, 3) + _ranges(0xE000, 0xF8FF, 64, 3) + _ranges(0xFB00, 0xFFFC, 8, 3)
#: ... and, in scripts without blanks, after about one character in six.
_SIXTH = _ranges(0xE00, 0xEFF, 4, 6) + _ranges(0x1000, 0x109F, 4, 6) + _ranges(0x1780, 0x17FF, 4, 6) + _ranges(0x3040, 0x30FF, 4, 6) + _ranges(0x3400, 0x9FFF, 64, 6) + _ranges(0xF900, 0xFAFF, 4, 6)
_BLANK = r"[ \t\u3000]"
LEAF_END = rf"{_BLANK}(?:(?<=[{_LATIN}].)|(?<=[^\u0000-\u00ff].)(?<=[{_LETTERS}{_SIXTH}].))|(?<=[^\u0000-\u0dff])(?<=[{_SIXTH}])(?!{_BLANK})"
#: A run of more than so many characters is cut inside its words, and by length where even that finds no border.
LONG, PIECE = 256, 64
INNER_END = rf"(?<=[{_LATIN}]{{3}})"
MARK, LENGTH = "\u0001", 4095
#: In sorted arrays of up to so many keys a key is looked for one by one.
LOOK = 4096
#: One block of texts has about so many bytes, unless that makes too few for the session's shuffle partitions.
BLOCK_BYTES = 256 << 20


def leaf(run: Column) -> Column:
    """64 bits: a hash above, the length (up to 4095) below."""
    return F.xxhash64(run).bitwiseAND(F.lit(~LENGTH)).bitwiseOR(F.least(F.length(run), F.lit(LENGTH)).cast("long"))


def tree(text: Column) -> Column:
    """struct(root, sections (key, size, paragraphs (key, size, leaves)), n_paragraphs) of a text column."""

    def leaves_of(runs: Column) -> Column:
        pieces = lambda x: F.when(F.length(x) > LONG, F.regexp_extract_all(x, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array(x))
        inner = lambda x: F.when(F.length(x) > LONG, F.flatten(F.transform(F.split(F.regexp_replace(x, INNER_END, MARK), MARK, -1), pieces))).otherwise(F.array(x))
        cut = F.when(F.exists(runs, lambda x: F.length(x) > LONG), F.flatten(F.transform(runs, inner))).otherwise(runs)
        return F.transform(cut, leaf)

    def paragraph(p: Column, marked: Column) -> Column:
        leaves = leaves_of(F.split(marked, MARK, -1))
        return let(leaves, lambda x: F.struct(F.sha2(F.concat_ws(MARK, p, F.array_join(x.cast("array<string>"), ",")), 256).alias("digest"), F.length(p).alias("n"), x.alias("leaves")))

    def grouped(paragraphs: Column) -> Column:
        n = F.size(paragraphs)
        digest = lambda i: F.element_at(paragraphs, i)["digest"]
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | digest(i).substr(1, 1).isin("0", "4", "8", "c"))

        def section(own: Column) -> Column:
            branches = F.transform(own, lambda p: F.struct(F.xxhash64(p["digest"]).alias("key"), (p["n"] + 1).alias("size"), F.filter(p["leaves"], lambda x: x.bitwiseAND(LENGTH) > 0).alias("leaves")))
            size = F.aggregate(own, F.lit(0), lambda s, p: s + p["n"] + 1)
            return let(F.sha2(F.array_join(F.transform(own, lambda p: p["digest"]), ""), 256), lambda d: F.struct(d.alias("digest"), F.xxhash64(d).alias("key"), size.alias("size"), branches.alias("paragraphs")))

        def sections(ends: Column) -> Column:
            before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.element_at(ends, F.greatest(k, F.lit(1))))
            return F.transform(ends, lambda e, k: let(F.slice(paragraphs, before(k) + 1, e - before(k)), section))

        return let(
            let(ends, sections),
            lambda s: F.struct(
                F.sha2(F.concat_ws(",", F.size(s).cast("string"), F.array_join(F.transform(s, lambda x: x["digest"]), "")), 256).alias("root"),
                F.transform(s, lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"), x["paragraphs"].alias("paragraphs"))).alias("sections"),
                n.alias("n_paragraphs"),
            ),
        )

    marked = F.regexp_replace(text, LEAF_END, "$0" + MARK)
    return let(F.zip_with(F.split(text, "\n", -1), F.split(marked, "\n", -1), paragraph), grouped)


def _first_of(keys: Column, key: Column) -> Column:
    """How many of the sorted ``keys`` are below ``key``, which is one of them or not: a look along a short array, bisection in a long one."""
    steps = F.lit([1 << k for k in range(30, -1, -1)])
    bisected = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(keys, at + step - 1) < key, F.lit(False)), at + step).otherwise(at))
    return F.when(F.size(keys) > LOOK, bisected).otherwise(F.array_position(keys, key).cast("int") - 1)


def _paired(a: Column, b: Column) -> Column:
    """(i, j) of branches of equal key, the k-th of a key with the k-th, by i."""
    sort = lambda x: F.array_sort(F.transform(x, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"))))
    keys = lambda s: F.transform(s, lambda e: e["key"])

    def pairs(s: Column) -> Column:
        def partner(e: Column, k: Column) -> Column:
            there = _first_of(s["kb"], e["key"])
            return let(F.when(there >= 0, F.get(s["b"], there + k - _first_of(s["ka"], e["key"]))), lambda t: F.struct(e["i"].alias("i"), F.when(t["key"] == e["key"], t["i"]).alias("j")))

        return F.array_sort(F.filter(F.transform(s["a"], partner), lambda m: m["j"].isNotNull()))

    return let(let(F.struct(sort(a).alias("a"), sort(b).alias("b")), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), keys(s["a"]).alias("ka"), keys(s["b"]).alias("kb"))), pairs)


def _level(a: Column, b: Column, below: str) -> Column:
    """struct(weight, a, b): the text of paired branches, and what stands ``below`` those without a partner on either side."""

    def summed(m: Column) -> Column:
        in_order = lambda e, k: (k == 0) | (e["j"] > F.element_at(m, F.greatest(k, F.lit(1)))["j"])
        weights = F.transform(m, lambda e, k: F.get(a, e["i"])["size"] * F.when(in_order(e, k), 1.0).otherwise(0.5))
        alone = lambda x, own: F.flatten(F.transform(F.array_except(F.transform(x, lambda _, i: i), F.transform(m, lambda e: e[own])), lambda i: F.get(x, i)[below]))
        return F.struct(F.aggregate(weights, F.lit(0.0), lambda s, w: s + w).alias("weight"), alone(a, "i").alias("a"), alone(b, "j").alias("b"))

    return let(_paired(a, b), summed)


def _shared(a: Column, b: Column) -> Column:
    """The lengths of the leaves that both sorted arrays have, as often as both have them: one step along either array at a time."""

    def step(s: Column, _: Column) -> Column:
        x, y = F.get(a, s["i"]), F.get(b, s["j"])
        over = x.isNull() | y.isNull()
        both = (~over) & (x == y)
        return F.struct((s["i"] + F.when(over | (x > y), 0).otherwise(1)).alias("i"), (s["j"] + F.when(over | (x < y), 0).otherwise(1)).alias("j"), (s["w"] + F.when(both, x.bitwiseAND(LENGTH)).otherwise(0)).alias("w"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).cast("long").alias("w"))
    return F.aggregate(F.sequence(F.lit(1), F.size(a) + F.size(b) + 1), start, step)["w"]


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two trees, 1 exactly where the roots agree: from the roots down, only into what differs."""
    size = lambda t: F.aggregate(t["sections"], F.lit(0), lambda s, x: s + x["size"])

    def descended(s: Column) -> Column:
        return let(_level(s["a"], s["b"], "leaves"), lambda p: s["weight"] + p["weight"] + let(F.struct(F.array_sort(p["a"]).alias("a"), F.array_sort(p["b"]).alias("b")), lambda x: _shared(x["a"], x["b"])))

    both = size(a) + size(b)
    text = let(_level(a["sections"], b["sections"], "paragraphs"), descended)
    return F.when(a["root"] == b["root"], 1.0).otherwise(let(F.lit(2.0) * text / both, lambda v: F.least(v, F.lit(1.0) - F.lit(1.0) / (both + 2))))


def _differing(x: Column, y: Column) -> Column:
    """struct(from, to): the places of ``x`` between the branches that it shares with ``y`` at both ends."""

    def run(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
        return let(F.array_position(same, F.lit(False)), lambda k: F.when(k == 0, F.size(x)).otherwise(k - 1).cast("int"))

    ends = F.struct(run(x, y).alias("head"), run(F.reverse(x), F.reverse(y)).alias("tail"))
    return let(ends, lambda s: F.struct(F.least(s["head"], F.size(x)).alias("from"), F.greatest(s["head"], F.size(x) - s["tail"]).alias("to")))


def edit_span(a: Column, b: Column) -> Column:
    """struct(from, to, paragraphs): where tree ``a`` differs from ``b``, in sections, and in paragraphs counted from the text's first."""
    keys = lambda x: F.transform(x, lambda e: e["key"])
    every = lambda t: F.flatten(F.transform(t["sections"], lambda s: keys(s["paragraphs"])))
    spans = F.struct(_differing(keys(a["sections"]), keys(b["sections"])).alias("s"), let(F.struct(every(a).alias("a"), every(b).alias("b")), lambda x: _differing(x["a"], x["b"])).alias("p"))
    return let(spans, lambda x: F.struct(x["s"]["from"].alias("from"), x["s"]["to"].alias("to"), x["p"].alias("paragraphs")))


def planned(sizes: list, target: float) -> tuple[list[int], list[int], dict[int, object]]:
    """(first block, number of blocks) of each bucket of ids, and the least id of each block.

    Neighbouring buckets share a block up to ``target`` bytes; a bucket of one id that is larger has several.
    """
    known = {r["bucket"]: r for r in sizes}
    first, parts, least, block, held = [], [], {}, -1, target
    for k in range(max(known, default=0) + 1):
        r = known.get(k)
        alone = r is not None and r["lo"] == r["hi"] and r["bytes"] > 2 * target
        if r is not None and (alone or held >= target or k == 1 and 0 in known):  # null ids, bucket 0, have blocks of their own
            block, held = block + 1, 0
        first.append(max(block, 0))
        parts.append(-(-int(r["bytes"]) // max(int(target), 1)) if alone else 1)
        if r is not None:
            for b in range(block, block + parts[-1]):
                least.setdefault(b, r["lo"])
            held += r["bytes"]
        if alone:
            block, held = block + parts[-1] - 1, target
    return first, parts, least


def in_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, h) with ``block``, their range of ids, and ``last``: 1 for a copy of the next block's first row.

    Blocks are of like size in bytes; rows of one id that are too many for a block are cut by ``h``. One row per bucket
    of ids (eight times as many as blocks) is all that reaches the driver.
    """
    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = docs.agg(F.sum(F.octet_length("text") + 64).alias("bytes")).first()["bytes"] or 0
    n = max(n, total // BLOCK_BYTES)
    seen = docs.agg(F.percentile_approx("doc_id", [i / (8 * n) for i in range(1, 8 * n)], max(10_000, 80 * n)).alias("cuts")).first()
    cuts = seen["cuts"] or []
    often = {c + 1 for c, d in zip(cuts, cuts[1:], strict=False) if c == d}  # an id of many rows has a bucket to itself
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(cuts_up_to(sorted(often.union(cuts)), F.col("doc_id")) + 1)
    sizes = docs.groupBy(bucket.alias("bucket")).agg(F.sum(F.octet_length("text") + 64).alias("bytes"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()
    first, parts, least = planned(sizes, total / n)
    docs = docs.withColumn("bucket", bucket)
    of = lambda table: F.element_at(F.lit(table), F.col("bucket") + 1)
    sub = F.shiftright((F.shiftright("h", 32) + F.lit(1 << 31)) * of(parts), 32).cast("int") if max(parts) > 1 else F.lit(0)
    docs = docs.withColumn("block", (of(first) + sub).cast("int")).drop("bucket")
    ids = [x for x in least.values() if x is not None]
    head = docs.filter(F.col("doc_id").isin(ids) | (F.col("doc_id").isNull() if len(ids) < len(least) else F.lit(False)))
    head = head.groupBy("block").agg(F.min_by(F.struct("doc_id", "text", "h"), F.struct("doc_id", "h")).alias("r")).select("r.*", "block")
    there = sorted(r["block"] for r in head.select("block").collect()) if max(parts) > 1 else sorted(least)
    before = {b: there[k - 1] for k, b in enumerate(there)}  # that of the first is the last: the order is a ring
    table = [before.get(b, 0) for b in range(max(there, default=0) + 1)]
    head = head.withColumn("block", F.element_at(F.lit(table), F.col("block") + 1)).withColumn("last", F.lit(1))
    return own_partitions(docs.withColumn("last", F.lit(0)).unionByName(head), max(n, len(table)), F.col("block"), "block")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, in which the last quarter gives way to the start of the next document.

    Texts are shuffled once, by range of ids; the next row of a range is read over a sorted window.
    """
    docs = in_blocks(docs.select("doc_id", text_or_empty().alias("text")).withColumn("h", F.xxhash64("text")))
    docs = docs.select("doc_id", "block", "last", "text", "h", tree(F.col("text")).alias("t"))
    here = W.partitionBy("block").orderBy("last", F.col("doc_id").asc_nulls_first(), "h")
    following = F.lead(F.struct("text", "t")).over(here)
    both = docs.withColumn("following", following).filter("last = 0")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("following.text", F.lit(1), cut))
    out = both.select("doc_id", n.cast("long").alias("n_chars"), "t", edited.alias("edited"), F.col("following.t").alias("x"))
    out = out.select("doc_id", "n_chars", "t", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("edited")).alias("e"), "x")
    t, e, x = F.col("t"), F.col("e"), F.col("x")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        t["root"].alias("fingerprint"),
        e["root"].alias("edited_fingerprint"),
        likeness(t, e).alias("near_edited"),
        likeness(t, x).alias("near_next"),
        t["n_paragraphs"].alias("n_paragraphs"),
        F.size(t["sections"]).alias("n_sections"),
        edit_span(t, e).alias("edited_sections"),
        t["sections"].alias("tree"),
    )
