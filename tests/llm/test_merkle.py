import hashlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from lectern.llm import merkle


def brute(pairs):
    """(id, text) rows -> [(n, hash of the edited text)] in the operator's order of rows."""
    out = {}
    for i, (key, text) in enumerate(pairs):
        nxt = pairs[(i + 1) % len(pairs)][1]
        k = len(text) // 4
        out[key] = (len(text), hashlib.sha256((text[: len(text) - k] + nxt[:k]).encode()).hexdigest())
    return out


def test_edits_against_brute_force(spark, make_docs):
    texts = ["short", None, "é" * 37 + "\n\n" + "words and more words " * 40, "", "x", "漢字、仮名。" * 50, "long line " * 30_000, "same text", "same text"]
    df = make_docs(*texts, ids=[40, -3, 7, 100, 2**40, 8, 9, 11, 12]).withColumn("t", F.lit("clash")).withColumn("block", F.lit(3))
    got = {r.doc_id: r for r in merkle.fingerprint_edits(df).collect()}
    want = brute(sorted((i, t or "") for i, t in zip([40, -3, 7, 100, 2**40, 8, 9, 11, 12], texts)))
    assert {k: (r.n_chars, r.edited_sha256) for k, r in got.items()} == want
    assert got[11].fingerprint == got[12].fingerprint and got[11].near_next == 1.0
    assert len({r.fingerprint for r in got.values()}) == 7  # two pairs of equal texts: empty ones and copies
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert all((r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint) for r in got.values())


def test_null_and_repeated_ids(spark, make_docs):
    df = make_docs("one two", "three four", "five six", "five six", ids=[None, 5, 5, 9])
    out = merkle.fingerprint_edits(df)
    assert out.count() == 4 and out.filter("doc_id IS NULL").count() == 1


def test_one_document_and_none(spark, make_docs):
    r = merkle.fingerprint_edits(make_docs("abcdefgh")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0
    assert merkle.fingerprint_edits(make_docs("x").limit(0)).count() == 0


def test_differing_branches_locate_an_edit(spark):
    lines = [f"paragraph number {i} with its own words" for i in range(200)]
    changed = lines[:120] + ["something else"] + lines[121:]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(changed))], "a string, b string")
    r = df.select(merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b")).select("a", "b", merkle.edit_span(F.col("a"), F.col("b")).alias("e")).first()
    assert r.a.root != r.b.root and 0 < r.e["from"] < r.e.to < len(r.a.sections) and r.e.to - r.e["from"] <= 3
    assert (r.e.paragraphs["from"], r.e.paragraphs.to) == (120, 121)


def plain_likeness(a, b):
    """Of two trees (root, sections) as they are returned, in plain Python."""
    if a[0] == b[0]:
        return 1.0

    def level(x, y, below):
        places = {}
        for j, e in enumerate(y):
            places.setdefault(e["key"], []).append(j)
        pairs = [(i, places[e["key"]].pop(0)) for i, e in enumerate(x) if places.get(e["key"])]
        weight = sum(x[i]["size"] * (1 if k == 0 or j > pairs[k - 1][1] else 0.5) for k, (i, j) in enumerate(pairs))
        one, two = {i for i, _ in pairs}, {j for _, j in pairs}
        return weight, [c for i, e in enumerate(x) if i not in one for c in e[below]], [c for j, e in enumerate(y) if j not in two for c in e[below]]

    first, x, y = level(a[1], b[1], "paragraphs")
    second, x, y = level(x, y, "leaves")
    shared = sum(n * (leaf & 4095) for leaf, n in (Counter(x) & Counter(y)).items())
    both = sum(s["size"] for t in (a, b) for s in t[1])
    return min(2 * (first + second + shared) / both, 1 - 1 / (both + 2))


def plain_root(text, tree):
    """The root from the text and its leaves, by hashlib; None where the tree does not cover the text."""
    digests, sections = [], []
    paragraphs = text.split("\n")
    held = [p for s in tree for p in s["paragraphs"]]
    if len(held) != len(paragraphs) or any(p["size"] != len(t) + 1 or sum(x & 4095 for x in p["leaves"]) != len(t) for p, t in zip(held, paragraphs)):
        return None
    at = 0
    for s in tree:
        own = []
        for p in s["paragraphs"]:
            # a text's last piece may be empty, and is a leaf without length
            leaves = [",".join(map(str, [*p["leaves"], *extra])) for extra in ([], [EMPTY])]
            own.append([hashlib.sha256(f"{paragraphs[at]}\u0001{x}".encode()).hexdigest() for x in leaves])
            at += 1
        own = [next(d for d in ds if signed(xxhash.xxh64(d.encode(), seed=42).intdigest()) == p["key"]) for ds, p in zip(own, s["paragraphs"])]
        assert all(d[0] not in "048c" for d in own[:-1]) and (own[-1][0] in "048c" or s is tree[-1])
        sections.append(hashlib.sha256("".join(own).encode()).hexdigest())
        digests += own
    return hashlib.sha256(f"{len(sections)},{''.join(sections)}".encode()).hexdigest()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


EMPTY = signed(xxhash.xxh64(b"", seed=42).intdigest() & ~4095 & (1 << 64) - 1)


def test_roots_and_likeness_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = {r.doc_id: r for r in merkle.fingerprint_edits(docs).collect()}
    order = sorted(rows)
    for k, after in zip(order, [*order[1:], order[0]]):
        assert plain_root(texts[k], rows[k].tree) == rows[k].fingerprint
        assert abs(plain_likeness((rows[k].fingerprint, rows[k].tree), (rows[after].fingerprint, rows[after].tree)) - rows[k].near_next) < 1e-9
    edits = [(k, texts[k], texts[k][: len(texts[k]) - len(texts[k]) // 4] + texts[a][: len(texts[k]) // 4]) for k, a in zip(order, [*order[1:], order[0]])]
    made = spark.createDataFrame(edits, "k long, a string, b string").select("k", merkle.tree(F.col("b")).alias("b")).collect()
    assert all(abs(plain_likeness((rows[r.k].fingerprint, rows[r.k].tree), (r.b.root, r.b.sections)) - rows[r.k].near_edited) < 1e-9 for r in made)


def test_order_and_number_of_branches_count(spark, monkeypatch):
    lines = [f"paragraph {i} has these {i * 7} words of its own" for i in range(60)]
    texts = {
        "whole": lines, "reversed": lines[::-1], "moved": [*lines[40:], *lines[:40]], "edits": [*lines[:9], "new one", *lines[10:30], "another", *lines[31:]], "twice": lines * 2, "none": ["nothing in common here"],
        "blank": [x for line in lines for x in (line, "")], "one": ["two words"], "often": ["two words " * 500],
    }
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "k string, text string").select("k", merkle.tree(F.col("text")).alias("t"))
    both = df.alias("a").join(df.alias("b"), F.lit(True))
    for look in (4096, 3):  # looked for one by one, and by bisection
        monkeypatch.setattr(merkle, "LOOK", look)
        rows = both.select(F.col("a.k").alias("x"), F.col("b.k").alias("y"), F.col("a.t").alias("one"), F.col("b.t").alias("two"), merkle.likeness(F.col("a.t"), F.col("b.t")).alias("v")).collect()
        got = {(r.x, r.y): r.v for r in rows}
        assert all(abs(plain_likeness((r.one.root, r.one.sections), (r.two.root, r.two.sections)) - r.v) < 1e-9 for r in rows)
    assert 0.45 < got["whole", "reversed"] < 0.6 and 0.9 < got["whole", "moved"] < 1 and 0.93 < got["whole", "edits"] < 1
    assert 0.6 < got["whole", "twice"] < 0.7 and got["whole", "none"] < 0.05 and 0 < got["one", "often"] < 0.01 and 0.95 < got["whole", "blank"] < 1


def test_likeness_orders_texts(spark, sf):
    rows = merkle.fingerprint_edits(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    long = [r for r in rows if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.97 * len(long)


def test_an_insertion_moves_no_border_in_any_script(spark):
    import random

    r = random.Random(1)
    alphabets = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщ", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"}
    texts = {k: " ".join("".join(r.choice(a) for _ in range(r.randrange(2, 9))) for _ in range(300)) for k, a in alphabets.items()}
    texts["han"] = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(1500))
    texts["kana"] = "".join(chr(r.randrange(0x3041, 0x3097)) for _ in range(1500))
    texts["hangul"] = " ".join("".join(chr(r.randrange(0xAC00, 0xD7A3)) for _ in range(3)) for _ in range(300))
    texts["digits"] = "".join(r.choice("0123456789abcdef") for _ in range(4000))
    df = spark.createDataFrame([(k, t, t[:1] + "x" + t[:2] + " " + t) for k, t in texts.items()], "k string, a string, b string")
    t = df.select("k", merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"))
    got = {r.k: r.v for r in t.select("k", merkle.likeness(F.col("a"), F.col("b")).alias("v")).collect()}
    assert all(0.9 < v < 1 for v in got.values()), got


def test_one_id_for_many_rows_is_cut_into_blocks(spark, make_docs):
    texts = [f"text {i} " * 40 for i in range(400)]
    df = make_docs(*texts, ids=[5 if i < 300 else i for i in range(400)]).repartition(3)
    blocks = merkle.in_blocks(df.select("doc_id", "text").withColumn("h", F.xxhash64("text")))
    assert max(r.n for r in blocks.filter("last = 0").groupBy("block").agg(F.count("*").alias("n")).collect()) < 120
    out = merkle.fingerprint_edits(df)
    h = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((i if i >= 300 else 5, h[t], t) for i, t in enumerate(texts)))
    want = sorted((k, hashlib.sha256((t[: len(t) - len(t) // 4] + order[(n + 1) % 400][2][: len(t) // 4]).encode()).hexdigest()) for n, (k, _, t) in enumerate(order))
    assert sorted((r.doc_id, r.edited_sha256) for r in out.collect()) == want


def test_each_part_has_a_partition_of_its_own(spark):
    from lectern.llm.common import cuts_up_to, own_partitions

    for n in (1, 8, 51, 211):
        df = own_partitions(spark.range(5 * n).withColumn("p", (F.col("id") % n).cast("int")), n, F.col("p"), "key")
        rows = df.groupBy(F.spark_partition_id().alias("at")).agg(F.count_distinct("p").alias("parts"), F.count("*").alias("n")).collect()
        assert len(rows) == n and {(r.parts, r.n) for r in rows} == {(1, 5)}
    cuts = [3, 5, 5, 9]
    assert [r.k for r in spark.range(12).select(cuts_up_to(cuts, F.col("id")).alias("k")).collect()] == [sum(c <= i for c in cuts) for i in range(12)]


def test_blocks_are_alike_in_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    sizes = sorted(r.b for r in merkle.in_blocks(docs).groupBy("block").agg(F.sum(F.octet_length("text")).alias("b")).collect())
    assert len(sizes) >= 6 and sizes[-1] < 2 * sizes[len(sizes) // 2]
