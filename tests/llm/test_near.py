import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import omh
from lectern.llm.omh import aligned_similarity, components, labelled_shingles, near_classes


def brute_classes(texts):
    """ids -> classes, by aligning every pair that shares a shingle."""
    label, count, _ = labelled_shingles(texts)
    parts = np.split(label, np.cumsum(count)[:-1])
    held = defaultdict(list)
    for i, p in enumerate(parts):
        for x in p.tolist():
            held[x].append(i)
    shared = Counter((a, b) for v in held.values() for k, b in enumerate(v) for a in v[:k])
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (shared[(j, i)] and aligned_similarity(parts[j], parts[i], 0.8) >= 0.8):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in range(len(texts))}


def edited(words, n, r):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.random()}"
    return " ".join(w)


def test_against_brute_force(spark, make_docs):
    r = random.Random(4)
    texts = []
    for g in range(12):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(r.choice([6, 60, 300]))]
        texts += [" ".join(base)] + [edited(base, r.choice([0, 1, 2, 3, 8, 40]), r) for _ in range(9)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{k}x{i}" for i in range(60)) for k in range(20)]
    texts += ["", "", None, "one", "One", "two words", "the the the the the the the"] + ["same words over again here now"] * 40
    got = {x.doc_id: x.class_id for x in near_classes(make_docs(*texts).withColumn("node", F.lit(1))).collect()}
    assert got == brute_classes([t or "" for t in texts])


def test_alignment_keeps_the_order():
    x = np.arange(1, 101).astype(np.uint64)
    assert aligned_similarity(x, x, 0.8) == 1.0
    assert aligned_similarity(x, np.concatenate([x[50:], x[:50]]), 0.8) < 0.8
    assert abs(aligned_similarity(x, np.concatenate([x[:40], x[45:]]), 0.8) - 0.95) < 1e-9


def test_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200)], "a long, b long")
    out = {r.node: r["class"] for r in components(links).collect()}
    assert set(out[i] for i in range(61)) == {0} and out[200] == 100


def test_nulls_repeats_and_empty(spark, make_docs):
    """Texts are compared, whatever their ids: null ids come last in a class, repeated rows are one document."""
    df = make_docs("a b c d e f g", "a b c d e f g", "a b c d e f g", None, ids=[7, 7, None, 3])
    rows = near_classes(df).collect()
    assert len(rows) == 4 and {(r.class_id, r.class_size) for r in rows if r.doc_id != 3} == {(7, 3)}
    assert [r.doc_id for r in rows if r.kept and r.class_id == 7] == [7]
    assert near_classes(df.limit(0)).count() == 0
    alone = near_classes(make_docs("", "x y", "x y", ids=[None, None, None])).collect()
    assert all(r.class_id is None for r in alone) and sorted((r.class_size, r.kept) for r in alone) == [(1, True), (2, False), (2, True)]


def test_one_id_with_different_texts(spark, make_docs):
    one, two = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = near_classes(make_docs(one, two, two + " more", ids=[5, 5, 9])).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size, r.kept) for r in rows) == [(5, 5, 1, True), (5, 5, 2, True), (9, 5, 2, False)]


def test_a_very_long_text_is_hashed_in_pieces(monkeypatch):
    texts = ["word%d " % i * 3 + "\n" for i in range(50)]
    texts.append(" ".join(texts))
    whole = labelled_shingles(texts)
    monkeypatch.setattr(omh, "BLOCK", 16)
    assert all((x == y).all() for x, y in zip(whole, labelled_shingles(texts)))


def family(size, planted, r):
    """Texts of one template, pairwise below 0.8 but for the planted pairs (2 i, 2 i + 1), and their words changed."""
    base = [f"w{i}" for i in range(800)]
    out = []
    for k in range(size):
        first = k % 2 and k < 2 * planted
        places = r.sample(range(800), 11)
        changed = {p: f"x{k}y{p}" for p in places}
        if first:
            changed = dict(list(out[-1].items())[:3] + list(changed.items())[:8])
        out.append(changed)
    return [" ".join(c.get(i, w) for i, w in enumerate(base)) for c in out]


def all_pairs_classes(texts):
    label, count, _ = labelled_shingles(texts)
    parts = np.split(label, np.cumsum(count)[:-1])
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if up[i] != up[j] and aligned_similarity(parts[j], parts[i], 0.8) >= 0.8:
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    return dict(enumerate(up))


def test_links_among_many_look_alikes(spark, make_docs):
    texts = family(400, 80, random.Random(7))
    want = all_pairs_classes(texts)
    assert len(set(want.values())) < 400
    assert {x.doc_id: x.class_id for x in near_classes(make_docs(*texts)).collect()} == want


def test_large_buckets_keep_their_pairs(spark, make_docs, monkeypatch):
    """A bucket over any limit by size loses no pair: all tables here are dealt in many blocks."""
    monkeypatch.setattr(omh, "HOT", 2, raising=False)
    monkeypatch.setattr(omh, "ROWS", 24, raising=False)
    texts = family(400, 150, random.Random(11))
    want = all_pairs_classes(texts)
    assert {x.doc_id: x.class_id for x in near_classes(make_docs(*texts)).collect()} == want


def test_link_with_a_poor_sketch(spark, make_docs):
    """Similarity 0.801, estimated as 0.710 by the sketches."""
    base = [f"w{i}" for i in range(909)]
    places = {5 * p: f"x{p}" for p in random.Random(6587).sample(range(180), 20)}
    df = make_docs(" ".join(base), " ".join(places.get(i, w) for i, w in enumerate(base)))
    assert {r.class_id for r in near_classes(df).collect()} == {0}


def test_recall_on_a_table(spark):
    """Every pair of sf0.01 over the threshold, found by brute force, is in one class, and no other is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    want = brute_classes([r.text or "" for r in rows])
    ids = [r.doc_id for r in rows]
    assert {x.doc_id: x.class_id for x in near_classes(docs).collect()} == {ids[k]: ids[v] for k, v in want.items()}
