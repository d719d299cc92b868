"""Spelling variants against a plain version: a dictionary of counts, all words one edit away made and looked up."""

import random
import re
import zlib
from collections import Counter

from lectern.llm.common import read
from lectern.llm.queries import op12_variants
from lectern.llm.variants import counted_words, near_pairs, variant_groups

UPPER = {c: c + 32 for c in range(65, 91)}


def plain_counts(rows, shortest=6, least=5, one_in=199):
    count = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            count[run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in count.items() if len(w) >= shortest and n >= least}


def edits(w, alphabet):
    less = {w[:i] + w[i + 1 :] for i in range(len(w))}
    other = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
    more = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
    return (less | other | more) - {w}


def plain_groups(count):
    alphabet, out, form = sorted(set("".join(count))), [], {}
    for w, n in count.items():
        near = [x for x in edits(w, alphabet) if x in count]
        best = min(near, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 5 * n else None
        out.append((w, n, len(near)))

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, k, count[form[w]] if form[w] else -1) for w, n, k in out)


def plainly(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def test_query_against_brute_force(spark, sf):
    count = plain_counts([(r["doc_id"], r["text"]) for r in read(spark, sf, "documents").collect()])
    expected = plain_groups(count)
    assert plainly(op12_variants(spark, sf)) == expected
    assert any(k for *_, k, _ in expected)


def words_of(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def near(spark, words, deep=32):
    pairs = [tuple(sorted(r)) for r in near_pairs(words_of(spark, words), deep).collect()]
    assert len(pairs) == len(set(pairs))  # each pair once
    return sorted(pairs)


def brute_pairs(words):
    have, alphabet = set(words), sorted(set("".join(words)))
    return sorted({tuple(sorted((w, x))) for w in have for x in edits(w, alphabet) if x in have})


def test_dense_vocabularies(spark):
    every = [a + b + c for a in ["", "a", "b", "aa"] for b in ["ab", "ba", "aab", "b"] for c in ["", "a", "aaa", "ba"]]
    assert near(spark, sorted(set(every))) == brute_pairs(every)
    rng = random.Random(4)
    made = sorted({"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    assert near(spark, made) == brute_pairs(made)
    # the same where most words are too long for the trie
    assert near(spark, made, 4) == brute_pairs(made)


def test_runs_ends_and_chains_of_prefixes(spark):
    chain = ["a" * k for k in range(1, 14)] + ["a" * k + "b" for k in range(1, 14)]
    assert near(spark, chain, 6) == near(spark, chain) == brute_pairs(chain)
    assert near(spark, ["lonely"]) == [] == near(spark, ["abcdef", "ghijkl"])


def test_forms_chain_to_a_root_and_ties_go_to_the_smaller(spark):
    count = {"colour": 700, "colours": 100, "coloursx": 6, "kolour": 700, "holour": 140, "zolour": 141, "lonely": 9, "garden": 50, "gardens": 50, "gardeñ": 10}
    df = variant_groups(spark.createDataFrame(list(count.items()), "word string, n long"))
    found = plainly(df)
    assert found == plain_groups(count)
    roots = {w: (f, r) for w, f, r, *_ in found}
    assert roots["coloursx"] == ("colours", "colour") and roots["holour"] == ("colour", "colour") and roots["zolour"] == ("", "zolour") and roots["gardens"] == ("", "gardens")


def test_nulls_repeats_deletions_and_clashing_names(spark, make_docs):
    from pyspark.sql import functions as F

    texts = ["Straße ÉTÉÉTÉ été-été straße naïvement naïvement NAÏVEMENT", None, "", "abcdef×ghi÷jkl " * 9, "x" * 70 + " " + "y" * 70, "x" * 69, "x" * 70, "x" * 71, "wordword " * 400]
    docs = make_docs(*[*texts, *texts, *texts, *texts, *texts], ids=[i + 1 for i in range(5 * len(texts))]).withColumns({c: F.lit("clash") for c in ("word", "n", "run", "h", "id")})
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")))
    for one_in in (199, 3):
        count = plain_counts([(r["doc_id"], r["text"]) for r in docs.collect()], one_in=one_in)
        words = counted_words(docs, drop_one_in=one_in)
        assert {r["word"]: r["n"] for r in words.collect()} == count
        assert plainly(variant_groups(words)) == plain_groups(count)
    assert counted_words(docs.limit(0)).count() == 0 == variant_groups(counted_words(docs.limit(0))).count()
