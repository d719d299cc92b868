"""Spelling variants: frequent words one edit apart, found by a self-join of the vocabulary's trie.

Words are counted over all texts. Their trie is a table of nodes, keyed by prefix and dealt over the
cluster by it, each with its children (one per letter, so their number is bounded by the alphabet). A node's
active nodes are those whose prefix is one edit away: they begin at a node where two children part (a letter replaced) or one
child is stepped over (a letter inserted), and from there on both sides go down by the same letter, round by round, for all depths at
once. Where both prefixes are words, the two are near. Below a node of a single word nothing branches: there the rest of
that word decides at once, by comparison or by a look-up of the only possible partner.
An inserted letter counts where it stands last in a run of its kind, so a pair is met once.

All of it is joins on prefixes: no group exceeds the alphabet's square, and a prefix that very many words share is only a row.
A round per depth is needed, so the trie holds words of up to ``DEEP`` letters; pairs with a longer word, which are rare, are found
by equal rests after one letter is left out.

Defined cases: a null text has no words, a null doc_id is written as an empty string in the hash that deletes letters; repeated
rows count each time; a tie of counts goes to the word that is smaller by code points; an empty table, or one without
frequent words, gives no rows; columns but doc_id and text are not read.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import spool, text_or_empty

RUN = "[A-Za-zÀ-ÿ]+"
#: letters of the longest word in the trie
DEEP = 32


def counted_words(docs: DataFrame, shortest: int = 6, least: int = 5, drop_one_in: int = 199) -> DataFrame:
    """word, n: runs of letters, A-Z in lower case, one letter less where the hash of document and run says so.

    ``docs``: (doc_id, text). Only words of ``shortest`` code points that occur ``least`` times overall.
    """
    lower = F.translate(text_or_empty(), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= shortest).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    k = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), k), F.col("run").substr(k + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _rest(word: str, prefix: Column, skip: int = 0) -> Column:
    """What of a word stands after as many letters as ``prefix`` has."""
    return F.col(word).substr(F.length(prefix) + 1 + skip, F.length(word))


def trie(words: DataFrame) -> DataFrame:
    """node, kids: the nodes below which two words or more stand, by prefix, with their children.

    A child has a letter c (empty: the node itself is a word), m words below, and the word itself if there is one only.
    """
    depth = F.explode(F.sequence(F.lit(0), F.length("word"))).alias("d")
    steps = words.select("word", depth).select("word", F.col("word").substr(F.lit(1), F.col("d")).alias("node"), F.col("word").substr(F.col("d") + 1, F.lit(1)).alias("c"))
    edges = steps.groupBy("node", "c").agg(F.count(F.lit(1)).alias("m"), F.min("word").alias("leaf"))
    kid = F.struct("c", "m", F.when(F.col("m") == 1, F.col("leaf")).alias("leaf"))
    kids = edges.groupBy("node").agg(F.collect_list(kid).alias("kids"))
    return kids.filter((F.size("kids") > 1) | (F.col("kids")[0]["m"] > 1))


def _seeds(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active pairs at the nodes where they begin: (a, leaf_a, b, leaf_b), and those that still go down by c on the second side."""
    two = nodes.select("node", F.explode("kids").alias("p"), "kids").select("node", "p", F.explode("kids").alias("q")).filter("p.c <> q.c")
    u, c, d = F.col("node"), F.col("p.c"), F.col("q.c")
    pair = lambda a, b: (a.alias("a"), F.col("p.leaf").alias("leaf_a"), b.alias("b"), F.col("q.leaf").alias("leaf_b"))
    replaced = two.filter((c < d) & (c != "")).select(*pair(F.concat(u, c), F.concat(u, d)))
    inserted = two.filter(d != "")
    # one side is the node itself, its next letter c; the other has stepped over d
    settled = F.col("p.leaf").isNotNull() | (F.col("q.leaf").isNotNull() & (F.col("q.leaf").substr(F.length(u) + 2, F.lit(1)) == c))
    at_node = inserted.filter(settled).select(*pair(u, F.concat(u, d)))
    going = inserted.filter(F.col("p.leaf").isNull() & F.col("q.leaf").isNull()).select(F.concat(u, c).alias("a"), F.concat(u, d).alias("y"), c.alias("c"))
    return replaced.unionByName(at_node), going


def _settle(pairs: DataFrame) -> DataFrame:
    """one, other, sure of pairs of nodes of which at least one has a single word; ``other`` is still to be looked up unless sure."""
    a, b = F.col("a"), F.col("b")
    both = F.col("leaf_a").isNotNull() & F.col("leaf_b").isNotNull()
    found = pairs.filter(F.col("leaf_a").isNotNull() | F.col("leaf_b").isNotNull()).filter(~both | (_rest("leaf_a", a) == _rest("leaf_b", b)))
    other = F.when(both, F.col("leaf_b")).when(F.col("leaf_a").isNotNull(), F.concat(b, _rest("leaf_a", a))).otherwise(F.concat(a, _rest("leaf_b", b)))
    return found.select(F.coalesce("leaf_a", "leaf_b").alias("one"), other.alias("other"), both.alias("sure"))


def _open(pairs: DataFrame) -> DataFrame:
    return pairs.filter("leaf_a IS NULL AND leaf_b IS NULL").select("a", "b")


def trie_pairs(words: DataFrame) -> DataFrame:
    """one, other: each pair of ``words`` (word) at distance one, once, found down the trie."""
    nodes = spool(trie(words))
    edges = spool(nodes.select("node", F.explode("kids").alias("k")).select("node", F.col("k.c").alias("c"), F.col("k.leaf").alias("leaf")))
    first, going = _seeds(nodes)
    below = edges.select(F.col("node").alias("y"), "c", F.col("leaf").alias("leaf_b"))
    stepped = going.join(below, ["y", "c"]).select("a", F.lit(None).cast("string").alias("leaf_a"), F.concat("y", "c").alias("b"), "leaf_b")
    pairs = spool(first.unionByName(stepped))
    found = [_settle(pairs)]
    while not (active := _open(pairs)).isEmpty():
        one = edges.select(F.col("node").alias("a"), "c", F.col("leaf").alias("leaf_a"))
        two = edges.select(F.col("node").alias("b"), "c", F.col("leaf").alias("leaf_b"))
        down = active.join(one, "a").join(two, ["b", "c"])
        pairs = spool(down.select(F.concat("a", "c").alias("a"), "leaf_a", F.concat("b", "c").alias("b"), "leaf_b"))
        found.append(_settle(pairs))
    every = reduce(DataFrame.unionByName, found)
    asked = every.filter("NOT sure").join(words.select(F.col("word").alias("other")), "other", "left_semi")
    return every.filter("sure").select("one", "other").unionByName(asked.select("one", "other"))


def long_pairs(words: DataFrame, deep: int = DEEP) -> DataFrame:
    """one, other: each pair of ``words`` at distance one of which at least one has more than ``deep`` letters."""
    long = words.filter(F.length("word") >= deep).select("word", F.length("word").alias("len"))
    without = lambda i: F.xxhash64(F.concat(F.col("word").substr(F.lit(1), i), F.col("word").substr(i + 2, F.col("len"))))
    less = spool(long.filter(F.col("len") > deep).select("word", "len", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("len") - 1), without)).alias("i", "h")))
    mine, theirs = less.withColumnRenamed("word", "one"), less.withColumnRenamed("word", "other")
    replaced = mine.join(theirs, ["len", "i", "h"]).filter("one < other").select("one", "other")
    inserted = long.select(F.col("word").alias("one"), (F.col("len") + 1).alias("len"), F.xxhash64("word").alias("h")).join(theirs, ["len", "h"]).select("one", "other").distinct()
    return replaced.unionByName(inserted).filter(F.levenshtein("one", "other") == 1)


def near_pairs(words: DataFrame, deep: int = DEEP) -> DataFrame:
    """one, other: each pair of ``words`` (word) that differ by one inserted, deleted or replaced code point, once."""
    return trie_pairs(words.filter(F.length("word") <= deep)).unionByName(long_pairs(words, deep))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): forms followed to the last. Each step goes to a larger count, so there is no circle."""
    tops = spool(forms.select("word", F.col("form").alias("root")))
    while True:
        up = tops.select(F.col("word").alias("root"), F.col("root").alias("top"))
        new = spool(tops.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        tops = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return tops


def variant_groups(words: DataFrame, times: int = 5, deep: int = DEEP) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of ``words`` (word, n).

    form: the near word of largest n (of equal n the smallest), if that is ``times`` the word's n; root: the last of the forms.
    """
    words = spool(words.select("word", "n"))
    pairs = spool(near_pairs(words, deep))
    both = pairs.unionByName(pairs.select(F.col("other").alias("one"), F.col("one").alias("other")))
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    near = both.join(counts, "other").groupBy(F.col("one").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    known = words.join(near, "word", "left")
    is_form = -F.col("best.minus") >= times * F.col("n")
    told = spool(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")))
    out = told.join(roots(told.filter("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
