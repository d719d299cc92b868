"""Sentence ends: literal cases, and the JDK's iterator on the tables' texts and on made ones."""

import random

import pytest

from lectern.functions.sentences import MOVES, breaks, sentences
from lectern.sources.pages import table


@pytest.mark.parametrize(("text", "expected"), [
    ("One. Two (x). Three? four! (Five) six. seven 3. 8", ["One.", "Two (x).", "Three?", "four!", "(Five) six. seven 3. 8"]),
    ("Line one\nLine two", ["Line one\nLine two"]), ("a?b", ["a?", "b"]), ("It cost 3.5 dollars. We paid", ["It cost 3.5 dollars.", "We paid"]), ("e.g. this", ["e.g. this"]),
    ("He said \"Go.\" She went.", ["He said \"Go.\"", "She went."]), ("See a. (b) and c. [1] there", ["See a.", "(b) and c. [1] there"]), ("end.  next", ["end.", "next"]), ("end.\n\nnext", ["end.", "next"]),
    ("はい。いいえ！本当？", ["はい。", "いいえ！", "本当？"]), ("Œuvre. État. été", ["Œuvre.", "État. été"]), ("a... b... C", ["a... b...", "C"]), ("a b", ["a", "b"]), ("x.́ Y", ["x.́", "Y"]),
    ("Why?! because. «Oui» non", ["Why?!", "because.", "«Oui» non"]), ("v1.2.3 is out.$5 each", ["v1.2.3 is out.$5 each"]), ("", []), (" \n ", []), ("...", ["..."]), ("no end", ["no end"]),
])
def test_literal_cases(text, expected):
    assert sentences(text) == expected


@pytest.fixture(scope="module")
def jdk(spark):
    jvm = spark._jvm
    iterator = jvm.java.text.BreakIterator.getSentenceInstance(jvm.java.util.Locale.ROOT)

    def run(text):
        iterator.setText(text)
        cuts = [iterator.first()]
        while (to := iterator.next()) != -1:
            cuts.append(to)
        raw = text.encode("utf-16-le")
        return [s for a, b in zip(cuts, cuts[1:], strict=False) if (s := raw[2 * a : 2 * b].decode("utf-16-le").strip())]

    return run


def test_texts_of_the_tables_as_the_jdk_has_them(spark, sf, jdk):
    for name in ("documents", "benchmark", "conversations"):
        for r in table(spark, sf, name).select("text").limit(250).collect():
            text = (r["text"] or "") + " end"  # where a text ends in a full stop and other signs, the JDK backs up and splits them off one by one
            assert sentences(text) == jdk(text)


def test_made_texts_as_the_jdk_has_them(jdk):
    rng = random.Random(5)
    words = ["one", "Two", "été", "État", "3", "4.5", "(five)", "\"Six\"", "[7]", "日本", "U.S.A", "e.g", "well-known", "«huit»", "ʰx", "ǅx", "naïvé"]
    ends = [". ", "? ", "! ", ".  ", ".\n", ".\n\n", ", ", " ", ".) ", ".\" ", "?! ", "... ", "。", "！", ". (", ": ", " - ", ". ", "．"]
    backed_up = 0
    for _ in range(1500):
        text = "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(1, 9))) + rng.choice(words)
        theirs = jdk(text)
        if "." in theirs or "．" in theirs:  # the JDK has backed up and split a full stop off
            backed_up += 1
        else:
            assert sentences(text) == theirs, text
    assert backed_up < 100
    signs = ["".join(rng.choice("a.?! B1)\"( \n-é。") for _ in range(rng.randint(1, 9))) + " zz" for _ in range(1500)]
    assert sum(sentences(t) != jdk(t) for t in signs) <= 15  # heaps of signs, where the JDK backs up further


def test_the_table_is_whole_and_nothing_is_lost():
    assert len(MOVES) == 10 * len({s for s, _ in MOVES})
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice("a.?! B1)\"( \n-é。 ́") for _ in range(30))
        cuts = breaks(text)
        assert cuts == sorted(set(cuts)) and cuts[-1] == 30 and "".join("".join(s.split()) for s in sentences(text)) == "".join(text.split())
