"""Alignment of two tokenizers against a plain version: whole texts, brute overlap of byte ranges, counts in a dictionary."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.common import read
from lectern.llm.queries import op11_align, tokenizer_path
from lectern.llm.tokenalign import Aligner, Measured, align_tokens, byte_of_letter, components, cut, measure, measured, pair_counts

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """(id, (start, end)) of both sides' tokens of a text; None where its bytes are not given back."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = byte_of_letter()

    def spans(ids, parts, text):
        if b"".join(parts) != (" " + text).encode():
            return None
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip(ids, zip([0, *ends], ends, strict=False), strict=True))

    def run(text):
        if not text:
            return None
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        x, y = spans(ia, [bytes(back[c] for c in a.id_to_token(i)) for i in ia], text), spans(ib, pb, text)
        return (x, y) if x and y else None

    return run


def links_and_groups(sides):
    x, y = sides
    links = [(i, j) for i, (s, e) in x for j, (t, f) in y if s < f and t < e]
    ends = {e for _, (_, e) in x} & {f for _, (_, f) in y}
    groups, lo = [], 0
    for hi in sorted(ends):
        groups.append(",".join(str(i) for i, (s, e) in x if lo <= s and e <= hi) + "|" + ",".join(str(j) for j, (t, f) in y if lo <= t and f <= hi))
        lo = hi
    return links, groups


def brute(rows, plain):
    found = [(k, plain(t)) for k, t in rows]
    made = [(k, sides, *(links_and_groups(sides) if sides else ([], []))) for k, sides in found]
    count = Counter(x for _, _, links, _ in made for x in links)
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for k, sides, links, groups in made:
        n_a, n_b = (len(s) for s in sides) if sides else (0, 0)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if sides else ""
        out.append((k, n_a, n_b, len(groups), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out


HARD = [
    "one two", None, "", " ", "  two  blanks  ", "tab\tand\nline \n end ", "it's <|endoftext|> <s> </s>", "x▁y not given back", "日本語のテキスト と 空白", "é ﬁ ﬀ \xa0 nbsp　wide",
    "emoji 👩‍👩‍👧 🇫🇷 end", "\x00 nul \x1c\x1d sep\x85next", "a\r\nb \r\n c", "1234567 3.14 a.b.c --- ***", "long" * 200, "one two", " lead", "trail ", "a   b​ c",
]


def test_hard_texts_and_repeated_rows(spark, make_docs, plain):
    docs = make_docs(*HARD, ids=[i + 1 for i in range(len(HARD))])
    found = sorted(tuple(r) for r in align_tokens(docs.unionByName(docs.filter("doc_id = 1")), A, B, block_links=40).collect())
    rows = [(i + 1, t) for i, t in enumerate(HARD)]
    assert found == sorted(brute([*rows, rows[0]], plain))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab .,'\n\t▁\xa0　é日\x1c\x00<s>|1👩")), min_size=1, max_size=40))
def test_any_text_is_aligned_as_a_whole(plain, text):
    known, m = Aligner_once(), Measured()
    for words in cut(text):
        m.add(known, known.look_up(words))
    counts, digest, pairs, times = m.result()
    (_, n_a, n_b, n_groups, n_links, _, _, expected), = brute([(0, text)], plain)
    assert (*counts.tolist(), digest) == (n_a, n_b, n_groups, n_links, expected)
    sides = plain(text)
    assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == (Counter(a * known.size_b + b for a, b in links_and_groups(sides)[0]) if sides else {})


_made: list[Aligner] = []


def Aligner_once():
    if not _made:
        _made.append(Aligner(A, B))
    return _made[0]


def test_long_texts_give_what_short_pieces_give(plain):
    known = Aligner_once()
    known.forget()
    long = "".join(f"wörd{i % 5000} and\n{i}  x" for i in range(60_000))
    (m,) = measure(known, [long])
    counts, digest, pairs, times = m.result()
    (x, y) = plain(long)
    ends = {e for _, (_, e) in x} & {f for _, (_, f) in y}
    assert counts.tolist() == [len(x), len(y), len(ends), len({e for _, (_, e) in x} | {f for _, (_, f) in y})] and times.sum() == counts[3]
    assert [m.result()[1] for m in measure(known, ["", "a b", long, "a b"])] == ["", *[m.result()[1] for t in ("a b", long, "a b") for m in measure(known, [t])]]
    assert digest == [m.result()[1] for m in measure(known, [long])][0]


def test_union_find_finds_components():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, n + 1))))
        near = np.eye(n, dtype=bool)
        near[a, b] = near[b, a] = True
        for _ in range(6):
            near = near @ near
        assert components(n, a, b).tolist() == near.argmax(1).tolist()
    chain = np.arange(10_000)
    assert not components(10_001, chain, chain + 1).any()


def test_query_against_brute_force(spark, sf, plain):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf, "documents").collect()]
    rows = [(k, t) for k, t in rows if len(t or "") < 4000 or k % 10 == 0]  # the plain version is quadratic
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in align_tokens(docs, A, B, block_links=3000).collect()) == sorted(brute(rows, plain))


def test_whole_query_is_the_same_whatever_the_blocks(spark, sf):
    one = sorted(tuple(r) for r in op11_align(spark, sf).collect())
    assert len(one) == read(spark, sf, "documents").count()
    assert one == sorted(tuple(r) for r in align_tokens(read(spark, sf, "documents"), A, B, block_links=500).collect())


def test_empty_table_string_ids_and_clashing_names(spark, make_docs):
    from pyspark.sql import functions as F

    docs = make_docs("a b", "a b c").withColumns({c: F.lit("clash") for c in ("block", "pair", "pairs", "count", "best", "known")})
    assert align_tokens(docs.limit(0), A, B).count() == 0
    named = docs.withColumn("doc_id", F.when(F.col("doc_id") == 0, F.lit("x")))
    assert sorted((r["doc_id"] or "", r["n_groups"], r["count_sum"]) for r in align_tokens(named, A, B).collect()) == [("", 3, 5), ("x", 2, 4)]
    counts = {(r["a"], r["b"]): (r["count"], r["best"]) for r in pair_counts(measured(docs, A, B), Aligner_once().size_b).collect()}
    assert sorted(counts.values()) == [(1, True), (2, True), (2, True)]
