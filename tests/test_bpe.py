"""Own byte-pair counts against a tokenizer library's, on the tables' texts and on made ones; chunks counted by them."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions import bpe
from lectern.operators import chunking, cleaning
from lectern.sources.pages import paged, table

vocabularies = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def library(name):
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.read_ranks(vocabularies.path(name)), special_tokens={})


@pytest.mark.parametrize("name", FILES)
def test_counts_of_all_documents(spark, sf, name):
    encoding, count = library(name), bpe.estimate(vocabularies.path(name), vocabularies.PATTERN)
    for r in table(spark, sf, "documents").select("text").collect():
        assert count(r["text"] or "") == len(encoding.encode_ordinary(r["text"] or ""))


_encoding = []


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(st.sampled_from("aab =-\n日é'st"), max_size=200)))
def test_counts_of_any_text(text):
    if not _encoding:
        _encoding.append(library(FILES[0]))
    text = text.encode("utf-8", "replace").decode()
    assert bpe.counter(vocabularies.path(FILES[0]), vocabularies.PATTERN)(text) == len(_encoding[0].encode_ordinary(text))


def test_very_long_words_and_forgotten_ones(monkeypatch):
    ranks = bpe.read_ranks(vocabularies.path(FILES[0]))
    encoding = library(FILES[0])
    for word in ("=" * 50_000, "ab" * 20_000, "aaab" * 5000):
        assert bpe.merged(word.encode(), ranks) == len(encoding.encode_ordinary(word))
    assert bpe.merged(b"", ranks) == 0 and bpe.merged(b"\xff", {}) == 1 and bpe.merged(b"abc", {}) == 3
    monkeypatch.setattr(bpe, "KNOWN", 3)
    count = bpe.Counter(ranks, vocabularies.PATTERN)
    texts = ["one two three four five", "two six", "one seven eight nine ten", "one"]
    assert [count(t) for t in texts * 2] == [len(encoding.encode_ordinary(t)) for t in texts * 2] and len(count.new) + len(count.old) < 15


def test_chunks_counted_by_a_vocabulary(spark, sf):
    """Each chunk's counts are the vocabulary's; no chunk passes the limit but for one that cannot be cut; no text is lost."""
    path = vocabularies.path(FILES[0])
    cleaned = cleaning.clean_pages(paged(table(spark, sf, "documents").limit(60)))
    rows = chunking.chunk_pages(cleaned, chunking.bpe_estimate(path, vocabularies.PATTERN)).select("document_key", "chunk_index", "text", "content_token_count", "estimated_token_count", "overlap_token_count").collect()
    count = bpe.counter(path, vocabularies.PATTERN)
    assert rows and all(r["estimated_token_count"] == count(r["text"]) for r in rows)
    assert all(r["content_token_count"] <= 300 for r in rows)
    words = lambda texts: sum(len("".join(t.split())) for t in texts)
    kept = words(r["text"] for r in rows if not r["overlap_token_count"])
    whole = words(r["text"] for r in cleaned.select("text").collect())
    assert kept <= whole <= words(r["text"] for r in rows)
