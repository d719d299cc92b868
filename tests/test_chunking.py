import pytest

from lectern.operators import chunking
from lectern.operators.chunking import Chunker, Page, chunk_pages, default_estimate, kind_of, level_of, sentences_of

SENTENCE = "This sentence number {} talks about a topic with some plain words. "


def chunks(*texts, **k):
    return Chunker(**k).chunks([(Page(f"p{i}", i + 1), t) for i, t in enumerate(texts)])


def test_kinds():
    assert kind_of("1. Intro") == "HEADING" and level_of("2.3 Deep") == 2 and level_of("## Two") == 2 and level_of("Examples") == 2
    assert kind_of("- a\n- b") == "LIST" and kind_of("int x = 1;") == "CODE" and kind_of("plain words go here.") == "PROSE"


def test_sentences():
    assert sentences_of("One. Two (x). Three? four! (Five) six. seven 3. 8") == ["One.", "Two (x).", "Three?", "four!", "(Five) six. seven 3. 8"]
    assert sentences_of("Line one\nLine two") == ["Line one\nLine two"]


def test_sections_are_cut_without_overlap():
    out = chunks("1. First\n\nWords of one.\n\n2. Second\n\nWords of two.")
    assert [d.boundary for d in out] == ["document_start", "new_section"] and all(d.overlap == 0 for d in out)


def test_a_section_runs_over_pages():
    out = chunks("1. First\n\nWords of one.", "More words of one.")
    assert len(out) == 1 and [p.number for p in out[0].pages] == [1, 2]


def test_long_prose_overlaps_a_little():
    out = chunks("1. Topic\n\n" + "".join(SENTENCE.format(i) for i in range(30)), target=250)
    assert len(out) >= 2 and all(1 <= d.overlap <= 24 for d in out[1:]) and all(default_estimate(d.text) <= 300 for d in out[1:])
    assert all(d.boundary == "same_topic_token_limit" for d in out[1:])


def test_structural_split_repeats_the_title():
    body = "".join(SENTENCE.format(i) for i in range(14))
    out = chunks(f"1. Topic\n\n{body}\n\n1.1 Part\n\n{body}")
    assert "same_section_structural_split" in [d.boundary for d in out]
    d = next(d for d in out if d.boundary == "same_section_structural_split")
    assert d.text.startswith("1. Topic\n\n1.1 Part") and 1 <= d.overlap <= 24


def test_code_and_lists_are_cut_between_lines():
    code = "\n".join(f"int value{i} = compute(alpha, {i});" for i in range(120))
    assert all(line.endswith(";") for d in chunks(code) for line in d.text.splitlines() if line)
    items = "\n".join(f"- item number {i} says a few words" for i in range(90))
    assert all(line.startswith("- item") for d in chunks(items) for line in d.text.splitlines() if line)


def test_one_huge_word_is_cut_by_tokens():
    out = chunks("x" * 5000)
    assert "".join(d.text for d in out).count("x") >= 5000 and all(d.tokens <= 300 for d in out)


def test_too_many_chunks():
    with pytest.raises(ValueError):
        chunks(*[f"# Title {i}\n\nwords" for i in range(6)], max_chunks=5)


def test_metadata(spark):
    rows = [("d", 1, "d:1", "1. First\n\nWords of one.\n\n2. Second\n\nWords of two.", 50, 40), ("d", 2, "d:2", "More of two.", 12, 12), ("e", 1, "e:1", "", 0, 0)]
    df = spark.createDataFrame(rows, "document_key string, page_number int, page_id string, text string, source_original_character_count int, source_cleaned_character_count int")
    a, b = chunk_pages(df).orderBy("chunk_index").collect()
    assert (a.section_title, b.section_title) == ("1. First", "2. Second") and b.page_numbers == [1, 2] and b.spans_pages
    assert (a.page_chunk_index, b.page_chunk_index, b.page_chunk_count) == (0, 1, 2) and b.starts_new_topic and b.source_original_character_count == 62
    assert b.heading_path == ["2. Second"] and not b.continues_from_previous_page


def test_ingestion_fingerprint_is_that_of_the_chunk_texts(spark):
    from lectern.operators.identity import ingestion_fingerprints
    from lectern.streaming.ingest import ingest

    df = spark.createDataFrame([("d", 1, "d:1", "1. A\n\nWords é.\n\n2. B\n\nMore.", "f"), ("e", 1, "e:1", "Plain.", "f")], "document_key string, page_number int, page_id string, text string, file_name string")
    chunks = ingest(df)
    want = {r.document_fingerprint: r.ingestion_fingerprint for r in ingestion_fingerprints(chunks.drop("ingestion_fingerprint")).collect()}
    assert {r.document_id: r.ingestion_fingerprint for r in chunks.collect()} == want


def test_a_refused_document_keeps_no_other_back(spark):
    from lectern.operators.chunking import drafts, refused_documents

    rows = [("long", 1, "l:1", "\n\n".join(f"# Title {i}\n\nwords" for i in range(9)), 0, 0), ("short", 1, "s:1", "Plain words.", 0, 0)]
    df = spark.createDataFrame(rows, "document_key string, page_number int, page_id string, text string, source_original_character_count int, source_cleaned_character_count int")
    assert [(r.document_key, r.problem) for r in refused_documents(df, max_chunks=5).collect()] == [("long", "document has 9 chunks, more than 5")]
    assert [r.text for r in drafts(df, max_chunks=5).filter("problem IS NULL").collect()] == ["Plain words."]


def test_a_table_keeps_all_chunks_of_a_long_document(spark):
    from lectern.functions.patterns import MAX_CHUNKS
    from lectern.streaming.ingest import PAGES, ingest

    n = MAX_CHUNKS + 5
    rows = [("long", 1, "l:1", "\n".join(f"# Title {i}\nwords" for i in range(n)), "f"), ("short", 1, "s:1", "Plain words.", "f")]
    chunks = ingest(spark.createDataFrame(rows, PAGES))
    found = sorted((r.document_id, r.chunk_index, r.text) for r in chunks.collect())
    assert found == [*(("long", i, f"# Title {i}\n\nwords") for i in range(n)), ("short", 0, "Plain words.")]
    assert [r.document_id for r in ingest(spark.createDataFrame(rows, PAGES), max_chunks=MAX_CHUNKS).collect()] == ["short"]


def test_counts_that_add_up_and_those_that_dont_give_the_same_chunks():
    text = "1. Topic\n\n" + "".join(SENTENCE.format(i) for i in range(40)) + "\n\n- a\n- b c\n\n" + "y" * 3000 + "; " + "z" * 3000
    assert chunks(text) == chunks(text, estimate=lambda t: default_estimate(t))


def test_a_byte_pair_vocabulary_counts_tokens(tmp_path):
    import base64

    from lectern.operators.chunking import bpe_estimate

    words = [bytes([i]) for i in range(256)] + [b"th", b"the", b" t", b" th", b" the"]
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(w) + b" %d" % i for i, w in enumerate(words)))
    estimate = bpe_estimate(str(path), r" ?\w+|[^\w\s]|\s")
    assert estimate("the the, x") == 5 and not getattr(estimate, "additive", False)
    assert all(d.tokens == estimate(d.text) for d in chunks("the the the. " * 50, estimate=estimate, target=20, limit=30, preferred=5, overlap_limit=0))


def test_pieces_are_counted_as_the_pattern_has_them_and_latin_texts_without_it(monkeypatch):
    import random

    r, pattern = random.Random(5), chunking._TOKEN
    plain = lambda t: len(pattern.findall(t))
    latin = ["".join(r.choices([chr(c) for c in range(256)] + list("abcdeéß 12") * 20, k=r.randrange(80))) for _ in range(3000)]
    assert all(chunking.default_estimate(t) == plain(t) for t in [*map(chr, range(256)), *latin])
    other = [t + r.choice("’漢Ж٣ ") + t[::-1] for t in latin[:500]]
    assert all(chunking.default_estimate(t) == plain(t) for t in other)

    class Never:
        def findall(self, text):
            raise AssertionError("taken apart")

    monkeypatch.setattr(chunking, "_TOKEN", Never())
    assert chunking.default_estimate("Grüße an 12345 words.") == 8
