"""Token files: exact round trips against a plain version, Elias-Fano against the numbers themselves."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.common import read
from lectern.llm.queries import op13_token_files, tokenizer_path
from lectern.llm.tokenfile import EliasFano, block_bytes, new_path, read_blocks, read_token_files, write_token_files


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**64 - 1)), max_size=200))
def test_elias_fano_gives_back_the_numbers(numbers):
    numbers = sorted(numbers)
    fano = EliasFano.from_bytes(EliasFano.encode(np.array(numbers, np.uint64)).to_bytes())
    assert [int(x) for x in fano.values()] == numbers
    assert [fano.select(i) for i in range(len(numbers))] == numbers


def test_elias_fano_is_small_and_checks_its_range():
    ends = np.cumsum(np.random.default_rng(5).integers(1, 1000, 10_000))
    fano = EliasFano.encode(ends)
    # 2 + log2(u / n) bits a number, half a bit for the kept places
    assert 8 * len(fano.to_bytes()) / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 1
    with pytest.raises(IndexError):
        fano.select(10_000)
    with pytest.raises(ValueError):
        next(read_blocks(bytes(60)))


def test_blocks_give_back_documents():
    ids = np.arange(10, dtype="<u2")
    raw = block_bytes(ids.tobytes(), 2, [3, 3, 10], [-5, 7, None], False) + b"\n" + block_bytes(b"\x0a\x00" * 4, 2, [], [], True) + b"\n"
    one, two = read_blocks(raw)
    assert [one.document(i).tolist() for i in range(3)] == [[0, 1, 2], [], [3, 4, 5, 6, 7, 8, 9]]
    assert [one.doc_id(i) for i in range(3)] == [-5, 7, None] and not one.open
    assert two.ids.tolist() == [10] * 4 and two.ends.n == 0 and two.open


def plain(rows):
    """doc_id, start, n_tokens, ids_crc32 of (doc_id, text) in ascending order, straight from the tokenizer."""
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(tokenizer_path()), 0, []
    tokenizer.encode_special_tokens = True
    for k, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_gives_what_the_tokenizer_gives(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in read(spark, sf, "documents").collect())
    found = op13_token_files(spark, sf).orderBy("doc_id").collect()
    assert [tuple(r)[:4] for r in found] == plain(rows)


def test_nulls_ties_long_texts_and_small_blocks(spark, make_docs):
    long = " ".join(f"word{i} Ünïcode" for i in range(3000))
    docs = make_docs("a b", None, "", long, "tie", "tie", "other", "<|endoftext|> x", ids=[5, -3, 2**62, 9, 7, 7, 7, None]).withColumn("file", docs_extra()).withColumn("value", docs_extra())
    path = new_path(spark)
    write_token_files(docs, path, tokenizer_path(), file_bytes=20_000, block_ids=1000)
    found = sorted((tuple(r)[:4] for r in read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [-3, 5, 7, 7, 7, 9, 2**62, None]
    texts = {-3: None, 5: "a b", 9: long, 2**62: "", None: "<|endoftext|> x"}
    crc = {t: plain([(0, t)])[0][3] for t in ("tie", "other")}
    tied = [next(t for t in crc if crc[t] == r[3]) for r in found if r[0] == 7]
    assert sorted(tied) == ["other", "tie", "tie"] and tied != ["tie", "other", "tie"]
    assert found == plain([(r[0], tied.pop(0) if r[0] == 7 else texts[r[0]]) for r in found])
    assert max(sum(1 for _ in read_blocks(f["content"])) for f in spark.read.format("binaryFile").load(path).collect()) > 5  # the long text takes several blocks


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_empty_table_and_wrong_ids(spark, make_docs):
    from pyspark.sql import functions as F

    path = new_path(spark)
    write_token_files(make_docs("x").limit(0), path, tokenizer_path())
    assert read_token_files(spark, path).count() == 0
    with pytest.raises(TypeError):
        write_token_files(make_docs("x").withColumn("doc_id", F.lit("s")), path, tokenizer_path())
