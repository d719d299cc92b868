import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lectern.llm import stages
from lectern.llm.packing import Limits, WordCache, halve_open, pack, place
from lectern.llm.queries import tokenizer_path

LIMITS = Limits(tokens=64, segments=5, loss=40)


def check(tokens, share, limits):
    pieces = place(tokens, share, limits)
    covered = {}
    for i, s, n, b, o in sorted(pieces):
        assert n > 0 and s == covered.get(i, 0)
        covered[i] = s + n
    assert [covered.get(i, 0) for i in range(len(tokens))] == tokens.tolist()
    bins = {}
    for i, s, n, b, o in pieces:
        bins.setdefault(b, []).append((o, n, i))
    for v in bins.values():
        v.sort()
        assert [o for o, _, _ in v] == np.concatenate([[0], np.cumsum([n for _, n, _ in v])[:-1]]).tolist()
        assert sum(n for _, n, _ in v) <= limits.tokens and len(v) <= limits.segments
        assert sum(int(np.ceil(n * share[i])) for _, n, i in v) <= limits.loss + len(v)
    return bins


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.sampled_from([0.0, 0.25, 0.5, 1.0])), min_size=0, max_size=40))
def test_three_limits_hold_and_every_token_has_one_place(items):
    check(np.array([t for t, _ in items], np.int64), np.array([s for _, s in items]), LIMITS)


def test_no_padding_where_only_tokens_limit():
    r = np.random.default_rng(1)
    bins = check(r.integers(1, 9000, 400), np.ones(400), Limits())
    fill = [sum(n for _, n, _ in v) for v in bins.values()]
    assert all(f & (f - 1) == 0 for f in fill)


def test_words_agree_with_the_tokenizer():
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    texts = ["", "It's ÉTÉ, naïve—don't!! x\x1cy\x85z w", "<|endoftext|> </w> ##a", "漢字 é ﬁ Ǆ İ ß", "a" * 5000, "Word, word. WORD! word's 12ab"]
    c = WordCache(tokenizer_path(), room=3)
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("group", [50, 1 << 21])
def test_rows(spark, make_docs, group):
    texts = [None, "", "one two three", "one two three", "word " * 9000, "tail"]
    rows = pack(make_docs(*texts, ids=[1, 2, 3, 3, None, 5]), tokenizer_path(), group_tokens=group).collect()
    t = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in zip([1, 2, 3, None, 5], [None, "", "one two three", "word " * 9000, "tail"])}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, ids.values())) + len(ids[3])
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in at.values())
    assert pack(make_docs("x").limit(0), tokenizer_path()).count() == 0


def plain_place(tokens, share, limits):
    """The same greedy rule document by document: the largest dot product, then the smaller needs, then the lower index."""
    caps = (limits.tokens, limits.segments, limits.loss)
    left, start, bins, out = [int(t) for t in tokens], [0] * len(tokens), 0, []
    need = lambda i: int(np.ceil(left[i] * share[i]))
    for i in range(len(left)):
        whole = max(1, int(min(limits.tokens, np.floor(limits.loss / max(share[i], 1e-9)) if share[i] > 0 else limits.tokens)))
        while left[i] >= whole:
            out.append((i, start[i], whole, bins, 0))
            left[i], start[i], bins = left[i] - whole, start[i] + whole, bins + 1
    open_, back = [i for i in range(len(left)) if left[i]], 0
    order = {i: i for i in open_}  # a cut document goes to the front of its equals
    while open_:
        room, offset = [limits.tokens, limits.segments, limits.loss], 0
        while open_ and min(room) > 0:
            fits = [i for i in open_ if left[i] <= room[0] and need(i) <= room[2]]
            if fits:
                score = lambda i: left[i] / caps[0] * room[0] / caps[0] + 1 / caps[1] * room[1] / caps[1] + need(i) / caps[2] * room[2] / caps[2]  # noqa: B023, E731
                best = max(score(i) for i in fits)
                i = min((i for i in fits if score(i) >= best - 1e-12), key=lambda i: (left[i], need(i), order[i]))
                length = left[i]
            else:
                i = min((i for i in open_ if (left[i], need(i)) == max((left[j], need(j)) for j in open_)), key=lambda i: order[i])
                length = int(min(room[0], left[i], np.floor(room[2] / share[i]) if share[i] > 0 else room[0]))
                if length < 1:
                    break
            out.append((i, start[i], length, bins, offset))
            loss = int(np.ceil(length * share[i]))
            left[i], start[i], offset = left[i] - length, start[i] + length, offset + length
            room = [room[0] - length, room[1] - 1, room[2] - loss]
            if left[i]:
                back -= 1
                order[i] = back
            else:
                open_.remove(i)
        bins += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 150), st.sampled_from([0.0, 0.5, 1.0])), min_size=0, max_size=30))
def test_placement_is_that_of_the_plain_greedy_rule(items):
    tokens, share = np.array([t for t, _ in items], np.int64), np.array([s for _, s in items])
    fill = lambda pieces: sorted(pieces)
    assert fill(place(tokens, share, LIMITS)) == fill(halve_open(plain_place(tokens, share, LIMITS), LIMITS))


def cased(tmp_path, lower):
    from tokenizers import models, normalizers, pre_tokenizers

    vocabulary = {c: i for i, c in enumerate("abAB,")} | {c + "</w>": 10 + i for i, c in enumerate("abAB,")} | {"<unk>": 30}
    t = Tokenizer(models.BPE(vocab=vocabulary, merges=[], unk_token="<unk>", end_of_word_suffix="</w>"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    if lower:
        t.normalizer = normalizers.Lowercase()
    path = str(tmp_path / f"{lower}.json")
    t.save(path)
    return path


@pytest.mark.parametrize("lower", [True, False])
def test_a_vocabulary_with_cases_keeps_them(tmp_path, lower):
    path = cased(tmp_path, lower)
    t = Tokenizer.from_file(path)
    c = WordCache(path)
    texts = ["Ab bA, AB", "ab"]
    assert c.by_letters == lower
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_a_very_long_text_in_pieces(monkeypatch):
    from lectern.llm import packing

    monkeypatch.setattr(packing, "PIECE", 50)
    text = "Some words, and É漢字 more\n" * 100
    t = Tokenizer.from_file(tokenizer_path())
    assert np.frombuffer(WordCache(tokenizer_path()).encode([text, "x"])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_the_stage_knows_fewer_words_and_packs_the_same_rows(spark, make_docs, sf, monkeypatch):
    docs = make_docs(*[" ".join(f"{chr(97 + i)}{chr(97 + k % 26)}{chr(97 + k // 26)}, word" for k in range(i, i + 300)) for i in range(20)])
    rows = lambda df: sorted(df.collect())
    asked = []
    monkeypatch.setattr(stages, "pack", lambda *a, **k: asked.append(k["known"]) or pack(*a, **k))
    assert rows(stages.pack_tokens(spark, docs, sf)) == rows(pack(docs, tokenizer_path())) == rows(pack(docs, tokenizer_path(), known=50))
    assert asked == [stages.PACK_KNOWN] and stages.PACK_KNOWN <= 50_000
    cache = WordCache(tokenizer_path(), 100)
    for i in range(0, 20_000, 50):
        cache.encode([" ".join("w" + "".join(chr(97 + int(c)) for c in str(k)) for k in range(i, i + 50))])
    assert max(len(cache.new), len(cache.old)) <= 150 and max(len(cache.cores), len(cache.past)) <= 300 + 50
