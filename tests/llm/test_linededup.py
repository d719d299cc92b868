import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lectern.llm.linededup import dedup_lines

PASSAGE = "\n".join(f"shared line {i} of the passage" for i in range(6))
LONG = " ".join(f"w{i}" for i in range(60))


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_passages_go_but_their_first_place(spark, make_docs):
    out = texts(dedup_lines(make_docs(f"a one\n{PASSAGE}\na two", f"b one\nb two\n{PASSAGE}", f"{PASSAGE}\nc one", "shared line 0 of the passage\nd one")))
    assert out == {0: f"a one\n{PASSAGE}\na two", 1: "b one\nb two", 2: "c one", 3: "shared line 0 of the passage\nd one"}


def test_one_long_line_is_a_passage_a_short_one_is_not(spark, make_docs):
    out = texts(dedup_lines(make_docs(f"x\n{LONG}\ny", f"p\n{LONG}\nq", "x\nq q")))
    assert out == {0: f"x\n{LONG}\ny", 1: "p\nq", 2: "x\nq q"}


def test_borders_do_not_shift(spark, make_docs):
    lines = [f"line {i} says {i * 7}" for i in range(300)]
    out = texts(dedup_lines(make_docs("\n".join(lines), "new start\n" + "\n".join(lines[10:250]) + "\nnew end")))
    assert out[0] == "\n".join(lines) and out[1] == "new start\nnew end"


def test_nulls_empties_copies_repeats_and_clashes(spark, make_docs):
    df = make_docs(None, "", PASSAGE, PASSAGE, PASSAGE, ids=[1, 2, 3, 3, 4]).withColumn("h", F.lit(1)).withColumn("lines", F.lit("x")).withColumn("gone", F.lit(2))
    out = dedup_lines(df)
    rows = sorted((r.doc_id, r.text) for r in out.filter("doc_id > 1").collect())
    assert rows == [(2, ""), (3, PASSAGE), (3, PASSAGE), (4, "")]  # equal rows are one document
    assert out.filter("doc_id = 1").first().text is None and out.columns[: len(df.columns)] == df.columns
    assert dedup_lines(df.limit(0)).count() == 0


def test_against_brute_force(spark, sf):
    """What is removed stands, line for line, in what is kept elsewhere; documents without repeats are untouched."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, out = texts(docs), dedup_lines(docs).collect()
    kept = "\n".join(r.text for r in out) + "\n"
    counts = {}
    for t in before.values():
        for line in set(t.split("\n")):
            counts[line] = counts.get(line, 0) + 1
    for r in out:
        old = before[r.doc_id].split("\n")
        if all(counts[x] == 1 for x in old) and len(set(old)) == len(old):
            assert r.text == before[r.doc_id]
        left = r.text.split("\n") if r.text or len(old) > r.n_removed_lines else []
        assert len(left) == len(old) - r.n_removed_lines
        for x in set(old) - set(left):
            assert x + "\n" in kept


def runs_left(out, words):
    """(document, first line) of each run of whole lines of so many words that stands in an earlier kept place, blank lines passed over."""
    seen, found = set(), []
    for d in sorted(out):
        lines = [x for x in (out[d] or "").split("\n") if x.split()]
        for i in range(len(lines)):
            n, j = 0, i
            while j < len(lines) and n < words:
                n += len(lines[j].split())
                j += 1
            if n >= words:
                if tuple(lines[i:j]) in seen:
                    found.append((d, i))
                seen.add(tuple(lines[i:j]))
    return found


def test_every_run_of_whole_lines_goes(spark, make_docs):
    """Blank lines, counts that differ, chance cuts and neighbours that are repeated too do not keep a run."""
    r = random.Random(5)
    lines = [" ".join(f"v{k}n{i}" for i in range(r.randrange(9, 30))) for k in range(60)]
    docs = ["\n".join(lines)]
    for k in range(25):
        a = r.randrange(50)
        part = [x for y in lines[a : a + r.randrange(4, 9)] for x in ([y, ""] if r.random() < 0.4 else [y])]
        docs.append("\n".join([f"own start {k}", *part, lines[r.randrange(60)], f"own end {k}"]))
    docs += [lines[k] for k in range(0, 60, 3) for _ in range(3)]
    before = dict(enumerate(docs))
    out = texts(dedup_lines(make_docs(*docs)))
    assert runs_left(before, 50) and not runs_left(out, 50)
    assert out[0] == docs[0] and all(out[k].startswith("own start") and out[k].endswith(f"own end {k - 1}") for k in range(1, 26))


def plain_dedup(rows, long_line=50, cut_every=(16, 4)):
    """(id, text) rows -> kept texts by the rules, in plain Python."""
    import xxhash

    signed = lambda v: v - (1 << 64) if v >> 63 else v
    of = lambda v, seed=42: xxhash.xxh64(v if isinstance(v, bytes) else (v & (1 << 64) - 1).to_bytes(8, "little"), seed=seed).intdigest()
    place = lambda i, t: (i is not None, i or 0, signed(of((t or "").encode())))
    lines = {r: (r[1] or "").split("\n") for r in rows}
    count = Counter(x for r in rows for x in lines[r] if x.strip(" "))
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    chunks, runs, gone = {}, {}, {r: set() for r in rows}
    for r in sorted(set(rows), key=lambda r: place(*r)):
        numbered = [(i, x) for i, x in enumerate(lines[r]) if x.strip(" ")]
        met = [(o, i, x) for o, (i, x) in enumerate(numbered) if count[x] > 1]
        for rate in cut_every:
            held = []
            for k, (_, i, x) in enumerate(met):
                cut = k == 0
                if k:
                    _, j, w = met[k - 1]
                    two = signed(of(of(x.encode()), of(of(w.encode()))))
                    cut = i != j + 1 or max(words(x), words(w)) >= long_line or two % rate == 0
                held = held + [[]] if cut else held
                held[-1].append((i, x))
            for c in held:
                if len(c) > 1 or words(c[0][1]) >= long_line:
                    chunks.setdefault(tuple(x for _, x in c), []).append((r, [i for i, _ in c]))
        for k in range(len(met)):
            for step in (1, -1):
                n, j, found = 0, k, []
                while 0 <= j < len(met) and n < long_line and (not found or met[j][0] == found[-1][0] + step):
                    n += max(1, words(met[j][2]))
                    found.append(met[j])
                    j += step
                if n >= long_line:
                    found = found[::step]
                    runs.setdefault(tuple(x for *_, x in found), []).append((r, range(found[0][1], found[-1][1] + 1)))
    for places in [*chunks.values(), *runs.values()]:
        first = min(places, key=lambda p: (place(*p[0]), p[1][0]))
        for r, at in places:
            if (place(*r), at[0]) > (place(*first[0]), first[1][0]):
                gone[r].update(at)
    return {r: None if r[1] is None else "\n".join(x for i, x in enumerate(lines[r]) if i not in gone[r]) for r in rows}


def test_exactly_the_lines_of_the_plain_version_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_dedup([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert got == {i: t for (i, _), t in want.items()}


def test_the_plain_version_agrees_on_hard_cases(spark, make_docs):
    r = random.Random(8)
    pool = [" ".join(f"q{k}x{i}" for i in range(r.choice([1, 2, 5, 12, 30, 60]))) for k in range(40)] + ["", " ", "solo"]
    texts = ["\n".join(r.choice(pool) if r.random() < 0.3 else pool[(s + i) % len(pool)] for i in range(r.randrange(1, 30))) for s in (r.randrange(43) for _ in range(60))] + [None, "", "a\nb"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5])]
    want = plain_dedup(rows)
    got = {(x.doc_id, x.before): x.text for x in dedup_lines(make_docs(*[t for _, t in rows], ids=[i for i, _ in rows]).withColumn("before", F.col("text"))).collect()}
    assert got == want


def test_a_passage_goes_whatever_its_lines_counts(spark, make_docs):
    """Three lines that two documents share, the middle one of which stands in six others."""
    three = ["\n".join(" ".join(f"{a}{i}" for i in range(8)) for a in "pqr")] * 2
    docs = [f"own {k}\n{t}\nend {k}" for k, t in enumerate(three)] + [f"other {k}\n" + three[0].split("\n")[1] + f"\nlast {k}" for k in range(6)]
    out = texts(dedup_lines(make_docs(*docs)))
    assert out[0] == docs[0] and out[1] == "own 1\nend 1" and all(out[k] == docs[k] for k in range(2, 8))


def test_lines_of_one_hash_and_other_bytes_are_found(spark, monkeypatch):
    """With a hash of lengths only, lines of one length meet; runs with such lines stay."""
    from lectern.llm import linededup

    docs = spark.createDataFrame([(1, 1, "a\nbb\nccc\nbb"), (2, 2, "dddd\nbb\nxyz")], "d int, h int, text string")
    places = spark.createDataFrame([(1, 1, 1, 3), (2, 2, 0, 3)], "d int, h int, start int, n_lines int")
    assert linededup.differing(places, docs).count() == 0
    real = F.xxhash64
    monkeypatch.setattr(linededup.F, "xxhash64", lambda *c: real(F.length(c[-1])))
    assert linededup.differing(places, docs).count() == 1


def test_own_results_win_over_columns_of_their_names(spark, make_docs):
    out = dedup_lines(make_docs(PASSAGE, PASSAGE).withColumn("n_removed_chunks", F.lit("mine")).withColumn("n_lines", F.lit(None)))
    assert sorted((r.doc_id, r.n_lines, r.n_removed_chunks) for r in out.collect()) == [(0, 6, 0), (1, 6, 1)]
