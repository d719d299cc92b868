import zlib

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import quality as Q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = Q.score_quality(docs, Q.fit_quality(docs, labels)).join(labels, "doc_id").toPandas()
    assert (scored.held_out == scored.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    out = scored[scored.held_out]
    assert ((out.predicted == 1) == (out.quality == 1)).mean() > 0.9
    assert (out[out.quality == 1].predicted == 1).mean() > 0.97


def test_batches_and_single_texts_agree():
    n = Q.Network()
    texts = ["", "x", "a" * 127, "a" * 128, "a" * 129, "é" * 400, "word " * 100_000, "b" * 256]
    one = [n.score([t])[0] for t in texts]
    n.prepare()
    direct = [n._combine(n.logits(*n.chunks(*n.pooled(t.encode())[:2]))[0]) for t in texts]
    assert np.allclose(n.score(texts), one) and np.allclose(direct, one)


def test_the_whole_text_counts():
    n = Q.Network().fit(["good words here " * 20, "bad!! BAD!! " * 20] * 30, np.array([1.0, 0.0] * 30), epochs=3)
    clean = "good words here " * 50_000
    assert n.score([clean])[0] > 0.5 > n.score([clean + "bad!! BAD!! " * 60])[0]


def test_nulls_no_labels_and_empty(spark, make_docs):
    docs = make_docs(None, "", "text", ids=[1, None, 3]).withColumn("score2", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = Q.score_quality(docs, Q.fit_quality(docs, none)).collect()
    assert len(rows) == 3 and all(r.score == 1.0 and r.predicted == 1 for r in rows)
    assert Q.score_quality(docs.limit(0), Q.Network()).count() == 0


def plain_score(n, text):
    """The network by loops: every filter at every byte, maxima over each chunk, the largest logit."""
    raw = text.encode("utf-8", "replace")
    size = max(1, len(raw))
    padded = raw + bytes(Q.WIDTH)
    halves = -(-size // Q.HALF)
    starts = [k * Q.HALF for k in range(max(1, halves - 1))]
    best = -np.inf
    for s in starts:
        end = min(size, s + 2 * Q.HALF)
        top = np.max([sum(n.w["conv"][j][padded[i + j]].astype(float) for j in range(Q.WIDTH)) for i in range(s, end)], axis=0)
        share = (min(len(raw), s + 2 * Q.HALF) - s) / (2 * Q.HALF)
        x = np.append(np.maximum(top + n.w["bias"], 0), share)
        best = max(best, np.tanh(x @ n.w["dense"] + n.w["hidden"]) @ n.w["out"] + n.w["shift"][0])
    return 1 / (1 + np.exp(np.clip(best, -30, 30)))


def test_scores_are_those_of_the_plain_convolution():
    r = np.random.default_rng(5)
    n = Q.Network(3)
    texts = ["", "a", "short text", *("".join(chr(c) for c in r.integers(32, 900, int(k))) for k in r.integers(1, 700, 12)), "b" * (Q.HALF * 2), "c" * (Q.HALF * 2 + 1)]
    assert np.allclose(n.score(texts), [plain_score(n, t) for t in texts], atol=1e-5)


def test_the_gradient_is_that_of_the_log_loss():
    n = Q.Network(4)
    n.w = {k: v.astype(np.float64) for k, v in n.w.items()}
    for text, junk in (("some words to look at " * 20, 1.0), ("x", 0.0), ("é" * 150, 0.0)):
        raw = text.encode()
        g = {k: np.zeros_like(v) for k, v in n.w.items()}
        n._gradient(raw, junk, g)

        def loss():
            maxima, share, _ = n.pooled(raw)
            z = n.logits(*n.chunks(maxima, share))[0].max()
            return np.logaddexp(0, z) - junk * z

        r = np.random.default_rng(1)
        for k, v in n.w.items():
            flat, grad = v.reshape(-1), g[k].reshape(-1)
            for i in {int(np.abs(grad).argmax()), *r.integers(len(flat), size=4).tolist()}:
                flat[i] += 1e-5
                up = loss()
                flat[i] -= 2e-5
                down = loss()
                flat[i] += 1e-5
                assert abs((up - down) / 2e-5 - grad[i]) < 1e-3 + 1e-2 * abs(grad[i]), (k, i)


def test_the_sample_is_bounded_in_all_and_takes_long_texts(spark, make_docs, monkeypatch):
    seen = {}
    monkeypatch.setattr(Q.Network, "fit", lambda self, texts, labels: seen.update(n=len(texts), chars=sum(map(len, texts)), most=max(map(len, texts))) or self)
    docs = make_docs(*["x" * 30_000 if i % 3 == 0 else "y" * 100 for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    Q.fit_quality(docs, labels, max_chars=200_000)
    assert seen["chars"] <= 200_000 and seen["most"] == 30_000 and seen["n"] > 20


def test_results_win_over_columns_of_their_names(spark, make_docs):
    df = make_docs("a", None).withColumn("score", F.lit("mine")).withColumn("predicted", F.lit(7)).withColumn("held_out", F.lit(1))
    out = Q.score_quality(df, Q.Network()).collect()
    assert all(isinstance(r.score, float) and r.predicted in (0, 1) and isinstance(r.held_out, bool) for r in out)
    assert Q.score_quality(df.limit(0), Q.Network()).count() == 0
