import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm.mixing import entropy_mix, solve_rates


def water(sizes, weights, share=1.5, most=2):
    left, rest, out = set(sizes), share * sum(sizes.values()), {}
    while left:
        total = sum(weights[s] for s in left)
        over = [s for s in left if rest * weights[s] / total > most * sizes[s]]
        if not over:
            out |= {s: rest * weights[s] / total for s in left}
            break
        for s in over:
            out[s] = most * sizes[s]
        rest -= sum(out[s] for s in over)
        left -= set(over)
    return out


def check(df, rows, near):
    got = entropy_mix(df).collect()
    assert len(got) == len(rows)
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    target = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    taken = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= near * max(target[s], 1) + 3, (s, taken[s], target[s])
    return sorted((r.doc_id, r.size, r.taken) for r in got)


def test_targets_and_rounding(spark, make_docs):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * int(r.lognormvariate(3, 1))), r.choice(["a"] * 8 + ["b", "c", "É", None, "z", "d"])) for i in range(3000)]
    df = make_docs(*[t for _, t, _ in rows], sources=[s for _, _, s in rows]).withColumn("h", F.lit(1)).withColumn("size", F.lit("x"))
    assert check(df, rows, 0.005) == check(df.repartition(7), rows, 0.005)


def test_hot_groups_of_copies(spark, make_docs):
    rows = [(i, "one two three", "a") for i in range(2000)] + [(2000 + i, "x " * (i + 1), "b") for i in range(50)]
    check(make_docs(*[t for _, t, _ in rows], sources=[s for _, _, s in rows]), rows, 0.01)


def test_nulls_one_document_and_none(spark, make_docs):
    rows = [(0, None, None), (1, "", "a"), (2, "a b c d", "a"), (3, "x", "b")]
    out = entropy_mix(make_docs(*[t for _, t, _ in rows], sources=[s for _, _, s in rows])).collect()
    assert len(out) == 4 and {r.doc_id: r.size for r in out} == {0: 0, 1: 0, 2: 4, 3: 1}
    assert entropy_mix(make_docs("x").limit(0)).count() == 0


def test_the_tilt_is_the_minimum_of_the_dual(spark):
    """Per source: words of all documents at rates min(2, exp(lam * size / mean)), by bisection in plain Python."""
    r = random.Random(9)
    sizes = {s: [int(r.lognormvariate(3, m)) for _ in range(200)] for s, m in (("a", 0.3), ("b", 1.5), (None, 1))}
    share = {"a": 1.7, "b": 0.4, None: 1.05}
    hist = spark.createDataFrame([(s, x, 1) for s, xs in sizes.items() for x in xs], "source string, size long, n long").groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = spark.createDataFrame([(s, sum(xs), share[s] * sum(xs)) for s, xs in sizes.items()], "source string, source_size long, target double")
    got = {x.source: x for x in solve_rates(hist, targets, 2).collect()}
    for s, xs in sizes.items():
        mean = sum(xs) / len(xs)
        words = lambda lam: sum(x * min(2.0, math.exp(min(1, lam * x / mean))) if lam * x / mean < 1 else 2.0 * x for x in xs)  # noqa: B023, E731
        low, high = -50.0, 50.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if words(middle) < share[s] * sum(xs) else (low, middle)
        assert abs(got[s].lam - low) < 1e-4 and not got[s].full


def test_copies_follow_the_rates(spark, make_docs):
    """Within each group of one size, the mean number of copies is the tilted rate, but for one large document's words and a copy by rounding."""
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.choice([5, 20, 80])), "a" if i % 4 else "b") for i in range(4000)]
    out = entropy_mix(make_docs(*[t for _, t, _ in rows], sources=[s for _, _, s in rows])).toPandas()
    for (s, size), g in out.groupby(["source", "size"]):
        mine, target = out[out.source == s], g.target.iloc[0]
        mean = mine["size"].mean()
        low, high = -50.0, 50.0
        for _ in range(100):
            lam = (low + high) / 2
            low, high = (lam, high) if (mine["size"] * np.minimum(2, np.exp(np.minimum(1, lam * mine["size"] / mean)))).sum() < target else (low, lam)
        assert abs(g.copies.mean() - min(2, math.exp(min(1, low * size / mean)))) <= (80 / size + 1) / len(g)


def test_a_rate_that_does_not_settle_is_warned_of(spark):
    hist = spark.createDataFrame([("a", 1, 5), ("a", 900, 3)], "source string, size long, n long")
    with pytest.warns(UserWarning, match="rate"):
        solve_rates(hist, spark.createDataFrame([("a", 2705, 2000.0)], "source string, source_size long, target double"), 2, max_steps=1)
