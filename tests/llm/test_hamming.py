import random

import pytest

from lectern.llm import hamming
from lectern.llm.hamming import sign_codes, top_k
from lectern.llm.queries import ORACLE_SQL, op8_hamming

SCHEMA = "vec_id long, code long"


def brute(rows, queries, k):
    signed = lambda x: x & (2**64 - 1)
    out = set()
    for q, c in queries:
        best = sorted(((signed(c) ^ signed(x)).bit_count(), i) for i, x in rows)[:k]
        out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(best)}
    return out


def test_against_brute_force(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) - 2**63 for _ in range(12)]
    rows = [(i, r.choice(base) ^ sum(1 << r.randrange(63) for _ in range(r.randrange(4)))) for i in range(600)]
    rows = [(i, c if -(2**63) <= c < 2**63 else 0) for i, c in rows] + [(1000 + i, base[0]) for i in range(300)]
    queries = [rows[0], rows[1], rows[700], (-5, r.getrandbits(62))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(x) for x in top_k(df, spark.createDataFrame(queries, SCHEMA), 7).collect()}
    assert got == brute(rows, queries, 7)


def test_few_rows_nulls_and_none(spark):
    t = spark.createDataFrame([(0, [1.0] * 64), (1, None), (2, [-1.0, 1.0]), (None, [1.0]), (4, [None, 2.0])], "vec_id long, embedding array<float>")
    codes = sign_codes(t)
    assert {r.vec_id: r.code for r in codes.collect()} == {0: -1, 2: 2, 4: 2}
    assert top_k(codes, codes.filter("vec_id = 2"), 10).orderBy("rank").collect()[1][2] == 4
    assert top_k(codes.limit(0), codes, 3).count() == 0


def test_query(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, op8_hamming(spark, sf).collect())) == sorted(con.sql(ORACLE_SQL["op8_hamming"]).fetchall())


def test_longer_embeddings_are_not_cut(spark):
    t = spark.createDataFrame([(0, [1.0] * 65)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="more than 64 dimensions"):
        sign_codes(t).collect()


def test_probes_are_dealt_and_never_sent_whole(spark, monkeypatch):
    """A few questions have thousands of probes each; the plan reckons them by the questions alone."""
    r = random.Random(3)
    df = spark.createDataFrame([(i, r.getrandbits(63)) for i in range(400)], SCHEMA)
    plans, kept = [], hamming.spool
    monkeypatch.setattr(hamming, "spool", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or kept(d))
    top_k(df, df.filter("vec_id % 100 = 0"), 5)
    probing = [p for p in plans if "[j#" in p and "Join [j#" in p]
    assert probing and not any("BroadcastHashJoin [j#" in p or "BroadcastHashJoin [value#" in p for p in probing)
    assert all("SortMergeJoin [j#" in p for p in probing)
