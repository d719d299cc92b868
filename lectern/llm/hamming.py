"""Exact top-k search over 64-bit codes by incremental multi-index hashing.

A code is cut into four segments of 16 bits, each indexed on its own. A query first looks up its
own segments, then those one bit away, two bits away, and so on. By the pigeonhole principle a
code within distance ``4 s - 1 + a`` agrees with the query to ``s`` bits in one of the first ``a``
segments or to ``s - 1`` bits in another; so once the k-th verified distance is at most that, no
better code can be missing and the query stops. A query probes only as many tables of a round as its
k-th distance so far asks for.

Rows of equal code are one index entry with its k smallest ids (all that a top-k can use), so a
hot code is one entry; probes and entries meet in an equi-join on (segment, value), both sides dealt and
sorted, so that neither is held whole by the driver or a task.

Defined cases: a null embedding, or one with a null id, has no code: it is neither found nor asked for; missing
dimensions count as zero, more than 64 are an error; ties are broken by id; with fewer than k rows all are returned; repeated rows
are ranked each on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lectern.llm.common import spool

SEGMENTS, BITS = 4, 16


def sign_codes(table: DataFrame) -> DataFrame:
    """vec_id, code: bit i says whether dimension i is positive; more than 64 dimensions are an error."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.coalesce(F.get(F.col("embedding"), i) > 0, F.lit(False)), F.expr("1L")).otherwise(F.expr("0L")))
    code = F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    longer = F.raise_error(F.concat(F.lit("an embedding has more than 64 dimensions: "), F.size("embedding").cast("string"))).cast("long")
    return table.filter("embedding IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", F.when(F.size("embedding") > SEGMENTS * BITS, longer).otherwise(code).alias("code"))


def _segment(code, j: int):
    return F.shiftrightunsigned(code, j * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _distance(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, distance for each row of ``queries`` (vec_id, code) against ``rows`` (vec_id, code)."""
    rows, queries = spool(rows), spool(queries)
    k = min(k, rows.limit(k).count())
    if not k:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).alias("distance")).limit(0)
    salted = W.partitionBy("code", "salt").orderBy("vec_id")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k)
    few = few.withColumn("r", F.row_number().over(W.partitionBy("code").orderBy("vec_id"))).filter(F.col("r") <= k)
    entries = spool(few.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("least", F.col("ids")[0]))
    index = spool(entries.select("code", "least", F.size("ids").alias("n"), F.posexplode(F.array(*[_segment(F.col("code"), j) for j in range(SEGMENTS)])).alias("j", "value")))

    q = spool(queries.select(F.col("code").alias("q")).distinct().withColumns({"dk": F.lit(None).cast("int"), "covered": F.lit(-1)}))
    best = None
    for s in range(BITS + 1):
        masks = [m for m in range(1 << BITS) if m.bit_count() == s]
        masks_column = F.sequence(F.lit(0), F.lit((1 << BITS) - 1))
        masks_column = F.filter(masks_column, lambda m: F.bit_count(m) == s) if s > 1 else F.array(*[F.lit(m) for m in masks])
        # one row with this radius's masks (12,870 at most) meets every active query
        mask_row = F.broadcast(q.sparkSession.range(1).select(masks_column.alias("masks"), F.lit(1).alias("one")))
        active = q.filter(F.col("dk").isNull() | (F.col("dk") > F.col("covered")))
        tables = F.when(F.col("dk").isNull(), SEGMENTS).otherwise(F.least(F.lit(SEGMENTS), F.col("dk") - (SEGMENTS * s - 1)))
        active = active.withColumn("tables", tables)
        probes = active.withColumn("one", F.lit(1)).join(mask_row, "one").select("q", "dk", "tables", "masks", F.posexplode(F.array(*[_segment(F.col("q"), j) for j in range(SEGMENTS)])).alias("j", "own")).filter("j < tables")
        probes = probes.select("q", "dk", "j", F.explode(F.transform("masks", lambda m: m.bitwiseXOR(F.col("own")))).alias("value"))
        # probes are many more than their plan tells (an explode is not reckoned): they are dealt, never sent to every task
        found = probes.hint("merge").join(index.hint("merge"), ["j", "value"]).select("q", "dk", "j", "code", "least", "n", _distance(F.col("q"), F.col("code")).alias("distance"))
        # what lies beyond the k-th distance so far is of no use
        found = found.filter(F.col("dk").isNull() | (F.col("distance") <= F.col("dk"))).drop("dk")
        # a code is taken from the first table that reaches it, in the first round that does
        parts = [_distance(_segment(F.col("q"), j).cast("long"), _segment(F.col("code"), j).cast("long")) for j in range(SEGMENTS)]
        nearest = F.least(*parts)
        first = F.array_position(F.array(*parts), nearest) - 1
        found = found.filter((nearest == s) & (first == F.col("j"))).drop("j")
        both = found if best is None else best.unionByName(found)
        order = W.partitionBy("q").orderBy("distance", "least")
        best = spool(both.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r"))
        # the distance at which k rows are there
        run = best.withColumn("have", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
        kth = run.filter(F.col("have") >= k).groupBy("q").agg(F.min("distance").alias("new"))
        q = active.select("q", "dk", (F.col("tables") + SEGMENTS * s - 1).alias("covered")).unionByName(q.filter(F.col("dk") <= F.col("covered")).select("q", "dk", "covered"))
        q = spool(q.join(kth, "q", "left").select("q", F.coalesce("new", "dk").cast("int").alias("dk"), F.col("covered").cast("int").alias("covered")))
        if q.filter(F.col("dk").isNull() | (F.col("dk") > F.col("covered"))).isEmpty():
            break
    out = best.hint("merge").join(entries.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("vec_id"))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "vec_id"))).filter(F.col("rank") <= k)
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q"))
    return asked.join(out, "q").select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))
