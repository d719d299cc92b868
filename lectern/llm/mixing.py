"""Mixing sources to target word counts by entropy balancing.

Every document gets a rate ``w = min(max_copies, exp(lambda_s * size / mean size of s))``: the
exponential tilt that stays closest (in Kullback-Leibler divergence) to one copy each while the
words of its source meet the target. One multiplier per source is found by safeguarded Newton
steps on the convex dual; each step is one distributed aggregation over the histogram of
(source, size), never over the documents. Rates are rounded to whole copies by a systematic
draw along the size order, so a source's total is off by less than one small document.

Defined cases: null text has size 0; a null source is a source of its own, last in order; an
empty table gives no rows; repeated rows are separate documents; a very long text is one size more of the
histogram; other columns pass by, and a source whose rate does not settle is warned of. Sources are ranked in one
task, a narrow row each: meant for up to some hundred thousands of them.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lectern.llm.common import spool, text_or_empty, word_count

#: Hash slices of one (source, size) group; a hot group is ranked slice by slice.
SLICES = 1024


def source_targets(by_source: DataFrame, weights: tuple[int, ...], total_share: float, max_copies: int) -> DataFrame:
    """(source, source_size) -> + target: shares by weight, stopped at ``max_copies`` times the source.

    The excess of stopped sources is reshared: with sources sorted by cap/weight the stopped ones
    are a prefix, found with running sums. One row per source, so the one-task windows are small.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    kinds = F.array(*[F.lit(float(x)) for x in weights])
    s = by_source.withColumn("weight", F.element_at(kinds, (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(max_copies))
    every = W.partitionBy()
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    s = (
        s.withColumn("all_words", F.sum("source_size").over(every) * total_share)
        .withColumn("rest", F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("rest_weight"))
    )
    # the first source that is not stopped fixes the water level for itself and all after it
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(by_ratio).alias("k"), F.col("level").alias("v")))).over(every)["v"])
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def _rate(lam, x, max_copies: int):
    return F.exp(F.least(F.lit(math.log(max_copies)), lam * x))


def solve_rates(hist: DataFrame, targets: DataFrame, max_copies: int, max_steps: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """Newton on the dual: (source, lam). ``hist``: source, size, n. Only one number per step reaches the driver."""
    means = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    start = targets.join(means, targets["source"].eqNullSafe(means["source"])).select(targets["source"], "target", "source_size", "mean")
    # a source stopped at its cap takes every document max_copies times
    full = F.col("target") >= F.col("source_size") * float(max_copies) * (1 - 1e-12)
    state = spool(start.select("source", "target", "mean", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), (full | (F.col("source_size") == 0)).alias("done"), full.alias("full")))
    for _ in range(max_steps):
        x = F.col("size") / F.col("mean")
        w = _rate(F.col("lam"), x, max_copies)
        words = F.col("n") * F.col("size")
        sums = (
            hist.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & ~F.col("done"))
            .groupBy("source")
            .agg((F.sum(words * w)).alias("got"), F.sum(F.when(w < max_copies, words * x * w).otherwise(0.0)).alias("slope"))
        )
        s = state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap >= 0, F.col("lam")).otherwise(F.col("hi"))
        s = s.withColumns({"lo": F.when(F.col("done"), F.col("lo")).otherwise(lo), "hi": F.when(F.col("done"), F.col("hi")).otherwise(hi), "gap": gap})
        step = F.col("lam") - F.col("gap") / F.col("slope")
        middle = (F.col("lo") + F.col("hi")) / 2
        inside = (F.col("slope") > 0) & (F.col("lo").isNull() | (step > F.col("lo"))) & (F.col("hi").isNull() | (step < F.col("hi")))
        outward = F.when(F.col("gap") < 0, F.col("lam") * 2 + 1).otherwise(F.col("lam") * 2 - 1)
        moved = F.when(inside, step).otherwise(F.coalesce(middle, outward))
        near = F.abs(F.col("gap")) <= F.greatest(F.col("target") * tolerance, F.lit(0.5))
        s = s.withColumn("near", F.col("done") | F.coalesce(near, F.lit(True)))
        state = spool(s.select("source", "target", "mean", F.when(F.col("near"), F.col("lam")).otherwise(moved).alias("lam"), "lo", "hi", F.col("near").alias("done"), "full"))
        if state.filter(~F.col("done")).isEmpty():
            break
    else:
        warnings.warn(f"a source's rate was not within {tolerance} of its target after {max_steps} steps; rounding makes up for the rest", stacklevel=2)
    return state.select("source", "mean", "lam", "full")


def entropy_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total_share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs`` (doc_id, text, source)."""
    sized = spool(docs.select("doc_id", "source", word_count(text_or_empty()).alias("size")).withColumn("h", F.xxhash64("doc_id", "size")))
    return mix_sized(sized, weights, total_share, max_copies)


def mix_sized(sized: DataFrame, weights: tuple[int, ...], total_share: float, max_copies: int) -> DataFrame:
    """As :func:`entropy_mix` from a narrow table doc_id, source, size, h (and columns to pass through)."""
    hist = spool(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    by_source = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = spool(source_targets(by_source, weights, total_share, max_copies))
    rates = solve_rates(hist, targets, max_copies)

    r = rates.withColumnRenamed("source", "s")
    g = hist.join(r, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    g = g.withColumn("w", F.when(F.col("full"), F.lit(float(max_copies))).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean"), max_copies)))
    g = g.withColumn("w", F.coalesce("w", F.lit(1.0)))
    by_size = W.partitionBy("source").orderBy("size")
    g = g.withColumn("base", F.floor("w")).withColumn("run", F.floor(F.sum((F.col("w") - F.floor("w")) * F.col("n")).over(by_size) + 0.5))
    g = g.withColumn("m", F.col("base") * F.col("n") + F.col("run") - F.coalesce(F.lag("run").over(by_size), F.lit(0)))
    # what the systematic draw left open (under one large document) goes to the small documents
    whole = W.partitionBy("source")
    t = targets.select(F.col("source").alias("s"), "target", "source_size")
    g = g.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    g = g.withColumn("open", F.col("target") - F.sum(F.col("m") * F.col("size")).over(whole))
    g = g.withColumn("room", F.when(F.col("open") >= 0, F.col("n") * max_copies - F.col("m")).otherwise(F.col("m")))
    before = F.sum(F.col("room") * F.col("size")).over(by_size) - F.col("room") * F.col("size")
    fill = F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.abs("open") - F.col("before")) / F.col("size"))))
    g = g.withColumn("before", before).withColumn("m", F.col("m") + F.when(F.col("size") > 0, F.signum("open").cast("long") * fill).otherwise(0))
    g = g.select("source", "size", "source_size", "target", F.floor(F.col("m") / F.col("n")).alias("each"), F.pmod(F.col("m"), F.col("n")).alias("extra"))

    # the documents of a group that get one copy more: those of the lowest hashes, found slice by slice
    sized = sized.withColumn("slice", F.pmod("h", F.lit(SLICES)).cast("int"))
    slices = sized.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("c"))
    in_group = W.partitionBy("source", "size").orderBy("slice")
    slices = slices.withColumn("ahead", F.sum("c").over(in_group) - F.col("c"))
    k = g.filter("extra > 0").select(F.col("source").alias("s"), F.col("size").alias("z"), "extra")
    edge = (
        slices.join(k, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("ahead") < F.col("extra")))
        .groupBy("source", "size")
        .agg(F.max_by(F.struct("slice", (F.col("extra") - F.col("ahead")).alias("left")), "slice").alias("edge"))
        .select(F.col("source").alias("s"), F.col("size").alias("z"), "edge")
    )
    g = g.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").drop("s", "z")
    g = spool(g.select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "each", "edge"))

    d = sized.join(g, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    on_edge = F.coalesce(F.col("slice") == F.col("edge.slice"), F.lit(False))
    rank = F.row_number().over(W.partitionBy("source", "size", "slice").orderBy("h", "doc_id"))
    plain = d.filter(~on_edge).withColumn("more", F.coalesce(F.col("slice") < F.col("edge.slice"), F.lit(False)).cast("long"))
    tied = d.filter(on_edge).withColumn("more", (rank <= F.col("edge.left")).cast("long"))
    d = plain.unionByName(tied)
    return d.withColumn("copies", (F.col("each") + F.col("more")).cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop("slice", "edge", "each", "more", "h")
