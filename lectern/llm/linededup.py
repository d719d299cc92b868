"""Line dedup by content-defined chunks of lines, in Column expressions and joins only.

A line that occurs once in the corpus cannot be part of a repeated passage, so only lines that
occur again go on. Runs of such lines are cut into chunks where the rolling hash of two
neighbouring lines says so, and around lines of ``long_line`` words, which are passages by themselves; once
into longer chunks and once into shorter ones (``cut_every``), which fall into step again sooner behind a line that is no part of
the passage. Every border depends on the two lines at it, so the same passage is cut alike wherever it stands.
Chunks of two lines or more (or one long line) with equal hashes are compared byte by byte with
the first of their kind; the equal ones are removed, the first stays.

Chunks may fall short of a passage, so runs of whole lines of ``long_line`` words are matched as well,
from each line on and back from each: whatever run of so many words stands in an earlier place is removed up to its
last line, with the blank lines inside it. Their lines are compared byte by byte too: the texts of all lines of such runs meet by
hash, and where two of one hash differ, no run with such a line is removed.

Counts are partial before each shuffle; joins on hot hashes leave the skew to be split by the
engine, one side having one row per hash.

A single line of ``long_line`` words counts as a passage although it is no chunk of several lines: passages of so
many words are to go however they are broken into lines. Shorter single lines stay (headings, refrains).

Defined cases: null text is empty and stays null; a very long text is one row more of lines, its passages travel
one by one; blank lines part chunks, not runs, and are never removed
alone; rows equal in doc_id and text are one document and treated alike; the first occurrence is
that of the least doc_id (null first), text hash, line; an empty table gives no rows; other columns
pass by in a struct, so their names may clash with none but the three results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lectern.llm.common import spool, text_or_empty, word_count


def _lines() -> Column:
    return F.split(text_or_empty(), "\n", -1)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """d, h (the document), i, x (hash), words, o (number among the lines that are not blank), c (count), sure: lines that occur again."""
    numbered = F.filter(F.transform(_lines(), lambda v, i: F.struct(i.alias("i"), v.alias("line"))), lambda v: F.trim(v["line"]) != "")
    lines = docs.select("d", "h", F.posexplode(numbered).alias("o", "l")).select("d", "h", "o", "l.*")
    lines = lines.select("d", "h", "o", "i", F.xxhash64("line").alias("x"), F.xxhash64(F.lit(7), "line").alias("y"), word_count(F.col("line")).cast("int").alias("words"))
    # written out, so that the join's sides are exchanges of their own and a hot line's partition can be split
    again = spool(lines.groupBy("x").agg(F.count(F.lit(1)).alias("c"), (F.min("y") == F.max("y")).alias("sure")).filter("c > 1"))
    return lines.drop("y").join(again, "x")


def repeated_runs(met: DataFrame, long_line: int) -> DataFrame:
    """d, h, start, end: later places of runs of whole lines of ``long_line`` words, blank lines passed over.

    From each line on, and back from each, the shortest run of so many words is taken. It depends on its
    own lines only, and these runs together cover every longer one that stands in an earlier place. A run
    goes on as 128 bits of its lines' hashes, so a row has the same size however many lines it spans.
    """
    here = W.partitionBy("d", "h").orderBy("i")
    # equal rows bring each line more than once
    met = met.filter("sure").withColumn("same", F.coalesce(F.lag("i").over(here) == F.col("i"), F.lit(False))).filter("not same").withColumn("words", F.greatest("words", F.lit(1)).cast("long"))
    met = met.withColumn("new", F.coalesce(F.col("o") != F.lag("o").over(here) + 1, F.lit(True)).cast("int"))
    met = met.withColumns({"run": F.sum("new").over(here), "upto": F.sum("words").over(here)}).withColumn("before", F.col("upto") - F.col("words"))
    of_run = W.partitionBy("d", "h", "run")
    forth, back = of_run.orderBy("before").rangeBetween(0, long_line - 1), of_run.orderBy("upto").rangeBetween(1 - long_line, 0)
    taken = lambda w: F.struct(F.min("i").over(w).alias("start"), F.max("i").over(w).alias("end"), F.sum("words").over(w).alias("size"), F.collect_list("x").over(w).alias("xs"))
    met = met.select("d", "h", taken(forth).alias("f"), taken(back).alias("b"))
    named = lambda r: F.when(r["size"] >= long_line, F.struct(r["start"].alias("start"), r["end"].alias("end"), F.xxhash64(r["xs"]).alias("one"), F.xxhash64(F.lit(7), r["xs"]).alias("two")))
    runs = met.select("d", "h", F.explode(F.array_compact(F.array(named(F.col("f")), named(F.col("b"))))).alias("r")).select("d", "h", "r.*")
    runs = spool(runs)
    place = F.struct("d", "h", "start")
    firsts = spool(runs.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").drop("last"))
    return runs.join(firsts, ["one", "two"]).select("d", "h", "start", "end", (place > F.col("first")).alias("later"))


def differing(places: DataFrame, texts: DataFrame) -> DataFrame:
    """x: hashes that stand for lines of different bytes among the lines of ``places`` (d, h, start, n_lines) in ``texts`` (d, h, text; equal rows do no harm)."""
    per_doc = places.groupBy("d", "h").agg(F.collect_list(F.struct("start", "n_lines")).alias("places"))
    held = texts.join(per_doc, ["d", "h"]).withColumn("lines", _lines())
    lines = held.select(F.explode(F.flatten(F.transform("places", lambda p: F.slice("lines", p["start"] + 1, p["n_lines"])))).alias("line"))
    return lines.groupBy(F.xxhash64("line").alias("x")).agg(F.min("line").alias("least"), F.max("line").alias("most")).filter("least <> most").select("x")


def merged(places: DataFrame) -> DataFrame:
    """d, h, start, n_lines: overlapping places (start, end) of a document as one."""
    order = W.partitionBy("d", "h").orderBy("start", "end")
    places = places.withColumn("reach", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    places = places.withColumn("no", F.sum(F.coalesce(F.col("start") > F.col("reach"), F.lit(True)).cast("int")).over(order))
    return places.groupBy("d", "h", "no").agg(F.min("start").alias("start"), (F.max("end") - F.min("start") + 1).alias("n_lines")).drop("no")


def repeated_chunks(met: DataFrame, long_line: int, cut_every: tuple[int, ...]) -> DataFrame:
    """d, h (the document), start, n_lines, chunk (hash): chunks of lines that occur again, cut by content at each of the rates."""
    here = W.partitionBy("d", "h").orderBy("i")
    before = lambda c: F.lag(c).over(here)
    # equal rows bring each line more than once
    met = met.withColumn("same", F.coalesce(before("i") == F.col("i"), F.lit(False))).filter("not same")
    met = met.withColumns({"i0": before("i"), "x0": before("x"), "w0": before("words")})
    apart = F.col("i0").isNull() | (F.col("i") != F.col("i0") + 1) | (F.greatest("words", "w0") >= long_line)
    cut = {f"cut{k}": apart | (F.pmod(F.xxhash64("x0", "x"), F.lit(k)) == 0) for k in cut_every}
    met = met.withColumns({name: F.sum(F.coalesce(c, F.lit(True)).cast("int")).over(here) for name, c in cut.items()})
    # both ways of cutting go through one grouping, which the windows' partitions already serve
    met = met.select("d", "h", "i", "x", "words", F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), F.col(f"cut{k}").alias("no")) for k in cut_every])).alias("at"))
    chunks = met.groupBy("d", "h", "at.rate", "at.no").agg(F.min("i").alias("start"), F.count(F.lit(1)).cast("int").alias("n_lines"), F.max("words").alias("words"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("xs"))
    return chunks.filter((F.col("n_lines") > 1) | (F.col("words") >= long_line)).select("d", "h", "start", "n_lines", F.xxhash64(F.transform("xs", lambda v: v["x"])).alias("chunk")).distinct()


def dedup_lines(docs: DataFrame, long_line: int = 50, cut_every: tuple[int, ...] = (16, 4)) -> DataFrame:
    """All columns of ``docs`` with ``text`` less the repeated chunks, and n_lines, n_removed_lines, n_removed_chunks.

    A column of ``docs`` with one of the three new names gives way to the new one.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines", "n_removed_chunks")]
    # other columns travel in a struct, so that no name clashes; without any, both joins below read one exchange of the texts
    others = [c for c in names if c not in ("doc_id", "text")]
    keyed = docs.select(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id").alias("d"), F.xxhash64(text_or_empty()).alias("h"), "text", *([F.struct(*others).alias("row")] if others else []))
    met = spool(repeated_lines(keyed.select("d", "h", "text")))
    chunks = spool(repeated_chunks(met, long_line, cut_every))
    place = F.struct("d", "h", "start")
    firsts = spool(chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first")).filter("c > 1"))
    found = spool(chunks.join(firsts, "chunk").select("d", "h", "start", "n_lines", "chunk", (place == F.col("first")).alias("is_first")))

    # byte comparison of each later chunk with the first of its hash
    per_doc = found.groupBy("d", "h").agg(F.collect_list(F.struct("start", "n_lines", "chunk", "is_first")).alias("found"))
    texts = keyed.select("d", "h", "text")
    once = texts.join(per_doc, ["d", "h"]).dropDuplicates(["d", "h"])
    once = once.withColumn("lines", _lines()).select("d", "h", F.explode(F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["n_lines"].alias("n_lines"), c["chunk"].alias("chunk"), c["is_first"].alias("is_first"), F.array_join(F.slice("lines", c["start"] + 1, c["n_lines"]), "\n").alias("passage")))).alias("c")).select("d", "h", "c.*")
    first = once.filter("is_first").select("chunk", F.col("passage").alias("kept"))
    gone = once.filter("not is_first").join(first, "chunk").filter(F.col("passage") == F.col("kept"))
    runs = spool(repeated_runs(met, long_line))
    # a run with a line whose hash stands for other bytes as well stays; written out, such hashes (none, as a rule) are seen to be few
    unlike = met.join(spool(differing(merged(runs.drop("later")), texts)), "x").select(F.col("d").alias("d0"), F.col("h").alias("h0"), "i")
    same = runs.filter("later").join(unlike, (F.col("d") == F.col("d0")) & (F.col("h") == F.col("h0")) & F.col("i").between(F.col("start"), F.col("end")), "left_anti")
    gone = gone.select("d", "h", "start", (F.col("start") + F.col("n_lines") - 1).alias("end")).unionByName(same.drop("later"))
    gone = merged(gone).groupBy("d", "h").agg(F.array_sort(F.collect_list(F.struct("start", "n_lines"))).alias("gone"))

    out = keyed.join(gone, ["d", "h"], "left").withColumn("lines", _lines())
    # what stays are the slices between removed chunks: linear in the lines, however many chunks
    end = lambda c: c["start"] + c["n_lines"]
    slices = F.transform(
        F.sequence(F.lit(0), F.size("gone")),
        lambda k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(end(F.element_at("gone", F.greatest(k, F.lit(1))))).alias("lo"),
            F.when(k == F.size("gone"), F.size("lines")).otherwise(F.element_at("gone", F.least(k + 1, F.size("gone")))["start"]).alias("hi"),
        ),
    )
    kept = F.flatten(F.transform(slices, lambda s: F.slice("lines", s["lo"] + 1, s["hi"] - s["lo"])))
    out = out.withColumn("kept", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    of = lambda c: F.col("kept") if c == "text" else F.col("d.doc_id") if c == "doc_id" else F.col("row").getField(c)
    columns = [of(c).alias(c) for c in names]
    removed = F.coalesce(F.aggregate("gone", F.lit(0), lambda s, c: s + c["n_lines"]), F.lit(0))
    extra = {"n_lines": F.size("lines"), "n_removed_lines": removed, "n_removed_chunks": F.coalesce(F.size("gone"), F.lit(0))}
    return out.select(*columns, *[v.alias(k) for k, v in extra.items()])
