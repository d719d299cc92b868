"""Chat formatting with budgeted windows, in Column expressions only.

Every turn costs its text's tokens (a fixed regular estimate, as a tokenizer would take Python code) and
``MARKS`` for its marks. Prefix sums of these costs cut a conversation into turn-aligned spans: fresh turns have what the
system turn and the history leave of the budget (half of what the system turn leaves, at least). Turns whose sum before them falls
into the same step of a grid share a window; a step is that room less the conversation's largest turn, so the turn that
reaches over a step's end still fits. A turn of more than half of the room has a window alone. Each window repeats
the conversation's first system turn and the whole turns of the last ``history`` tokens before it that still fit;
what is repeated bears no loss, so each assistant text is a target once. A window passes the budget only where
one turn, or one turn with the system turn, does.

Template: ``<s>`` then ``[INST]role[/INST]text</s>`` per turn. Any of these control strings (or
the system marks of the same family) inside a role or text gets one backslash more after its
opening bracket; reading back takes one away.

Prefix sums run over slices of a conversation, joined by one row per slice, so no task holds a whole
conversation; only :func:`chat_digests`, whose hashes are of whole conversations, does.

Defined cases: null role or text is empty; a null conv_id is a conversation; turns are ordered by
turn (nulls first), role, text; repeated rows are turns of their own; a very long turn has a window alone,
whole; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lectern.llm.common import let, spool

MARKS, SLICE = 4, 256
#: fixed: control strings of the template's family
CONTROL = r"(<<|<|\[)(\\*)(/?(?:s>|INST\]|SYS>>))"
ESCAPED = r"(<<|<|\[)\\(\\*)(/?(?:s>|INST\]|SYS>>))"
TOKEN = r"\p{L}{1,4}|\p{N}{1,3}|[^\s\p{L}\p{N}]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("[INST]"), escape(role), F.lit("[/INST]"), escape(text), F.lit("</s>"))


def sliced(t: DataFrame) -> DataFrame:
    """``t`` with ``part`` and ``sub``: slices of a conversation, in its order, of ``SLICE`` turn numbers.

    A slice with many more rows than numbers (turns tied or null) is cut further by turn, role and the start of the text.
    """
    none = -(1 << 62)
    t = t.withColumn("part", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(none)))
    keys = ["c", "cn", "part"]
    hot = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4 * SLICE).select(*keys, F.lit(True).alias("hot"))
    if hot.isEmpty():
        return t.withColumn("sub", F.lit(""))
    fine = F.struct(F.coalesce("turn", F.lit(none)).alias("turn"), "role", F.substring("text", 1, 24).alias("text"))
    return t.join(spool(hot), keys, "left").withColumn("sub", F.when(F.col("hot"), fine).otherwise(F.struct(F.lit(none).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text")))).drop("hot")


def chat_windows(turns: DataFrame, budget: int = 2048, history: int = 512) -> DataFrame:
    """conv_id, first_turn, last_turn (ordinals), n_repeated, tokens, over_budget, formatted, loss_spans per window.

    ``turns``: conv_id, turn, role, text. ``loss_spans``: array of (start, length) in code points of ``formatted``.
    Texts are shuffled twice: to their slice, and to the window (and the next ones that repeat them).
    """
    none = F.lit(0).cast(turns.schema["conv_id"].dataType)
    t = turns.select(F.coalesce("conv_id", none).alias("c"), F.col("conv_id").isNull().alias("cn"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = sliced(t.withColumn("cost", (F.regexp_count("text", F.lit(TOKEN)) + MARKS).cast("long")))
    slice_ = ["c", "cn", "part", "sub"]
    inside = W.partitionBy(*slice_).orderBy("turn", "role", "text")
    t = t.withColumns({"k": F.row_number().over(inside), "sum": F.sum("cost").over(inside.rowsBetween(W.unboundedPreceding, 0))})
    # one row per slice carries the sums, and the first system turn, over to the others
    parts = t.groupBy(*slice_).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("tokens"), F.max(F.when(F.col("role") != "system", F.col("cost"))).alias("most"), F.min(F.when(F.col("role") == "system", F.struct("k", "cost", "text"))).alias("s"))
    over = W.partitionBy("c", "cn").orderBy("part", "sub")
    whole = over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ahead = lambda c: F.coalesce(F.sum(c).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"n0": ahead("n"), "c0": ahead("tokens"), "total": F.sum("tokens").over(whole), "most": F.max("most").over(whole)})
    parts = parts.withColumn("s", F.when(F.col("s").isNotNull(), F.struct((F.col("s.k") + F.col("n0")).alias("at"), F.col("s.cost").alias("cost"), F.col("s.text").alias("text"))))
    parts = parts.select(*slice_, "n0", "c0", "total", "most", F.first("s", ignorenulls=True).over(whole).alias("system"))
    t = t.join(parts, slice_).withColumns({"at": F.col("k") + F.col("n0"), "before": F.col("sum") + F.col("c0") - F.col("cost")})

    # turns whose sum before them falls into the same step share a window; one over the most that a step allows for has a window alone
    room = budget - F.coalesce("system.cost", F.lit(0))
    fresh = F.when(room >= 4, F.greatest(room - history, F.floor(room / 2))).otherwise(F.lit(max(budget // 2, 2)))
    t = t.withColumn("fresh", fresh.cast("long")).withColumn("most", F.greatest(F.lit(1), F.least("most", F.floor(F.col("fresh") / 2))).cast("long"))
    t = t.withColumn("step", F.col("fresh") - F.col("most")).withColumn("span", F.floor(F.col("before") / F.col("step")))
    # the system turn's text goes once to each span
    first = F.coalesce(F.lag("span").over(W.partitionBy(*slice_).orderBy("k")) != F.col("span"), F.lit(True))
    t = t.withColumn("system", F.when(first, F.col("system")))
    reach = F.greatest(F.lit(0), F.least(F.lit(history), room))
    last = F.least(F.floor((F.col("before") + reach) / F.col("step")), F.floor((F.col("total") - 1) / F.col("step")))
    t = t.select("c", "cn", "most", "span", "at", "role", "text", "cost", "before", "system", F.explode(F.sequence("span", F.greatest("span", last))).alias("to"))
    own = F.col("span") == F.col("to")
    w = t.groupBy("c", "cn", "to", "most").agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "text", "cost", "before", own.alias("own")))).alias("near"), F.max(F.when(own, F.col("system"))).alias("system")
    )
    kind = lambda small: F.filter("near", lambda x: x["own"] & ((x["cost"] <= F.col("most")) == F.lit(small)))
    w = w.withColumn("new", F.explode(F.filter(F.array(kind(True), kind(False)), lambda x: F.size(x) > 0)))
    start = F.col("new")[0]
    has_system = F.coalesce(F.col("system.at") < start["at"], F.lit(False))
    plain = lambda x: F.struct(x["at"].alias("at"), x["role"].alias("role"), x["text"].alias("text"), x["cost"].alias("cost"))
    w = w.withColumn("head", F.when(has_system, F.array(F.struct(F.col("system.at").alias("at"), F.lit("system").alias("role"), F.col("system.text").alias("text"), F.col("system.cost").alias("cost")))).otherwise(F.slice(F.transform("new", plain), 1, 0)))
    used = F.aggregate("new", F.lit(0).cast("long"), lambda s, x: s + x["cost"]) + F.when(has_system, F.col("system.cost")).otherwise(0)
    w = w.withColumn("room", F.greatest(F.lit(0), F.least(F.lit(history), budget - used)))
    past = F.filter("near", lambda x: (x["before"] < start["before"]) & (x["before"] >= start["before"] - F.col("room")) & ~(has_system & (x["at"] == F.col("system.at"))))
    w = w.withColumns({"past": F.transform(past, plain), "conv_id": F.when(~F.col("cn"), F.col("c"))}).withColumn("new", F.transform("new", plain))
    w = w.withColumn("all", F.concat("head", "past", "new")).withColumn("n_repeated", F.size("head") + F.size("past"))
    w = w.withColumn("pieces", F.transform("all", lambda x: formatted_turn(x["role"], x["text"])))
    w = w.withColumn("tokens", F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["cost"]))
    spans = F.aggregate(
        F.sequence(F.lit(1), F.size("all")),
        F.struct(F.lit(3).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, i: let(
            F.struct(F.element_at("all", i).alias("x"), F.length(F.element_at("pieces", i)).alias("n")),
            lambda v: F.struct(
                (s["at"] + v["n"]).cast("int").alias("at"),
                F.when(
                    (i > F.col("n_repeated")) & (v["x"]["role"] == "assistant"),
                    F.concat(s["spans"], F.array(let(F.length(escape(v["x"]["text"])), lambda m: F.struct((s["at"] + v["n"] - 4 - m).cast("int").alias("start"), m.cast("int").alias("length"))))),
                ).otherwise(s["spans"]).alias("spans"),
            ),
        ),
    )["spans"]
    return w.select(
        "conv_id", F.col("new")[0]["at"].alias("first_turn"), F.element_at("new", -1)["at"].alias("last_turn"), "n_repeated", "tokens",
        (F.col("tokens") > budget).alias("over_budget"), F.concat(F.lit("<s>"), F.array_join("pieces", "")).alias("formatted"), spans.alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, first_turn, turns (role, text; the fresh ones), loss_text, formatted_chars of each window, from its output alone."""
    marked = F.split(F.substring("formatted", F.lit(4), F.length("formatted")), "</s>", -1)
    fresh = let(marked, lambda s: F.slice(s, F.col("n_repeated") + 1, F.greatest(F.size(s) - 1 - F.col("n_repeated"), F.lit(0))))
    role = lambda s: unescape(F.regexp_extract(s, r"(?s)^\[INST\](.*?)\[/INST\]", 1))
    text = lambda s: unescape(F.regexp_replace(s, r"(?s)^\[INST\].*?\[/INST\]", ""))
    return windows.select(
        "conv_id", "first_turn", F.transform(fresh, lambda s: F.struct(role(s).alias("role"), text(s).alias("text"))).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"]))), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_digests(windows: DataFrame) -> DataFrame:
    """One row per conversation: what the windows hold of it, read back."""
    r = read_back(windows).withColumn("said", F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""))
    r = r.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("first_turn", "said", "loss_text"))).alias("w"),
        F.sum("formatted_chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"),
    )
    r = r.withColumn("said", F.array_join("w.said", "")).withColumn("loss", F.array_join("w.loss_text", ""))
    return r.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
