"""Conversation memory and prompts, for all chats at once: windows over messages and ordered string folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lectern.functions import patterns as P

KEY = ["chat_id", "context_version"]


def memory_state(chats: DataFrame, messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """The messages of each chat's present version that no summary covers yet, with summary and marker."""
    s = summaries.select(*KEY, "summary", F.col("summarized_through_order").alias("marker"))
    now = chats.select(*KEY).join(s, KEY, "left").withColumn("marker", F.coalesce("marker", F.lit(0)).cast("long"))
    return messages.join(now, KEY).filter(F.col("message_order") > F.col("marker"))


def split_memory(state: DataFrame, above: int = P.MEMORY_COMPACT_ABOVE, keep: int = P.MEMORY_KEEP) -> DataFrame:
    """Adds ``to_summary``: with more than ``above`` messages, all but the latest ``keep`` are to be summarized."""
    latest = F.row_number().over(W.partitionBy(*KEY).orderBy(F.col("message_order").desc()))
    total = F.count(F.lit(1)).over(W.partitionBy(*KEY))
    return state.withColumn("to_summary", (total > above) & (latest > keep))


def summary_inputs(memory: DataFrame) -> DataFrame:
    """chat_id, context_version, summary_input, marker for each chat that has messages to summarize."""
    part = F.concat(F.lit("\n--- "), "role", F.lit(" message ---\n"), F.col("content"))
    old = memory.filter("to_summary").groupBy(*KEY).agg(F.first("summary").alias("summary"), F.max("message_order").alias("marker"), F.array_sort(F.collect_list(F.struct("message_order", part.alias("t")))).alias("ms"))
    known = F.when(F.trim(F.coalesce("summary", F.lit(""))) == "", "(none)").otherwise(F.trim("summary"))
    text = F.concat(F.lit("Existing rolling summary:\n"), known, F.lit("\n\nNew conversation messages to incorporate:\n"), F.array_join(F.transform("ms", lambda m: m["t"]), ""))
    return old.select(*KEY, text.alias("summary_input"), "marker")


def checked_summary(summary: str | None) -> str:
    if summary is None or not summary.strip():
        raise ValueError("the summary must not be blank")
    return summary.strip()


def retrieval_queries(memory: DataFrame, questions: DataFrame) -> DataFrame:
    """chat_id, query: the question, after the summary and the latest question that is still remembered."""
    kept = memory.filter("not to_summary")
    last = kept.filter(F.upper("role") == "USER").groupBy("chat_id").agg(F.max_by("content", "message_order").alias("previous"))
    known = memory.groupBy("chat_id").agg(F.max("summary").alias("summary"))
    q = questions.join(last, "chat_id", "left").join(known, "chat_id", "left")
    summary = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.concat(F.lit("Older conversation context: "), F.trim("summary"), F.lit("\n")))
    previous = F.concat(F.lit("Previous question: "), "previous", F.lit("\n"))
    asked = F.trim("question")
    alone = F.col("previous").isNull() & summary.isNull()
    return q.select("chat_id", F.when(alone, asked).otherwise(F.concat(F.coalesce(summary, F.lit("")), F.coalesce(previous, F.lit("")), F.lit("Current question: "), asked)).alias("query"))


def prompt_role(role: Column) -> Column:
    return F.when(F.upper(role) == "USER", "user").otherwise("assistant")


#: fixed: the text around a summary in a prompt
SUMMARY_NOTE = (
    "The following is a rolling summary of the older conversation. Use it only\nto understand the user's goals and resolve conversational references. It\n"
    "is not document evidence and must never be cited as a source or override\nthe document-grounding instructions.\n\nConversation summary:\n%s\n"
)


def summary_message(summary: Column) -> Column:
    before, after = SUMMARY_NOTE.split("%s")
    return F.concat(F.lit(before), summary, F.lit(after))


def grounded_contexts(hits: DataFrame, key: str, with_document: bool = True) -> DataFrame:
    """key, context: the sources of each question in rank order; ``hits``: key, rank, text and metadata columns."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) if c in hits.columns else F.lit("Unknown")
    lines = [F.lit("\n[Source "), F.col("rank").cast("string"), F.lit("]\n")]
    if with_document:
        lines += [F.lit("Document: "), known("source_file_name"), F.lit("\nDocument ID: "), known("document_id"), F.lit("\n")]
    lines += [F.lit("Section: "), known("section_title"), F.lit("\nPages: "), known("page_numbers"), F.lit("\nContent:\n"), F.col("text"), F.lit("\n[/Source "), F.col("rank").cast("string"), F.lit("]\n")]
    one = F.struct("rank", F.concat(*lines).alias("t"))
    return hits.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "").alias("context"))


def grounded_message(question: Column, context: Column, chat: bool = True) -> Column:
    asked, found = ("User question:\n", "\n\nSources retrieved from the selected documents:\n") if chat else ("Answer this question about the selected document:\n", "\n\nRetrieved document sources:\n")
    return F.concat(F.lit(asked), question, F.lit(found), context, F.lit("\n"))


def prompts(system: str, memory: DataFrame, grounded: DataFrame) -> DataFrame:
    """chat_id, prompt: array of (role, text): instructions, summary where there is one, history, grounded question."""
    message = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    h = memory.filter("not to_summary").groupBy("chat_id").agg(F.first("summary").alias("summary"), F.array_sort(F.collect_list(F.struct("message_order", prompt_role(F.col("role")).alias("role"), F.col("content").alias("text")))).alias("h"))
    g = grounded.join(h, "chat_id", "left")
    history = F.coalesce(F.transform("h", lambda m: message(m["role"], m["text"])), F.array().cast("array<struct<role:string,text:string>>"))
    note = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.array(message(F.lit("system"), summary_message(F.trim("summary"))))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return g.select("chat_id", F.concat(F.array(message(F.lit("system"), F.lit(system))), note, history, F.array(message(F.lit("user"), F.col("grounded")))).alias("prompt"))


def basic_window(messages: DataFrame, size: int = P.BASIC_CHAT_WINDOW) -> DataFrame:
    """The latest messages of each chat."""
    return messages.withColumn("age", F.row_number().over(W.partitionBy("chat_id").orderBy(F.col("message_order").desc()))).filter(F.col("age") <= size).drop("age")


def citations(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, place, source_rank for each source an answer names, in order of mention."""
    groups = F.regexp_extract_all(text, F.lit(P.CITATION), F.lit(0))
    ranks = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(?i)Source\s+(\d+)"), F.lit(1))))
    return answers.select(key, F.posexplode(ranks).alias("place", "source_rank")).withColumn("source_rank", F.col("source_rank").cast("int"))
