"""The catalog as stored tables: upserts and deletes as small files of rows under versions (``commits``).

A change writes the rows it touches and publishes a version that names them; no table is written again. A
table is read as its newest row per key. A change is worked out from the version it follows: where another writer was first, it is
checked and worked out again, so what no longer holds (a chat that is gone, a context that has moved on) is refused and nothing of
it is seen. The last message's order is kept in the version. ``compact`` folds a table's files into one set.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions import text as T
from lectern.operators import catalog
from lectern.sources import commits

SCHEMAS = {"documents": catalog.DOCUMENTS, "chats": catalog.CHATS, "chat_documents": catalog.CHAT_DOCUMENTS, "messages": catalog.MESSAGES, "sources": catalog.SOURCES, "summaries": catalog.SUMMARIES}
KEYS = {"documents": ["document_id"], "chats": ["chat_id"], "chat_documents": ["chat_id", "document_id"], "messages": ["message_id"], "sources": ["message_id", "source_rank"], "summaries": ["chat_id", "context_version"]}
Change = dict[str, DataFrame]


@dataclass
class View:
    """The tables of one version."""

    spark: SparkSession
    path: str
    state: commits.State

    def table(self, name: str, where: Any = None) -> DataFrame:
        """The newest row of each key that is not deleted. ``where`` may only use columns of the key, or such as never change for a key."""
        parts = self.state.get("tables", {}).get(name, [])
        schema = SCHEMAS[name]
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = [self.spark.read.schema(f"{schema}, gone boolean").parquet(f"{self.path}/{name}/{p}").withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
        every = reduce(DataFrame.unionByName, rows if where is None else [r.filter(where) for r in rows])
        if len(parts) > 1:
            every = every.groupBy(*KEYS[name]).agg(F.max_by(F.struct(*every.columns), "part").alias("newest")).select("newest.*")
        return every.filter(~F.col("gone")).drop("gone", "part")

    def find(self, name: str, **key: Any) -> Row | None:
        """One row by its key."""
        return self.table(name, reduce(lambda a, b: a & b, [F.col(c) == v for c, v in key.items()])).first()

    def rows(self, name: str, *rows: dict[str, Any]) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.get(c.split()[0]) for c in SCHEMAS[name].split(", ")) for r in rows], SCHEMAS[name])

    def chat(self, chat_id: str) -> dict[str, Any]:
        found = self.find("chats", chat_id=chat_id)
        if found is None:
            raise LookupError("chat was not found")
        return found.asDict()


def gone(rows: DataFrame) -> DataFrame:
    """Rows to delete."""
    return rows.withColumn("gone", F.lit(True))


@dataclass
class Ledger:
    spark: SparkSession
    path: str

    def view(self) -> View:
        return View(self.spark, self.path, commits.current(self.spark, self.path)[1])

    def table(self, name: str) -> DataFrame:
        return self.view().table(name)

    def change(self, step: Callable[[View], Change], orders: int = 0) -> int:
        """Publish the rows that ``step`` makes of the newest version (those with ``gone`` are deleted); ``orders``: message orders taken."""

        def run(state: commits.State) -> commits.State:
            changed = step(View(self.spark, self.path, state))
            tables = dict(state.get("tables", {}))
            for name, rows in changed.items():
                part = uuid.uuid4().hex
                flag = F.col("gone") if "gone" in rows.columns else F.lit(False)
                rows.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMAS[name].split(", ")], flag.alias("gone")).write.parquet(f"{self.path}/{name}/{part}")
                tables[name] = [*tables.get(name, []), part]
            return state | {"tables": tables, "last_order": state.get("last_order", 0) + orders}

        return commits.change(self.spark, self.path, run)[0]

    def load(self, **tables: DataFrame) -> int:
        """Many rows at once, sorted by key so that a later look-up skips files and row groups."""
        last = tables["messages"].agg(F.max("message_order")).first()[0] if "messages" in tables else None
        return self.change(lambda _: {n: t.repartitionByRange(*KEYS[n]).sortWithinPartitions(*KEYS[n]) for n, t in tables.items()}, orders=last or 0)

    def compact(self, name: str) -> int:
        """A table's files folded into one set; what other writers add meanwhile stays as it is."""
        before = self.view()
        folded, part = before.state.get("tables", {}).get(name, []), uuid.uuid4().hex
        rows = before.table(name).withColumn("gone", F.lit(False))
        rows.repartitionByRange(*KEYS[name]).sortWithinPartitions(*KEYS[name]).write.parquet(f"{self.path}/{name}/{part}")

        def run(state: commits.State) -> commits.State:
            now = state["tables"].get(name, [])
            if now[: len(folded)] != folded:
                raise commits.Conflict("the table was folded by another writer")
            return state | {"tables": state["tables"] | {name: [part, *now[len(folded) :]]}}

        return commits.change(self.spark, self.path, run)[0]


# ---- changes of chats -------------------------------------------------------------------------------
def _title(spark: SparkSession, title: str | None, length: int = P.TITLE_LENGTH) -> str:
    return spark.range(1).select(T.title(F.lit(title).cast("string"), length)).first()[0]


def create_chat(ledger: Ledger, chat_id: str, title: str | None, at: datetime) -> int:
    name = _title(ledger.spark, title)
    return ledger.change(lambda v: {"chats": v.rows("chats", {"chat_id": chat_id, "title": name, "context_version": 1, "created_at": at, "updated_at": at})})


def rename_chat(ledger: Ledger, chat_id: str, title: str, at: datetime) -> int:
    if not title or not title.strip():
        raise ValueError("title must not be blank")
    name = _title(ledger.spark, title)
    return ledger.change(lambda v: {"chats": v.rows("chats", v.chat(chat_id) | {"title": name, "updated_at": at})})


def delete_chat(ledger: Ledger, chat_id: str) -> int:
    """The chat with its links, messages, their sources and its summaries; an unknown chat is an error, documents stay."""

    def step(v: View) -> Change:
        v.chat(chat_id)
        own = F.col("chat_id") == chat_id
        messages = v.table("messages", own)
        sources = v.table("sources").join(messages.select("message_id"), "message_id", "left_semi")
        return {"chats": gone(v.table("chats", own)), "chat_documents": gone(v.table("chat_documents", own)), "messages": gone(messages), "sources": gone(sources), "summaries": gone(v.table("summaries", own))}

    return ledger.change(step)


def attach_documents(ledger: Ledger, chat_id: str, ids: list[str], at: datetime) -> int:
    """New links only; the chat's context version goes up once if there are any."""
    if len(set(ids)) < len(ids):
        raise ValueError("document ids must be distinct")

    def step(v: View) -> Change:
        chat = v.chat(chat_id)
        known = F.col("document_id").isin(ids)
        if catalog.ready(v.table("documents", known)).count() < len(ids):
            raise ValueError("every document must be ready")
        own = {r["document_id"] for r in v.table("chat_documents", F.col("chat_id") == chat_id).select("document_id").collect()}  # three at most
        new = [i for i in ids if i not in own]
        if len(own) + len(new) > P.MAX_DOCUMENTS:
            raise ValueError(f"a chat has at most {P.MAX_DOCUMENTS} documents")
        if not new:
            return {}
        return {"chats": v.rows("chats", chat | {"context_version": chat["context_version"] + 1, "updated_at": at}), "chat_documents": v.rows("chat_documents", *[{"chat_id": chat_id, "document_id": i, "attached_at": at} for i in new])}

    return ledger.change(step)


def detach_document(ledger: Ledger, chat_id: str, document_id: str, at: datetime) -> int:
    def step(v: View) -> Change:
        chat = v.chat(chat_id)
        link = v.table("chat_documents", (F.col("chat_id") == chat_id) & (F.col("document_id") == document_id))
        if link.isEmpty():
            return {}
        return {"chats": v.rows("chats", chat | {"context_version": chat["context_version"] + 1, "updated_at": at}), "chat_documents": gone(link)}

    return ledger.change(step)


def save_turn(ledger: Ledger, chat_id: str, version: int, question: str, answer: str, hits: DataFrame, tokens: tuple[int | None, int | None, int | None], ids: tuple[str, str], at: datetime) -> int:
    """A question, its answer and the answer's sources, all or nothing; refused where the chat's context has moved on since ``version``."""
    titled = _title(ledger.spark, question, P.QUESTION_TITLE_LENGTH)

    def step(v: View) -> Change:
        chat = v.chat(chat_id)
        if chat["context_version"] != version:
            raise RuntimeError("chat context changed while the answer was made")
        last = v.state.get("last_order", 0)
        base = {"chat_id": chat_id, "context_version": version, "created_at": at}
        asked = base | {"message_id": ids[0], "message_order": last + 1, "role": "USER", "content": question}
        told = base | {"message_id": ids[1], "message_order": last + 2, "role": "ASSISTANT", "content": answer, "prompt_tokens": tokens[0], "completion_tokens": tokens[1], "total_tokens": tokens[2]}
        sources = hits.select(F.lit(ids[1]).alias("message_id"), F.col("rank").alias("source_rank"), "score", F.col("text").alias("chunk_text"), "metadata")
        title = titled if chat["title"] == P.DEFAULT_TITLE else chat["title"]
        return {"chats": v.rows("chats", chat | {"title": title, "updated_at": at}), "messages": v.rows("messages", asked, told), "sources": sources}

    return ledger.change(step, orders=2)


def save_summary(ledger: Ledger, chat_id: str, version: int, summary: str, through: int, at: datetime) -> int:
    def step(v: View) -> Change:
        v.chat(chat_id)
        return {"summaries": v.rows("summaries", {"chat_id": chat_id, "context_version": version, "summary": summary, "summarized_through_order": through, "updated_at": at})}

    return ledger.change(step)


# ---- changes of documents ------------------------------------------------------------------------------
def register_documents(ledger: Ledger, new: DataFrame, at: datetime) -> int:
    """Upsert by content fingerprint of (document_id, content_fingerprint, original_file_name); only the documents touched are written."""

    def step(v: View) -> Change:
        known = v.table("documents").join(new.select("content_fingerprint").distinct(), "content_fingerprint", "left_semi")
        return {"documents": catalog.register(known, new, F.lit(at))}

    return ledger.change(step)


def mark_document(ledger: Ledger, document_id: str, chunk_count: int | None, at: datetime) -> int:
    """Ready with so many chunks; failed where ``chunk_count`` is None, unless an earlier ingestion left chunks."""

    def step(v: View) -> Change:
        own = v.table("documents", F.col("document_id") == document_id)
        if own.isEmpty():
            raise LookupError("document was not found")
        return {"documents": catalog.mark_failed(own, document_id, F.lit(at)) if chunk_count is None else catalog.mark_ready(own, document_id, chunk_count, F.lit(at))}

    return ledger.change(step)
