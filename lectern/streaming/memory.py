"""Rolling conversation memory over a stream of messages: state per chat and context version.

The state of a chat holds only messages that no summary covers yet, so it never has more than
``above`` of them between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions import patterns as P

DUE = "chat_id string, context_version int, marker long, orders array<long>, text string"
STATE = "orders array<long>, parts array<string>"


def summaries_due(messages: DataFrame, above: int = P.MEMORY_COMPACT_ABOVE, keep: int = P.MEMORY_KEEP) -> DataFrame:
    """For a stream (chat_id, context_version, message_order, role, content): a row whenever a chat has more than ``above``
    messages, with the older ones to summarize; the latest ``keep`` stay in the state. Messages seen before are left out."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        floor = min(held, default=0)
        for rows in batches:
            for order, role, content in zip(rows.message_order, rows.role, rows.content, strict=True):
                if order >= floor:
                    held[int(order)] = f"\n--- {role} message ---\n{content}"
        orders = sorted(held)
        if len(orders) > above:
            old, orders = orders[:-keep], orders[-keep:]
            yield pd.DataFrame([{"chat_id": key[0], "context_version": key[1], "marker": old[-1], "orders": old, "text": "".join(held[k] for k in old)}])
        state.update((orders, [held[k] for k in orders]))

    return messages.groupBy("chat_id", "context_version").applyInPandasWithState(update, DUE, STATE, "append", GroupStateTimeout.NoTimeout)
