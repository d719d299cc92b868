"""Byte-pair token counts: a word's bytes are joined by rank, pair by pair, and its count is remembered.

The lowest-ranked neighbouring pair is joined first, the leftmost of equals. Neighbours are linked and candidate pairs wait in a
heap, so a word of n bytes takes n log n steps however long it is.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from functools import lru_cache

import regex

#: words whose counts a worker remembers, twice over at most
KNOWN = 200_000


def merged(word: bytes, ranks: dict[bytes, int]) -> int:
    """How many tokens a word has."""
    if len(word) < 2 or word in ranks:
        return min(1, len(word))
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    waiting: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(waiting, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    count = n
    while waiting:
        _, i, to = heapq.heappop(waiting)
        j = after[i] if end[i] else -1
        if j < 0 or end[j] != to:  # one of the two has been joined meanwhile
            continue
        end[i], after[i], end[j] = to, after[j], 0
        if after[i] >= 0:
            before[after[i]] = i
        count -= 1
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return count


class Counter:
    """Tokens of texts by one vocabulary: ``ranks`` of byte strings, and the pattern that splits a text into words beforehand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.words, self.new, self.old = ranks, regex.compile(pattern), {}, {}

    def __call__(self, text: str) -> int:
        total, new = 0, self.new
        for word in self.words.findall(text):
            n = new.get(word)
            if n is None:
                n = self.old.get(word)
                if n is None:
                    n = merged(word.encode("utf-8", "replace"), self.ranks)
                new[word] = n
            total += n
        if len(new) > KNOWN:
            self.old, self.new = new, {}
        return total


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of base64 tokens and their ranks, one a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(read_ranks(path), pattern)


def estimate(path: str, pattern: str) -> Callable[[str], int]:
    """The count as a function that can be sent to workers: each reads the vocabulary once. Counts need not add up over joined texts."""
    return lambda text: counter(path, pattern)(text)
