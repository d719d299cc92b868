"""Scalar text functions as Column expressions: they stay inside the JVM and are pruned and pushed like any other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.transform(F.array(value), body)[0]


def normalized_words(text: Column) -> Column:
    """Lower case, everything but letters, digits and _ to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), P.NOT_WORD, " "))


def words(text: Column) -> Column:
    return let(normalized_words(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def shingles(text: Column, size: int = P.SHINGLE_WORDS) -> Column:
    """64-bit hashes of the distinct runs of ``size`` words; empty for shorter texts."""
    return let(
        words(text),
        lambda w: F.when(F.size(w) < size, F.array().cast("array<long>")).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size))))
        ),
    )


def overlap_coefficient(shingles_a: Column, shingles_b: Column, same_text: Column) -> Column:
    """Shared share of the smaller set; where a set is empty, 1 for equal texts and else 0."""
    least = F.least(F.size(shingles_a), F.size(shingles_b))
    return F.when(least == 0, F.when(same_text, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(shingles_a, shingles_b)) / least)


def text_overlap(a: Column, b: Column) -> Column:
    return overlap_coefficient(shingles(a), shingles(b), normalized_words(a) == normalized_words(b))


def shorten(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.rtrim(F.substring(text, 1, length - 1)), F.lit("…"))).otherwise(text)


def title(text: Column, length: int = P.TITLE_LENGTH) -> Column:
    """White space collapsed and cut; the default title where nothing is given."""
    clean = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")
    return F.when(F.coalesce(clean, F.lit("")) == "", P.DEFAULT_TITLE).otherwise(shorten(clean, length))


def add_tokens(a: Column, b: Column) -> Column:
    """A sum in which one missing count is 0, and two are missing."""
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def lenient_int(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("int")


def equal_and_present(a: Column, b: Column) -> Column:
    return F.coalesce(a.isNotNull() & (F.trim(a) != "") & (a == b), F.lit(False))


def chunk_key(chunk_id: Column, document_id: Column, chunk_fingerprint: Column, text: Column) -> Column:
    """The chunk's id, or one made of its document and its fingerprint (of its text without one)."""
    own = F.nullif(F.trim(chunk_id), F.lit(""))
    return F.coalesce(own, F.concat_ws(":", F.coalesce(document_id, F.lit("unknown")), F.coalesce(chunk_fingerprint, F.md5(text))))


def canonical_uuid(value: Column, label: str = "document_id") -> Column:
    """Lower-case form; a value that is no UUID stops the query."""
    trimmed = F.trim(value)
    return F.when(trimmed.rlike(P.UUID), F.lower(trimmed)).otherwise(F.raise_error(F.lit(f"{label} must be a valid UUID")))


def count_of(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def relevance_percent(score: Column) -> Column:
    return F.floor(score * 100 + 0.5).cast("int")


def normalize_line(line: Column) -> Column:
    """Trailing space off, inner runs to one space, indentation kept up to a bound (a tab counts four). Most lines are so already: one look tells."""
    bare = F.regexp_replace(line, r"\s+$", "")
    lead = F.regexp_extract(bare, r"^(\s*)", 1)
    content = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^\s+", ""), P.HORIZONTAL_SPACE, " "), r"\s+$", "")
    indent = F.length(lead) + count_of(lead, "\t") * 3
    changed = F.when(content == "", "").otherwise(F.concat(F.repeat(F.lit(" "), F.least(indent, F.lit(P.MAX_INDENT))), content))
    return F.when(line.rlike(P.NORMAL_LINE), line).otherwise(changed)


def canonical_margin(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, P.PAGE_COUNTER, P.PAGE_COUNTER_TEXT)))


def is_page_number(line: Column) -> Column:
    return line.rlike(P.STANDALONE_PAGE_NUMBER)
