"""Page cleaning: lines are normalized, repeated margins found over a document's pages and removed, blocks joined.

Pages are dealt by document once. What needs one document's pages together is an aggregation over narrow
rows (page, line); all else works page by page. The rules of headings, lists, code and prose, and Unicode
composition of non-ASCII pages, run in Arrow batches; lines and margins are expressions. Each rule has one form.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions import text as T


def _compose(texts: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(run, "string")(texts)


def composed(text: Column) -> Column:
    """Compatibility composition; of ASCII texts only a null leaves the JVM."""
    t = F.coalesce(text, F.lit(""))
    return F.coalesce(_compose(F.when(t.rlike(r"[^\x00-\x7F]"), t)), t)


def normalized_lines(text: Column, compose: bool = True) -> Column:
    """array<string> of a page's lines; a last line break opens no further line."""
    t = composed(text) if compose else F.coalesce(text, F.lit(""))
    t = F.regexp_replace(F.replace(t, F.lit("\u00a0"), F.lit(" ")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"\n$", "")
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.split(t, "\n", -1), T.normalize_line))


def margin_indexes(lines: Column, count: int = P.MARGIN_LINES) -> Column:
    """0-based places of the first and last lines that are not blank."""
    full = F.filter(F.transform(lines, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    return T.let(full, lambda f: F.array_union(F.slice(f, 1, count), F.slice(f, F.greatest(F.size(f) - (count - 1), F.lit(1)), count)))


def margin_counts(lined: DataFrame, ratio: float = P.MARGIN_RATIO) -> DataFrame:
    """document_key, line, n: canonical margin lines that stand on enough (n) of a document's pages.

    ``lined``: document_key, page_number, lines, margins. Each page gives at most six lines, and an empty one that
    stands for itself, so the counts are partial before they are shuffled and pages are counted on the way.
    """
    own = F.array_distinct(F.transform("margins", lambda i: T.canonical_margin(F.get("lines", i))))
    lines = lined.select("document_key", F.explode(F.concat(F.array(F.lit("")), F.filter(own, lambda x: x != ""))).alias("line"))
    counts = lines.groupBy("document_key", "line").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("n_pages", F.max(F.when(F.col("line") == "", F.col("n"))).over(W.partitionBy("document_key")))
    enough = (F.col("n_pages") >= 2) & (F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("n_pages") * ratio)))
    return counts.filter((F.col("line") != "") & enough).select("document_key", "line", "n")


def margin_candidates(lined: DataFrame) -> DataFrame:
    """``lined`` with ``repeats``: of each line, whether it is a margin line that repeats or only numbers the page."""
    repeated = margin_counts(lined).groupBy("document_key").agg(F.collect_set("line").alias("repeated"))
    known = F.coalesce("repeated", F.array().cast("array<string>"))
    flag = lambda x, i: (x != "") & F.array_contains("margins", i) & (F.array_contains(known, T.canonical_margin(x)) | T.is_page_number(x))
    return lined.join(repeated, "document_key", "left").withColumn("repeats", F.transform("lines", flag)).drop("repeated")


# ---- blocks: code carries its depth from block to block, so a page is folded in order ----------

_HEADING = {k: re.compile(p, re.ASCII) for k, p in (("number", P.NUMBERED_HEADING), ("sharp", P.MARKDOWN_HEADING), ("child", P.CHILD_HEADING), ("list", P.LIST_LINE), ("call", P.CODE_CALL), ("word", P.code_keyword(P.CODE_WORDS_CLEANING)))}


def title_like(text: str) -> bool:
    words = text.split()
    if not words or len(words) > P.HEADING_WORDS or text.strip()[-1] in P.HEADING_STOPS:
        return False
    firsts = [next((c for c in w if c.isalpha()), None) for w in words]
    lettered = [c for c in firsts if c]
    return bool(lettered) and 2 * sum(c.isupper() for c in lettered) >= len(lettered)


def explicit_heading(line: str) -> bool:
    c = line.strip()
    if _HEADING["sharp"].match(c) or _HEADING["child"].match(c):
        return True
    m = _HEADING["number"].match(c)
    return bool(m) and ("." in m[1] or title_like(m[2]))


def list_line(line: str) -> bool:
    return bool(_HEADING["list"].match(line.strip()))


def code_line(line: str, keyword: re.Pattern[str] = _HEADING["word"]) -> bool:
    c = line.strip()
    if c in ("{", "}") or c.startswith("@"):
        return True
    return bool((keyword.match(c) and any(m in c for m in ";{}(")) or _HEADING["call"].match(c) or ("->" in c and ("=" in c or c.endswith(";"))))


def code_block(lines: list[str], keyword: re.Pattern[str] = _HEADING["word"]) -> bool:
    signals = sum(code_line(x, keyword) for x in lines)
    return signals >= 2 or 2 * signals >= len(lines) if len(lines) > 1 else signals == 1


_QUOTED = re.compile(r"\\[\"']|\"(?:\\.|[^\"\\])*(?:\"|$)|'(?:\\.|[^'\\])*(?:'|$)")


def outside_quotes(line: str) -> str:
    """The line without what stands in quotes; an open quote runs to the end."""
    return _QUOTED.sub("", line)


def balance(line: str, opened: str, closed: str) -> int:
    bare = outside_quotes(line)
    return bare.count(opened) - bare.count(closed)


def indent_by_braces(lines: list[str], depth: int) -> list[str]:
    out, parens = [], 0
    for line in map(str.strip, lines):
        level = max(0, depth - (len(line) - len(line.lstrip("}"))))
        out.append(" " * (4 * level + 4 * (parens > 0)) + line)
        depth, parens = max(0, depth + balance(line, "{", "}")), max(0, parens + balance(line, "(", ")"))
    return out


def indent_by_steps(lines: list[str], depth: int) -> list[str]:
    leads = [len(x) - len(x.lstrip(" ")) for x in lines]
    extra = [x - min(leads) for x in leads]
    step = reduce(math.gcd, extra) or 4
    return [" " * (4 * (depth + math.floor(e / step + 0.5))) + x.strip() for e, x in zip(extra, lines, strict=True)]


def join_prose(lines: list[str]) -> str:
    joined = ""
    for line in map(str.strip, lines):
        if joined.endswith("-") and line[:1].islower():
            joined = joined[:-1] + line
        else:
            joined += (" " if joined else "") + line
    return joined


def join_items(lines: list[str]) -> str:
    starts = [i for i, x in enumerate(lines) if i == 0 or list_line(x)]
    return "\n".join(join_prose(lines[a:b]) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True))


def folded_page(lines: list[str]) -> str:
    """Blocks of a page: blank lines and explicit headings part them; code keeps its depth over blank lines."""
    done: list[str] = []
    depth = 0
    block: list[str] = []
    for line in [*lines, ""]:
        heading = line != "" and explicit_heading(line)
        if line != "" and not heading:
            block.append(line)
            continue
        if block:
            if code_block(block):
                braces = any("{" in x or "}" in x for x in block)
                done.append("\n".join((indent_by_braces if braces else indent_by_steps)(block, depth)))
                depth = max(0, depth + balance(done[-1], "{", "}"))
            else:
                done.append(join_items(block) if any(map(list_line, block)) else join_prose(block))
                depth = 0
            block = []
        if heading:
            done.append(line.strip())
            depth = 0
    return "\n\n".join(done).strip()


def cleaned_page(lines: list[str], repeats: list[bool]) -> tuple[str, int]:
    """(text, number of margin lines removed). A removed line is blank from then on, and so parts blocks; headings stay."""
    gone = [r and not explicit_heading(x) for x, r in zip(lines, repeats, strict=True)]
    return folded_page(["" if g else x for x, g in zip(lines, gone, strict=True)]), sum(gone)


def _fold_pages(lines: str, repeats: str) -> Column:
    def run(lines: pd.Series, repeats: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cleaned_page(list(x), list(r)) for x, r in zip(lines, repeats, strict=True)], columns=["text", "removed"])

    return F.pandas_udf(run, "text string, removed int")(lines, repeats)


def by_document(pages: DataFrame) -> DataFrame:
    """Pages dealt by document, once: all that follows per document, in cleaning and chunking, needs no further shuffle."""
    return pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "document_key")


def clean_pages(pages: DataFrame) -> DataFrame:
    """All pages cleaned: document_key, page_number, page_id, text and the four metrics.

    ``pages``: document_key, page_number, page_id, text, and optionally file_name, which becomes source_file_name.
    """
    if "file_name" in pages.columns:
        pages = pages.withColumnRenamed("file_name", "source_file_name")
    lined = by_document(pages).withColumn("original_text", F.coalesce("text", F.lit(""))).withColumn("lines", normalized_lines(F.col("text")))
    lined = lined.withColumn("margins", margin_indexes(F.col("lines")))
    out = margin_candidates(lined).withColumn("cleaned", _fold_pages("lines", "repeats")).withColumn("text", F.col("cleaned.text"))
    return out.withColumns({
        "removed_margin_line_count": F.col("cleaned.removed"),
        "text_cleaned": F.lit(True),
        "source_original_character_count": F.length("original_text"),
        "source_cleaned_character_count": F.length("text"),
    }).drop("lines", "margins", "repeats", "cleaned", "original_text")


def documents_with_text(cleaned: DataFrame) -> DataFrame:
    """document_key, has_text: a document none of whose pages holds text is to be rejected."""
    return cleaned.groupBy("document_key").agg(F.max(F.col("text").rlike(r"\S")).alias("has_text"))
