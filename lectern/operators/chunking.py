"""Structure-aware chunking of cleaned pages.

A document is a group of its own, and each chunk depends on the one before it. A table's documents keep all their
chunks; a request that takes one document may refuse it above ``MAX_CHUNKS``. Documents are folded one by one as they stream past; everything that can be said
of one chunk, or of neighbours, is worked out afterwards in expressions and windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lectern.functions import bpe
from lectern.functions import patterns as P
from lectern.functions import text as T
from lectern.functions.sentences import sentences as sentences_of
from lectern.operators.cleaning import code_block, title_like

Estimate = Callable[[str], int]

_TOKEN = regex.compile(P.TOKEN)
#: of the first 256 characters: a letter, a digit, white space or a mark
_CLASSES = bytes(next(k for k, p in zip(b"a1 .", (r"\p{L}", r"\p{N}", r"\s", r"[\s\S]"), strict=True) if regex.match(p, chr(c))) for c in range(256))
_KEYWORD = re.compile(P.code_keyword(P.CODE_WORDS_CHUNKING), re.ASCII)
_NUMBER, _SHARP, _CHILD, _LIST = (re.compile(x, re.ASCII) for x in (P.NUMBERED_HEADING, P.MARKDOWN_HEADING, P.CHILD_HEADING, P.LIST_LINE))
_BREAK = re.compile(r"(?:(?:\r\n|[\n\x0b\f\r\x85  ])\s*){2,}")
SEPARATOR = {"PROSE": " ", "LIST": "\n", "CODE": "\n", "HEADING": "\n\n"}


def default_estimate(text: str) -> int:
    """Pieces of up to four letters, three digits or one mark. No piece spans white space, so counts add up over it."""
    try:
        classes = text.encode("latin-1").translate(_CLASSES)
    except UnicodeEncodeError:
        return len(_TOKEN.findall(text))
    # whole pieces first, then what is left of a run, which is one piece: each a single sign at last
    for piece in (b"aaaa", b"aaa", b"aa", b"111", b"11"):
        classes = classes.replace(piece, b".")
    return len(classes) - classes.count(b" ")


default_estimate.additive = True


def bpe_estimate(path: str, pattern: str) -> Estimate:
    """Tokens of a byte-pair vocabulary: a file of base64 tokens and ranks, and the pattern that splits texts beforehand."""
    return bpe.estimate(path, pattern)


def level_of(block: str) -> int:
    """The level of a heading, 0 for none."""
    c = block.strip()
    if not c or "\n" in c or len(c) > P.HEADING_CHARS:
        return 0
    if m := _NUMBER.match(c):
        return m[1].count(".") + 1
    if m := _SHARP.match(c):
        return len(m[1])
    return 2 if _CHILD.match(c) or title_like(c) else 0


def kind_of(block: str) -> str:
    lines = [x.strip() for x in block.splitlines() if x.strip()]
    if lines and code_block(lines, _KEYWORD):
        return "CODE"
    listed = bool(lines) and all(map(_LIST.match, lines))
    if listed and (len(lines) > 1 or lines[0][0] in P.BULLETS):
        return "LIST"
    if level_of(block):
        return "HEADING"
    return "LIST" if listed else "PROSE"


@dataclass(frozen=True)
class Page:
    id: str
    number: int
    original: int = 0
    cleaned: int = 0


@dataclass(frozen=True)
class Unit:
    """What may not be cut any more: a paragraph or part of one, with the headings before it."""

    text: str
    kind: str
    page: Page
    section: str | None
    subsection: str | None
    level: int = 0
    opens: str = ""  # "section" or "subsection"
    gap: str = "\n\n"


@dataclass(frozen=True)
class Draft:
    text: str
    kinds: frozenset[str]
    heading: bool
    section: str | None
    subsections: tuple[str, ...]
    level: int
    boundary: str
    pages: tuple[Page, ...]
    tokens: int
    overlap: int = 0


def _distinct(items: Iterable, key=lambda x: x) -> tuple:
    return tuple({key(x): x for x in reversed(list(items))}[k] for k in dict.fromkeys(map(key, items)))


@dataclass
class Chunker:
    """Folds one document. Any estimate of tokens will do; it is asked about joined texts, as tokens need not add up."""

    estimate: Estimate = default_estimate
    target: int = P.TARGET_TOKENS
    limit: int = P.HARD_MAX_TOKENS
    preferred: int = P.MIN_PREFERRED_TOKENS
    useful: int = P.MIN_USEFUL_TOKENS
    overlap_limit: int = P.MAX_OVERLAP_TOKENS
    max_chunks: int | None = P.MAX_CHUNKS
    additive: bool = field(init=False)

    def __post_init__(self) -> None:
        self.additive = getattr(self.estimate, "additive", False)

    def count(self, parts: list[tuple[str, int]], gap: str) -> int:
        """Tokens of parts (text, tokens) joined by white space; only counts that don't add up are asked for again."""
        return sum(n for _, n in parts) if self.additive else self.estimate(gap.join(t for t, _ in parts))

    # ---- parts of one block -------------------------------------------------------------
    def gathered(self, pieces: Iterable[str], gap: str, smaller: Callable[[str], list[str]], open_after: Callable[[list[str]], bool] | None = None) -> list[str]:
        """Pieces gathered up to the target; one over the limit is cut by ``smaller``; no cut while ``open_after``."""
        out: list[str] = []
        held: list[tuple[str, int]] = []

        def close() -> None:
            if (text := gap.join(t for t, _ in held).strip()):
                out.append(text)
            held.clear()

        for piece in pieces:
            tokens = self.estimate(piece)
            if tokens > self.limit:
                close()
                out.extend(smaller(piece))
                continue
            if held and not (open_after and open_after([t for t, _ in held])) and self.count([*held, (piece, tokens)], gap) > self.target:
                close()
            held.append((piece, tokens))
        close()
        return out

    def prose(self, text: str) -> list[str]:
        return [text] if self.estimate(text) <= self.target else self.gathered(sentences_of(text), " ", self.by_tokens)

    def listing(self, text: str) -> list[str]:
        items = [x.strip() for x in text.splitlines() if x.strip()]
        return [text] if self.estimate(text) <= self.limit else self.gathered(items, "\n", self.prose)

    def code(self, text: str) -> list[str]:
        def in_parentheses(held: list[str]) -> bool:
            joined = "".join(held)
            return joined.count("(") != joined.count(")")

        def by_lines(unit: str) -> list[str]:
            return self.gathered(unit.splitlines(), "\n", self.by_tokens, in_parentheses)

        return [text] if self.estimate(text) <= self.limit else self.gathered(self.statements(text), "\n", by_lines)

    @staticmethod
    def statements(text: str) -> Iterator[str]:
        """Runs of lines that end with a whole declaration or body at the outer two levels."""
        held: list[str] = []
        braces = parentheses = 0
        for line in text.splitlines():
            held.append(line)
            braces += line.count("{") - line.count("}")
            parentheses += line.count("(") - line.count(")")
            if parentheses <= 0 and braces <= 1 and line.rstrip().endswith((";", "}")):
                if (unit := "\n".join(held).strip()):
                    yield unit
                held = []
        if (unit := "\n".join(held).strip()):
            yield unit

    def by_tokens(self, text: str) -> list[str]:
        """The last resort for one sentence or line over the limit: windows of the target, ended at a mark where one is far enough in."""
        out, rest = [], text.strip()
        while rest:
            high = 4 * self.target  # a start that is too long, so that no more of the rest is counted
            while high < len(rest) and self.estimate(rest[:high]) <= self.target:
                high *= 2
            if high >= len(rest) and self.estimate(rest) <= self.target:
                break
            low, high = 1, min(high, len(rest))  # the longest start within the target
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if self.estimate(rest[:middle]) <= self.target else (low, middle - 1)
            mark = max(rest.rfind(m, 0, low) for m in (";", "}", "\n"))
            cut = mark + 1 if mark >= 100 else low
            out.append(rest[:cut].strip())
            rest = rest[cut:].strip()
        return [x for x in [*out, rest] if x]

    # ---- units --------------------------------------------------------------------------
    def units(self, pages: Iterable[tuple[Page, str]]) -> list[Unit]:
        """Units in order. Headings go before the first unit after them on their page; the section runs on over pages."""
        out: list[Unit] = []
        section: str | None = None
        subsection: str | None = None
        for page, text in pages:
            chain: list[str] = []
            opens, level = "", 0

            def lead(first: Unit | None, page: Page = page) -> Unit:
                titles = "\n\n".join(chain)
                if first is None:
                    return Unit(titles, "HEADING", page, section, subsection, level, opens)
                return replace(first, text=f"{titles}\n\n{first.text}", level=level, opens=opens, gap="\n\n")

            for block in filter(None, (b.strip() for b in _BREAK.split(text or ""))):
                kind = kind_of(block)
                if kind == "HEADING":
                    level = level_of(block)
                    opens = opens if chain else "subsection"
                    chain.append(block)
                    if level == 1 or section is None:
                        section, subsection, opens = block, None, "section"
                    else:
                        subsection = block
                    continue
                parts = {"PROSE": self.prose, "LIST": self.listing, "CODE": self.code}[kind](block)
                new = [Unit(p, kind, page, section, subsection, gap=SEPARATOR[kind] if i else "\n\n") for i, p in enumerate(parts)]
                if chain:
                    new = [lead(new[0] if new else None), *new[1:]]
                    chain, opens = [], ""
                out += new
            if chain:
                out.append(lead(None))
        return out

    # ---- chunks -------------------------------------------------------------------------
    def draft(self, unit: Unit, boundary: str) -> Draft:
        subs = (unit.subsection,) if unit.subsection and unit.subsection.strip() else ()
        return Draft(unit.text, frozenset([unit.kind]), bool(unit.level), unit.section, subs, unit.level, boundary, (unit.page,), self.estimate(unit.text))

    def joined(self, a: Draft, b: Draft, gap: str) -> Draft:
        text = a.text + gap + b.text
        subs = _distinct([*a.subsections, *(s for s in b.subsections if s.strip())])
        return Draft(text, a.kinds | b.kinds, a.heading or b.heading, a.section, subs, max(a.level, b.level), a.boundary, _distinct([*a.pages, *b.pages], key=lambda p: p.id), self.count([(a.text, a.tokens), (b.text, b.tokens)], gap))

    def fits(self, current: Draft, together: Draft, unit: Draft) -> bool:
        """The target is soft: a little over it beats a small remainder on either side."""
        return together.tokens <= self.target or (together.tokens <= self.limit and (current.tokens < self.preferred or unit.tokens < self.useful))

    def packed(self, units: list[Unit]) -> list[Draft]:
        out: list[Draft] = []
        for unit in units:
            new = self.draft(unit, "")
            if out and unit.opens != "section":
                together = self.joined(out[-1], new, unit.gap)
                if self.fits(out[-1], together, new):
                    out[-1] = together
                    continue
                boundary = "same_section_structural_split" if unit.opens == "subsection" else "same_topic_token_limit"
            else:
                boundary = "new_section" if out else "document_start"
            if unit.text.strip():
                out.append(replace(new, boundary=boundary))
        return out

    @staticmethod
    def _continues(a: Draft, b: Draft) -> bool:
        return b.boundary.startswith("same_") and a.section == b.section

    @staticmethod
    def _gap(a: Draft, b: Draft) -> str:
        return "\n" if "CODE" in a.kinds and "CODE" in b.kinds else "\n\n"

    def balanced(self, drafts: list[Draft]) -> list[Draft]:
        """A small chunk joins the one before it, or takes in the one after it, within its section and the limit."""
        out, k = list(drafts), 0
        while k < len(out):
            if out[k].tokens < self.preferred:
                for left in (k - 1, k):
                    if 0 <= left and left + 1 < len(out) and self._continues(out[left], out[left + 1]):
                        both = self.joined(out[left], out[left + 1], self._gap(out[left], out[left + 1]))
                        if both.tokens <= self.limit:
                            out[left : left + 2] = [both]
                            k = left
                            break
                else:
                    k += 1
                continue
            k += 1
        return out

    def bridge(self, previous: Draft) -> str:
        """The end of a chunk, whole sentences or one whole list or code block, within the overlap's limit."""
        block = previous.text.rsplit("\n\n", 1)[-1].strip()
        if kind_of(block) in ("CODE", "LIST"):
            return block if self.estimate(block) <= self.overlap_limit else ""
        taken: list[str] = []
        for sentence in reversed(sentences_of(" ".join(block.split()))):
            if self.estimate(" ".join([sentence, *taken])) > self.overlap_limit:
                break
            taken.insert(0, sentence)
        return " ".join(taken)

    def overlapped(self, drafts: list[Draft]) -> list[Draft]:
        out = drafts[:1]
        for previous, current in zip(drafts, drafts[1:], strict=False):
            if self._continues(previous, current):
                title = previous.section if previous.section and self.estimate(previous.section) <= self.overlap_limit else ""
                split = current.boundary == "same_section_structural_split"
                lead = (title if split else "") or self.bridge(previous) or title
                gap, tokens = self._gap(previous, current), self.estimate(lead)
                if lead.strip() and self.count([(lead, tokens), (current.text, current.tokens)], gap) <= self.limit:
                    current = replace(current, text=lead + gap + current.text, overlap=tokens)
            out.append(current)
        return out

    def chunks(self, pages: Iterable[tuple[Page, str]]) -> list[Draft]:
        out = self.overlapped(self.balanced(self.packed(self.units(pages))))
        if self.max_chunks is not None and len(out) > self.max_chunks:
            raise ValueError(f"document has {len(out)} chunks, more than {self.max_chunks}")
        return out


DRAFT_SCHEMA = (
    "document_key string, chunk_index int, text string, contains_code boolean, contains_list boolean, contains_heading boolean, section_title string, "
    "subsection_titles array<string>, max_heading_level int, structural_boundary string, source_document_ids array<string>, page_numbers array<int>, "
    "content_token_count int, overlap_token_count int, estimated_token_count int, source_original_character_count int, source_cleaned_character_count int, ingestion_fingerprint string, problem string"
)


def chunk_pages(cleaned: DataFrame, estimate: Estimate = default_estimate, max_chunks: int | None = None) -> DataFrame:
    """All chunks of every document of ``cleaned`` (the output of ``clean_pages``), with all metadata; with ``max_chunks``, none of a document that has more."""
    return with_chunk_metadata(drafts(cleaned, estimate, max_chunks).filter("problem IS NULL").drop("problem"))


def refused_documents(cleaned: DataFrame, estimate: Estimate = default_estimate, max_chunks: int = P.MAX_CHUNKS) -> DataFrame:
    """document_key, problem of the documents that have too many chunks; they don't keep the others back."""
    return drafts(cleaned, estimate, max_chunks).filter("problem IS NOT NULL").select("document_key", "problem")


def drafts(cleaned: DataFrame, estimate: Estimate = default_estimate, max_chunks: int | None = P.MAX_CHUNKS) -> DataFrame:
    """The rows of ``DRAFT_SCHEMA``: chunks, or one row that tells the problem of a refused document."""
    # dealt by document before the window, which needs no exchange of its own then; documents are told apart in the stream
    dealt = cleaned.withColumn("document_key", F.col("document_key").cast("string")).repartition("document_key")
    pages = dealt.select(
        "document_key",
        F.coalesce(T.lenient_int(F.col("page_number")), F.row_number().over(W.partitionBy("document_key").orderBy("page_number", "page_id"))).alias("page_number"),
        F.col("page_id").cast("string").alias("page_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("source_original_character_count", F.lit(0)).alias("original"),
        F.coalesce("source_cleaned_character_count", F.lit(0)).alias("cleaned"),
    )
    columns = [c.strip().split(" ")[0] for c in DRAFT_SCHEMA.split(", ")]
    additive = getattr(estimate, "additive", False)

    def fold(key: str | None, source: list[tuple[Page, str]]) -> Iterator[tuple]:
        try:
            drafts = Chunker(estimate, max_chunks=max_chunks).chunks(source)
        except ValueError as e:
            yield (key, *[None] * (len(columns) - 2), str(e))
            return
        # as identity.ingestion_fingerprints has it, while the document's chunks are together
        whole = hashlib.sha256((key or "").encode() + b"".join(b"\x1f" + d.text.encode("utf-8", "replace") for d in drafts)).hexdigest()
        for k, d in enumerate(drafts):
            yield (
                key, k, d.text, "CODE" in d.kinds, "LIST" in d.kinds, d.heading, d.section or "", list(d.subsections), d.level, d.boundary,
                [p.id for p in d.pages], list(dict.fromkeys(p.number for p in d.pages)), d.tokens, d.overlap, d.tokens + d.overlap if additive else estimate(d.text), sum(p.original for p in d.pages), sum(p.cleaned for p in d.pages), whole, None,
            )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple = ()
        source: list[tuple[Page, str]] = []
        made: list[tuple] = []
        # a refused document has no numbers: the columns take them as they are
        frame = lambda rows: pd.DataFrame(rows, columns=columns, dtype=object)
        for rows in batches:
            for key, number, page, text, original, kept in zip(*(rows[c] for c in ("document_key", "page_number", "page_id", "text", "original", "cleaned")), strict=True):
                if (key,) != at:
                    if source:
                        made += fold(at[0], source)
                    at, source = (key,), []
                source.append((Page(page, int(number), int(original), int(kept)), text))
            if made:
                yield frame(made)
                made = []
        if source:
            yield frame(list(fold(at[0], source)))

    return pages.sortWithinPartitions("document_key", "page_number", "page_id").mapInPandas(run, DRAFT_SCHEMA)


def with_chunk_metadata(drafts: DataFrame) -> DataFrame:
    """What follows from a draft and its neighbours: pages, paths, counts per page, flags."""
    start = F.array_min("page_numbers")
    d = drafts.withColumns({
        "page_number": start,
        "start_page_number": start,
        "end_page_number": F.array_max("page_numbers"),
        "spans_pages": F.size("page_numbers") > 1,
        "source_document_id": F.get("source_document_ids", 0),
        "source_page_count": F.size("source_document_ids"),
        "heading_path": F.concat(F.when(F.trim("section_title") != "", F.array("section_title")).otherwise(F.array().cast("array<string>")), "subsection_titles"),
        "chunk_character_count": F.length("text"),
        "starts_new_topic": (F.col("structural_boundary") == "new_section") | ((F.col("structural_boundary") == "document_start") & F.col("contains_heading")),
        "overlap_applied": F.col("overlap_token_count") > 0,
        "overlap_source_chunk_index": F.when(F.col("overlap_token_count") > 0, F.col("chunk_index") - 1),
    })
    in_order = W.partitionBy("document_key").orderBy("chunk_index")
    on_page = W.partitionBy("document_key", "start_page_number")
    return d.withColumns({
        "page_chunk_index": F.row_number().over(on_page.orderBy("chunk_index")) - 1,
        "page_chunk_count": F.count(F.lit(1)).over(on_page).cast("int"),
        "continues_from_previous_page": F.coalesce((F.lag("section_title").over(in_order) == F.col("section_title")) & (F.col("start_page_number") > F.lag("start_page_number").over(in_order)), F.lit(False)),
    })
