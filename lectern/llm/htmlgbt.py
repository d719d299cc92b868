"""Main text of web pages by gradient-boosted trees over DOM nodes.

The page is read into a tree of block elements whose leaves are runs of text. Every node gets
features of its subtree (characters, density of text, links and punctuation), of its tag and its
attribute tokens, of its depth, its ancestors and its siblings. Boosted trees give the odds that
the node holds main text. Decoding is hierarchical: a node can only be kept if its parent is, and
the labelling of the largest total log-odds under that rule is found in one pass up and one down,
so no ancestor contradicts a descendant.

The trees are fitted on the driver, in a few seconds, on pages made up by a seeded generator
(:func:`made_up_pages`): many layouts, with and without speaking tags. Nothing of the corpus is
needed, and every page gets the same model at any size.

Defined cases: null html is empty and gives empty text; comments, scripts, styles, the fields of forms
and the head never give text (what else stands in a form is judged by the trees, as some pages are one
form); unclosed and stray tags are mended as browsers do; a line break inside a block is white space; a
very long page is read in time and memory proportional to its length, however deep its tags; rows are taken each
on its own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>?", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?]")

#: fixed: elements of HTML
SKIPPED = frozenset("script style noscript template svg math head title textarea select option button iframe object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HOLDS_P = ("td", "th", "li", "blockquote")
ITEMS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tr td th thead tbody", "table"), "thead": ("", "table")}
ITEMS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ITEMS.items()}

#: words of attributes (and tags) that speak for one kind of block each
KINDS = (
    frozenset("nav navigation menu navbar breadcrumb breadcrumbs pagination pager toc skip".split()),
    frozenset("ad ads advert adverts advertisement sponsor sponsored promo promoted banner adsense commercial".split()),
    frozenset("header footer masthead copyright foot topbar legal logo".split()),
    frozenset("sidebar aside side rail widget related recommended recommendations trending popular more".split()),
    frozenset("cookie cookies notice consent gdpr alert popup modal overlay subscribe newsletter paywall".split()),
    frozenset("form search login signup input fieldset share social sharing follow buttons toolbar tools".split()),
    frozenset("comment comments reply replies respond disqus discussion responses reader readers".split()),
    frozenset("article content main post entry story body text page articlebody prose blog".split()),
)
TAGS = ("p", "h1", "h", "li", "list", "td", "table", "article", "main", "section", "div", "body", "text")


def _flags(tag: str, attributes: str) -> int:
    words = {tag}
    for m in _ATTRIBUTE.finditer(attributes):
        words.update(t.lower() for t in _TOKEN.findall(m[2] or m[3] or m[4] or ""))
    return sum(1 << k for k, kind in enumerate(KINDS) if words & kind)


_flags_of: dict[tuple[str, str], int] = {}


def flags(tag: str, attributes: str) -> int:
    if not attributes or len(attributes) > 300:
        return _flags(tag, attributes)
    f = _flags_of.get((tag, attributes))
    if f is None:
        if len(_flags_of) > 50_000:
            _flags_of.clear()
        f = _flags_of[tag, attributes] = _flags(tag, attributes)
    return f


def _tag_class(tag: str) -> int:
    if tag in ("ul", "ol", "dl", "menu"):
        tag = "list"
    elif tag in ("td", "th"):
        tag = "td"
    elif tag in ("table", "tr", "tbody"):
        tag = "table"
    elif tag in ("dt", "dd"):
        tag = "li"
    elif len(tag) == 2 and tag[0] == "h" and tag[1] in "23456":
        tag = "h"
    return TAGS.index(tag) if tag in TAGS else len(TAGS)


class Page:
    """Nodes of a page in document order: parent, end of the subtree, tag class, flags, depth, text of leaves."""

    def __init__(self, source: str):
        self.parent, self.end, self.tag, self.flag, self.above, self.depth = [-1], [0], [_tag_class("body")], [0], [0], [0]
        self.text: list[str | None] = [None]
        self.linked: list[int] = [0]
        self._read(source)

    def _node(self, parent: int, tag: int, flag: int, text: str | None, linked: int) -> int:
        self.parent.append(parent)
        self.end.append(0)
        self.tag.append(tag)
        self.flag.append(flag)
        self.above.append(self.above[parent] | self.flag[parent])
        self.depth.append(self.depth[parent] + 1)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack, names = [0], ["#root"]
        places: dict[str, list[int]] = {}  # of each open tag's name: its places in the stack, rising
        parts: list[str] = []
        link, linked, at = 0, 0, 0
        leaf = _tag_class("text")
        unclosed: set[str] = set()  # tags with no end tag in the rest of the page

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    k = self._node(stack[-1], leaf, 0, text, min(linked, len(text)))
                    self.end[k] = k + 1
                parts.clear()
            linked = 0

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                self.end[stack.pop()] = len(self.parent)
                places.get(names.pop(), _NONE).pop()

        def last(tags: Iterable[str]) -> int:
            """The highest place of any of the tags, 0 (the root's) if none is open."""
            return max((places[x][-1] for x in tags if places.get(x)), default=0)

        def say(raw: str) -> None:
            nonlocal linked
            if raw:
                text = _html.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if link:
                    linked += len(text)

        find = _TAG.search
        n = len(source)
        while at < n:
            m = find(source, at)
            if m is None:
                say(source[at:])
                break
            say(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            closing = m[1]
            if tag in INLINE:
                if tag == "a":
                    link = 0 if closing else 1
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    parts.append(" ")
                continue
            if tag in SKIPPED:
                if not closing and tag != "head":  # the head's elements are skipped by name; it may lack an end
                    close = None if tag in unclosed else _CLOSERS[tag].search(source, at)
                    if close:
                        at = close.end()
                    else:
                        unclosed.add(tag)
                        at = n if tag in ("script", "style") else at
                continue
            flush()
            if closing:
                if places.get(tag):
                    pop_to(places[tag][-1])
                link = 0 if tag in ENDS_P else link
                continue
            if tag in ENDS_P and places.get("p"):
                k = places["p"][-1]
                if last(HOLDS_P) < k:
                    pop_to(k)
            if tag in ITEMS:
                shut, stop = ITEMS[tag]
                barrier = last(stop)
                ends = [x[bisect_right(x, barrier)] for x in (places.get(t, _NONE) for t in shut) if x and x[-1] > barrier]
                if ends:
                    pop_to(min(ends))
            places.setdefault(tag, []).append(len(stack))
            stack.append(self._node(stack[-1], _tag_class(tag), flags(tag, m[3]), None, 0))
            names.append(tag)
        flush()
        pop_to(1)
        self.end[0] = len(self.parent)


_NONE: list[int] = []
_CLOSERS = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in SKIPPED}


def features(pages: list[Page]) -> np.ndarray:
    """(nodes of all pages, features)."""
    sizes = np.array([len(p.parent) for p in pages])
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    col = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.int64)
    parent, end, tag, flag, above, depth, linked = (col(c) for c in ("parent", "end", "tag", "flag", "above", "depth", "linked"))
    texts = [x for p in pages for x in p.text]
    n = len(texts)
    me = np.arange(n)
    up = np.where(parent < 0, me, parent + base)
    stop = end + base
    chars = np.array([len(x) if x else 0 for x in texts], float)
    words = np.array([x.count(" ") + 1 if x else 0 for x in texts], float)
    marks = np.array([len(_PUNCTUATION.findall(x)) if x else 0 for x in texts], float)
    leaf = chars > 0

    def below(x: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(x)])
        return run[stop] - run[me]

    c, w, m, l, k = below(chars), below(words), below(marks), below(linked.astype(float)), below(leaf.astype(float))
    nodes = (stop - me).astype(float)
    root = me == base
    page_chars = np.maximum(1, c[base])
    before = np.concatenate([[0], np.cumsum(chars)])[me] - np.concatenate([[0], np.cumsum(chars)])[base]
    children = np.bincount(up[~root], minlength=n).astype(float)
    # place among siblings: a stable sort by parent keeps the document order
    order = np.argsort(up, kind="stable")
    first = np.r_[True, up[order][1:] != up[order][:-1]]
    rank = np.empty(n)
    rank[order] = me - np.maximum.accumulate(np.where(first, me, 0))
    left, right = np.zeros(n), np.zeros(n)
    same = ~first[1:]
    left[order[1:][same]] = c[order[:-1][same]]
    right[order[:-1][same]] = c[order[1:][same]]
    alike = np.bincount(up * 32 + tag, minlength=32 * n)[up * 32 + tag].astype(float)
    one = lambda x: np.maximum(1, x)
    out = [
        depth, np.log1p(c), l / one(c), c / one(w), m / one(w), c / nodes, np.log1p(k), children, children[up], rank / one(children[up]),
        c / one(c[up]), before / page_chars, c / page_chars, np.log1p(left), np.log1p(right), alike / one(children[up]), l[up] / one(c[up]), m[up] / one(w[up]), c[up] / one(nodes[up]), tag, tag[up],
    ]
    out += [(flag >> i) & 1 for i in range(len(KINDS))] + [(above >> i) & 1 for i in range(len(KINDS))]
    return np.stack([np.asarray(x, np.float32) for x in out], 1)


class Trees:
    """Gradient-boosted complete trees for the log loss, fitted on histograms."""

    def __init__(self, depth: int = 4, count: int = 60, rate: float = 0.2, bins: int = 32):
        self.depth, self.count, self.rate, self.bins = depth, count, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(f)], 1)
        offset = np.arange(f) * self.bins
        self.start = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
        z = np.full(n, self.start)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature, self.cut, self.value = np.zeros((self.count, inner), np.int64), np.full((self.count, inner), np.inf, np.float32), np.zeros((self.count, leaves))
        for t in range(self.count):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p) + 1e-6
            at = np.zeros(n, np.int64)
            for d in range(self.depth):
                k = 2**d
                cell = (at[:, None] * f * self.bins + offset + binned).ravel()
                size = k * f * self.bins
                gs = np.cumsum(np.bincount(cell, np.repeat(g, f), size).reshape(k, f, self.bins), axis=2)
                hs = np.cumsum(np.bincount(cell, np.repeat(h, f), size).reshape(k, f, self.bins), axis=2)
                G, H = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                gain[(hs < 2) | (H - hs < 2)] = 0
                best = gain.reshape(k, -1).argmax(1)
                j, b = best // self.bins, best % self.bins
                for q in range(k):
                    if gain[q, j[q], b[q]] > 1e-3 and b[q] < len(cuts[j[q]]):
                        self.feature[t, k - 1 + q], self.cut[t, k - 1 + q] = j[q], cuts[j[q]][b[q]]
                node = k - 1 + at
                at = 2 * at + (x[np.arange(n), self.feature[t, node]] > self.cut[t, node])
            G, H = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
            self.value[t] = self.rate * G / (H + 1)
            z += self.value[t, at]
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        z = np.full(len(x), self.start)
        row = np.arange(len(x))
        for t in range(self.count):
            at = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                node = 2**d - 1 + at
                at = 2 * at + (x[row, self.feature[t, node]] > self.cut[t, node])
            z += self.value[t, at]
        return z


def decode(parent: list[int], odds: list[float]) -> list[bool]:
    """The labelling of the largest total log-odds in which no kept node has a parent that is not."""
    total = list(odds)
    for k in range(len(parent) - 1, 0, -1):
        if total[k] > 0:
            total[parent[k]] += total[k]
    keep = [True] * len(parent)  # the root only holds the page
    for k in range(1, len(parent)):
        keep[k] = total[k] > 0 and keep[parent[k]]
    return keep


MARK = "\ue000"


def made_up_pages(count: int = 400, seed: int = 11) -> list[str]:
    """Pages of many layouts; the words of the main text carry ``MARK``."""
    r = np.random.default_rng(seed)
    syllables = "an the or ti re en de la con mi sto ber ung ier que ción é ü ra lo no pe sa tu".split()
    pick = lambda *a: a[r.integers(len(a))]
    chance = lambda p: r.random() < p

    def words(n: int, marks: bool = True) -> str:
        out = []
        for _ in range(n):
            w = "".join(syllables[i] for i in r.integers(len(syllables), size=r.integers(1, 4)))
            out.append(w + (pick(".", ",", ".", "!", "&amp;", "?") if marks and chance(0.15) else ""))
        return " ".join(out) + ("." if marks and chance(0.8) else "")

    def main_words(n: int) -> str:
        junk = chance(0.1)
        return MARK + words(n, not junk or chance(0.5))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{words(1, False)}">{words(int(r.integers(1, 4)), False)}</a></li>' for _ in range(n))

    def name(kind: str) -> str:
        sets = {
            "nav": ("nav", "menu", "main-menu", "breadcrumbs", "navbar"), "ad": ("ad", "ads", "advert", "sponsored", "promo-box", "ad-slot"), "head": ("header", "site-header", "masthead", "top"),
            "foot": ("footer", "site-footer", "copyright", "legal"), "side": ("sidebar", "widget", "related", "rail", "trending"), "note": ("cookie-notice", "notice", "consent", "alert", "newsletter"),
            "form": ("search", "login", "subscribe", "share", "social"), "comment": ("comments", "comment-list", "replies", "respond", "reader-comments"),
            "main": ("content", "post", "entry-content", "article-body", "story", "main", "post-text"), "none": ("", "wrap", "row", "col-8", "x1", "inner", "box"),
        }
        return pick(*sets[kind])

    def box(kind: str, inner: str, tags: tuple[str, ...] = ("div",)) -> str:
        tag = pick(*tags)
        token = name(kind) if tag in ("div", "section", "ul", "p") or chance(0.4) else ""
        attribute = pick(f' class="{token}"', f' id="{token}"', f" class='{token}'") if token else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def junk(kind: str) -> str:
        some = lambda a, b: int(r.integers(a, b))
        if kind == "nav":
            return box("nav", f"<ul>{links(some(3, 12))}</ul>", ("nav", "nav", "div", "ul"))
        if kind == "ad":
            return box("ad", pick(words(some(3, 30)), f"<p>{words(some(3, 30))}</p>", f'<a href="/x">{words(some(2, 8))}</a>'), ("div", "div", "aside", "section"))
        if kind == "head":
            return box("head", pick(f"<a href='/'>{words(2, False)}</a>", words(some(1, 12)), f"<p>{words(some(2, 9))}</p><ul>{links(some(2, 7))}</ul>"), ("header", "header", "div"))
        if kind == "foot":
            return box("foot", pick(f"&copy; {words(some(2, 12))}", f"<p>&copy; {words(some(2, 15))}</p><ul>{links(some(2, 8))}</ul>"), ("footer", "footer", "div"))
        if kind == "side":
            return box("side", f"<h3>{words(2, False)}</h3>" + pick(f"<ul>{links(some(3, 9))}</ul>", f"<p>{words(some(8, 40))}</p>"), ("aside", "aside", "div", "section"))
        if kind == "note":
            return box("note", pick(words(some(8, 30)), f"<p>{words(some(8, 30))}</p>"), ("div", "div", "section", "p"))
        if kind == "form":
            return pick(f"<form action='/s'><label>{words(2, False)}</label><input name='q'><button>{words(1, False)}</button><p>{words(some(2, 9))}</p></form>", box("form", f"<ul>{links(some(2, 5))}</ul>"))
        posts = "".join(pick(f"<p>{words(some(4, 50))}</p>", f"<div class='comment'><b>{words(1, False)}</b><p>{words(some(4, 50))}</p></div>", f"<li>{words(some(4, 40))}</li>") for _ in range(some(1, 7)))
        return box("comment", pick("", f"<h3>{words(2, False)}</h3>") + posts, ("section", "div", "div", "ul"))

    def body() -> str:
        title = int(r.integers(2, 12))
        out = [f"<h1>{main_words(title)}</h1>"] if chance(0.8) else []
        for _ in range(int(r.choice([1, 2, 3, 5, 8, 13, 25]))):
            n = int(r.choice([1, 2, 4, 8, 15, 30, 60, 120, 250]))
            x = r.random()
            if x < 0.72:
                out.append(pick("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<p><a href='/r'>" + main_words(2) + "</a> {}</p>").format(main_words(n)))
            elif x < 0.8:
                out.append(f"<h2>{main_words(int(r.integers(1, 8)))}</h2>")
            elif x < 0.87:
                tag = pick("ul", "ol")
                out.append(f"<{tag}>" + "".join(f"<li>{main_words(int(r.integers(2, 25)))}</li>" for _ in range(int(r.integers(2, 7)))) + f"</{tag}>")
            elif x < 0.91:
                out.append(f"<blockquote><p>{main_words(n)}</p></blockquote>")
            elif x < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{main_words(3)}</td><td>{main_words(4)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.94:
                out.append(f"<pre>{main_words(n)}</pre>")
            else:
                out.append(junk(pick("ad", "side", "form", "note", "ad")))
        return "".join(out)

    pages = []
    for _ in range(count):
        kind = r.random()
        inner = body()
        if kind < 0.45:
            main = f"<article>{inner}</article>"
        elif kind < 0.6:
            main = pick(f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<article><section>{inner}</section></article>")
        elif kind < 0.88:
            main = box("main", inner, ("div", "div", "section"))
        else:
            main = box("none", inner)
        if chance(0.3):
            main = box("none", main + (junk("comment") if chance(0.3) else "") + (junk("side") if chance(0.3) else ""))
        head = "".join(junk(k) for k in ("head", "nav", "note", "ad", "form") if chance(0.5))
        tail = "".join(junk(k) for k in ("side", "comment", "ad", "nav", "note", "foot") if chance(0.5))
        style = "<head><meta charset='utf-8'><title>" + words(4) + "</title><style>p{margin:0}</style><script>var t=\"</p>\";</script></head>" if chance(0.7) else ""
        page = f"<!DOCTYPE html><html>{style}<body>{head}{main}{tail}</body></html>"
        pages.append(page if chance(0.85) else page[: page.rfind("</body>")])
    return pages


@lru_cache(maxsize=1)
def fitted_trees() -> Trees:
    pages = [Page(x) for x in made_up_pages()]
    x = features(pages)
    y = []
    for p in pages:
        run = np.concatenate([[0], np.cumsum([MARK in t if t else False for t in p.text])])
        y.append(run[np.array(p.end)] > run[np.arange(len(p.parent))])
    return Trees().fit(x, np.concatenate(y).astype(float))


def main_texts(sources: list[str], trees: Trees) -> list[str]:
    pages = [Page(x) for x in sources]
    if not pages:
        return []
    odds = trees.odds(features(pages))
    out, at = [], 0
    for p in pages:
        n = len(p.parent)
        keep = decode(p.parent, odds[at : at + n].tolist())
        at += n
        out.append("\n\n".join(t for t, k in zip(p.text, keep, strict=True) if t and k))
    return out


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    trees = fitted_trees()
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sources = [x or "" for x in rows["html"]]
            texts: list[str] = []
            at = 0
            while at < len(sources):  # a few pages at a time: their nodes are held together
                end, size = at, 0
                while end < len(sources) and (end == at or size + len(sources[end]) < 1 << 20):
                    size += len(sources[end])
                    end += 1
                texts += main_texts(sources[at:end], trees)
                at = end
            yield pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {id_type}, url string, text string, n_chars long")
