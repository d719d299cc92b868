"""SQL (for DuckDB) that cleaning and chunking must agree with: the same rules, as sets and list folds of their own.

The tables hold no block of code; where a line of code would decide, the SQL stops with an error instead of guessing.
"""

from __future__ import annotations

from collections.abc import Callable

from lectern.functions import patterns as P

_GAP = "chr(10) || chr(10)"


def pages_sql(lines_per_page: int) -> str:
    """CTEs ``lines``, ``numbered``, ``paged`` (document_key, source, page_number, text)."""
    n = lines_per_page
    return f"""lines AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    numbered AS (SELECT doc_id, source, ls, unnest(range(1, CAST(ceil(len(ls) / {n}.0) AS BIGINT) + 1)) AS page_number FROM lines),
    paged AS (SELECT CAST(doc_id AS VARCHAR) AS document_key, source, CAST(page_number AS INTEGER) AS page_number, array_to_string(list_slice(ls, (page_number - 1) * {n} + 1, page_number * {n}), chr(10)) AS text FROM numbered)"""


NORMAL_LINE = r"""CASE WHEN regexp_matches(l, '^\s*$') THEN '' ELSE repeat(' ', least(40, length(regexp_extract(l, '^\s*')) + 3 * (length(regexp_extract(l, '^\s*')) - length(replace(regexp_extract(l, '^\s*'), chr(9), '')))))
      || regexp_replace(regexp_replace(regexp_replace(l, '^\s+', ''), '[\p{Zs}\t\x0B\f]+', ' ', 'g'), '\s+$', '') END"""
CANONICAL = r"trim(lower(regexp_replace(line, '(?i)\bpage\s+\d+\s+(?:of|/)\s*\d+\b', 'page # of #', 'g')))"
_NUMBER = r"^(\d+(?:\.\d+)*)[.)]?\s+(.+)$"
_CHILD = "(?i)^(concept|how it works|practical considerations?|examples?|engineering notes?|chunking checkpoints?)$"
_LIST = rf"^([{P.BULLETS}]|\d+[.)]|[A-Za-z][.)])\s+.+$"
_PAGE_NUMBER = r"(?i)^\s*(page\s+)?[-–—]?\s*(\d+|[ivxlcdm]+)(\s*(of|/)\s*\d+)?\s*[-–—]?\s*$"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def title_like(c: str) -> str:
    words = rf"string_split_regex({c}, '\s+')"
    lettered = rf"len(list_filter({words}, lambda w: regexp_matches(w, '\p{{L}}')))"
    upper = rf"len(list_filter({words}, lambda w: regexp_matches(w, '^[^\p{{L}}]*\p{{Lu}}')))"
    return f"(len({words}) <= 14 AND NOT regexp_matches({c}, '[.?!;:{{}}]$') AND {lettered} > 0 AND 2 * {upper} >= {lettered})"


def explicit_heading(c: str) -> str:
    number, rest = f"regexp_extract({c}, '{_NUMBER}', 1)", f"regexp_extract({c}, '{_NUMBER}', 2)"
    return rf"(regexp_matches({c}, '^#{{1,6}}\s+.+$') OR regexp_matches({c}, '{_CHILD}') OR ({number} <> '' AND (contains({number}, '.') OR {title_like(rest)})))"


def code_line(c: str, words: list[str]) -> str:
    keyword = rf"(regexp_matches({c}, '^({'|'.join(words)})\b.*$') AND regexp_matches({c}, '[;{{}}(]'))"
    call = rf"regexp_matches({c}, '^(([\w.$<>?\[\],]+\s+)+\w+\s*=.+;|[\w.$]+\s*\([^;]*\);)$')"
    return f"({c} IN ('{{', '}}') OR starts_with({c}, '@') OR {keyword} OR {call} OR (contains({c}, '->') AND (contains({c}, '=') OR ends_with({c}, ';'))))"


def join_prose(x: str) -> str:
    return rf"replace(regexp_replace({x}, '-\n(\p{{Ll}})', '\1', 'g'), chr(10), ' ')"


def clean_sql() -> str:
    """CTEs up to ``cleaned`` (document_key, page_number, source, original, text, removed)."""
    return rf"""{pages_sql(40)},
    norm AS (SELECT document_key, source, page_number, text AS original, regexp_replace(regexp_replace(replace(text, chr(160), ' '), '\r\n?', chr(10), 'g'), '\n$', '') AS t FROM paged),
    ls AS (SELECT document_key, source, page_number, original, CASE WHEN t = '' THEN [] ELSE list_transform(string_split(t, chr(10)), lambda l: {NORMAL_LINE}) END AS ls FROM norm),
    l AS (SELECT document_key, page_number, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM ls),
    f AS (SELECT *, row_number() OVER (PARTITION BY document_key, page_number ORDER BY i) AS a, row_number() OVER (PARTITION BY document_key, page_number ORDER BY i DESC) AS z FROM l WHERE line <> ''),
    canon AS (SELECT *, {CANONICAL} AS c, a <= 3 OR z <= 3 AS margin, {strip("line")} AS s FROM f),
    n_pages AS (SELECT document_key, count(*) AS pages FROM paged GROUP BY document_key),
    rep AS (SELECT document_key, c FROM (SELECT DISTINCT document_key, page_number, c FROM canon WHERE margin AND c <> '') JOIN n_pages USING (document_key)
            GROUP BY document_key, c, pages HAVING pages >= 2 AND count(*) >= greatest(2, ceil(pages * 0.6))),
    judged AS (SELECT x.*, {explicit_heading("x.s")} AS heading, x.margin AND (r.c IS NOT NULL OR regexp_matches(x.line, '{_PAGE_NUMBER}')) AND NOT {explicit_heading("x.s")} AS gone
               FROM canon x LEFT JOIN rep r ON x.document_key = r.document_key AND x.c = r.c),
    kept AS (SELECT *, lag(i) OVER w AS pi, lag(heading) OVER w AS ph FROM judged WHERE NOT gone WINDOW w AS (PARTITION BY document_key, page_number ORDER BY i)),
    b AS (SELECT *, sum(CASE WHEN heading OR pi IS NULL OR pi <> i - 1 OR ph THEN 1 ELSE 0 END) OVER (PARTITION BY document_key, page_number ORDER BY i) AS block FROM kept),
    items AS (SELECT *, sum(CASE WHEN regexp_matches(s, '{_LIST}') THEN 1 ELSE 0 END) OVER (PARTITION BY document_key, page_number, block ORDER BY i) AS item, {code_line("s", P.CODE_WORDS_CLEANING)} AS code FROM b),
    joined AS (SELECT document_key, page_number, block, item, min(i) AS i, bool_and(heading) AS heading, count(*) AS n, count(*) FILTER (code) AS signals, {join_prose("string_agg(s, chr(10) ORDER BY i)")} AS s FROM items GROUP BY ALL),
    blocks AS (SELECT document_key, page_number, block, CASE WHEN NOT bool_and(heading) AND sum(signals) >= 1 AND (sum(signals) >= 2 OR 2 * sum(signals) >= sum(n)) THEN error('a block of code') ELSE string_agg(s, chr(10) ORDER BY i) END AS s
               FROM joined GROUP BY document_key, page_number, block),
    texts AS (SELECT document_key, page_number, {strip(f"string_agg(s, {_GAP} ORDER BY block)")} AS text FROM blocks GROUP BY document_key, page_number),
    removed AS (SELECT document_key, page_number, count(*) AS removed FROM judged WHERE gone GROUP BY document_key, page_number),
    cleaned AS (SELECT document_key, page_number, source, original, coalesce(text, '') AS text, coalesce(removed, 0) AS removed FROM ls LEFT JOIN texts USING (document_key, page_number) LEFT JOIN removed USING (document_key, page_number))"""


# ---- chunking: folds over lists ------------------------------------------------------------------------
_PIECE = r"(?:\p{L}{1,4}|\p{N}{1,3}|[^\s\p{L}\p{N}])"


def tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{_PIECE}'))"


_CLOSING = r"""[)\]"''’”]*\s+"""
_OPENING = r"""[^\x00-@\[-\x7F\p{Ll}]|[(\["“]"""


def sentences(x: str) -> str:
    marked = rf"regexp_replace(regexp_replace({x}, '(\.+{_CLOSING})({_OPENING})', '\1' || chr(1) || '\2', 'g'), '([!?]+{_CLOSING})', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda z: {strip('z')}), lambda z: z <> '')"


def by_tokens(x: str) -> str:
    """Windows of 250 tokens, ended at the last mark where one is at least 100 characters in."""
    pieces = rf"regexp_extract_all(s.rest, '\s*{_PIECE}')"
    low = f"list_sum(list_transform({pieces}[1:250], lambda y: length(y))) + length({pieces}[251]) - length(ltrim({pieces}[251]))"
    mark = rf"length(regexp_extract(substr(s.rest, 1, CAST({low} AS BIGINT)), '(?s)^.*[;}}\n]'))"
    cut = f"(CASE WHEN {mark} >= 101 THEN {mark} ELSE {low} END)"
    step = f"CASE WHEN {tokens('s.rest')} <= 250 THEN s ELSE {{'out': list_append(s.out, {strip(f'substr(s.rest, 1, CAST({cut} AS BIGINT))')}), 'rest': {strip(f'substr(s.rest, CAST({cut} AS BIGINT) + 1)')}}} END"
    run = f"list_reduce(range(0, length({x}) // 100 + 2), lambda s, i: {step}, {{'out': []::VARCHAR[], 'rest': {strip(x)}}})"
    return f"list_transform([{run}], lambda r: list_filter(list_append(r.out, r.rest), lambda y: y <> ''))[1]"


def gathered(pieces: str, gap: str, smaller: Callable[[str], str], v: str = "", is_open: Callable[[str], str] = lambda held: "FALSE") -> str:
    """Pieces gathered up to 250 tokens, and on while what is held ``is_open``; one of more than 300 is made ``smaller``. ``v`` tells the variables of nested folds apart."""
    s, p = f"s{v}", f"p{v}"
    closed = f"(CASE WHEN {s}.held = '' THEN {s}.out ELSE list_append({s}.out, {s}.held) END)"
    step = f"""CASE WHEN {p}.n > 300 THEN {{'out': list_concat({closed}, {smaller(f"{p}.t")}), 'held': '', 'n': 0}}
        WHEN {s}.held <> '' AND NOT {is_open(f"{s}.held")} AND {s}.n + {p}.n > 250 THEN {{'out': list_append({s}.out, {s}.held), 'held': {p}.t, 'n': {p}.n}}
        ELSE {{'out': {s}.out, 'held': CASE WHEN {s}.held = '' THEN {p}.t ELSE {s}.held || {gap} || {p}.t END, 'n': {s}.n + {p}.n}} END"""
    counted = f"list_transform({pieces}, lambda z: {{'t': z, 'n': CAST({tokens('z')} AS BIGINT)}})"
    run = f"list_reduce({counted}, lambda {s}, {p}: {step}, {{'out': []::VARCHAR[], 'held': '', 'n': CAST(0 AS BIGINT)}})"
    return f"list_transform([{run}], lambda r: CASE WHEN r.held = '' THEN r.out ELSE list_append(r.out, r.held) END)[1]"


def prose(x: str, v: str = "") -> str:
    return f"CASE WHEN {tokens(x)} <= 250 THEN [{x}] ELSE {gathered(sentences(x), repr(' '), by_tokens, v)} END"


def listing(x: str) -> str:
    items = f"list_filter(list_transform(string_split({x}, chr(10)), lambda z: {strip('z')}), lambda z: z <> '')"
    return f"CASE WHEN {tokens(x)} <= 300 THEN [{x}] ELSE {gathered(items, 'chr(10)', lambda y: '(' + prose(y) + ')', '0')} END"


def count_of(x: str, mark: str) -> str:
    return f"(length({x}) - length(replace({x}, '{mark}', '')))"


def statements(x: str) -> str:
    """Runs of lines that end with a whole declaration or body at the outer two levels."""
    held = "CASE WHEN s.k = 0 THEN l ELSE s.held || chr(10) || l END"
    braces, parens = (f"s.{v} + {count_of('l', a)} - {count_of('l', b)}" for v, a, b in (("b", "{", "}"), ("p", "(", ")")))
    step = rf"""CASE WHEN {parens} <= 0 AND {braces} <= 1 AND regexp_matches(l, '[;}}]\s*$') THEN {{'units': list_append(s.units, {strip(held)}), 'held': '', 'k': 0, 'b': {braces}, 'p': {parens}}}
        ELSE {{'units': s.units, 'held': {held}, 'k': s.k + 1, 'b': {braces}, 'p': {parens}}} END"""
    run = f"list_reduce(string_split({x}, chr(10)), lambda s, l: {step}, {{'units': []::VARCHAR[], 'held': '', 'k': 0, 'b': CAST(0 AS BIGINT), 'p': CAST(0 AS BIGINT)}})"
    return f"list_transform([{run}], lambda r: list_filter(list_append(r.units, {strip('r.held')}), lambda y: y <> ''))[1]"


def code(x: str) -> str:
    """A block of code in parts: whole statements, one that is too large by its lines, never inside parentheses, a line that is too long by tokens."""
    inside = lambda held: f"({count_of(held, '(')} <> {count_of(held, ')')})"
    by_lines = lambda unit: gathered(f"string_split({unit}, chr(10))", "chr(10)", by_tokens, "2", inside)
    return f"CASE WHEN {tokens(x)} <= 300 THEN [{x}] ELSE {gathered(statements(x), 'chr(10)', by_lines, '1')} END"


_PAGE = "STRUCT(id VARCHAR, n INTEGER, original BIGINT, cleaned BIGINT)"
_UNIT = f"STRUCT(text VARCHAR, kind VARCHAR, page {_PAGE}, section VARCHAR, subsection VARCHAR, level INTEGER, opens VARCHAR, gap VARCHAR, n BIGINT)"
_DRAFT = f"STRUCT(text VARCHAR, listed BOOLEAN, heading BOOLEAN, section VARCHAR, subs VARCHAR[], level INTEGER, boundary VARCHAR, pages {_PAGE}[], n BIGINT)"


def level(c: str) -> str:
    number = f"regexp_extract({c}, '{_NUMBER}', 1)"
    return rf"""CAST(CASE WHEN contains({c}, chr(10)) OR length({c}) > 140 OR {c} = '' THEN 0 WHEN {number} <> '' THEN length({number}) - length(replace({number}, '.', '')) + 1
        WHEN regexp_matches({c}, '^#{{1,6}}\s+.+$') THEN length(regexp_extract({c}, '^#+')) WHEN regexp_matches({c}, '{_CHILD}') THEN 2 WHEN {title_like(c)} THEN 2 ELSE 0 END AS INTEGER)"""


def kind(c: str) -> str:
    lines = f"list_filter(list_transform(string_split({c}, chr(10)), lambda y: {strip('y')}), lambda y: y <> '')"
    listed = f"(len(list_filter({lines}, lambda y: NOT regexp_matches(y, '{_LIST}'))) = 0)"
    signals = f"len(list_filter({lines}, lambda y: {code_line('y', P.CODE_WORDS_CHUNKING)}))"
    return f"""CASE WHEN {signals} >= 1 AND ({signals} >= 2 OR 2 * {signals} >= len({lines})) THEN error('a block of code') WHEN {listed} AND (len({lines}) > 1 OR contains('{P.BULLETS}', substr({lines}[1], 1, 1))) THEN 'LIST'
        WHEN {level(c)} > 0 THEN 'HEADING' WHEN {listed} THEN 'LIST' ELSE 'PROSE' END"""


def _draft(**fields: str) -> str:
    names = ("text", "listed", "heading", "section", "subs", "level", "boundary", "pages", "n")
    return "{" + ", ".join(f"'{k}': {fields[k]}" for k in names) + "}"


def _union(a: str, b: str) -> str:
    return f"list_concat({a}, list_filter({b}, lambda y: NOT list_contains({a}, y)))"


def _joined(a: str, b: str, gap: str) -> str:
    return _draft(
        text=f"{a}.text || {gap} || {b}.text", listed=f"{a}.listed OR {b}.listed", heading=f"{a}.heading OR {b}.heading", section=f"{a}.section", subs=_union(f"{a}.subs", f"{b}.subs"),
        level=f"greatest({a}.level, {b}.level)", boundary=f"{a}.boundary", pages=_union(f"{a}.pages", f"{b}.pages"), n=f"{a}.n + {b}.n",
    )


def chunk_sql() -> str:
    """CTEs up to ``chunks``: document_key, k (index), and a draft's fields with text and overlap as they are stored."""
    unit = "{{'text': {0}, 'kind': {1}, 'page': s.page, 'section': s.section, 'subsection': s.subsection, 'level': {2}, 'opens': {3}, 'gap': {4}, 'n': CAST(0 AS BIGINT)}}"
    flushed = f"(CASE WHEN s.chain <> '' AND s.page.id <> b.page.id THEN list_append(s.units, {unit.format('s.chain', repr('HEADING'), 's.level', 's.opens', _GAP)}) ELSE s.units END)"
    chain = "(CASE WHEN s.page.id = b.page.id THEN s.chain ELSE '' END)"
    new_section = "(b.level = 1 OR s.section IS NULL)"
    first = f"(i = 1 AND {chain} <> '')"
    part = f"""{{'text': CASE WHEN {first} THEN {chain} || {_GAP} || p ELSE p END, 'kind': b.kind, 'page': b.page, 'section': s.section, 'subsection': s.subsection, 'level': CASE WHEN {first} THEN s.level ELSE 0 END,
        'opens': CASE WHEN {first} THEN s.opens ELSE '' END, 'gap': CASE WHEN i = 1 OR {first} THEN {_GAP} WHEN b.kind = 'PROSE' THEN ' ' ELSE chr(10) END, 'n': CAST(0 AS BIGINT)}}"""
    step = f"""CASE WHEN b.kind = 'HEADING' THEN {{'units': {flushed}, 'page': b.page, 'section': CASE WHEN {new_section} THEN b.text ELSE s.section END, 'subsection': CASE WHEN {new_section} THEN NULL ELSE b.text END,
            'chain': CASE WHEN {chain} = '' THEN b.text ELSE {chain} || {_GAP} || b.text END, 'opens': CASE WHEN {new_section} THEN 'section' WHEN {chain} <> '' THEN s.opens ELSE 'subsection' END, 'level': b.level}}
        ELSE {{'units': list_concat({flushed}, list_transform(b.parts, lambda p, i: {part})), 'page': b.page, 'section': s.section, 'subsection': s.subsection, 'chain': '', 'opens': '', 'level': 0}} END"""
    state = f"STRUCT(units {_UNIT}[], page {_PAGE}, section VARCHAR, subsection VARCHAR, chain VARCHAR, opens VARCHAR, level INTEGER)"
    start = f"CAST({{'units': [], 'page': {{'id': '', 'n': 0, 'original': 0, 'cleaned': 0}}, 'section': NULL, 'subsection': NULL, 'chain': '', 'opens': '', 'level': 0}} AS {state})"
    fresh = _draft(
        text="u.text", listed="u.kind = 'LIST'", heading="u.level > 0", section="u.section", subs="CASE WHEN trim(coalesce(u.subsection, '')) <> '' THEN [u.subsection] ELSE []::VARCHAR[] END", level="u.level",
        boundary="CASE WHEN len(s) = 0 THEN 'document_start' WHEN u.opens = 'section' THEN 'new_section' WHEN u.opens = 'subsection' THEN 'same_section_structural_split' ELSE 'same_topic_token_limit' END", pages="[u.page]", n="u.n",
    )
    last = "s[len(s)]"
    together = _joined(last, f"list_transform([{fresh}], lambda d: d)[1]", "u.gap")
    packed = f"""CASE WHEN len(s) > 0 AND u.opens <> 'section' AND ({last}.n + u.n <= 250 OR ({last}.n + u.n <= 300 AND ({last}.n < 180 OR u.n < 80))) THEN list_append(list_slice(s, 1, len(s) - 1), {together})
        ELSE list_append(s, {fresh}) END"""
    goes_on = lambda a, b: f"(starts_with({b}.boundary, 'same_') AND {a}.section IS NOT DISTINCT FROM {b}.section AND {a}.n + {b}.n <= 300)"
    at = lambda j: f"s.out[s.k + {j}]"
    merged = lambda j: f"list_concat(list_append(list_slice(s.out, 1, s.k + {j} - 1), {_joined(at(j), at(j + 1), _GAP)}), list_slice(s.out, s.k + {j} + 2, len(s.out)))"
    balanced = f"""CASE WHEN s.k > len(s.out) THEN s WHEN {at(0)}.n >= 180 THEN {{'out': s.out, 'k': s.k + 1}}
        WHEN s.k >= 2 AND {goes_on(at(-1), at(0))} THEN {{'out': {merged(-1)}, 'k': s.k - 1}}
        WHEN s.k < len(s.out) AND {goes_on(at(0), at(1))} THEN {{'out': {merged(0)}, 'k': s.k}}
        ELSE {{'out': s.out, 'k': s.k + 1}} END"""
    trailing = "regexp_extract(p.text, '(?s)^(?:.*\\n\\n)?(.*)$', 1)"
    suffix = f"""list_reduce(list_reverse({sentences(rf"regexp_replace({strip('block')}, '\s+', ' ', 'g')")}), lambda s, y: CASE WHEN s.over OR s.n + {tokens('y')} > 24 THEN {{'t': s.t, 'n': s.n, 'over': TRUE}}
        ELSE {{'t': CASE WHEN s.t = '' THEN y ELSE y || ' ' || s.t END, 'n': s.n + {tokens('y')}, 'over': FALSE}} END, {{'t': '', 'n': CAST(0 AS BIGINT), 'over': FALSE}}).t"""
    return rf"""page_blocks AS (SELECT document_key, page_number, unnest(string_split(text, {_GAP})) AS block, generate_subscripts(string_split(text, {_GAP}), 1) AS pos,
            {{'id': document_key || ':' || page_number, 'n': page_number, 'original': length(original), 'cleaned': length(text)}} AS page FROM cleaned),
    kinds AS (SELECT document_key, page_number, pos, page, {strip("block")} AS text, {kind(strip("block"))} AS kind, {level(strip("block"))} AS level FROM page_blocks WHERE {strip("block")} <> ''),
    parts AS (SELECT *, CASE WHEN kind = 'LIST' THEN {listing("text")} ELSE {prose("text")} END AS parts FROM kinds),
    held AS (SELECT document_key, list({{'kind': kind, 'level': level, 'text': text, 'parts': parts, 'page': page}} ORDER BY page_number, pos) AS bs FROM parts GROUP BY document_key),
    folded AS (SELECT document_key, list_reduce(bs, lambda s, b: {step}, {start}) AS s FROM held),
    closed AS (SELECT document_key, CASE WHEN s.chain <> '' THEN list_append(s.units, {unit.format('s.chain', repr('HEADING'), 's.level', 's.opens', _GAP)}) ELSE s.units END AS units FROM folded),
    counted AS (SELECT document_key, list_transform(units, lambda u: {{'text': u.text, 'kind': u.kind, 'page': u.page, 'section': u.section, 'subsection': u.subsection, 'level': u.level, 'opens': u.opens, 'gap': u.gap, 'n': CAST({tokens("u.text")} AS BIGINT)}}) AS units FROM closed),
    packed AS (SELECT document_key, list_reduce(units, lambda s, u: {packed}, CAST([] AS {_DRAFT}[])) AS ds FROM counted),
    balanced AS (SELECT document_key, list_reduce(range(0, 3 * len(ds) + 3), lambda s, i: {balanced}, {{'out': ds, 'k': CAST(1 AS BIGINT)}}).out AS ds FROM packed),
    single AS (SELECT document_key, unnest(ds) AS d, generate_subscripts(ds, 1) - 1 AS k, unnest(list_concat([NULL], ds[1:len(ds) - 1])) AS p FROM balanced),
    before AS (SELECT *, p IS NOT NULL AND starts_with(d.boundary, 'same_') AND p.section IS NOT DISTINCT FROM d.section AS goes_on, {strip(trailing)} AS block FROM single),
    bridges AS (SELECT *, CASE WHEN NOT goes_on THEN '' WHEN {kind("block")} = 'LIST' THEN CASE WHEN {tokens("block")} <= 24 THEN block ELSE '' END ELSE {suffix} END AS bridge,
            CASE WHEN goes_on AND {tokens("coalesce(p.section, '')")} <= 24 THEN coalesce(p.section, '') ELSE '' END AS title FROM before),
    leads AS (SELECT *, CASE WHEN d.boundary = 'same_section_structural_split' AND title <> '' THEN title WHEN bridge <> '' THEN bridge ELSE title END AS lead FROM bridges),
    fit AS (SELECT *, trim(lead) <> '' AND {tokens("lead")} + d.n <= 300 AS over FROM leads),
    chunks AS (SELECT document_key, CAST(k AS INTEGER) AS k, CASE WHEN over THEN lead || {_GAP} || d.text ELSE d.text END AS text, d.listed AS listed, d.heading AS heading, coalesce(d.section, '') AS section, d.subs AS subs, d.level AS level,
            d.boundary AS boundary, list_transform(d.pages, lambda y: y.n) AS numbers, list_transform(d.pages, lambda y: y.id) AS ids, list_sum(list_transform(d.pages, lambda y: y.original)) AS original,
            list_sum(list_transform(d.pages, lambda y: y.cleaned)) AS cleaned, d.n AS n, CASE WHEN over THEN {tokens("lead")} ELSE 0 END AS overlap FROM fit)"""
