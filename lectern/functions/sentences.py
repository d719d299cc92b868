"""Where sentences end: a table-driven machine over classes of characters.

A character's class follows from its Unicode category. Marks that only shape others (Mn, Me, Cf) belong to the
character before them. A sentence ends after marks that always close one (! ? and their wide forms), with the brackets, quotes and
white space after them. A full stop is ambiguous: it ends a sentence before two blanks, or after one blank before a
letter that is no small one, or before other signs and then a letter of any kind; before a digit, or a small letter after one
blank, the sentence goes on. A paragraph separator always ends one. On texts as they are written the result is that of the JDK's own
sentence iterator; a test holds both together and lists the heaps of signs where that one backs up further.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# --- fixed values: classes of characters ----------------------------------------------------
TERMINATORS, FULL_STOPS, QUOTES = "!?。！？", ".．", "\"'"
SPACES = "\t\r\f\n "

#: classes: t terminator, a full stop, e closing, q quote, s white space, p paragraph, l small letter, u other letter, d digit, o other, m mark
_CLASSES = "taeqspludo"
#: one row per state, one entry per class in the order above. "." goes on in the text; "!" the sentence ended before the white space's end:
#: a new one begins with this character; upper-case letters name the next state.
_TABLE = {
    #     t    a    e    q    s    p    l    u    d    o
    ".": "T    A    .    .    .    P    .    .    .    .",
    "T": "T    T    T    T    S    P    !    !    !    !",
    "S": "!    !    !    !    S    P    !    !    !    !",
    "A": "T    A    A    Q    B    P    .    .    .    X",
    "Q": "T    A    A    Q    B    P    !    !    .    X",
    "B": "T    A    .    Y    C    P    .    !    .    Y",
    "C": "T    A    .    !    C    P    !    !    .    Y",
    "X": "T    A    .    X    .    P    #    #    .    X",
    "Y": "T    A    .    Y    .    P    #    #    .    Y",
    "P": "!    !    !    !    !    !    !    !    !    !",
}
MOVES = {(state, c): move for state, row in _TABLE.items() for c, move in zip(_CLASSES, row.split(), strict=True)}


@lru_cache(maxsize=4096)
def kind(c: str) -> str:
    if c in TERMINATORS:
        return "t"
    if c in FULL_STOPS:
        return "a"
    if c in QUOTES:
        return "q"
    if c in SPACES:
        return "s"
    category = unicodedata.category(c)
    if category in ("Mn", "Me", "Cf"):
        return "m"
    if category == "Zp":
        return "p"
    if category == "Zs" or category == "Zl":
        return "s"
    if category in ("Pe", "Pf"):
        return "e"
    if category == "Nd":
        return "d"
    if category[0] == "L":
        return "l" if category == "Ll" else "u"
    return "o"


#: in the midst of a sentence only these change the state
_ENDS = re.compile(f"[{re.escape(TERMINATORS + FULL_STOPS)}\u2029]")


def breaks(text: str) -> list[int]:
    """The places after which sentences end, the text's end among them."""
    out, state, mark, at, n = [], ".", 0, 0, len(text)
    while at < n:
        if state == ".":
            m = _ENDS.search(text, at)
            if not m:
                break
            at = m.start()
        k = kind(text[at])
        if k == "m" and state != "P":
            at += 1
            continue
        move = MOVES[state, k if k != "m" else "o"]
        if move == "#":  # the sentence ended where the other signs began
            out.append(mark)
            move = "."
        elif move == "!":
            out.append(at)
            move = MOVES[".", k if k != "m" else "o"]
        if move in "XY" and state not in "XY":
            mark = at
        state = move
        at += 1
    if text and (not out or out[-1] < n):
        out.append(n)
    return out


def sentences(text: str) -> list[str]:
    """The sentences without white space around them; blank ones are left out."""
    cuts = [0, *breaks(text)]
    return [s for a, b in zip(cuts, cuts[1:], strict=False) if (s := text[a:b].strip())]
