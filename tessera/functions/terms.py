"""Search tokens and index terms of whole texts, in Python with words remembered.

The same rules as the column expressions in ``text``; those suit short identifiers, but as
lambdas they are interpreted, and over whole texts one look-up a word is some ten times faster.
"""

from __future__ import annotations

import unicodedata

import regex

BLANKS = regex.compile(r"\p{White_Space}+")
HEAD = regex.compile(r"^[^\p{L}\p{Nd}_]+")
TAIL = regex.compile(r"[^\p{L}\p{Nd}_]+$")
HUMP, RUN = regex.compile(r"([^\p{Lu}])(\p{Lu})"), regex.compile(r"(\p{Lu})(\p{Lu}\p{Ll})")
LETTER, SIGNS = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{N}]+")
#: Latin letters without their diacritics.
FOLD = {i: d[0] for i in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(i))) > 1}
REMEMBERED = 200_000

_tokens: dict[str, tuple[str, ...]] = {}
_terms: dict[str, tuple[str, ...]] = {}


def _word(word: str) -> tuple[str, ...]:
    if not LETTER.search(word):
        return (word,)
    head = HEAD.match(word)
    lead = (head[0],) if head else ()
    name = TAIL.sub("", HEAD.sub("", word))
    spaced = RUN.sub(r"\1 \2", HUMP.sub(r"\1 \2", name))
    parts: dict[str, None] = {}
    for snake in spaced.split("_"):
        if snake:
            parts[snake.replace(" ", "").lower()] = None
            parts.update((p.lower(), None) for p in snake.split(" ") if p)
    whole = name.lower()
    return lead + ((whole,) if len(parts) <= 1 else (whole, *(p for p in parts if p != whole)))


def search_tokens(text: str | None) -> list[str]:
    out: list[str] = []
    for w in BLANKS.split(text or ""):
        if w:
            got = _tokens.get(w)
            if got is None:
                if len(_tokens) > REMEMBERED:
                    _tokens.clear()
                got = _tokens[w] = _word(w)
            out += got
    return out


def parted(text: str) -> list[str]:
    return [t for t in SIGNS.split(text.lower().translate(FOLD)) if t]


def index_terms(text: str | None) -> list[str]:
    out: list[str] = []
    for w in BLANKS.split(text or ""):
        if w:
            got = _terms.get(w)
            if got is None:
                if len(_terms) > REMEMBERED:
                    _terms.clear()
                got = _terms[w] = tuple(t for token in _word(w) for t in parted(token))
            out += got
    return out
