"""Parsing with derivatives over token streams, memoised.

The derivative of a language by a token holds what may follow that token. A grammar here is a
regular expression over tokens whose brackets enclose further rules, so nesting goes through
brackets alone. The derivative by an opening bracket is the inner language followed by its
continuation; as the head is not nullable before its closing bracket, only the head needs to be
derived, and the continuations wait on a stack. Every derivative is hash-consed and every step
(state, token) is memoised, so a stream costs one lookup per token once the states in use are
known. Alternatives that open the same bracket run side by side in one state.

An empty derivative marks the token at which no parse is left. A stream whose last derivative
is not nullable, or that leaves brackets open, was cut off.

Notation of grammars: words are tokens or macros, ``'x'`` is a token, ``|`` ``*`` ``+`` ``?`` and
``( )`` as usual, ``(:r:)`` ``[:r:]`` ``{:r:}`` ``<:r:>`` is rule r within round, square or curly
brackets or an indented block. Rules may refer to each other only within brackets; a macro is
put in place where it is named.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Token classes of brackets, in all grammars; an indented block opens with \x01.
OPENS, CLOSES = "([{\x01", ")]}\x02"
CLOSE_OF = dict(zip(OPENS, CLOSES))
#: What stops the parse at once, and what may be ignored or consumed (a line end).
BAD, SOFT = "\x00", "EOL"

EMPTY, EPS = 0, 1


class Terms:
    """Hash-consed expressions by number; 0 is the empty language, 1 the empty string."""

    def __init__(self) -> None:
        self.nodes: list[tuple] = [("empty",), ("eps",)]
        self.number: dict[tuple, int] = {n: i for i, n in enumerate(self.nodes)}
        self.null: dict[int, bool] = {EMPTY: False, EPS: True}
        self.derived: dict[tuple[int, str], int] = {}
        self.opened: dict[tuple[int, str], tuple] = {}

    def make(self, node: tuple) -> int:
        got = self.number.get(node)
        if got is None:
            got = self.number[node] = len(self.nodes)
            self.nodes.append(node)
        return got

    def tokens(self, names: frozenset[str]) -> int:
        return self.make(("tok", names)) if names else EMPTY

    def seq(self, a: int, b: int) -> int:
        if EMPTY in (a, b):
            return EMPTY
        if a == EPS or b == EPS:
            return b if a == EPS else a
        if self.nodes[a][0] == "seq":  # to the right, so that equal languages look alike
            return self.seq(self.nodes[a][1], self.seq(self.nodes[a][2], b))
        return self.make(("seq", a, b))

    def alt(self, *parts: int) -> int:
        flat: set[int] = set()
        names: set[str] = set()
        for p in parts:
            for q in self.nodes[p][1] if self.nodes[p][0] == "alt" else (p,):
                if self.nodes[q][0] == "tok":
                    names |= self.nodes[q][1]
                elif q != EMPTY:
                    flat.add(q)
        if names:
            flat.add(self.tokens(frozenset(names)))
        if len(flat) < 2:
            return next(iter(flat), EMPTY)
        return self.make(("alt", frozenset(flat)))

    def star(self, a: int) -> int:
        if a in (EMPTY, EPS):
            return EPS
        return a if self.nodes[a][0] == "star" else self.make(("star", a))

    def nullable(self, a: int) -> bool:
        got = self.null.get(a)
        if got is None:
            kind, *args = self.nodes[a]
            if kind == "seq":
                got = self.nullable(args[0]) and self.nullable(args[1])
            elif kind == "alt":
                got = any(map(self.nullable, args[0]))
            else:
                got = kind == "star"
            self.null[a] = got
        return got

    def derive(self, a: int, token: str) -> int:
        key = (a, token)
        got = self.derived.get(key)
        if got is None:
            kind, *args = self.nodes[a]
            if kind == "tok":
                got = EPS if token in args[0] else EMPTY
            elif kind == "seq":
                got = self.seq(self.derive(args[0], token), args[1])
                if self.nullable(args[0]):
                    got = self.alt(got, self.derive(args[1], token))
            elif kind == "alt":
                got = self.alt(*(self.derive(x, token) for x in args[0]))
            elif kind == "star":
                got = self.seq(self.derive(args[0], token), a)
            else:
                got = EMPTY
            self.derived[key] = got
        return got

    def open(self, a: int, bracket: str) -> tuple[tuple[str, int], ...]:
        """Pairs (rule, continuation) of what an opening bracket begins here."""
        key = (a, bracket)
        got = self.opened.get(key)
        if got is None:
            kind, *args = self.nodes[a]
            found: dict[str, int] = {}

            def add(pairs, then: int = EPS) -> None:
                for rule, rest in pairs:
                    found[rule] = self.alt(found.get(rule, EMPTY), self.seq(rest, then))

            if kind == "group" and args[0] == bracket:
                found[args[1]] = EPS
            elif kind == "seq":
                add(self.open(args[0], bracket), args[1])
                if self.nullable(args[0]):
                    add(self.open(args[1], bracket))
            elif kind == "alt":
                for x in args[0]:
                    add(self.open(x, bracket))
            elif kind == "star":
                add(self.open(args[0], bracket), a)
            got = self.opened[key] = tuple(sorted(found.items()))
        return got


class Grammar:
    """Rules in the notation above, compiled to memoised steps; ``file`` is the start."""

    def __init__(self, text: str):
        self.terms = Terms()
        self.source = {}
        for line in re.sub(r"\n\s+", " ", text.strip()).split("\n"):
            name, _, body = line.partition(" = ")
            self.source[name.strip()] = body
        self.compiled: dict[str, int] = {}
        self.frames: list[tuple] = []
        self.frame_of: dict[tuple, int] = {}
        self.links: list[tuple] = []
        self.link_of: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.pushes: dict[tuple[int, str], tuple[int, int]] = {}
        self.pops: dict[tuple[int, int, str], int] = {}
        self.start = self._frame(("file",), (self.rule("file"),))

    # ---- reading the notation

    def rule(self, name: str) -> int:
        if name not in self.compiled:
            tokens = re.findall(r"[(\[{<]:\w+:[)\]}>]|'[^']*'|[\w$]+|[()|*+?]", self.source[name])
            value, rest = self._alternatives(tokens)
            if rest:
                raise ValueError(f"{name}: {rest[:5]}")
            self.compiled[name] = value
        return self.compiled[name]

    def _alternatives(self, t: list[str]) -> tuple[int, list[str]]:
        parts = []
        while True:
            value, t = self._sequence(t)
            parts.append(value)
            if t[:1] != ["|"]:
                return self.terms.alt(*parts), t
            t = t[1:]

    def _sequence(self, t: list[str]) -> tuple[int, list[str]]:
        items = []
        while t and t[0] not in ("|", ")"):
            value, t = self._item(t)
            while t and t[0] in "*+?":
                star = self.terms.star(value)
                value = {"*": star, "+": self.terms.seq(value, star), "?": self.terms.alt(value, EPS)}[t[0]]
                t = t[1:]
            items.append(value)
        out = EPS
        for x in reversed(items):
            out = self.terms.seq(x, out)
        return out, t

    def _item(self, t: list[str]) -> tuple[int, list[str]]:
        head, t = t[0], t[1:]
        if head == "(":
            value, t = self._alternatives(t)
            return value, t[1:]
        if len(head) > 3 and head[1] == ":" and head[-2] == ":":
            return self.terms.make(("group", "\x01" if head[0] == "<" else head[0], head[2:-2])), t
        if head[0] != "'" and head in self.source:
            return self.rule(head), t
        return self.terms.tokens(frozenset([head.strip("'")])), t

    # ---- states: a tuple of the rules running side by side, and of their derivatives

    def _frame(self, rules: tuple, values: tuple) -> int:
        key = (rules, values)
        got = self.frame_of.get(key)
        if got is None:
            got = self.frame_of[key] = len(self.frames)
            self.frames.append(key)
        return got

    def step(self, frame: int, token: str) -> int:
        """The state after a token that is no bracket, or -1."""
        rules, values = self.frames[frame]
        derive = self.terms.derive
        if token == SOFT:
            after = tuple(self.terms.alt(v, derive(v, token)) for v in values)
        else:
            after = tuple(derive(v, token) for v in values)
        got = self.steps[frame, token] = self._frame(rules, after) if any(after) else -1
        return got

    def push(self, frame: int, bracket: str) -> tuple[int, int]:
        """(state within the bracket, link to what waits outside), or (-1, -1)."""
        rules, values = self.frames[frame]
        inner: dict[str, int] = {}
        waits = []
        for v in values:
            pairs = self.terms.open(v, bracket)
            for r, _ in pairs:
                inner.setdefault(r, len(inner))
            waits.append(tuple((inner[r], rest) for r, rest in pairs))
        if not inner:
            got = (-1, -1)
        else:
            link = (CLOSE_OF[bracket], rules, tuple(waits))
            if link not in self.link_of:
                self.link_of[link] = len(self.links)
                self.links.append(link)
            got = (self._frame(tuple(inner), tuple(self.rule(r) for r in inner)), self.link_of[link])
        self.pushes[frame, bracket] = got
        return got

    def pop(self, frame: int, link: int, bracket: str) -> int:
        close, rules, waits = self.links[link]
        got = -1
        if close == bracket:
            done = [self.terms.nullable(v) for v in self.frames[frame][1]]
            after = tuple(self.terms.alt(*(rest for i, rest in w if done[i])) for w in waits)
            if any(after):
                got = self._frame(rules, after)
        self.pops[frame, link, bracket] = got
        return got

    def remembered(self) -> int:
        """Entries of the memo tables."""
        return len(self.steps) + len(self.pushes) + len(self.pops) + len(self.frames) + len(self.links) + len(self.terms.nodes) + len(self.terms.derived)

    def accepts(self, frame: int) -> bool:
        return any(self.terms.nullable(v) for v in self.frames[frame][1])

    def parse(self, classes: list[str]) -> int:
        """Where the parse fails: a position, len(classes) if the stream was cut off, or -1."""
        steps, pushes, pops = self.steps, self.pushes, self.pops
        state, stack = self.start, []
        for at, c in enumerate(classes):
            if c in OPENS:
                got = pushes.get((state, c)) or self.push(state, c)
                state = got[0]
                if state < 0:
                    return at
                stack.append(got[1])
            elif c in CLOSES:
                if not stack:
                    return at
                key = (state, stack.pop(), c)
                after = pops.get(key)
                state = self.pop(*key) if after is None else after
                if state < 0:
                    return at
            else:
                after = steps.get((state, c))
                if after is None:
                    after = self.step(state, c)
                if after < 0:
                    return at
                state = after
        return -1 if not stack and self.accepts(state) else len(classes)


@lru_cache(maxsize=None)
def grammar(text: str) -> Grammar:
    return Grammar(text)
