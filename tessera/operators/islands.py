"""Chunks and edges of brace languages by island parsing.

Strings and comments are blanked out in place, brackets are paired, and declarations are looked
for at the outermost level and, for classes, one level below; a declaration's body is the bracket
pair that follows its head. Everything else is water. Nothing fails: what is not understood stays
in unnamed blocks.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?"
_PLAIN = r'"(?:[^"\\\n]|\\[\s\S])*"?' + r"|'(?:[^'\\\n]|\\[\s\S])*'?"
MASKS = {
    "go": re.compile(_COMMENT + "|" + _PLAIN + "|`[^`]*`?"),
    "javascript": re.compile(_COMMENT + "|" + _PLAIN + r"|`(?:[^`\\]|\\[\s\S])*`?|(?<=[=(,:;!&|?{}\n])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"),
    "c": re.compile(_COMMENT + "|" + _PLAIN),
}
_NAME = r"[A-Za-z_$][\w$]*"
_EXPORT = r"(?P<export>export[ \t]+(?:default[ \t]+)?)?(?:declare[ \t]+)?"

#: Node kinds by declaration, as the languages' public grammars name them.
DECLARATIONS = {
    "go": [
        ("method_declaration", re.compile(rf"^func[ \t]*\([ \t]*(?:\w+[ \t]+)?\*?[ \t]*(?P<parent>{_NAME})[^)]*\)[ \t]*(?P<name>{_NAME})", re.M)),
        ("function_declaration", re.compile(rf"^func[ \t]+(?P<name>{_NAME})", re.M)),
        ("type_declaration", re.compile(rf"^type[ \t]+(?P<name>{_NAME})", re.M)),
    ],
    "javascript": [
        ("function_declaration", re.compile(rf"^{_EXPORT}(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>{_NAME})", re.M)),
        ("class_declaration", re.compile(rf"^{_EXPORT}(?:abstract[ \t]+)?class[ \t]+(?P<name>{_NAME})", re.M)),
        ("interface_declaration", re.compile(rf"^{_EXPORT}interface[ \t]+(?P<name>{_NAME})", re.M)),
        ("enum_declaration", re.compile(rf"^{_EXPORT}(?:const[ \t]+)?enum[ \t]+(?P<name>{_NAME})", re.M)),
        ("type_alias_declaration", re.compile(rf"^{_EXPORT}type[ \t]+(?P<name>{_NAME})[^=\n]*=", re.M)),
        ("lexical_declaration", re.compile(rf"^{_EXPORT}(?:const|let|var)[ \t]+(?P<name>{_NAME})[^=\n]*=[ \t]*(?:async\b[ \t]*)?(?:function\b|\([^()]*\)[^=\n]*=>|{_NAME}[ \t]*=>)", re.M)),
    ],
    "c": [
        ("function_definition", re.compile(rf"^(?!#)(?:[A-Za-z_][\w \t*]*[ \t*\n])?(?P<name>{_NAME})[ \t]*\((?P<args>[^;{{}}]*)\)\s*(?=\{{)", re.M)),
        ("struct_specifier", re.compile(rf"^(?:typedef[ \t]+)?struct[ \t]+(?P<name>{_NAME})\s*(?=\{{)", re.M)),
        ("union_specifier", re.compile(rf"^(?:typedef[ \t]+)?union[ \t]+(?P<name>{_NAME})\s*(?=\{{)", re.M)),
        ("enum_specifier", re.compile(rf"^(?:typedef[ \t]+)?enum[ \t]+(?P<name>{_NAME})\s*(?=\{{)", re.M)),
    ],
}
METHOD = re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)[ \t]+)*\*?[ \t]*(?P<name>#?{_NAME})[ \t]*(?:<[^>\n]*>)?\((?P<args>[^{{}};]*)\)[^\n{{;=]*(?=\{{)", re.M)
EXTENDS = re.compile(rf"\bextends[ \t]+(?:{_NAME}\.)*({_NAME})|\bimplements[ \t]+([\w$., \t]+)")
CALL = re.compile(rf"(?:({_NAME})\s*(?:\.|->|\?\.|::)\s*)?(?<![\w$])({_NAME})\s*\(")
TYPED = {"go": re.compile(rf"(?:({_NAME})\.)?\b([A-Z]\w*)\{{"), "javascript": re.compile(rf":[ \t]*(?:({_NAME})\.)?([A-Z][\w$]*)\b")}
#: Words of the languages that stand before brackets without being called.
NOT_CALLED = frozenset("if for while switch catch return function func go defer select case sizeof typeof await new delete in of with super constructor import do else range map chan interface struct defined void throw yield assert".split())
IMPORTS = {
    "go": re.compile(r"^[ \t]*(?:import[ \t]+)?(?:(?P<alias>[\w.]+)[ \t]+)?(?P<quote>\")", re.M),
    "javascript": re.compile(rf"^[ \t]*import\b(?:[ \t]+type\b)?(?:[ \t]*\*[ \t]*as[ \t]+(?P<alias>{_NAME})|[ \t]+(?P<plain>{_NAME})|[^;\"'`]*?)?[^;\"'`]*?(?P<quote>[\"'])|^[ \t]*(?:const|let|var)[ \t]+(?P<name>{_NAME})[ \t]*=[ \t]*require\([ \t]*(?P<quoted>[\"'])", re.M),
    "c": re.compile(r"^[ \t]*#[ \t]*include[ \t]*(?P<quote>[<\"])", re.M),
}
FAMILY = {"go": "go", "javascript": "javascript", "typescript": "javascript", "tsx": "javascript", "c": "c", "cpp": "c"}


@dataclass(frozen=True)
class Island:
    begin: int
    end: int
    kind: str
    name: str
    parent: str
    head: int  # where the body begins


def blanked(text: str, family: str) -> str:
    """The text without its strings and comments: quotes and line ends stay, so places do too."""

    def blank(m: re.Match) -> str:
        whole = m[0]
        inner = re.sub(r"[^\n]", " ", whole)
        if whole[0] in "\"'`":
            return whole[0] + inner[1:-1] + (whole[-1] if len(whole) > 1 and whole[-1] != "\n" else inner[-1:] if len(whole) > 1 else "")
        return inner

    return MASKS[family].sub(blank, text)


def pairs(masked: str) -> tuple[dict[int, int], list[int], list[int]]:
    """Where each opening brace closes, and how deep the text is: places and the depth from there on."""
    closes: dict[int, int] = {}
    at, depth, held = [0], [0], []
    for m in re.finditer(r"[{}]", masked):
        if m[0] == "{":
            held.append(m.start())
        elif held:
            closes[held.pop()] = m.end()
        at.append(m.end())
        depth.append(len(held))
    closes.update(dict.fromkeys(held, len(masked)))
    return closes, at, depth


def _islands(masked: str, family: str) -> list[Island]:
    closes, at, depth = pairs(masked)
    deep = lambda p: depth[bisect_right(at, p) - 1]
    found: list[Island] = []

    def end_of(after: int) -> tuple[int, int]:
        """(body's begin, end): of the brace that opens on the line or after it, else the line's or statement's end."""
        opened = masked.find("{", after)
        stop = min([p for p in (masked.find(";", after), masked.find("\n\n", after)) if p >= 0], default=len(masked))
        if 0 <= opened < stop:
            end = closes[opened]
            return opened, end + (masked[end : end + 1] == ";")
        line = masked.find("\n", after)
        stop = stop + 1 if masked[stop : stop + 1] == ";" and family != "go" else line if family == "go" and line >= 0 else stop
        return stop, stop

    for kind, pattern in DECLARATIONS[family]:
        for m in pattern.finditer(masked):
            if deep(m.start()):
                continue
            parts = m.groupdict()
            if family == "c" and kind == "function_definition" and parts["name"] in NOT_CALLED:
                continue
            head, end = end_of(m.end())
            found.append(Island(m.start(), end, "export_statement" if parts.get("export") else kind, parts["name"], parts.get("parent") or "", head))
            if kind == "class_declaration":
                for f in METHOD.finditer(masked, head + 1, end):
                    if deep(f.start()) == 1 and f["name"] not in NOT_CALLED - {"constructor"}:
                        body, stop = end_of(f.end())
                        begin = f.start() + len(f[0]) - len(f[0].lstrip())
                        found.append(Island(begin, stop, "method_definition", f["name"], parts["name"], body))
    found.sort(key=lambda x: (x.begin, -x.end))
    return found


def _line(starts: list[int], place: int) -> int:
    return bisect_right(starts, place)


def _blocks(text: str, islands: list[Island]) -> Iterator[tuple[int, int]]:
    """What is between the outermost islands, in paragraphs, as (begin, end) without blanks around."""
    at = 0
    for begin, end in [(i.begin, i.end) for i in islands if not i.kind.startswith("method_definition")] + [(len(text), len(text))]:
        for m in re.finditer(r"\S(?:[^\n]|\n(?![ \t\r]*(?:\n|\Z)))*", text[at:begin]) if begin > at else ():
            yield at + m.start(), at + m.start() + len(m[0].rstrip())
        at = max(at, end)


def island_chunks(text: str, language: str) -> tuple[list[tuple], list[tuple]]:
    """Chunks and edges as ``analyse`` gives them, of a language in ``FAMILY``."""
    family = FAMILY[language]
    masked = blanked(text, family)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    islands = _islands(masked, family)
    spans = [(i.begin, i.end, i.kind, i.name, i.parent) for i in islands]
    spans += [(a, b, "comment" if not masked[a:b].strip() else "block", "", "") for a, b in _blocks(text, islands)]
    chunks = []
    for begin, end, kind, name, parent in sorted(spans):
        content = text[begin:end].rstrip()
        if content:
            chunks.append((content, language, kind, name, parent, _line(starts, begin), _line(starts, begin + len(content) - 1)))

    begins = [i.begin for i in islands]
    around: list[int] = []  # the island each lies in, or -1
    for n, island in enumerate(islands):
        above = n - 1
        while above >= 0 and islands[above].end <= island.begin:
            above = around[above]
        around.append(above)

    def source(place: int) -> str:
        n = bisect_right(begins, place) - 1
        while n >= 0 and islands[n].end <= place:
            n = around[n]
        return islands[n].name if n >= 0 else ""

    edges = [("inherit", i.name, base, "", _line(starts, i.begin)) for i in islands for m in EXTENDS.finditer(masked, i.begin, i.head) for base in re.findall(rf"(?:{_NAME}\.)*({_NAME})", m[1] or m[2])]
    named = {m.start("name") for _, p in DECLARATIONS[family] for m in p.finditer(masked)} | {m.start("name") for m in METHOD.finditer(masked) if family == "javascript"}
    for m in CALL.finditer(masked):
        if m[2] not in NOT_CALLED and m.start(2) not in named:
            edges.append(("call", source(m.start()), m[2], "" if m[1] in NOT_CALLED else m[1] or "", _line(starts, m.start(2))))
    for m in TYPED[family].finditer(masked) if family in TYPED else ():
        edges.append(("reference", source(m.start()), m[2], m[1] or "", _line(starts, m.start(2))))
    grouped = [(m.start(), m.end()) for m in re.finditer(r"^import\s*\([^)]*\)", masked, re.M)] if family == "go" else []
    for m in IMPORTS[family].finditer(masked):
        parts = m.groupdict()
        quote = m.start("quote") if parts.get("quote") else m.start("quoted")
        if family == "go" and not (m[0].lstrip().startswith("import") or any(a < m.start() < b for a, b in grouped)):
            continue
        stop = re.compile({"<": ">"}.get(text[quote], re.escape(text[quote])) + r"|\n").search(text, quote + 1)
        module = text[quote + 1 : stop.start() if stop else len(text)]
        alias = parts.get("alias") or parts.get("plain") or parts.get("name") or ""
        edges.append(("import", "" if alias == "import" else alias, module, "", _line(starts, quote)))
    return chunks, edges
