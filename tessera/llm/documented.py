"""Functions paired with their documentation (problem 7).

An island grammar for each language reads what lies around a function: documentation, annotations,
the signature, and its balanced body; all other code is water and skipped. Documentation is the
comment directly above the function, in its chunk or in the one that ends on the line before, and
in Python the string that opens the body too.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.filetext import per_file
from tessera.llm.languages import language_of
from tessera.sources.tables import table

#: The node kinds of functions and methods.
FUNCTIONS = {"function_definition", "function_declaration", "method_definition", "method_declaration"}
WORDS = 4

#: Islands: a comment block, an annotation, and the beginning of a signature up to its name.
COMMENT = {
    "hash": re.compile(r"[ \t]*#[^\n]*"),
    "slash": re.compile(r"[ \t]*(?://[^\n]*|/\*(?:[^*]++|\*(?!/))*+\*/[ \t]*)"),
}
ANNOTATION = re.compile(r"[ \t]*(?:@[\w.]+[ \t]*|__attribute__[ \t]*|\[\[[^\]\n]*\]\])")
SIGNATURE = {
    "python": re.compile(r"[ \t]*(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*(?:\[[^\]]*\])?"),
    "go": re.compile(r"[ \t]*func[ \t]*(?:\([^()]*\)[ \t]*)?([^\W\d]\w*)?[ \t]*(?:\[[^\]]*\])?"),
    "script": re.compile(
        r"[ \t]*(?:(?:export|default|async|static|public|private|protected|readonly|override|abstract|declare|get|set)[ \t]+)*"
        r"(?:function[ \t]*\*?[ \t]*([\w$]+)?|(?:const|let|var)[ \t]+([\w$]+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?:function\b[ \t]*\*?[ \t]*[\w$]*)?|\*?[ \t]*(#?[\w$]+|\[[^\]]*\]))[ \t]*(?:<[^()]*>)?[ \t]*(?=\()"
    ),
    "c": re.compile(r"[ \t]*(?:[\w*]+[\s*]+)+?\**([^\W\d]\w*)[ \t]*(?=\()"),
}
STRING = re.compile(r"""\"{3}(?:[^"\\]++|\\[\s\S]|"(?!""))*+\"{3}|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'""")
DOCSTRING = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*(?:[rRuU]?)(" + STRING.pattern + r")[ \t]*(?:;|#[^\n]*)?(?=\n|$)")
PARTS = {
    "hash": re.compile(r"(?P<comment>#[^\n]*)|(?P<blank>\s+)|(?P<code>" + STRING.pattern + r"|[^\s\"'#]++|[\s\S])"),
    "slash": re.compile(r"(?P<comment>//[^\n]*|/\*(?:[^*]++|\*(?!/))*+\*/)|(?P<blank>\s+)|(?P<code>" + STRING.pattern + r"|`[^`]*`|[^\s\"'`/]++|[\s\S])"),
}
SKIP = re.compile(r"[^()\[\]{}\"'`/#]++")
FAMILY = {"python": ("hash", "python"), "go": ("slash", "go"), "javascript": ("slash", "script"), "typescript": ("slash", "script"), "c": ("slash", "c")}

#: Lines of documentation that do not describe.
TAG = re.compile(r"^(?:@\w|\\(?:param|return|brief|throws)|:\w[^:\n]*:|(?:args?|arguments|param(?:eter)?s|returns?|raises|yields|throws|examples?|notes?|see also)\s*:?\s*$)", re.I)
DIRECTIVE = re.compile(
    r"^(?:noqa\b|type:\s*ignore|nolint\b|no-?sec\b|eslint[-\s]|tslint:|jshint\b|jslint\b|pylint:|flake8[:\b]|mypy:|pragma\b|fmt:|yapf:|isort:|ruff:|black:|go:\w|\+build\b|ts-(?:ignore|expect-error|nocheck)|prettier-ignore|istanbul\b|c8\s+ignore|v8\s+ignore|clang-(?:format|tidy)|cppcheck|cspell|spell-?checker|coverage:|lint:|sonar|#?(?:end)?region\b|-\*-|vim?:|shellcheck|biome-ignore|deno-lint|webpack|nocover|export_\w|cgo\b|SPDX-|copyright\b|\(c\)\s|all rights reserved|use is subject to)",
    re.I,
)
TODO = re.compile(r"^\W*(?:TODO|FIXME|XXX|HACK|TBD|BUG|WIP)\b(?:\([^)]*\))?[:\s-]*", re.I)
CODE = re.compile(
    r"^(?:[\w.$\[\]\"']+(?:\s*,\s*[\w.$]+)*\s*(?:[-+*/|&^%]|<<|>>)?(?::?=)(?!=)\s*\S.*|(?:const|let|var|int|char|def|func|function|import|return|if|for|while|elif|else|print|raise|throw|await)\b.*(?:[;{:]|\)|=.*)\s*|[\w.$]+\([^)]*\)\s*[;{]?\s*|.*[;{}]\s*|[})\]]+.*)$"
)
PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\dA-Za-z_]+")
WORD = re.compile(r"[^\W\d_][\w'’-]*")


def balanced(text: str, at: int) -> int:
    """The place after the bracket group that begins at ``at``; len(text) if it never ends."""
    depth, size = 0, len(text)
    while at < size:
        c = text[at]
        if c in "([{":
            depth += 1
            at += 1
        elif c in ")]}":
            depth -= 1
            at += 1
            if depth <= 0:
                return at
        elif m := (STRING.match(text, at) if c in "\"'" else SKIP.match(text, at)):
            at = m.end()
        elif c == "`":
            end = text.find("`", at + 1)
            at = size if end < 0 else end + 1
        elif c == "#" or text.startswith("//", at):
            end = text.find("\n", at)
            at = size if end < 0 else end
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            at = size if end < 0 else end + 2
        else:
            at += 1
    return size


def comment_above(text: str, kind: str) -> tuple[str, int]:
    """The comment that text begins with and the place after it; a blank line parts it off."""
    at, block = 0, 0
    size = len(text)
    while at < size:
        m = COMMENT[kind].match(text, at)
        if m:
            at = m.end()
            if text[at : at + 1] == "\n":
                at += 1
            continue
        line = text.find("\n", at)
        if line >= 0 and not text[at:line].strip():
            at = block = line + 1
            continue
        break
    return text[block:at], at


def comment_below(text: str, kind: str) -> str:
    """The comment that text ends with, from the last blank line or code on; read once."""
    begin, code = None, False
    for m in PARTS[kind].finditer(text):
        if m.lastgroup == "comment":
            if begin is None and not code:
                begin = m.start()
        elif m.lastgroup == "blank":
            breaks = m[0].count("\n")
            begin = None if breaks > 1 else begin
            code = code and not breaks
        else:
            begin, code = None, True
    return text[begin:] if begin is not None else ""


def islands(text: str, language: str) -> tuple[str, str, str, str]:
    """(documentation, name, code from the annotations on, documentation string) of a chunk."""
    kind, family = FAMILY[language]
    doc, at = comment_above(text, kind)
    begin = at
    while m := ANNOTATION.match(text, at):
        at = m.end()
        if text[at : at + 1] == "(":
            at = balanced(text, at)
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        if below := COMMENT[kind].match(text, at):
            at = below.end() + 1
    sign = SIGNATURE[family].match(text, at)
    if not sign:
        return doc, "", text[begin:], ""
    name = next((g for g in sign.groups() if g), "")
    at, inside = sign.end(), ""
    if text[at : at + 1] == "(":
        at = balanced(text, at)
    if family == "python":
        while at < len(text) and text[at] != ":":
            at = balanced(text, at) if text[at] in "([{" else at + 1
        found = DOCSTRING.match(text, at + 1)
        if found and "\n" in text[at + 1 : found.start(1)] or found and not text[at + 1 : found.start(1)].strip():
            inside = found[1]
    return doc, name, text[begin:], inside


def described(doc: str, name: str) -> list[str]:
    """The words of documentation that are left once marks, tags, directives, to-do lines,
    commented-out code and the words of the function's own name are taken out."""
    own = {p.lower() for p in PART.findall(name or "")} | {(name or "").lower()}
    words = []
    for line in doc.split("\n"):
        line = re.sub(r"^\s*(?:/\*+!?|\*+/?|//+!?|#+!?|\"{3}|'{3}|--)?\s*", "", line.strip())
        line = re.sub(r"\s*(?:\*+/|\"{3}|'{3})\s*$", "", line).strip()
        if not line or TAG.match(line) or DIRECTIVE.match(line) or TODO.match(line) or CODE.match(line):
            continue
        words += [w for w in WORD.findall(line) if not {p.lower() for p in PART.findall(w)} <= own and w.lower() not in own]
    return words


def _pairs(path: str, rows: list[tuple]):
    language = language_of(path)
    if language not in FAMILY:
        return
    kind = FAMILY[language][0]
    done = set()
    before = None
    for start, content, node, name, key in rows:
        if content is None:
            continue
        text = content.replace("\r\n", "\n")
        if node in FUNCTIONS and key not in done:
            done.add(key)
            doc, parsed, code, inside = islands(text, language)
            if start is not None and before is not None and before[0] == start - 1 and not (doc and not text.startswith(doc)) and (doc or comment_above(text, kind)[1] == 0):
                above = comment_below(before[1], kind)
                doc = above + "\n" + doc if above else doc
            doc = "\n".join(x for x in (doc, re.sub(r"^(\"{3}|'{3}|[\"'])|(\"{3}|'{3}|[\"'])$", "", inside) if inside else "") if x.strip())
            called = name or parsed
            if doc and len(described(doc, called)) >= WORDS:
                yield key, path, called, code, doc
        if start is not None:
            before = (start + text.count("\n"), text)


def documented(chunks: DataFrame) -> DataFrame:
    """Pairs of code and description: id, file_path, name, code, documentation.

    Functions whose documentation is missing or trivial (fewer than four words of its own) are
    left out, and so are files of languages without an island grammar. ``name`` is the chunk's,
    or what the signature says where that is null or empty. An id counts once.
    """
    columns = ["start_line", "content", "node_kind", "name", "id"]
    return per_file(chunks, columns, _pairs, "id string, file_path string, name string, code string, documentation string").dropDuplicates(["id"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods with non-trivial documentation."""
    return documented(table(spark, sf_dir, "chunks")).select("id")


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and description of every documented function."""
    return documented(table(spark, sf_dir, "chunks"))


QUERIES = {"p7_found": p7_found, "p7_pairs": p7_pairs}
SQL: dict[str, str] = {}
