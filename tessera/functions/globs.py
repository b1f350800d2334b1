"""Path globs and ignore rules, compiled to regular expressions on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set(".^$+{}()|\\[]&~#")


def _class(pattern: str, at: int) -> tuple[str, int] | None:
    """A bracket class at ``at`` as a regular expression, and the place after it."""
    end = pattern.find("]", at + 2 if pattern[at + 1 : at + 2] in ("!", "^") else at + 1)
    if end < 0:
        return None
    body = pattern[at + 1 : end]
    negated = body[:1] in ("!", "^")
    body = body[1:] if negated else body
    if not body:
        return None
    return f"[{'^' if negated else ''}{re.sub(r'([\\\[\]&^~])', r'\\\1', body)}]", end + 1


def glob_regex(pattern: str) -> str | None:
    """A path glob: ``*`` and ``?`` stay within a folder, a trailing ``/**`` is all below.

    None if the pattern is malformed; it then matches nothing.
    """
    if pattern == "**":
        return "^.*$"
    if pattern.endswith("/**"):
        head = glob_regex(pattern[:-3])
        return None if head is None else f"{head[:-1]}/.*$"
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            got = _class(pattern, at)
            if got is None:
                return None
            out.append(got[0])
            at = got[1]
            continue
        elif c == "\\":
            at += 1
            if at >= len(pattern):
                return None
            out.append(re.escape(pattern[at]))
        else:
            out.append("\\" + c if c in _SPECIAL else c)
        at += 1
    return f"^{''.join(out)}$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches any of the globs; without globs everything does."""
    if not patterns:
        return F.lit(True)
    good = [r for r in map(glob_regex, patterns) if r]
    return path.rlike("|".join(f"(?:{r})" for r in good)) if good else F.lit(False)


@dataclass(frozen=True)
class IgnoreRule:
    regex: str
    negated: bool
    folders_only: bool
    anchored: bool


def ignore_rule(line: str) -> IgnoreRule | None:
    """One line of an ignore file, or None for blanks, comments and malformed lines."""
    line = re.sub(r"(?<!\\)[ \t\r]+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line[:2] in ("\\#", "\\!") else line
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    anchored = "/" in line
    line = line.lstrip("/")
    if not line:
        return None
    out, at = [], 0
    while at < len(line):
        if line.startswith("**/", at) and (at == 0 or line[at - 1] == "/"):
            out.append("(?:.*/)?")
            at += 3
        elif line.startswith("/**", at) and at + 3 == len(line):
            out.append("/.*")
            at += 3
        elif line[at] == "*":
            while line[at : at + 1] == "*":
                at += 1
            out.append("[^/]*")
        elif line[at] == "?":
            out.append("[^/]")
            at += 1
        elif line[at] == "[":
            got = _class(line, at)
            if got is None:
                return None
            out.append(got[0])
            at = got[1]
        elif line[at] == "\\" and at + 1 < len(line):
            out.append(re.escape(line[at + 1]))
            at += 2
        else:
            out.append("\\" + line[at] if line[at] in _SPECIAL else line[at])
            at += 1
    return IgnoreRule(f"^{'' if anchored else '(?:.*/)?'}{''.join(out)}$", negated, folders, anchored)


def ignore_state(rules: list[str], path: str, is_folder: bool) -> str:
    """``none``, ``ignored`` or ``included``: what the last rule that matches a path says."""
    state = "none"
    for line in rules:
        rule = ignore_rule(line)
        if rule and (is_folder or not rule.folders_only) and re.search(rule.regex, path):
            state = "included" if rule.negated else "ignored"
    return state


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether a file is ignored: the last rule that matches the nearest of its folders or the
    file itself decides, and nothing below an ignored folder comes back."""
    compiled = [r for r in map(ignore_rule, rules) if r]
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("p"), (n < F.size(parts)).alias("folder")))

    def state(s: Column) -> Column:
        out = F.lit(0)
        for r in compiled:
            hit = s["p"].rlike(r.regex) & (s["folder"] | F.lit(not r.folders_only))
            out = F.when(hit, F.lit(2 if r.negated else 1)).otherwise(out)
        return out

    return F.exists(prefixes, lambda s: state(s) == 1) if compiled else F.lit(False)
