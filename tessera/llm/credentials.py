"""Credentials embedded in source code (problem 3).

Code is tokenized lexically, and of each string the identifier it is assigned to, or the call it
is passed to, is read off the tokens before it, however far away.
A literal is a credential if that identifier is credential-named and the value is no stand-in,
reference, digest with its algorithm, or plain word. Values that carry their kind with them
(addresses with a password, authorization headers, connection strings, private keys, signed
tokens, tokens with an issuer's prefix) are found under any name, in comments and prose too.
Length does not tell, but for seeds: data saved under a credential's name is known by its first
bytes, and a name that ends in ``seed`` holds data where the value is longer than any seed.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.languages import language_of
from tessera.sources.tables import table

#: Words of credential names, words that qualify ``key``, and words after which a
#: name means something about a credential rather than one.
SECRET_WORDS = {"password", "passwd", "pwd", "pw", "pass", "passphrase", "passcode", "secret", "secrets", "token", "credential", "credentials", "apikey", "auth", "authtoken", "hmac", "pat", "psk"}
KEY_WORDS = {"api", "access", "secret", "private", "signing", "webhook", "encryption", "master", "service", "client", "auth", "ssh", "storage", "account", "license", "deploy", "hmac", "session", "shared", "app", "admin", "root", "cipher", "crypto", "jwt", "aes", "rsa"}
ABOUT_WORDS = {"hint", "kind", "ref", "reference", "name", "path", "file", "filename", "url", "uri", "id", "ids", "type", "field", "label", "env", "var", "header", "prefix", "suffix", "length", "len", "count", "size", "ttl", "expiry", "expires", "policy", "rule", "rules", "regex", "pattern", "format", "algo", "algorithm", "hash", "digest", "checksum", "fingerprint", "public", "pub", "placeholder", "prompt", "message", "msg", "error", "help", "title", "text", "description", "desc", "column", "param", "arg", "location", "endpoint", "class", "mode", "status", "example", "raw", "image", "lut", "blob", "table", "data", "version", "scope", "issuer"}
LOGIN_CALLS = re.compile(r"(?i)(?:^|_|(?<=[a-z.]))(?:log_?in|sign_?in|authenticate|auth|basic_?auth|set_?(?:password|token|secret|api_?key|credentials)|with_?(?:password|token|secret|api_?key|credentials?)|connect)$")
STAND_IN = re.compile(
    r"(?i)^(?:change[-_ ]?(?:me|it)|replace[-_ ]?(?:me|this|with.*)|to[-_ ]?do|fix[-_ ]?me|tbd|n/?a|none|null|nil|undefined|dummy.*|fake.*|sample.*|example.*|test|placeholder.*|"
    r"redacted.*|your[-_ ].*|my[-_ ].*|insert[-_ ].*|enter[-_ ].*|some[-_ ].*|xxx+.*|\*+|\.+|x+|-+|_+|0+|12345\d*|abc123|secret|password|passw0rd|token|default|unset|empty|<.*>|\[.*\]|%\w+%|%[sdv]|\{\w*\}|@\w+@|__\w+__)$"
)
REFERENCE = re.compile(
    r"(?i)\$\{|\$\(|\{\{|<%|#\{|%\(\w+\)s|^\$\w+$|^(?:vault|env|file|ssm|secret|secrets|sm|aws|gcp|azure|op|k8s|kv|arn|ref|config|keyring|keychain|https?|ftp)[:/]|^(?:md5|sha\d*|blake\w*|crc\w*|pbkdf2\w*|bcrypt|scrypt|argon2\w*)[:$-]|^\$2[aby]\$|^data:|^-----BEGIN|^(?:process\.env|os\.|ENV\[)"
)
UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
SIGNED = re.compile(r"^[\w-]{16,}\.[\w-]{16,}\.[\w-]{8,}$")
ISSUED = re.compile(r"^(?=.{16,120}$)[A-Za-z][A-Za-z0-9]{1,7}(?:[-_](?:[a-z]{2,4}|[a-z]?\d))?[-_.][A-Za-z0-9]{14,}(?:[-_][A-Za-z0-9]+)*$")
#: Greatest length of a seed; the first bytes, in base64, of images, documents, archives, fonts and markup.
SEED = 300
DATA = re.compile(r"^(?:iVBORw0|/9j/|R0lGOD|UklGR|JVBER|UEsDB|H4sI|AAEAAA|d09G|T1RUTw|PHN2Zy|PD94bW)")

_STRING = (
    r"(?P<q>" + '"""' + r'(?:[^"\\]++|\\[\s\S]|"(?!""))*+' + '"""' + r"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|"
    r'"(?:[^"\\\n]++|\\[\s\S])*+"' + r"|'(?:[^'\\\n]++|\\[\s\S])*+'|`(?:[^`\\]++|\\[\s\S])*+`)"
)
_SLASHES = r"(?P<c>//[^\n]*|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?)"
_HASHES = r"(?P<c>#[^\n]*)"
LEXERS = {
    "hash": re.compile(f"[^\"'`#]++|{_HASHES}|{_STRING}|[\\s\\S]"),
    "slash": re.compile(f"[^\"'`/]++|{_SLASHES}|{_STRING}|[\\s\\S]"),
}

#: Tokens besides strings and comments: names (a hyphen within them is of configuration), numbers, signs.
_REST = r"(?P<w>[A-Za-z_$][\w$]*(?:-[\w$]+)*)|(?P<n>\d[\w.]*)|(?P<s>:=|=>|==|!=|<=|>=|->|::|\|\||\?\?|&&|\[\]|[^\s\w])|\s+|[\s\S]"
TOKENS = {"hash": re.compile(f"{_HASHES}|{_STRING}|{_REST}"), "slash": re.compile(f"{_SLASHES}|{_STRING}|{_REST}")}
#: What may stand before a string and belongs to it, calls that wrap a value, signs of types, calls
#: that look up a name and take a value in its place, and what joins such a value.
MARKS = re.compile(r"(?i)^(?:r|b|u|f|l|rb|br|fr|rf|u8)$")
WRAPPERS = {"String", "byte", "bytes", "str", "Buffer"}
TYPE_SIGNS = {".", "[", "]", "[]", "<", ">", "|", "*", "?", "&"}
LOOKUP = re.compile(r"(?i)(?:^|_|\.|(?<=[a-z]))(?:get_?env|env\w*\.get|env_?or\w*|lookup_?env\w*|get_?or_?default|get_?config|setdefault)$|\.get$")
OTHERWISE = {"||", "??", "or"}
JOIN = re.compile(r"[ \t]*(?:\+|\.\.|\\)?[ \t]*\r?\n?[ \t]*(?:\+[ \t]*)?(?=[\"'`])")

ADDRESS = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]{1,20}://[^\s:/@\"'`<>]{1,80}:([^\s@/\"'`<>]{3,})@[\w.\-\[]")
HEADER = re.compile(r"(?i)\b(?:proxy-)?authorization[\"']?\s*[:=,]\s*[\"']?(basic|bearer|token|digest|apikey)\s+([^\s\"'`,;\\]{6,})")
KEYED_HEADER = re.compile(r"(?i)(?<![\w-])x-([a-z][\w-]{1,40})[\"']?\]?\s*[:=,]\s*[\"']?([^\s\"'`,;\\]{6,})")
CONNECTION = re.compile(r"(?i)(?:[;?&\"'`]|^)\s*(?:pwd|password|accountkey|sharedaccesskey|access_token|api_key|apikey|auth_token|sig|secret)\s*=\s*([^\s;&\"'`]{4,})")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----((?:[A-Za-z0-9+/=\s,:\-\\\"']|\\[nr])*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)")
PROSE = re.compile(
    r"(?i)\b(?:log-?in|password|passwd|passphrase|pw|pwd|passcode|api[ -]?key|(?:access |auth |api |service |bearer )?token|secret(?: key)?|credentials?|kennwort|passwort|contrase(?:ñ|n)a|clave)\b"
    r"(?:\s+(?:is|ist|es|for [\w.-]+ is|to [\w.-]+ is))?\s*(?:[:=]|\bis\b|\bist\b|->)\s*(?:[\w.@-]+\s*(?:/|:)\s+)?[\"'`]?([^\s\"'`,;()<>]{6,})"
)
PAIR = re.compile(r"(?<![\w/.])[\w.@+-]{2,40}[ \t]+/[ \t]+([^\s\"'`,;()<>/]{6,100})")
EXPORTED = re.compile(r"^[ \t$>]*(?:export\s+|set\s+|setx\s+|ENV\s+|ARG\s+)?([A-Za-z_][A-Za-z0-9_]*)=(?![=\s])([^\s\"'`;#]{4,})", re.M)
PLAIN_ENTRY = re.compile(r"^[ \t-]*([A-Za-z_][\w.\-]*)[ \t]*:[ \t]+([^\s\"'#|>&*\[{][^\n#]*?)[ \t]*(?:#.*)?$", re.M)
FLAG = re.compile(r"(?<![\w-])--?(?:password|passwd|token|secret|api-?key|auth-token)[= ]([^\s\"'`;|<>]{6,})")
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])")


def names_secret(name: str) -> bool:
    """Whether an identifier names a credential, and not something about one."""
    words = [w.lower() for w in SPLIT.split(name) if w]
    at = next((i for i, w in enumerate(words) if w in SECRET_WORDS or w in ("key", "seed") and i and words[i - 1] in KEY_WORDS), None)
    if at is None:
        return False
    return not any(w in ABOUT_WORDS for w in words[at + 1 :]) and "public" not in words[:at]


def secret(name: str, value: str) -> bool:
    """Whether a value under this name is a credential."""
    return names_secret(name) and opaque(value) and not (len(value) > SEED and name.lower().rstrip("_").endswith("seed"))


def mixed(value: str) -> bool:
    """Letters of both cases and digits, as random text over an alphabet has, or so many letters of both without words."""
    if not (any(c.islower() for c in value) and any(c.isupper() for c in value)):
        return False
    return any(c.isdigit() for c in value) or len(value) >= 18 and not re.fullmatch(r"(?:[A-Z]?[a-z]++|[A-Z]++(?![a-z]))+", value)


def opaque(value: str) -> bool:
    """A value that reads like a secret: no stand-in, no reference, no words alone."""
    if len(value) < 6 or any(c.isspace() for c in value) or DATA.match(value) or STAND_IN.match(value) or REFERENCE.search(value) or UUID.match(value):
        return False
    if len(set(value)) < 4 or "|" in value and value.count("|") > 2:
        return False
    digit, letter = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
    odd = any(not c.isalnum() and c not in "-_./: " for c in value)
    cases = any(c.islower() for c in value) and sum(c.isupper() for c in value) >= 2 and len(value) >= 12 and not re.fullmatch(r"(?:[A-Z]?[a-z]++[-_.]?)+", value)
    return letter and (digit or odd or cases)


class Tokens:
    """The lexical tokens of a text, and what a literal among them is assigned or passed to."""

    def __init__(self, text: str, style: str):
        self.text = text
        self.found = [m for m in TOKENS[style].finditer(text) if m.lastgroup and m.lastgroup != "c"]
        self.at = {m.start(): i for i, m in enumerate(self.found)}

    def __getitem__(self, i: int) -> str:
        return self.found[i][0] if 0 <= i < len(self.found) else ""

    def kind(self, i: int) -> str:
        return self.found[i].lastgroup if 0 <= i < len(self.found) else ""

    def name(self, i: int) -> str:
        """The name that ends at a token: a word, or what is in a string or between brackets."""
        if self[i] == "[]":
            i -= 1
        elif self[i] == "]":
            if self.kind(i - 1) == "q" and self[i - 2] == "[":
                return self.inner(i - 1)
            if self.kind(i - 1) == "n" and self[i - 2] == "[":
                i -= 3
        return self[i] if self.kind(i) == "w" else self.inner(i) if self.kind(i) == "q" else ""

    def inner(self, i: int) -> str:
        lo, hi = inner_span(self[i])
        return self[i][lo:hi]

    def before(self, i: int) -> int:
        """The token before a literal, without the letters that belong to it."""
        i -= 1
        if self.kind(i) == "w" and MARKS.match(self[i]) and self.found[i].end() == self.found[i + 1].start():
            i -= 1
        return i

    def assigned(self, i: int) -> str:
        """The name a value that begins after token i is assigned to, as target, key or default."""
        if self[i] == "&":
            i -= 1
        elif self[i] == "(":
            if self[i - 1] in WRAPPERS:
                i -= 3 if self[i - 2] == "[]" else 2
            elif self[i - 2] == "new":
                i -= 3
            else:
                i -= 1
        if self[i] not in (":=", "=", ":"):
            return self[i] if self.kind(i) == "w" and self[i - 1] == "define" and self[i - 2] == "#" else ""
        sign, i = self[i], i - 1
        if sign == "=":
            k, inside = i, 0
            while k > i - 40 and (self.kind(k) == "w" or self[k] in TYPE_SIGNS or inside and self[k] == ","):
                inside += {">": 1, "<": -1}.get(self[k], 0)
                k -= 1
            if self[k] == ":" and k < i and (typed := self.name(k - 1)):
                return typed
            if self.kind(i) == "w" and self.kind(i - 1) == "w" and self[i - 2] in ("var", "const"):
                return self[i - 1]
        return self.name(i)

    def passed(self, i: int) -> tuple[str, int, int]:
        """(called name with what it is of, number of arguments before, the bracket) of the call a
        value that begins after token i is an argument of; an empty name if it is of none."""
        commas = depth = 0
        while i >= 0:
            t = self[i]
            if t in (")", "]", "}"):
                depth += 1
            elif t in ("(", "[", "{"):
                if depth == 0:
                    break
                depth -= 1
            elif not depth and t == ",":
                commas += 1
            elif not depth and t in (";", "=", ":=", ":", "=>"):
                return "", 0, -1
            i -= 1
        if self[i] != "(" or self.kind(i - 1) != "w":
            return "", 0, -1
        k, called = i - 1, self[i - 1]
        while self[k - 1] == "." and self.kind(k - 2) == "w":
            called, k = f"{self[k - 2]}.{called}", k - 2
        return called, commas, i

    def looked_up(self, i: int) -> tuple[str, int] | None:
        """(name, first token) of the look-up whose place the value after token i takes, if nothing is found."""
        if self[i] in OTHERWISE:
            if self[i - 1] == "]" and self.kind(i - 2) == "q" and self[i - 3] == "[" and self[i - 4] in ("env", "environ", "ENV"):
                return self.inner(i - 2), i - 4
            if self.kind(i - 1) == "w" and self[i - 2] == "." and self[i - 3] in ("env", "environ", "ENV"):
                return self[i - 1], i - 3
            return None
        called, earlier, bracket = self.passed(i)
        if earlier == 1 and LOOKUP.search(called) and self.kind(bracket + 1) == "q":
            return self.inner(bracket + 1), bracket
        return None

    def target(self, i: int) -> str:
        """The name that what token i is part of is assigned to, on its line."""
        begin = self.text.rfind("\n", 0, self.found[i].start()) + 1
        while i >= 0 and self.found[i].start() >= begin:
            if self[i] in ("=", ":=", ":"):
                return self.assigned(i)
            i -= 1
        return ""

    def secret(self, i: int, value: str) -> bool:
        """Whether the value of literal i goes to a name of a credential."""
        at = self.before(i)
        if known := self.looked_up(at):
            return secret(known[0], value) or secret(self.target(known[1]), value)
        if name := self.assigned(at):
            return secret(name, value)
        called, earlier, _ = self.passed(at)
        last = called.rpartition(".")[2]
        return bool(LOGIN_CALLS.search(last) and (earlier or re.search(r"(?i)password|token|secret|key|credential|bearer", last)) and opaque(value))


def inner_span(literal: str) -> tuple[int, int]:
    """Where the value of a string literal begins and ends within it."""
    width = 3 if literal[:3] in ('"""', "'''") and len(literal) >= 6 else 1
    return width, len(literal) - width


def basic_pair(value: str) -> bool:
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode()
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    user, colon, word = plain.partition(":")
    return bool(colon and user and word) and not STAND_IN.match(word) and not REFERENCE.search(word)


def _carried(text: str) -> Iterator[tuple[int, int]]:
    """Spans of values whose surroundings say what they are, anywhere in the text."""
    low = text.lower()
    if "://" in text:
        for m in ADDRESS.finditer(text):
            v = m[1]
            if not STAND_IN.match(v) and not REFERENCE.search(v) and not re.fullmatch(r"[A-Z][A-Z_]+|\W+", v):
                yield m.span(1)
    if "authorization" in low:
        for m in HEADER.finditer(text):
            kind, v = m[1].lower(), m[2]
            if STAND_IN.match(v) or REFERENCE.search(v):
                continue
            if basic_pair(v) if kind == "basic" else opaque(v) or SIGNED.match(v):
                yield m.span(2)
    if "x-" in low:
        for m in KEYED_HEADER.finditer(text):
            if (names_secret(m[1]) or not {"auth", "authorization"}.isdisjoint(re.split(r"[-_]", m[1].lower()))) and opaque(m[2]):
                yield m.span(2)
    if "=" in text and any(w in low for w in ("pwd", "password", "key", "token", "sig=", "secret")):
        for m in CONNECTION.finditer(text):
            v = m[1]
            if re.search(r"[;?&]", text[max(0, m.start() - 1) : m.start() + 1]) and not STAND_IN.match(v) and not REFERENCE.search(v):
                yield m.span(1)
    if "PRIVATE KEY" in text:
        for m in PRIVATE.finditer(text):
            if len(re.sub(r"\W|\\[nr]", "", m[1])) >= 24:
                yield m.span(0)


def _prose(text: str, base: int) -> Iterator[tuple[int, int]]:
    for m in PROSE.finditer(text):
        v = m[1].rstrip(".")
        if opaque(v) and any(c.isdigit() for c in v) and not re.search(r"[=(){}\[\]]|^\d+\w?$", v):
            yield base + m.start(1), base + m.start(1) + len(v)


def _pairs(text: str, base: int) -> Iterator[tuple[int, int]]:
    """User and password with a stroke between, as they are noted in comments."""
    for m in PAIR.finditer(text) if " / " in text else ():
        v = m[1].rstrip(".")
        if len(v) >= 8 and opaque(v) and any(c.isdigit() for c in v) and re.search(r"[A-Za-z]{3}", v) and re.search(r"[0-9]{3}|[!#$%^&*@]|-.*-", v) and not re.search(r"[=(){}\[\]:]", v):
            yield base + m.start(1), base + m.start(1) + len(v)


def find(text: str, path: str) -> list[tuple[int, int]]:
    """Spans (begin, end) of credentials' values in a chunk's text, by their place in it.

    A value in several joined literals is one find, with the span of the first literal's value
    to the last one's; redaction touches the literals alone.
    """
    language = language_of(path)
    spans = set(_carried(text))
    hidden = sorted(spans)
    if language in ("markdown", "yaml", None):
        for m in EXPORTED.finditer(text):
            if secret(m[1], m[2]):
                spans.add(m.span(2))
        if language != "yaml":
            spans.update(_prose(text, 0))
            spans.update(_pairs(text, 0))
    for m in FLAG.finditer(text) if "--" in text else ():
        if opaque(m[1]):
            spans.add(m.span(1))
    if language == "yaml":
        for m in PLAIN_ENTRY.finditer(text):
            if secret(m[1], m[2]):
                spans.add(m.span(2))
    style = "hash" if language in ("python", "yaml") else "slash"
    lexed: Tokens | None = None
    tokens = [m for m in LEXERS[style].finditer(text) if m.lastgroup] if any(q in text for q in "\"'`#/") else []
    joined = 0
    for i, m in enumerate(tokens):
        if m.lastgroup == "c":
            if language != "markdown":
                spans.update(_prose(m[0], m.start()))
                spans.update(_pairs(m[0], m.start()))
                for e in re.finditer(r"([A-Za-z_]\w*)\s*(?::=|=|:)\s*[\"'`]([^\"'`\n]+)[\"'`]", m[0]):
                    if secret(e[1], e[2]):
                        spans.add((m.start() + e.start(2), m.start() + e.end(2)))
            continue
        if i < joined:
            continue
        lo, hi = inner_span(m[0])
        begin, end, value = m.start() + lo, m.start() + hi, m[0][lo:hi]
        last = i
        while last + 1 < len(tokens) and tokens[last + 1].lastgroup == "q" and language not in ("json", "yaml", "markdown"):
            gap = JOIN.match(text, tokens[last].end())
            if not gap or gap.end() != tokens[last + 1].start():
                break
            last += 1
            a, b = inner_span(tokens[last][0])
            value += tokens[last][0][a:b]
            end = tokens[last].start() + b
        joined = last + 1
        if len(value) < 6 or value[:1].isspace():
            continue
        if any(a < end and begin < b for a, b in hidden):
            continue
        plain = opaque(value)  # what is no secret by itself needs no name
        if not plain and not ("-" in value or "_" in value or "." in value):
            continue
        if "{" in value and re.search(r"(?i)(?<!\w)(?:f|fr|rf)$", text[max(0, m.start() - 3) : m.start()]):
            continue  # put together when it runs
        if m[0][:1] == "`" and "${" in value:
            continue
        found = False
        if plain:
            lexed = lexed or Tokens(text, style)
            found = m.start() in lexed.at and lexed.secret(lexed.at[m.start()], value)
        if not found and ("-" in value or "_" in value or "." in value):
            issued = ISSUED.match(value) and mixed(re.split(r"[-_.]", value)[-1])
            found = bool(issued or SIGNED.match(value) and mixed(value)) and not REFERENCE.search(value)
        if found:
            spans.add((begin, end))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if not out or a >= out[-1][1]:
            out.append((a, b))
        elif b > out[-1][1]:
            out[-1] = (out[-1][0], b)
    return out


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the values blanked out, as long as before.

    Letters and digits become ``x``, or ``0`` where the value has digits alone, and so do signs,
    but quotes, escapes, line ends, brackets of joined literals and the frame of a private key
    stay; the text has the same tokens as before.
    """
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        value = text[a:b]
        if "-----" in value:
            parts = re.split(r"(-----[A-Z0-9 ]+-----|\\[\s\S])", value)
            out.append("".join(p if i % 2 else re.sub(r"[^\s\"'`+,]", "x", p) for i, p in enumerate(parts)))
        elif re.search(r"[\"'`][^\"'`]*[\"'`]", value):
            parts = re.split(r"([\"'`]\s*(?:\+|\.\.|\\)?\s*(?:\+\s*)?[\"'`]|\\[\s\S])", value)
            out.append("".join(p if i % 2 else re.sub(r"[^\s]", "x", p) for i, p in enumerate(parts)))
        else:
            parts = re.split(r"(\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[\s\S]))", value)
            out.append("".join(p if i % 2 else re.sub(r"[^\s\"'`]", "x", p) for i, p in enumerate(parts)))
        at = b
    out.append(text[at:])
    return "".join(out)


def credentials(chunks: DataFrame) -> DataFrame:
    """One row per chunk id with a credential: id, file_path, lines (array), redacted.

    ``lines`` are those of the file, by the chunk's start_line (1 where it is null), on which a
    value begins; ``redacted`` is the content with the values blanked out. Null contents have
    none. Repeated rows of an id count once; an empty table gives no rows. The only shuffle is
    that of the finds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, path, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                spans = find(text, path or "") if text else []
                if spans:
                    lines = sorted({(start or 1) + text.count("\n", 0, a) for a, _ in spans})
                    rows.append((key, path, lines, redact(text, spans)))
            cols = list(zip(*rows)) or [[], [], [], []]
            kinds = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "file_path", "lines", "redacted"])

    rows = chunks.where(chunks["content"].isNotNull()).select("id", "file_path", "start_line", "content")
    found = rows.mapInArrow(run, "id string, file_path string, lines array<int>, redacted string")
    return found.groupBy("id").agg(
        F.min("file_path").alias("file_path"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("lines"), F.min("redacted").alias("redacted")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk and line on which a credential's value begins."""
    return credentials(table(spark, sf_dir, "chunks")).select("id", F.explode("lines").alias("line"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of chunks with credentials, blanked out."""
    return credentials(table(spark, sf_dir, "chunks")).select("id", "file_path", "redacted")


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted}
SQL: dict[str, str] = {}
