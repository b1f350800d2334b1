"""Token streams and grammars of the languages that files are parsed in.

Each language has a scanner (one regular expression; what it does not know becomes a token of
its own, so nothing is skipped unseen) and a grammar in the notation of ``derivative``. The
grammars are of syntax alone and lean towards acceptance: precedence, types and scopes are not
checked, conditional expressions nest four deep on their middle branch.
"""

from __future__ import annotations

import re
from functools import lru_cache

from tessera.llm.derivative import BAD, CLOSES, OPENS, SOFT, grammar

#: Extensions and the language they stand for.
EXTENSIONS = {
    "py": "python", "pyw": "python", "pyi": "python",
    "go": "go",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "c": "c", "h": "c",
    "json": "json",
    "yaml": "yaml", "yml": "yaml",
    "md": "markdown", "markdown": "markdown",
}


def language_of(path: str) -> str | None:
    """The language a path's extension stands for, or None."""
    name = path.rpartition("/")[2]
    return EXTENSIONS.get(name.rpartition(".")[2].lower()) if "." in name else None


NUMBER = r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?\w*|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?\w*"
DOUBLE, SINGLE = r'"(?:[^"\\\n]++|\\[\s\S])*+"', r"'(?:[^'\\\n]++|\\[\s\S])*+'"
BLOCK_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+\*/"
WORD = r"[^\W\d]\w*"


class Scanner:
    """Splits a text into tokens and names their classes; classes of texts are remembered.

    ``closed`` is what has an end of its own, a string or comment, and ``opener`` its beginning.
    One that isn't closed takes the whole rest as the last token, so no text is scanned twice.
    """

    def __init__(self, pattern: str, keywords: str, name, closed: str, opener: str):
        self.find = re.compile(pattern.replace("CLOSED", f"{closed}|(?:{opener})[\\s\\S]*+")).findall
        self.closed, self.opener = re.compile(closed), re.compile(opener)
        self.known = {k: k for k in keywords.split()}
        self.name = name

    def classes(self, text: str) -> list[str]:
        tokens = self.find(text)
        known, name = self.known, self.name
        out = []
        if tokens and self.opener.match(tokens[-1]) and not self.closed.fullmatch(tokens[-1]):
            tokens[-1] = BAD
        for t in tokens:
            c = known.get(t)
            if c is None:
                c = name(t) if t != BAD else BAD
                if len(t) < 40 and len(known) < 50_000:
                    known[t] = c
            if c:
                out.append(c)
        return out


# ---------------------------------------------------------------- json

JSON_GRAMMAR = """
file = value
value = S | N | true | false | null | {:object:} | [:array:]
object = (S ':' value (',' S ':' value)*)?
array = (value (',' value)*)?
"""


def _json_name(t: str) -> str:
    if t[0] == '"' and len(t) > 1:
        return "S"
    return "N" if re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", t) else t if t in "{}[],:" else BAD


JSON_SCANNER = Scanner(
    r'[ \t\n\r]*(CLOSED|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.])|[\w.]+|[^ \t\n\r])',
    "true false null",
    _json_name,
    r'"(?:[^"\\\x00-\x1f]++|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+"',
    '"',
)


def json_classes(text: str) -> list[str]:
    return JSON_SCANNER.classes(text)


# ---------------------------------------------------------------- python

PYTHON_GRAMMAR = """
file = stmt*
body = stmt+
ident = I | match | case | type | '_'
stmt = simple (';' simple)* ';'? NL | compound
suite = ':' (simple (';' simple)* ';'? NL | NL <:body:>)
compound = 'if' cond suite ('elif' cond suite)* ('else' suite)?
  | 'while' cond suite ('else' suite)?
  | async? for targets in exprs suite ('else' suite)?
  | try suite ((except '*'? (exprs (as ident)?)? suite)+ ('else' suite)? (finally suite)? | finally suite)
  | async? with (witem (',' witem)* | (:witems:)) suite
  | async? def ident [:tparams:]? (:params:) ('->' exprs)? suite
  | class ident [:tparams:]? (:args:)? suite
  | match exprs ':' NL <:cases:>
  | '@' cond NL
cases = (case cpat (',' cpat)* ','? ('if' cond)? suite)+
cpat = '*'? chain (as ident)?
witem = cond (as target)?
witems = witem (',' witem)* ','?
simple = exprs (':' cond)? ('=' (yieldx | exprs))* | exprs aug (yieldx | exprs) | yieldx
  | pass | break | continue | return exprs? | raise (cond (from cond)?)?
  | (global | nonlocal) ident (',' ident)* | del exprs | assert cond (',' cond)?
  | import dotted (as ident)? (',' dotted (as ident)?)*
  | from ('.' | '...')* dotted? import ('*' | (:imports:) | imported (',' imported)*)
  | type ident [:tparams:]? '=' cond
imported = ident (as ident)?
imports = imported (',' imported)* ','?
dotted = ident ('.' ident)*
yieldx = yield (from cond | exprs)?
aug = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
atom = ident | N | S+ | None | True | False | '...' | (:paren:) | [:paren:] | {:dict:}
trailer = '.' ident | (:args:) | [:subs:]
unit = ('-' | '+' | '~' | not | await)* atom trailer*
bin = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | ':='
  | in | not in | is not? | and | or
chain = unit (bin unit)*
lparam = ident ('=' chain)? | '*' ident? | '**' ident | '/'
cond = (lambda (lparam (',' lparam)* ','?)? ':' | chain 'if' chain 'else')* chain
star = '*'? cond
exprs = star (',' star)* ','?
target = '*'? atom trailer*
targets = target (',' target)* ','?
comp = (async? for targets in cond ('if' cond)*)+
paren = (yieldx | star (comp | (',' star)* ','?))?
dict = (item (',' item)* ','?)?
item = cond ':' cond comp? | '**' chain | star comp?
args = (arg (',' arg)* ','?)?
arg = ident '=' cond | '*' cond | '**' cond | cond comp?
subs = sub (',' sub)* ','?
sub = star | cond? ':' cond? (':' cond?)?
params = (param (',' param)* ','?)?
param = ident (':' cond)? ('=' cond)? | '*' (ident (':' star)?)? | '**' ident (':' cond)? | '/'
tparams = tparam (',' tparam)* ','?
tparam = ('*' | '**')? ident (':' cond)? ('=' cond)?
"""


def _python_name(t: str) -> str:
    c = t[0]
    if c in "\"'":
        return "S" if len(t) > 1 else BAD
    if c == "#":
        return ""
    if c.isalpha() or c == "_" or ord(c) > 127:
        return "S" if t[-1] in "\"'" else "I" if t.isidentifier() else BAD
    if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
        return "N"
    if c == "\n":
        return t
    return "" if c == "\\" and len(t) == 2 else t if t not in "$?`!\\" else BAD


_LONG = "(?:[rRbBuUfFtT]{1,2})?(?:" + '"""' + r'(?:[^"\\]++|\\[\s\S]|"(?!""))*+' + '"""' + r"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|" + f"(?!\"\"\"|''')(?:{DOUBLE}|{SINGLE}))"
PYTHON_SCANNER = Scanner(
    rf"[ \t\f]*(\n(?:[ \t\f]*+(?:#[^\n]*)?\n)*[ \t\f]*|#[^\n]*|CLOSED|{WORD}|{NUMBER}|\\\n|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|[-+*/%@&|^<>=!]=|\*\*|//|<<|>>|[^ \t\f])",
    "if elif else while for try except finally with def class async await pass break continue return raise from global nonlocal del assert import as in "
    "is not and or lambda yield None True False match case type _",
    _python_name,
    _LONG,
    "(?:[rRbBuUfFtT]{1,2})?[\"']",
)


def python_classes(text: str) -> list[str]:
    """Line ends become NL and changes of indentation brackets; within brackets neither counts."""
    out: list[str] = []
    indents, depth = [0], 0
    for c in PYTHON_SCANNER.classes("\n" + text + "\n"):
        if c[0] == "\n":
            if depth:
                continue
            if out and out[-1] not in ("NL", "\x01", "\x02"):
                out.append("NL")
            width = len(c.rpartition("\n")[2].expandtabs(8))
            if width > indents[-1]:
                indents.append(width)
                out.append("\x01")
            while width < indents[-1]:
                indents.pop()
                out.append("\x02" if width <= indents[-1] else BAD)
        else:
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            out.append(c)
    return out


# ---------------------------------------------------------------- go

GO_GRAMMAR = """
file = package I ';' (import (spec | (:specs:)) ';')* ((decl | func) ';')* (decl | func)?
spec = ('.' | I)? S
specs = (spec ';')* spec?
decl = const (cspec | (:consts:)) | var (vspec | (:vars:)) | type (tspec | (:types:))
names = I (',' I)*
cspec = names (type1? '=' list)?
consts = (cspec ';')* cspec?
vspec = names (type1 ('=' list)? | '=' list)
vars = (vspec ';')* vspec?
tspec = I [:tparams:]? '='? type1
types = (tspec ';')* tspec?
func = 'func' (:params:)? I [:tparams:]? (:params:) result? {:block:}?
result = type1 | (:params:)
params = (param (',' param)* ','?)?
param = I? '...'? type1
tparams = (param ('|' '~'? type1)* | '~' type1 ('|' '~'? type1)*) (',' param ('|' '~'? type1)*)* ','?
tpre = '*' | [:index:] | chan '<-'? | '<-' chan | map [:type1:] | 'func' (:params:)
tbase = I ('.' I)? [:targs:]? | struct {:fields:} | interface {:methods:} | 'func' (:params:) (:params:)? | (:type1:)
type1 = tpre* tbase
index = ('...' | expr | type1)?
targs = type1 (',' type1)* ','?
fields = (field ';')* field?
field = (names type1 | '*'? I ('.' I)? [:targs:]?) S?
methods = (method ';')* method?
method = I (:params:) result? | '~'? type1 ('|' '~'? type1)*
prefix = '+' | '-' | '!' | '^' | '*' | '&' | '<-'
atom = I | N | S | R | (:paren:) | 'func' (:params:) result? {:block:} | tpre+ tbase | struct {:fields:} | interface {:methods:}
paren = expr | type1
trailer = '.' I | '.' (:assert:) | [:subs:] | (:args:) | {:literal:}
assert = type | type1
subs = expr | expr? ':' expr? (':' expr)? | targs
args = (arg (',' arg)* ','?)?
arg = expr '...'? | type1
literal = (element (',' element)* ','?)?
element = (value ':')? value
value = expr | {:literal:}
bin = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '&&' | '||' | '==' | '!=' | '<' | '<=' | '>' | '>='
unit = prefix* atom trailer*
expr = unit (bin unit)*
list = expr (',' expr)*
assign = '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
small = list (assign list)? | expr ('++' | '--') | expr '<-' expr
block = (stmt ';')* stmt?
stmt = (I ':' ';'?)* (decl | small | return list? | (go | defer) expr | (break | continue | goto) I? | fallthrough | {:block:}
  | 'if' (small? ';')? expr {:block:} ('else' 'if' (small? ';')? expr {:block:})* ('else' {:block:})?
  | for (expr? | small? ';' expr? ';' small? | (list ('=' | ':='))? range expr) {:block:}
  | switch (small? ';')? small? {:cases:} | select {:cases:})?
cases = (case (small | type1) (',' (expr | type1))* ':' | default ':' | stmt ';')* stmt?
"""

GO_ENDS = {"I", "N", "S", "R", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def _go_name(t: str) -> str:
    c = t[0]
    if c == "/" and t[:2] in ("//", "/*"):
        return "\n" if "\n" in t else "" if len(t) > 1 and (t[1] == "/" or t.endswith("*/")) else BAD
    if c in '"`':
        return "S" if len(t) > 1 else BAD
    if c == "'":
        return "R" if len(t) > 1 else BAD
    if c.isalpha() or c == "_":
        return "I"
    if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
        return "N"
    return t if t not in "#$?@\\" else BAD


GO_SCANNER = Scanner(
    rf"[ \t]*(\n|//[^\n]*|CLOSED|{WORD}|{NUMBER}|<<=|>>=|&\^=|\.\.\.|&\^|:=|\+\+|--|&&|\|\||<-|<<|>>|[-+*/%&|^<>=!]=|[^ \t])",
    "package import const var type func chan map struct interface return go defer break continue goto fallthrough if else for range switch select case default",
    _go_name,
    rf"{BLOCK_COMMENT}|{DOUBLE}|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{{3}}|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}))'",
    r"[\"'`]|/\*",
)


def go_classes(text: str) -> list[str]:
    """A line end after an operand or a closing bracket is a semicolon."""
    out: list[str] = []
    last = ""
    for c in GO_SCANNER.classes(text + "\n"):
        if c == "\n":
            if last not in GO_ENDS:
                continue
            c = ";"
        out.append(c)
        last = c
    return out


# ---------------------------------------------------------------- c

C_GRAMMAR = """
file = (';' | I S {:file:} | I (:pa:) | head ('=' init)? (',' head ('=' init)?)* ';' | head {:block:})*
agg = (struct | union | enum) (I (:pa:))? I? {:fields:}?
head = (I | agg | '*' | (:pa:) | [:subs:])+
fields = (head (':' expr)? (',' head? (':' expr)?)* ';')* | enumerator (',' enumerator)* ','?
enumerator = I ('=' expr)?
pa = (pitem (',' pitem)*)?
pitem = head | expr | '...' | {:block:}
subs = (static? expr | head)?
block = stmt*
heads = 'if' (:control:) | 'else' | for (:forhead:) | while (:control:) | do | switch (:control:) | case expr ('...' expr)? ':' | default ':' | I ':'
stmt = heads | {:block:} | ';' | list ';' | decl ';' | return init? ';' | (break | continue) ';' | goto '*'? I ';'
decl = (I | agg) head? ('=' init)? (',' head ('=' init)?)*
control = list | decl
forhead = (list | decl)? ';' list? ';' list?
prefix = '!' | '~' | '-' | '+' | '*' | '&' | '++' | '--' | '&&' | sizeof | (:pa:)
atom = I | N | R | S (S | I)* | (:pa:) | (:pa:) {:ilist:} | sizeof (:pa:)
trailer = (:pa:) | [:subs:] | '.' I | '->' I | '++' | '--'
unit = prefix* atom trailer*
bin = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&&' | '||' | '==' | '!=' | '<' | '<=' | '>' | '>='
  | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>='
chain = unit (bin unit)*
mid1 = chain ('?' chain? ':' chain)*
mid2 = chain ('?' mid1? ':' chain)*
expr = chain ('?' mid2? ':' chain)*
list = expr (',' expr)*
init = expr | {:ilist:}
ilist = (entry (',' entry)* ','?)?
entry = (('.' I | [:subs:])+ '=')? init
"""


def _c_name(t: str) -> str:
    if not t:
        return ""
    c = t[0]
    if c == "/" and t[:2] in ("//", "/*"):
        return "" if t[1] == "/" or len(t) > 3 and t.endswith("*/") else BAD
    if t[-1] == '"' and len(t) > 1:
        return "S"
    if t[-1] == "'" and len(t) > 1:
        return "R"
    if c.isalpha() or c == "_":
        return "I"
    if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
        return "N"
    return t if t not in "#$@\\`\"'" else BAD


C_SCANNER = Scanner(
    rf"\s*\n[ \t]*#(?:\\[\s\S]|{BLOCK_COMMENT}|[^\n\\])*+|\s*(//(?:\\\n|[^\n])*|CLOSED|{WORD}|{NUMBER}"
    r"|<<=|>>=|\.\.\.|->|\+\+|--|&&|\|\||<<|>>|[-+*/%&|^<>=!]=|\S)",
    "struct union enum static if else for while do switch case default return break continue goto sizeof",
    _c_name,
    rf"{BLOCK_COMMENT}|(?:u8|[LuU])?(?:{DOUBLE}|{SINGLE})",
    r"(?:u8|[LuU])?[\"']|/\*",
)
C_SCANNER.known["static"] = "I"


def c_classes(text: str) -> list[str]:
    return C_SCANNER.classes("\n" + text)


# ---------------------------------------------------------------- javascript and typescript

SCRIPT_GRAMMAR = """
file = block
end = ';' | EOL
ident = I | as | from | of | get | set | async | let | static | CONTEXT
word = ident | KEYWORDS
block = item* tail?
item = label* (whole | open end)
tail = label+ open | open
label = 'if' (:seq:) | 'else' | for await? (:forhead:) | while (:seq:) | do | with (:seq:) | ident ':' | LABEL
whole = {:block:} | ';' | try {:block:} (catch (:param:)? {:block:})? (finally {:block:})? | switch (:seq:) {:cases:}
  | (export default?)? (func | klass) | WHOLE
open = seq | vars | return seq? | throw seq | (break | continue) ident? | debugger | while (:seq:)
  | import S | import TYPE? (ident (',' ({:names:} | '*' as ident))? | {:names:} | '*' as ident) from S (with {:object:})?
  | export TYPE? ({:names:} (from S)? | '*' (as word)? from S) | export vars | export default expr | OPEN
names = (named (',' named)* ','?)?
named = TYPE? (word | S) (as (word | S))?
vars = (var | let | const) vdecl (',' vdecl)*
vdecl = bind NONNULL? ANN? ('=' expr)?
bind = ident | this | {:object:} | [:list:]
forhead = (vars | seq)? ';' seq? ';' seq? | seq | (var | let | const) bind ANN? (of | in) seq | unit of expr
cases = (case seq ':' | default ':' | item)* tail?
func = async? function '*'? ident? TPARAMS? (:params:) ANN? {:block:}
klass = decorator* ABSTRACT? class ident? TPARAMS? (extends (ident | (:args:)) ('.' word | (:args:) | [:list:])* TARGS?)? IMPLEMENTS? {:members:}
decorator = '@' ident ('.' word)* (:args:)?
atom = ident | N | S | T | R | this | super | null | true | false | yield | (:args:) | [:list:] | {:object:} | func | klass
  | import (:args:) | import '.' ident | new '.' ident
prefix = '!' | '~' | '+' | '-' | '++' | '--' | typeof | void | delete | await | new | yield '*'?
arrow = async? (ident | TPARAMS? (:params:) ANN?) '=>'
trailer = '.' word | '?.' (word | [:list:] | (:args:)) | [:list:] | TARGS? (:args:) | T | '++' | '--' | NONNULL
unit = (prefix | arrow)* atom trailer* | (prefix | arrow)* arrow {:block:}
bin = '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|' | '^' | '<<' | '>' ('>' '>'?)? | '&&' | '||' | '??' | '==' | '!=' | '===' | '!==' | '<' | '<='
  | '>=' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '>' '>'? '>=' | '&&=' | '||=' | '??=' | in | instanceof
chain = unit (bin unit | CAST)*
mid1 = chain ('?' chain ':' chain)*
mid2 = chain ('?' mid1 ':' chain)*
mid3 = chain ('?' mid2 ':' chain)*
expr = chain ('?' mid3 ':' chain)*
seq = expr (',' expr)*
args = ('...'? expr (',' '...'? expr)* ','?)?
list = ','* ('...'? expr (','+ '...'? expr)* ','*)?
params = (param (',' param)* ','?)?
param = decorator* MODS '...'? bind OPTIONAL? ANN? ('=' expr)?
object = (prop (',' prop)* ','?)?
prop = (get | set | async | '*')* pname (TPARAMS? (:params:) ANN? {:block:} | ':' expr | '=' expr)? | '...' expr
pname = word | S | N | [:list:]
members = (method | static {:block:} | field end | ';')* field?
mods = (static | async | get | set | '*' | MOD)*
method = decorator* mods pname OPTIONAL? TPARAMS? (:params:) ANN? {:block:}
field = decorator* mods pname (OPTIONAL | NONNULL)? ANN? ('=' expr)? | FIELD
"""

#: Words of the two languages.
_RESERVED = (
    "if else for while do with try catch finally switch case default return throw break continue debugger import export var const function class extends "
    "this super null true false new typeof void delete await yield in instanceof enum"
)
_CONTEXT = "type interface namespace module declare abstract readonly public private protected override keyof infer is asserts satisfies unique implements accessor global"

TYPE_GRAMMAR = """
type1 = (tunion extends tunion '?' tunion ':')* tunion
tunion = ('|' | '&')? tunit (('|' | '&') tunit)*
tunit = tpre* tatom [:tindex:]* (is tatom [:tindex:]*)?
tpre = keyof | typeof | readonly | unique | infer | asserts | new | abstract | TPARAMS? (:params:) '=>'
tatom = word ('.' word)* targs? | S | N | '-' N | T | {:tobject:} | [:tuple:] | (:type1:) | import (:args:) ('.' word)* targs?
tindex = type1?
tuple = (telement (',' telement)* ','?)?
telement = (ident '?'? ':')? '...'? type1 '?'?
targs = '<' (word | '.' | ',' | '|' | '&' | S | N | T | {:tobject:} | [:tuple:] | (:tany:) | '=>' | '<' | '>' | '=' | '?' | ':' | '-')+ '>'
tany = params | type1
tobject = (tmember (';' | ',' | EOL))* tmember?
tmember = ('+' | '-' | mods)* (pname ('-' | '+')? '?'? (TPARAMS? (:params:))? ANN? | new? TPARAMS? (:params:) ANN? | [:tkey:] ('-' | '+')? '?'? ANN)
tkey = ident (':' type1 | in type1 (as type1)?)
enumbody = (pname ('=' expr)? (',' pname ('=' expr)?)* ','?)?
"""


def _script(typed: bool) -> str:
    never = "'$'"
    slots = {
        "CONTEXT": " | ".join(_CONTEXT.split()),
        "KEYWORDS": " | ".join(f"'{w}'" for w in _RESERVED.split()),
    }
    if typed:
        slots |= {
            "ANN": "(':' type1)", "TARGS": "targs", "TPARAMS": "targs", "NONNULL": "'!'", "OPTIONAL": "'?'", "ABSTRACT": "abstract", "TYPE": "type",
            "IMPLEMENTS": "(implements type1 (',' type1)*)", "CAST": "(as | satisfies) tunion", "LABEL": "declare | export declare",
            "MODS": "(readonly | public | private | protected | override)*",
            "MOD": "readonly | public | private | protected | override | abstract | declare | accessor",
            "WHOLE": "export? interface ident targs? (extends type1 (',' type1)*)? {:tobject:} | export? const? enum ident {:enumbody:}"
            " | export? (namespace | module | global) (ident ('.' ident)* | S)? {:block:}",
            "OPEN": "export? type ident targs? '=' type1 | (export default?)? async? function '*'? ident targs? (:params:) (':' type1)? | export '=' expr"
            " | export? import ident '=' expr",
            "FIELD": "mods [:tkey:] ':' type1 | mods pname '?'? targs? (:params:) (':' type1)?",
        }
    else:
        slots |= dict.fromkeys("ANN TARGS TPARAMS NONNULL OPTIONAL ABSTRACT TYPE IMPLEMENTS CAST LABEL MOD WHOLE OPEN FIELD".split(), never) | {"MODS": f"{never}*"}
    text = SCRIPT_GRAMMAR + (TYPE_GRAMMAR.lstrip() if typed else "")
    return re.sub(r"\b[A-Z]{3,}\b", lambda m: slots.get(m[0], m[0]), text)


def _script_name(t: str) -> str:
    c = t[0]
    if c == "\n":
        return SOFT
    if c in "\"'":
        return "S" if len(t) > 1 else BAD
    if c == "`":
        return "T" if len(t) > 1 else BAD
    if c == "/":
        if t[:2] in ("//", "/*"):
            return "" if t[1] == "/" else BAD if not t.endswith("*/") else SOFT if "\n" in t else ""
        return "R" if len(t) > 2 else t
    if c.isalpha() or c in "_$":
        return "I"
    if c == "#":
        return "I" if len(t) > 1 else BAD
    if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
        return "N"
    return t if t != "\\" else BAD


_HOLE = r"\$\{(?:[^{}`'\"/]++|" + f"{DOUBLE}|{SINGLE}" + r"|/|`(?:[^`\\]++|\\[\s\S])*+`|\{(?:[^{}`'\"]++|" + f"{DOUBLE}|{SINGLE}" + r"|`(?:[^`\\]++|\\[\s\S])*+`|\{[^{}]*\})*+\})*+\}"
_TEMPLATE = rf"`(?:[^`\\$]++|\\[\s\S]|{_HOLE}|\$(?!\{{))*+`"
_REGEX = (
    r"(?:(?<=[(,=:\[!&|?{};+\-*%<>~^\n])|(?<=[(,=:\[!&|?{};+\-*%<>~^] )|(?<=return )|(?<=typeof )|(?<=case ))"
    r"/(?![*/])(?:[^\\/\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*"
)
_SCRIPT_PATTERN = (
    rf"[ \t\f\xa0﻿]*(\n\s*|//[^\n]*|{_REGEX}|CLOSED|#?[^\W\d]\w*(?:[\w$]*)|\$[\w$]*|{NUMBER}|#"
    r"|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|\.\.\.|=>|\?\.(?!\d)|\*\*|<<|&&|\|\||\?\?|\+\+|--|[-+*/%&|^<>=!]=|[^ \t])"
)
SCRIPT_SCANNER = Scanner(_SCRIPT_PATTERN, f"{_RESERVED} {_CONTEXT} as from of get set async let static", _script_name, f"{BLOCK_COMMENT}|{DOUBLE}|{SINGLE}|{_TEMPLATE}", r"[\"'`]|/\*")


def script_classes(text: str) -> list[str]:
    """Line ends may end a statement; runs of them count once."""
    if text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    out: list[str] = []
    last = SOFT
    for c in SCRIPT_SCANNER.classes(text):
        if c != SOFT or last != SOFT:
            out.append(c)
            last = c
    return out


# ---------------------------------------------------------------- yaml

YAML_GRAMMAR = """
file = DOC* node? (DOC+ node?)*
node = P* (map | seq | V | flow | <:node:>)
map = (K P* value)+
value = (V | flow | <:node:> | seq)?
seq = (D (<:node:> | V | flow)?)+
flow = P* (V | [:flowseq:] | {:flowmap:})
flowseq = (entry (',' entry)* ','?)?
flowmap = (entry (',' entry)* ','?)?
entry = flow (':' flow?)? | ':' flow?
"""

_YAML_QUOTED = re.compile(r'"(?:[^"\\]++|\\[\s\S])*+"|' + r"'(?:[^']++|'')*+'")
_YAML_PROPERTY = re.compile(r"(?:[&!][^\s,\[\]{}]*|\*[^\s,\[\]{}]+)(?=\s|$|[,\]}])")
_YAML_BLOCK = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:#.*)?$")
_YAML_KEY = re.compile(r"(?:[^\s#&*!|>'\"%@`,\[\]{}?:-]|[?:-](?=[^\s]))(?:[^:#\n]++|:(?=\S)|(?<=\S)#)*?[ \t]*:(?=\s|$)")
_YAML_PLAIN = re.compile(r"(?:[^\s#&*!|>'\"%@`,\[\]{}?:-]|[?:-](?=[^\s]))(?:[^\n:#]++|:(?=\S)|(?<=\S)#)*+")
_FLOW_PLAIN = re.compile(r"[^\s,\[\]{}:\"'#&*!|>%@`][^,\[\]{}\n:#]*(?:(?::(?=[^\s,\[\]{}])|(?<=\S)#)[^,\[\]{}\n:#]*)*")
_REST = re.compile(r"[ \t]*(?:#[^\n]*)?(?=\n|$)")


def yaml_classes(text: str) -> list[str]:
    """Blocks by indentation; keys (K), entries (D), scalars (V), properties (P), flow brackets."""
    out: list[str] = []
    columns = [-1]  # of the open blocks
    at, size = 0, len(text)

    def end_of(pos: int) -> int:
        stop = text.find("\n", pos)
        return size if stop < 0 else stop

    def rest_is_blank(pos: int) -> bool:
        found = _REST.match(text, pos)
        return bool(found) and (found.end() == pos or text[pos] in " \t\n" or found.group() == "")

    def flow(pos: int) -> int:
        """Tokens of a flow collection; where it ends, or -1."""
        depth = 0
        while pos < size:
            c = text[pos]
            if c in " \t\n":
                pos += 1
            elif c == "#":
                pos = end_of(pos)
            elif c in "[{":
                depth += 1
                out.append(c)
                pos += 1
            elif c in "]}":
                depth -= 1
                out.append(c)
                pos += 1
                if not depth:
                    return pos
            elif c in ",:":
                out.append(c)
                pos += 1
            elif m := _YAML_QUOTED.match(text, pos) if c in "\"'" else None:
                out.append("V")
                pos = m.end()
            elif m := _YAML_PROPERTY.match(text, pos):
                out.append("V" if c == "*" else "P")
                pos = m.end()
            elif m := _FLOW_PLAIN.match(text, pos):
                while True:  # a plain scalar may go on in the next line
                    pos = m.end()
                    nxt = re.compile(r"\s+").match(text, pos)
                    m = _FLOW_PLAIN.match(text, nxt.end()) if nxt else None
                    if not m:
                        break
                out.append("V")
            else:
                return -1
        return -1

    while at < size:
        stop = end_of(at)
        line = text[at:stop]
        bare = line.strip(" \t")
        if not bare or bare[0] == "#":
            at = stop + 1
            continue
        if re.match(r"(?:---|\.\.\.)(?=\s|$)", line):
            out += ["\x02"] * (len(columns) - 1)
            columns = [-1]
            out.append("DOC")
            if rest_is_blank(at + 3) or line[:3] == "...":
                at = stop + 1
                continue
            at += 4
            column = 4 + len(text[at:stop]) - len(text[at:stop].lstrip(" "))
            at += column - 4
        elif line[0] == "%" and columns == [-1]:
            at = stop + 1
            continue
        else:
            column = len(line) - len(line.lstrip(" "))
            if line[column] == "\t":
                return [*out, BAD]
            at += column
        while len(columns) > 1 and column < columns[-1]:
            columns.pop()
            out.append("\x02")
        if column > columns[-1]:
            columns.append(column)
            out.append("\x01")
        elif column < columns[-1]:
            return [*out, BAD]
        # entries and keys that begin in this line
        here = False
        while True:
            c = text[at] if at < size else "\n"
            if c == "-" and text[at + 1 : at + 2] in (" ", "\n", "", "\t"):
                out.append("D")
                skip = len(text[at + 1 : end_of(at)]) - len(text[at + 1 : end_of(at)].lstrip(" \t"))
                at += 1 + skip
                if rest_is_blank(at) or at >= size:
                    at = end_of(at) + 1
                    break
                column += 1 + skip
                columns.append(column)
                out.append("\x01")
                here = False
                continue
            if c in "\"'":
                m = _YAML_QUOTED.match(text, at)
                if not m:
                    return [*out, BAD]
                after = re.compile(r"[ \t]*:(?=\s|$)").match(text, m.end())
                if after and "\n" not in m.group():
                    if here:
                        return [*out, BAD]
                    out.append("K")
                    at, here = after.end(), True
                else:
                    out.append("V")
                    if not rest_is_blank(m.end()):
                        return [*out, BAD]
                    at = end_of(m.end()) + 1
                    break
            elif c in "[{":
                end = flow(at)
                if end < 0:
                    return [*out, BAD]
                after = re.compile(r"[ \t]*:(?=\s|$)").match(text, end)
                if after or not rest_is_blank(end):
                    return [*out, BAD]
                at = end_of(end) + 1
                break
            elif c in "&!*" and (m := _YAML_PROPERTY.match(text, at)):
                if c == "*":
                    after = re.compile(r"[ \t]+:(?=\s|$)").match(text, m.end())
                    out.append("K" if after else "V")
                    at = after.end() if after else m.end()
                    here = here or bool(after)
                else:
                    out.append("P")
                    at = m.end()
            elif c in "|>":
                if not _YAML_BLOCK.match(text[at : end_of(at)]):
                    return [*out, BAD]
                out.append("V")
                inner, at = columns[-1], end_of(at) + 1
                while at < size:  # all lines deeper than the block that holds the scalar
                    stop = end_of(at)
                    line = text[at:stop]
                    if line.strip(" ") and len(line) - len(line.lstrip(" ")) <= inner:
                        break
                    at = stop + 1
                break
            elif c == "?" and text[at + 1 : at + 2] in (" ", "\n"):
                out.append("K")  # an explicit key; its value line begins with a colon
                at = end_of(at) + 1
                break
            elif m := _YAML_KEY.match(text, at):
                if here:
                    return [*out, BAD]
                out.append("K")
                at, here = m.end(), True
            elif m := _YAML_PLAIN.match(text, at):
                out.append("V")
                at = m.end()
                if not rest_is_blank(at):
                    return [*out, BAD]
                at = end_of(at) + 1
                least = columns[-1] if here else columns[-2]
                while at < size:  # plain scalars go on over deeper lines
                    stop = end_of(at)
                    line = text[at:stop]
                    bare = line.lstrip(" ")
                    if bare.strip():
                        if len(line) - len(bare) <= least or bare[0] == "#" or re.match(r"(?:---|\.\.\.)(?=\s|$)", line):
                            break
                        if re.search(r":(?=\s|$)", bare.partition(" #")[0]):
                            return [*out, BAD]
                    at = stop + 1
                break
            else:
                return [*out, BAD]
            gap = len(text[at : end_of(at)]) - len(text[at : end_of(at)].lstrip(" \t"))
            if rest_is_blank(at) or at + gap >= size:
                at = end_of(at) + 1
                break
            at += gap
    return out + ["\x02"] * (len(columns) - 1)


# ---------------------------------------------------------------- all


@lru_cache(maxsize=None)
def _tools(language: str):
    return {
        "json": (json_classes, JSON_GRAMMAR),
        "python": (python_classes, PYTHON_GRAMMAR),
        "go": (go_classes, GO_GRAMMAR),
        "c": (c_classes, C_GRAMMAR),
        "javascript": (script_classes, _script(False)),
        "typescript": (script_classes, _script(True)),
        "yaml": (yaml_classes, YAML_GRAMMAR),
    }[language]


#: States and steps a worker remembers of a grammar before it forgets all.
REMEMBERED = 2_000_000


def place(text: str, language: str) -> tuple[str, int, int] | None:
    """None if the text parses, else what went wrong and where: (``token``, its number, its line)
    where no parse is left at some token, or (``truncated``, number of tokens, last line) where all
    tokens fit, but something is still open at the end. Tokens count from 0, lines from 1.

    The line is the first whose text, with what is before it, has the token.
    """
    if language == "markdown":
        return None
    classes, source = _tools(language)
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n") if language != "json" else text
    stream = classes(text)
    rules = grammar(source)
    at = rules.parse(stream)
    if rules.remembered() > REMEMBERED:
        grammar.cache_clear()
    if at < 0:
        return None
    lines = text.split("\n")
    if at == len(stream):
        return "truncated", at, len(lines)
    low, high = 1, len(lines)
    while low < high:
        middle = (low + high) // 2
        if len(classes("\n".join(lines[:middle]))) > at:
            high = middle
        else:
            low = middle + 1
    return "token", at, low


def failure(text: str, language: str) -> str | None:
    """What went wrong (see ``place``), or None."""
    got = place(text, language)
    return got and got[0]


__all__ = ["EXTENSIONS", "failure", "place", "language_of", "OPENS", "CLOSES"]
