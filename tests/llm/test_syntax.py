import ast
import json
import random
import warnings

import pytest

from tessera.llm.derivative import Grammar
from tessera.llm.filetext import text_of
from tessera.llm.languages import failure, language_of, place
from tessera.llm.syntax import file_syntax

GOOD = {
    "python": [
        "", "# only\n", "x = 1", "def f(a, *, b: int = 2, **k) -> 'x':\n    '''doc'''\n    return [i for i in a if i]\n",
        "class A(B, metaclass=M):\n\tx: int = 3\n\n\t@p.q(1)\n\tasync def f(self): await g()\n",
        "if a:\n  b\nelif c: d; e\nelse:\n  pass\n", "try:\n  a\nexcept (X, Y) as e:\n  raise Z from e\nfinally:\n  b\n",
        "match x:\n  case [1, *r] if r: y\n  case {'a': b}: z\n  case _: w\n", "f = lambda a, b=1: a if b else c\nx = f'{a!r:>{w}}' \"b\" '''c\n'''\n",
        "with (a as b, c as d):\n  x[1:2, ::3] += y\n", "a = b\\\n  + c\nprint(*a, **b, c=d)\nfrom . import (x as y,\n  z,)\n", "while (y := f(x)): pass\nelse: z\n",
        "type X[T: int] = list[T]\ndef f[T](x: T): yield from x\n", "x = not a in b and c is not d\ndel a, b[0]\nglobal q\nassert a, 'b'\n",
    ],
    "javascript": [
        "", "let a = b ? c : d ? e : f\nfoo()\n", "const re = /[/\"({]+x/g, t = `a ${ f({x: `b`}) } {`;", "for (const [k, v] of Object.entries(o)) if (a) b(); else c()\n",
        "export default class A extends B { static x = 1; #p = 2; get y() { return this.#p } async *z() {} }\n", "import a, { b as c } from './x';\nexport * from 'y'\n",
        "do x++; while (x < 3)\nlabel: for (;;) { break label }\n", "const f = async (a, {b = 1, ...c}, [d]) => ({ ...a, [b]: c, d, 'e': 1, f() {} });\n",
        "a = b\n  .c(d)\n  ?.e[f]\n", "!function(e,t){'use strict';var n={};if(e.d||t.d>6)e.d=\"(\";n.$z=function(e){return e?t+1:n}}(this)", "switch (x) { case 1: case 2: a(); break; default: b() }",
        "try { a() } catch { b() } finally { c() }\nnew Foo\nif (x) return\n",
    ],
    "typescript": [
        "function f(a: string[], b?: Map<string, Array<number>>, ...c: any[]): asserts a is string { return a as unknown as T }",
        "interface A<T> extends B { x: number; y?(): void; readonly [k: string]: any; new (a: T): A }\ntype U = A | { b: C } & D[] | ((x: E) => F)\n",
        "export abstract class X<T> implements Y { constructor(private readonly a: T, public b = 2) { super() } abstract z(): void; w!: string }\n",
        "enum E { A = 1, B }\ndeclare module 'm' { export const x: number }\nconst x = <const T,>(a: T): T => a\nlet y = f<string>(z)!\n",
        "type M<T> = { [K in keyof T]?: T[K] extends infer U ? U : never }\nconst a: { b: number } = { b: 1 }\nconst g = (x: A): B => x\n",
    ],
    "go": [
        "package a\n", 'package a\n\nimport (\n\t"b"\n\tc "d/e"\n)\n\nvar x, y = 1, `raw {`\n', "package a\nfunc (s *S) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; !ok {\n\t\treturn 0, nil\n\t} else if x > 1 {\n\t}\n\treturn\n}\n",
        "package a\ntype T[K comparable, V any] struct {\n\tA int `json:\"a\"`\n\t*B\n\tc.D\n}\ntype I interface {\n\tM(x int) string\n\t~int | string\n}\n",
        "package a\nfunc f() {\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor range x {\n\t}\n\tfor k, v := range m {\n\t\tgo func() { c <- v }()\n\t}\n\tswitch y := x.(type) {\n\tcase int, []string:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase d <- 1:\n\t}\nL:\n\tgoto L\n}\n",
        "package a\nvar m = map[string][]T{\"a\": {{1, 2}}, \"b\": nil}\nvar f = func(x chan<- int) <-chan int { return make(chan int) }\nconst (\n\tA = iota\n\tB\n)\nvar r = '\\''\n",
    ],
    "c": [
        "", "#include <x.h>\n#define M(a) \\\n  { a\nint main(void)\n{\n  return 0;\n}\n", "static const char *s[] = {\"a\" PRIu64 \"b\", [2] = \"c\"};\nstruct p { int x, y : 3; struct q *n; } v = { .x = 1 };\n",
        "typedef int (*cb)(const void *, size_t);\nenum e { A, B = 2, };\nextern \"C\" { void f(int a, ...); }\n",
        "void f(void) { for (int i = 0; i < n; i++) if (a) b(); else { c = (int)d * sizeof(struct x); } do { x->y++; } while (0); switch (x) { case 'a': case 1 ... 3: break; default: goto out; } out: return; }\n",
        "int g(int *p) { unsigned long z = *p ? (p[0], 1) : ~2; return (struct s){ 1, 2 }.x; }\n",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, "x\\u00e9\\n"], "b": {}}', " 3 ", '""'],
    "yaml": [
        "", "a: 1\nb:\n  - x\n  - y: 2\n    z: 'q'\nc: [d, {e: f},\n  g]\n", "- a\n-\n  b: c\n- - d\n  - e\n", "a: |\n  text: x\n   more\nb: >-\n  folded\n", "--- \n# c\nx: &a {k: v}\ny: *a\n...\n---\nz: !t w\n",
        "a: b\n  c d\n", "plain words\nover lines\n", '"q": "x\n  y"\nurl: http://a.b:80/#c\n', "k:\n- a\n- b\nl: ~\n",
    ],
}

BAD = {
    "python": ["def f(:\n  pass", "if a:\nb", "x = [1, 2", "<<<<<<< HEAD\n", "a b", "class A:\n", "print 'x'", "x = 'abc", "  x\n", "if a:\n    b\n  c\n", "def f():\n  return {)"],
    "javascript": ["function f(a: string) {}", "let a = ;", "if (a {", "import store\n", "package main\n\nimport x", "x = `abc", "Cost grows with size.", "f(1, 2", "a b", "}", "<<<<<<< ours\n"],
    "typescript": ["function f(a: string) {", "int x = 3;", "def f():\n  pass", "#include <a>\n", ">>>>>>> theirs\n", "const a: = 1"],
    "go": ["import a\n", "package a\nfunc f() {", "package a\nfunc f() {\n\tx := [1\n}\n", 'package a\nvar x = "abc\n', "package a\nfoo()\n", "package a\nfunc f() {\n\ta b\n}\n", "{\"a\": 1}"],
    "c": ["int f(void) {", "}", "int x = ;", "x += 1;", "def f(a):\n  return 1\n", "char *s = \"abc;\n", "/* open", "int f() { int x 3; }", "<<<<<<< HEAD\nint x;\n"],
    "json": ["", "{", '{"a": 1,}', "{'a': 1}", '{"a" 1}', "[1 2]", "// c\n{}", "01", '"\t"', "{}{}"],
    "yaml": ["a: [b, c", 'a: "b', "<<<<<<< HEAD\na: 1\n", "a: 1\n=======\nb: 2\n", "a: b: c\n", "a:\n  b: 1\n c: 2\n", "a: @x\n", "\ta: 1\n", "a: 1\n>>>>>>> x\n", "a: 'b' c\n"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_texts(language):
    assert [t for t in GOOD[language] if failure(t, language)] == []
    assert [t for t in BAD[language] if not failure(t, language)] == []


def test_truncation_is_told_from_errors():
    assert failure("package a\nfunc f() {\n\tx()", "go") == "truncated"
    assert failure("function f( { ", "javascript") == "truncated" or failure("function f(a) {", "javascript") == "truncated"
    assert failure("x = = 1", "python") == "token"


def test_engine():
    g = Grammar("file = (a | (:inner:) b)*\ninner = a? | (:other:) a\nother = c")
    parse = lambda s: g.parse(s.split())
    assert parse("a ( a ) b a") == -1 and parse("( ( c ) a ) b") == -1 and parse("") == -1
    assert parse("( a") == 2 and parse("( c") == 1 and parse("( a ]") == 2 and parse("( ) a") == 2 and parse(")") == 0


def test_long_and_deep():
    assert failure("x = " + "(" * 50_000 + "1" + ")" * 50_000, "python") is None
    assert failure("[" * 50_000, "json") == "truncated"
    assert failure('"' + "a" * 3_000_000, "javascript") == "token"
    assert failure("a = '" + "\\'" * 500_000, "python") == "token"
    assert failure("x;" * 500_000, "javascript") is None


def _files(sf):
    import duckdb

    rows = duckdb.execute(f"SELECT DISTINCT file_path, start_line, content FROM '/root/testdata/{sf}/chunks.parquet' ORDER BY 1, 2, 3").fetchall()
    by: dict = {}
    for p, s, c in rows:
        by.setdefault(p, []).append((s, c))
    return {p: text_of(r) for p, r in by.items()}


def test_like_the_languages_own_parsers():
    """Python's and JSON's parsers over the files of a table, whole and cut at random places."""
    rnd = random.Random(3)
    warnings.simplefilter("ignore")
    seen = 0
    for path, text in _files("sf0.01").items():
        language = language_of(path)
        if language not in ("python", "json"):
            continue
        for t in [text, *(text[: rnd.randrange(len(text) + 1)] for _ in range(6))]:
            try:
                ast.parse(t) if language == "python" else json.loads(t)
                fine = True
            except (SyntaxError, ValueError):
                fine = False
            assert fine == (failure(t, language) is None), (path, t[-200:])
            seen += 1
    assert seen > 100


def test_rows(spark):
    df = spark.createDataFrame(
        [
            ("r/a.py", 3, "    return 1", "go", "x"),
            ("r/a.py", 1, "def f():\r\n", "go", "x"),
            ("r/a.py", 1, "def f():\r\n", "go", "y"),
            ("r/b.js", 1, "let a = {", None, "x"),
            ("r/c.md", 1, "(((", None, "x"),
            ("r/d.txt", 1, "(((", None, "x"),
            ("e.json", None, None, None, "x"),
            (None, 1, "(", None, "x"),
        ],
        "file_path string, start_line int, content string, language string, problem string",
    )
    got = {r["file_path"]: (r["repo"], r["language"], r["problem"]) for r in file_syntax(df).collect()}
    assert got == {"r/a.py": ("r", "python", None), "r/b.js": ("r", "javascript", "truncated"), "r/c.md": ("r", "markdown", None), "e.json": ("e.json", "json", "truncated")}
    assert file_syntax(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "language, text, want",
    [
        ("python", "x = 1\ny = 2\nz = = 3\n", ("token", 3)),
        ("python", "def f(:\n  pass\n", ("token", 1)),
        ("javascript", "let a = 1;\n\nlet b = ;\n", ("token", 3)),
        ("go", "package a\n\nfunc f() {\n\tx := 1\n", ("truncated", 5)),
        ("json", '{"a": 1,\n "b": }', ("token", 2)),
        ("c", "int x;\n<<<<<<< HEAD\nint y;\n", ("token", 2)),
    ],
)
def test_place_of_the_failure(language, text, want):
    problem, token, line = place(text, language)
    assert (problem, line) == want and token >= 0
    assert place("", "markdown") is None


def test_memory_is_bounded(monkeypatch):
    from tessera.llm import languages

    monkeypatch.setattr(languages, "REMEMBERED", 0)
    assert [failure(t, "json") for t in ("[1, 2]", "[1,", "[1, 2]")] == [None, "truncated", None]
    assert languages.grammar.cache_info().currsize == 0
