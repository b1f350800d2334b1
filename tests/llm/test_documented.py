import pytest

from tessera.llm import documented as D

TEXT = "Reads one row and keeps the order"


def pairs(path, *chunks):
    rows = sorted((s, c, k, n, f"id{s}") for s, c, k, n in chunks)
    return {r[0]: r for r in D._pairs(path, rows)}


@pytest.mark.parametrize(
    "path, text, name",
    [
        ("a.py", f'def f(a: int = (1), b="):"):\n    """{TEXT}."""\n    return 1', "f"),
        ("a.py", f"# {TEXT}\n@deco(1,\n  2)\nasync def f(a):\n    return 1", "f"),
        ("a.py", f"class_x = 1\n", None),
        ("a.py", f"def f(\n  a,\n):\n\n    r'''{TEXT}'''\n", "f"),
        ("a.go", f"// {TEXT}\nfunc (s *T) F(a int) (int, error) {{\n}}", "F"),
        ("a.js", f"/** {TEXT} */\nexport default async function f(a) {{ }}", "f"),
        ("a.ts", f"  // {TEXT}\n  public get<T>(a: T): T {{ }}", "get"),
        ("a.ts", f"// {TEXT}\nexport const f = async (a: string) => {{ }}", "f"),
        ("a.c", f"/*\n * {TEXT}\n */\nstatic const char *f(void)\n{{\n}}", "f"),
    ],
)
def test_islands(path, text, name):
    got = pairs(path, (1, text, "function_definition", ""))
    assert (got["id1"][2] if got else None) == name


@pytest.mark.parametrize(
    "doc",
    ["", "// TODO: say what this does to rows", "// nolint:errcheck", "// helper for tests", "// total = f(rows, 3)", "/**\n * @param {Array} items what to read here\n * @returns {number} of them\n */", "// load next row\n", "// ---------- row helpers ----------",
     "// eslint-disable-next-line no-shadow no-undef"],
)
def test_trivial(doc):
    assert pairs("a.js", (1, doc + "\nfunction loadNextRow(items) {\n}", "function_declaration", "loadNextRow")) == {}


def test_where_the_comment_is():
    fn = ("function_declaration", "f")
    assert "id2" in pairs("a.js", (1, f"// {TEXT}", "comment", ""), (2, "function f() {}", *fn))
    assert pairs("a.js", (1, f"// {TEXT}", "comment", ""), (3, "function f() {}", *fn)) == {}
    assert pairs("a.js", (1, f"// {TEXT}\n\nfunction f() {{}}", *fn)) == {}
    assert "id3" in pairs("a.js", (1, f"let a\n// {TEXT}", "block", ""), (3, "function f() {}", *fn))
    assert pairs("a.js", (1, "let a = 1 // all of the rows are read", "block", ""), (2, "function f() {}", *fn)) == {}
    assert pairs("a.py", (1, f'def f():\n    x = 1\n    """{TEXT}"""', "function_definition", "f")) == {}
    assert pairs("a.md", (1, f"// {TEXT}\nfunction f() {{}}", *fn)) == {}
    assert pairs("a.js", (1, f"// {TEXT}\nclass F {{}}", "class_declaration", "F")) == {}


def test_rows(spark):
    schema = "id string, file_path string, content string, node_kind string, name string, start_line int, documentation string"
    f = f"// {TEXT}\r\nfunc F() {{\r\n}}"
    df = spark.createDataFrame(
        [("1", "r/a.go", f, "function_declaration", None, 1, "x"), ("1", "r/a.go", f, "function_declaration", None, 1, "y"), ("2", "r/a.go", None, "function_declaration", "g", 9, "x"), ("3", None, f, "function_declaration", "g", 9, "x"),
         ("4", "r/b.go", "// " + "word " * 100_000 + "\nfunc G() {}", "function_declaration", "G", None, "x")], schema,
    )
    got = {r["id"]: r["name"] for r in D.documented(df).collect()}
    assert got == {"1": "F", "4": "G"}
    assert D.documented(df.limit(0)).count() == 0
