import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import repomap as M

CHUNK = "id string, name string, file_path string, node_kind string, parent string, start_line int, end_line int, language string"
EDGE = "src_id string, file_path string, src_name string, kind string, dst_name string, dst_qualifier string, line int"
IMPORT = "file_path string, module string, alias string, line int"


def defs(spark, *rows):
    return spark.createDataFrame([(i, n, p, "function_declaration", "", a, b, "go") for i, n, p, a, b in rows], CHUNK)


def edges(spark, *rows):
    return spark.createDataFrame([(s, f, n, k, d, q, ln) for s, f, n, k, d, q, ln in rows], EDGE)


def none(spark):
    return spark.createDataFrame([], IMPORT)


def test_across_files(spark):
    c = defs(spark, ("1", "Run", "main.go", 1, 10), ("2", "Helper", "helper.go", 1, 8))
    e = edges(spark, ("1", "main.go", "Run", "call", "Helper", "", 5), ("1", "main.go", "Run", "call", "Println", "fmt", 5), ("1", "main.go", "Run", "reference", "string", None, 5))
    assert [(r["name"], r["file_path"], r["line"]) for r in G.callers(e, c).where("target = 'Helper'").collect()] == [("Run", "main.go", 5)]
    got = {(r["name"], r["qualifier"], r["resolved"]) for r in G.callees(e, c, none(spark)).collect()}
    assert got == {("Helper", "", True), ("Println", "fmt", False)}


def test_preference(spark):
    c = defs(spark, ("1", "Caller", "z.go", 1, 9), ("2", "Target", "a.go", 1, 9), ("3", "Target", "z.go", 20, 29), ("4", "Get", "store/store.go", 1, 2), ("5", "Get", "cache/cache.go", 1, 2))
    e = edges(spark, ("1", "z.go", "Caller", "call", "Target", "", 5), ("1", "z.go", "Caller", "call", "Get", "st", 6), ("1", "z.go", "Caller", "call", "Get", "", 7))
    imports = spark.createDataFrame([("z.go", "x/store/", "st", 1), ("z.go", "store", "st", 2), ("z.go", "./cache", None, 2)], IMPORT)
    got = {(r["name"], r["line"]): r["file_path"] for r in G.callees(e, c, imports).collect()}
    assert got == {("Target", 5): "z.go", ("Get", 6): "cache/cache.go", ("Get", 7): "cache/cache.go"}
    imports = spark.createDataFrame([("z.go", "store", "st", 1)], IMPORT)
    assert {r["file_path"] for r in G.callees(e, c, imports).where("line = 6").collect()} == {"store/store.go"}


def test_impact(spark):
    c = defs(spark, ("1", "A", "a.go", 1, 9), ("2", "B", "b.go", 1, 9), ("3", "C", "c.go", 1, 9))
    e = edges(spark, ("2", "b.go", "B", "call", "A", "", 5), ("3", "c.go", "C", "call", "B", "", 5), ("1", "a.go", "A", "call", "B", "", 5))
    got = lambda d: {(r["name"], r["depth"]) for r in G.impact(e, c, "A", d).collect()}
    assert got(2) == {("B", 1), ("C", 2)} and got(1) == {("B", 1)} and got(99) == {("B", 1), ("C", 2)} and got(0) == got(2)
    assert G.impact(e, c, "C", 3).count() == 0


def test_callers_without_names(spark):
    c = spark.createDataFrame([("frag", "", "f.go", "block", "", 40, 60, "go"), ("t", "Target", "t.go", "f", "", 1, 2, "go"), ("c", "Caller", "c.go", "f", "", 1, 20, "go")], CHUNK)
    e = edges(spark, ("frag", "f.go", "HugeFunc", "call", "Target", "", 50), ("", "f.go", "OtherFunc", "call", "Target", "", 900), ("frag", "f.go", "", "call", "Target", "", 51), *[("c", "c.go", "", "call", "Target", "", n) for n in (5, 6, 7)])
    got = {(r["name"], r["start_line"], r["line"]) for r in G.callers(e, c).collect()}
    assert got == {("HugeFunc", 40, 50), ("OtherFunc", 900, 900), ("Caller", 1, 5)}


def test_attribution(spark):
    c = defs(spark, ("a", "a", "x", 1, 10), ("outer", "o", "y", 1, 300), ("inner", "i", "y", 100, 200), ("same", "s", "y", 100, 100), ("bad", "b", "y", 9, 3))
    e = edges(spark, *[("", f, "", "call", "t", "", n) for f, n in (("x", 1), ("x", 10), ("x", 11), ("y", 99), ("y", 100), ("y", 150), ("y", 150), ("y", 201), ("z", 1))], ("", "x", "", "call", "t", "", None))
    got = sorted((r["file_path"], r["line"] or -1, r["chunk_id"] or "") for r in G.attribute(e, c).collect())
    assert got == sorted([("x", 1, "a"), ("x", 10, "a"), ("x", 11, ""), ("x", -1, ""), ("y", 99, "outer"), ("y", 100, "same"), ("y", 150, "inner"), ("y", 150, "inner"), ("y", 201, "outer"), ("z", 1, "")])


def test_empty(spark):
    c, e = defs(spark, ("1", "A", "a.go", 1, 9)), edges(spark, ("1", "a.go", "A", "call", "B", "", 1)).limit(0)
    assert G.callers(e, c).count() == G.callees(e, c.limit(0), none(spark)).count() == G.attribute(e, c).count() == 0
    with pytest.raises(G.GraphNotBuilt):
        G.require_graph(e)


def chunk(i, path, name, kind="function_declaration", parent="", line=1, language="go"):
    return (str(i), name, path, kind, parent, line, line + 2, language)


def test_map(spark):
    rows = [chunk(1, "store/store.go", "Store", "interface_declaration"), chunk(2, "store/store.go", "Search", parent="Store", line=5), chunk(3, "indexer/indexer.go", "Index"), chunk(4, "CHANGELOG.md", "Title", language="markdown"), chunk(5, "indexer/indexer.go", "loose", parent="Missing", line=9), chunk(6, "store/b.go", "helper")]
    named = M.mapped_symbols(spark.createDataFrame(rows, CHUNK))
    first = "# package: store (2 files, 3 symbols)\n\nstore/store.go\n  + interface Store:1-3\n    + func Search:5-7\n\n"
    rest = "store/b.go\n  - func helper:1-3\n\n# package: indexer (1 files, 2 symbols)\n\nindexer/indexer.go\n  + func Index:1-3\n  - func loose:9-11\n\n"
    assert M.render(named, 0) == first + rest == M.render(named, 1000)
    assert "CHANGELOG" in M.render(M.mapped_symbols(spark.createDataFrame(rows, CHUNK), code_only=False), 0)
    # the first file is there whatever the budget, and the heading and blank lines count
    assert M.render(named, 1) == first + "# ... 2 more files in 1 packages (truncated to ~1 tokens)\n"
    room = -(-(len(first) + 32) // 4)
    assert M.render(named, room) == first + f"store/b.go\n  - func helper:1-3\n\n# ... 1 more files in 1 packages (truncated to ~{room} tokens)\n"
    assert M.render(named.limit(0), 10) == ""


def test_map_of_parents_summaries_and_languages(spark):
    # a symbol with a parent is no parent itself; what is below it is listed at the end
    rows = [chunk(1, "a.go", "T", "type_spec"), chunk(2, "a.go", "m", "method_declaration", "T", 4), chunk(3, "a.go", "inner", parent="m", line=5), chunk(4, "a.go", "T", "struct_type", line=20), chunk(5, "a.go", "F", "method_definition", line=30)]
    named = M.mapped_symbols(spark.createDataFrame(rows, CHUNK))
    assert {r["id"]: r["level"] for r in M.nested(named).collect()} == {"1": 0, "2": 1, "3": 0, "4": 0, "5": 0}
    assert M.file_lines(named).first()["text"] == "a.go (3 func, 1 struct, 1 type)\n  + type T:1-3\n    - func m:4-6\n  + struct T:20-22\n    - func m:4-6\n  + func F:30-32\n  - func inner:5-7\n\n"
    # the first symbol's language is the file's
    mixed = [chunk(1, "b.x", "Up", language="go"), chunk(2, "b.x", "_p", language="python", line=9), chunk(3, "c.toml", "key", language="toml"), chunk(4, "d.yaml", "key", language="YAML"), chunk(5, "d.yaml", "g", language="go", line=7)]
    named = M.mapped_symbols(spark.createDataFrame(mixed, CHUNK))
    assert {(r["name"], r["mark"]) for r in named.collect()} == {("Up", "+"), ("_p", "-"), ("key", "")}


def test_numbered(spark):
    from tessera.operators.ordering import numbered

    df = spark.range(1000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1000)))
    assert [r["k"] for r in numbered(df, [F.desc("k")], "n").orderBy("n").collect()] == list(range(999, -1, -1))
    assert numbered(df.limit(0), [F.asc("k")], "n").count() == 0


@pytest.mark.parametrize("paths, root", [(["/r/a/x", "/r/a/b/y", "/r/ab/z"], "/r"), (["x"], "."), (["a/x", "b/y"], ""), (["a/b/x", "a/b/y"], "a/b"), ([], "")])
def test_common_root(spark, paths, root):
    assert M.common_root(spark.createDataFrame([(p,) for p in paths], "path string")).first()["root"] == root


def test_formatted(spark):
    c = spark.createDataFrame([("1", "Run", "main.go", "function_declaration", "", 1, 10, "go"), ("2", "Helper", "helper.go", "method_declaration", "Kit", 3, 8, "go")], CHUNK)
    e = edges(spark, ("1", "main.go", "Run", "call", "Helper", "", 5), ("1", "main.go", "Run", "call", "Println", "fmt", 6), ("1", "main.go", "Run", "inherit", "Helper", "", 7))
    got = {r["line_text"] for r in G.formatted(G.callees(e, c, none(spark))).collect()}
    assert got == {"  helper.go:3 Kit.Helper", "  main.go:6 fmt.Println (external)", "  helper.go:3 Kit.Helper (inherit)"}
    there = [r["line_text"] for r in G.formatted(G.callers(e, c).where("target = 'Helper'"), at_reference=True).collect()]
    assert there == ["  main.go:5 Run"]
    deep = [r["line_text"] for r in G.formatted(G.impact(e, c, "Helper", 2), at_reference=True, show_depth=True).collect()]
    assert deep == ["  main.go:5 Run depth=1"]
    assert G.listing(there, "callers of", "Helper") == "1 callers of Helper:\n  main.go:5 Run\n"
    assert G.listing(["a", "b"], "callees of", "x", 1) == "1 callees of x:\na\n\n(truncated to 1; raise the limit to see more)\n"
    assert G.listing([], "impact of", "x") == "No impact of x found.\n"


def test_impact_tells_the_first_discovery(spark):
    """Of one level the caller found first tells, and of its references the first."""
    c = defs(spark, ("1", "B", "b.go", 1, 9), ("2", "A", "z.go", 1, 9), ("3", "C", "c.go", 1, 9))
    e = edges(spark, ("1", "b.go", "B", "call", "T", "", 5), ("2", "z.go", "A", "call", "T", "", 1), ("3", "c.go", "C", "call", "A", "q", 2), ("3", "c.go", "C", "reference", "B", "", 8), ("3", "c.go", "C", "call", "B", "", 7))
    got = {r["name"]: (r["depth"], r["line"], r["kind"], r["file_path"], r["node_kind"], r["end_line"]) for r in G.impact(e, c, "T", 3).collect()}
    assert got == {"B": (1, 5, "call", "b.go", "function_declaration", 9), "A": (1, 1, "call", "z.go", "function_declaration", 9), "C": (2, 7, "call", "c.go", "function_declaration", 9)}


def test_common_root_of_every_repository(spark):
    from tessera.plans.retrieval import common_root

    sf = "/root/testdata/sf0.01"
    below: dict = {}
    for r in spark.read.parquet(f"{sf}/files.parquet").where("path IS NOT NULL").select("path").collect():
        below.setdefault(r["path"].split("/")[0], []).append(r["path"].rpartition("/")[0] or ".")
    want = {}
    for repo, folders in below.items():
        a, b = min(f.split("/") for f in folders), max(f.split("/") for f in folders)
        same = [x for x, y in zip(a, b)]
        while same != b[: len(same)]:
            same.pop()
        want[repo] = "/".join(same)
    assert len(want) > 1 and {r["repo"]: r["root"] for r in common_root(spark, sf).collect()} == want
