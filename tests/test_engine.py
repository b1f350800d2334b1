import pytest

from tessera.config import Config, duration, layered
from tessera.engine import Engine, symbol
from tessera.operators.graph import GraphNotBuilt


def test_config():
    c = layered(Config(root="a", graph=False), Config(store="s", max_file_size=-1))
    assert (c.root, c.store, c.graph, c.max_file_size, c.debounce) == ("a", "s", False, -1, "500ms")
    assert duration("1h30m") == 5400 and duration("500ms") == 0.5
    for bad in ("", "5", "5x", "s5"):
        with pytest.raises(ValueError):
            duration(bad)
    with pytest.raises(ValueError):
        Config.of({"nonsense": 1})
    with pytest.raises(ValueError):
        layered(Config(debounce="soon"))
    assert symbol(" f ", 500) == ("f", 100)
    with pytest.raises(ValueError):
        symbol(" ")


def test_index_search_and_graph(spark, tmp_path):
    root = tmp_path / "p"
    (root / "lib").mkdir(parents=True)
    (root / "main.py").write_text("import lib.tools as t\n\n\ndef run(x):\n    return t.helper(x)\n\n\ndef other():\n    return run(1)\n")
    (root / "lib" / "tools.py").write_text("def helper(x):\n    return parse_config(x)\n\n\ndef parse_config(x):\n    return x\n")
    (root / "notes.bin").write_text("binary")
    (root / "skip.min.js").write_text("x")
    engine = Engine(spark, Config(root=str(root), store=f"file://{tmp_path}/store", ignore=("*.min.js",)))
    with pytest.raises(GraphNotBuilt):
        engine.callers("helper")
    assert engine.index() == {"indexed": 3, "failed": 0, "deleted": 0, "version": 1}
    assert engine.index()["indexed"] == 0
    assert engine.stats()["files"] == 3
    rows, cut = engine.search("parse config", limit=3)
    assert rows[0]["name"] == "parse_config" and not cut
    assert {r["name"] for r in engine.callers("helper")} == {"run"}
    assert [(r["name"], r["resolved"], r["file_path"]) for r in engine.callees("run")] == [("helper", True, "lib/tools.py")]
    assert [(r["name"], r["depth"]) for r in engine.impact("helper", 3)] == [("run", 1), ("other", 2)]
    assert "# package: lib (1 files, 2 symbols)" in engine.map() and "+ func helper" in engine.map()
    cut = engine.callers("helper", 1)
    assert not cut.truncated and cut.text == "1 callers of helper:\n  main.py:5 run\n"
    (root / "lib" / "tools.py").write_text("def helper(x):\n    return 2\n")
    assert engine.stale(["lib/tools.py", "main.py", "gone.py"]) == ["gone.py", "lib/tools.py"]
    (root / "main.py").unlink()
    got = engine.index()
    assert (got["indexed"], got["deleted"]) == (1, 1)
    assert engine.stats()["edges"] == 0
    rows, _ = engine.search("helper", freshness=True)
    assert rows and not any(r["stale"] for r in rows)


def test_failing_chunk_keeps_the_stored_file(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "a.py").write_text("def a():\n    pass\n")
    (root / "b.py").write_text("def b():\n    pass\n")
    engine = Engine(spark, Config(root=str(root), store=f"file://{tmp_path}/store"))
    engine.index()
    good = engine.embed
    engine.embed = lambda texts: [ValueError("no") if "bad" in t else good([t])[0] for t in texts]
    (root / "a.py").write_text("def bad():\n    pass\n")
    (root / "b.py").write_text("def c():\n    pass\n")
    assert engine.index() == {"indexed": 1, "failed": 1, "deleted": 0, "version": 2}
    assert {r["name"] for r in engine.tables()["chunks"].collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        Engine(spark, Config(root=str(root), store=f"file://{tmp_path}/store", embedding_width=8))
    engine.reset()
    assert engine.store.metadata() is None


def test_other_languages_are_indexed_with_their_graph(spark, tmp_path):
    root = tmp_path / "p"
    (root / "store").mkdir(parents=True)
    (root / "main.go").write_text('package main\n\nimport st "x/store"\n\nfunc Run() {\n\tst.Get(1)\n}\n')
    (root / "store" / "store.go").write_text("package store\n\n// Get finds.\nfunc Get(k int) int { return helper(k) }\n\nfunc helper(k int) int { return k }\n")
    (root / "a b%20+c.ts").write_text("export class Shop extends Base {\n  sell(x: Item) { return Run(x); }\n}\n")
    (root / "list.c").write_text("static int walk(int n)\n{\n    return n ? walk(n - 1) : Get(0);\n}\n")
    engine = Engine(spark, Config(root=str(root), store=f"file://{tmp_path}/store"))
    seen = []
    assert engine.index(progress=lambda stage, n: seen.append((stage, n)))["indexed"] == 4
    assert seen == [("chunking", 4), ("writing", 4), ("done", 4)]
    assert {(r["name"], r["ref_file"]) for r in engine.callers("Get")} == {("Run", "main.go"), ("walk", "list.c")}
    assert [(r["name"], r["file_path"]) for r in engine.callees("Run")] == [("Get", "store/store.go")]
    assert {(r["name"], r["depth"]) for r in engine.impact("helper", 3)} == {("Get", 1), ("Run", 2), ("walk", 2), ("sell", 3)}
    assert engine.impact("helper", 3).text.splitlines()[1] == "  store/store.go:4 Get depth=1"
    text = engine.map(0)
    assert "a b%20+c.ts\n  + export Shop:1-3\n    - func sell:2\n" in text and "  + func Get:4\n  - func helper:6" in text
    assert all(ok for _, ok, _ in engine.doctor()), engine.doctor()
    # a change of one file is written alone, and the rest is read from earlier writes
    (root / "list.c").write_text("int other(void) { return 1; }\n")
    assert engine.index(["list.c"])["indexed"] == 1
    assert {r["name"] for r in engine.callers("Get")} == {"Run"}
    assert engine.store.read("files").count() == 4 and engine.store.metadata()["tables"]["chunks"] == [1, 2]
    rows, _ = engine.search("other", limit=1)
    assert rows[0]["file_path"] == "list.c"


def test_many_writes_are_compacted_and_old_ones_deleted(spark, tmp_path):
    from tessera.operators.indexing import Store

    store = Store(spark, f"file://{tmp_path}/s", "m", 3)
    frame = lambda *rows: spark.createDataFrame(rows, "path string, content_hash string")
    for n in range(6):
        store.FOLDERS = 3
        store.write({"files": frame(("a", str(n)), (f"p{n}", str(n)))}, frame(("a", ""), ("p0", "")) if n else frame(("a", "")))
    want = {("a", "5"), ("p5", "5"), ("p4", "4"), ("p3", "3"), ("p2", "2"), ("p1", "1")}
    assert {tuple(r) for r in store.read("files").collect()} == want
    assert len(store.metadata()["tables"]["files"]) <= 3 and len(store._numbers("versions")) == 2
    assert len(store._numbers("data")) <= 5
    # a write that fails leaves the version as it was
    with pytest.raises(Exception):
        store.write({"files": frame(("z", "1")).selectExpr("path", "assert_true(path = 'a') AS content_hash")}, frame(("a", "")))
    assert {tuple(r) for r in Store(spark, f"file://{tmp_path}/s", "m", 3).read("files").collect()} == want
    store.note(owner="x")
    assert store.metadata()["notes"] == {"owner": "x"} and {tuple(r) for r in store.read("files").collect()} == want


def test_ignore_files_of_folders(spark, tmp_path):
    root = tmp_path / "p"
    for name, text in {".gitignore": "*.gen.py\nbuild/\n", "a.gen.py": "", "build/x.py": "", "lib/.gitignore": "!keep.gen.py\nsecret.py\n", "lib/keep.gen.py": "", "lib/drop.gen.py": "", "lib/secret.py": "", "secret.py": "", ".git/x.py": "", "lib/deep/keep.gen.py": ""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text or "x = 1\n")
    engine = Engine(spark, Config(root=str(root), store=f"file://{tmp_path}/store"))
    paths = lambda df: {r["path"] for r in df.select("path").collect()}
    assert paths(engine._scan()) == {"lib/keep.gen.py", "lib/deep/keep.gen.py", "secret.py"}
    assert paths(engine._scan(["lib/keep.gen.py", "lib/secret.py", "a.gen.py", "gone.py", "build/x.py"])) == {"lib/keep.gen.py"}


def test_watching_and_polling(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "a.py").write_text("def a():\n    pass\n")
    engine = Engine(spark, Config(root=str(root), store=f"file://{tmp_path}/store"))
    engine.watch(str(root), f"{tmp_path}/ck").awaitTermination(120)
    assert {r["name"] for r in engine.symbols().collect()} == {"a"}
    waits = []
    (root / "b.py").write_text("def b():\n    pass\n")
    got = engine.poll(4, waits.append)
    assert [r["indexed"] for r in got] == [1, 0, 0, 0] and waits == [5, 10, 20]
    assert {r["name"] for r in engine.symbols().collect()} == {"a", "b"}


def test_names_with_dots_and_underscores_are_walked(spark, tmp_path):
    from tessera.operators.indexing import walk

    for name in ("__init__.py", "_private/x.py", ".hidden.py", "deep/er/y.py"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(b"\xff\n")
    (tmp_path / "t" / "loop").symlink_to(tmp_path / "t")
    (tmp_path / "t" / "dead").symlink_to(tmp_path / "nowhere")
    (tmp_path / "t" / "link.py").symlink_to(tmp_path / "t" / "__init__.py")
    for root in (str(tmp_path / "t"), f"file://{tmp_path}/t/"):
        assert {r["path"] for r in walk(spark, root).collect()} == {"__init__.py", "_private/x.py", ".hidden.py", "deep/er/y.py", "link.py"}
    assert walk(spark, f"{tmp_path}/none").count() == 0 and walk(spark, str(tmp_path / "t"), 1).count() == 0


def test_listing_goes_on_in_rounds(spark, tmp_path, monkeypatch):
    from tessera.sources import tree

    for i in range(5):
        for j in range(4):
            (tmp_path / f"a{i}" / f"b{j}").mkdir(parents=True)
            (tmp_path / f"a{i}" / f"b{j}" / "f").write_text("x")
    monkeypatch.setattr(tree, "ENTRIES", 3)
    assert tree.listed(spark, str(tmp_path)).count() == 20


def test_a_version_is_not_overwritten(spark, tmp_path):
    from tessera.operators.indexing import Store

    one, other = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    one.write({"files": spark.createDataFrame([("a", "1")], "path string, content_hash string")})
    with pytest.raises(OSError):
        other._commit(1, {"version": 1})
    assert one.read("files").count() == 1
