import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import globs
from tessera.operators import analysis as A
from tessera.operators import indexing as I
from tessera.streaming import watch as E

IGNORE = [
    (["*.log"], "a/b.log", False, "ignored"), (["*.log"], "a.txt", False, "none"), (["*.log", "!keep.log"], "x/keep.log", False, "included"), (["build/"], "build", True, "ignored"), (["build/"], "build", False, "none"),
    (["/root.txt"], "root.txt", False, "ignored"), (["/root.txt"], "a/root.txt", False, "none"), (["a/b"], "a/b", False, "ignored"), (["a/b"], "c/a/b", False, "none"), (["**/x"], "p/q/x", False, "ignored"), (["**/x"], "x", False, "ignored"),
    (["a/**"], "a/b/c", False, "ignored"), (["a/**/b"], "a/b", False, "ignored"), (["a/**/b"], "a/x/y/b", False, "ignored"), (["# c", "", "\\#f"], "#f", False, "ignored"), (["\\!f"], "!f", False, "ignored"), (["a?c"], "abc", False, "ignored"),
    (["a?c"], "a/c", False, "none"), (["[!x]y"], "ay", False, "ignored"), (["[!x]y"], "xy", False, "none"), (["[a-c]z"], "bz", False, "ignored"), (["[ab"], "a", False, "none"), (["f  "], "f", False, "ignored"), (["a.b"], "axb", False, "none"), (["*.log", "!*.log", "*.log"], "q.log", False, "ignored"),
]


@pytest.mark.parametrize("rules, path, folder, want", IGNORE)
def test_ignore(rules, path, folder, want):
    assert globs.ignore_state(rules, path, folder) == want


def test_globs(spark):
    cases = [("src/**", "src/a/b", 1), ("src/*", "src/a/b", 0), ("src/*.go", "src/a.go", 1), ("*.go", "src/a.go", 0), ("a[!b]c", "axc", 1), ("a[", "a[", 0), ("a\\*", "a*", 1), ("a.c", "abc", 0), ("**", "x/y", 1)]
    for pattern, path, want in cases:
        assert spark.range(1).select(globs.matches_any(F.lit(path), [pattern]).alias("m")).first()["m"] == bool(want), pattern


def test_candidates(spark):
    paths = ["a.go", "vendor/x/b.go", "keep/c.go", "c.yaml", ".git/config", "build/keep.go", "d", "E.GO", "s/a_test.go"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"] for r in I.candidates(df, ["vendor/", "build", "!build/keep.go"], exclude=["*_test.go"], extensions=[".go"]).collect()}
    assert got == {"a.go", "keep/c.go", "E.GO"}
    assert {r["path"] for r in I.candidates(df, [], include=["*.yaml"]).collect()} == {"c.yaml"}


STATE = "path string, content_hash string, mtime long, size long"


def test_snapshots(spark):
    old = spark.createDataFrame([("same", "a", 1, 1), ("touched", "a", 1, 1), ("edited", "a", 1, 1), ("gone", "a", 1, 1), ("back", "a", 5, 1), ("big", "a", 1, 1)], STATE)
    new = spark.createDataFrame([("same", "a", 1, 1), ("touched", "a", 2, 1), ("edited", "b", 2, 2), ("new", "c", 1, 1), ("back", "b", 4, 1), ("big", "b", 2, 2 << 20)], STATE)
    assert {tuple(r) for r in I.snapshot_diff(old, new).collect()} == {("touched", "write"), ("edited", "write"), ("gone", "remove"), ("new", "create"), ("big", "write")}
    assert {r["path"] for r in I.stale(old, old, new).where("stale").collect()} == {"edited", "gone", "back"}
    assert {r["path"] for r in I.deleted(old, new).collect()} == {"gone"}
    assert {r["path"] for r in I.changed(old, new).collect()} == {"edited", "new", "back", "big"}


def test_replace(spark):
    chunks = spark.createDataFrame([("1", "a", [1.0, 2.0]), ("2", "b", [1.0, 2.0])], "id string, file_path string, embedding array<float>")
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content_hash string")
    new = {"files": files.where("path = 'a'"), "chunks": chunks.where("id = '1'").withColumn("id", F.lit("9"))}
    out = I.replace_by_files({"files": files, "chunks": chunks}, new, 2)
    assert {r["id"] for r in out["chunks"].collect()} == {"9", "2"} and out["files"].count() == 2
    with pytest.raises(I.BadWidth):
        I.replace_by_files({"files": files, "chunks": chunks}, new | {"chunks": chunks.withColumn("embedding", F.array(F.lit(1.0).cast("float")))}, 2)
    up = I.upsert(files, spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("c", "3", 1)], "path string, content_hash string, n int"), "path", "n")
    assert {(r["path"], r["content_hash"]) for r in up.collect()} == {("a", "2"), ("b", "y"), ("c", "3")}
    reuse = I.reusable(spark.createDataFrame([("dup2", "h", [0.4]), ("dup1", "h", [0.1]), ("n", "h2", None)], "id string, content_hash string, embedding array<float>"))
    assert [(r["content_hash"], r["id"]) for r in reuse.collect()] == [("h", "dup1")]


@pytest.mark.parametrize("most", [1, 8, 32])
def test_buckets(spark, most):
    rows = [(i, 1 + (i * 37) % 700) for i in range(257)]
    got = I.bucketize(spark.createDataFrame(rows, "key long, n int"), "n", "key", most).collect()
    assert sorted(r["key"] for r in got) == list(range(257))
    assert all(r["bucket"] in (8, 16, 32, 64, 128, 256, 512) and r["bucket"] >= min(512, rows[r["key"]][1]) for r in got)
    sizes: dict = {}
    for r in got:
        sizes[r["bucket"], r["batch"]] = sizes.get((r["bucket"], r["batch"]), 0) + 1
    assert max(sizes.values()) <= most


def test_events(spark):
    at = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(milliseconds=s)
    df = spark.createDataFrame([("a", "create", at(0)), ("a", "write", at(400)), ("a", "remove", at(1000)), ("b", "reindex", at(100)), ("b", "write", None)], E.EVENT)
    got = {(r["path"], r["events"], r["last_op"], r["reindex"]) for r in E.coalesced(df).collect()}
    assert got == {("a", 2, "write", False), ("a", 1, "remove", False), ("b", 1, "reindex", True)}
    assert E.coalesced(df.limit(0)).count() == 0
    assert [E.next_interval(5, i) for i in range(4)] == [5, 10, 20, 20]
    bits = spark.createDataFrame([(["create", "remove"],), (["write", "create"],), (["chmod"],), (["rename", "write"],)], "bits array<string>")
    assert sorted(r["op"] for r in E.classify(bits).collect()) == ["create", "remove", "rename"]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("x")
    seen = []
    q = E.run_batches(E.stream_files(spark, f"{tmp_path}/in"), lambda df, full: seen.append((sorted(r["path"].rpartition("/")[2] for r in df.collect()), full)), f"{tmp_path}/ck")
    q.awaitTermination(60)
    (tmp_path / "in" / "b.py").write_text("y")
    E.run_batches(E.stream_files(spark, f"{tmp_path}/in"), lambda df, full: seen.append((sorted(r["path"].rpartition("/")[2] for r in df.collect()), full)), f"{tmp_path}/ck").awaitTermination(60)
    assert seen == [(["a.py"], False), (["b.py"], False)]


def test_session_windows_in_a_stream(spark, tmp_path):
    rows = [("a", "write", dt.datetime(2025, 1, 1, 0, 0, s)) for s in (0, 1, 30)] + [("z", "write", dt.datetime(2025, 1, 2))]
    spark.createDataFrame(rows, E.EVENT).coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(E.EVENT).parquet(f"{tmp_path}/ev")
    q = E.coalesced(stream, "5 seconds", watermark="1 minute").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted((r["path"], r["events"]) for r in spark.table("sessions").collect()) == [("a", 1), ("a", 2)]


def test_analysis(spark):
    files = spark.createDataFrame([("m.py", "import a.b as c\n\nclass K(Base):\n    def f(self):\n        return c.g(h())\n"), ("x.xyz", "?"), ("n.md", "one\n\ntwo\nthree"), ("broken.py", "def ("), ("bad.py", "BOOM")], "path string, content string")

    def chunker(path, text):
        if text == "BOOM":
            raise RuntimeError("boom")
        return A.analyse(path, text)

    parsed = A.analysed(files, chunker).cache()
    assert {r["path"]: r["error"] for r in parsed.collect() if r["error"]} == {"bad.py": "RuntimeError: boom"}
    chunks = A.chunk_rows(parsed)
    assert {(r["file_path"], r["name"], r["start_line"], r["end_line"]) for r in chunks.collect()} == {("m.py", "", 1, 1), ("m.py", "K", 3, 5), ("m.py", "f", 4, 5), ("n.md", "", 1, 1), ("n.md", "", 3, 4), ("broken.py", "", 1, 1)}
    edges, imports = A.edge_rows(parsed, chunks)
    assert {(r["kind"], r["dst_name"], r["dst_qualifier"]) for r in edges.collect()} == {("inherit", "Base", ""), ("call", "g", "c"), ("call", "h", "")}
    assert [(r["module"], r["alias"]) for r in imports.collect()] == [("a.b", "c")]


def test_embedder(spark):
    embed = A.hashing_embedder(16)
    df = spark.createDataFrame([("h1", "some text"), ("h1", "some text"), ("h2", " ")], "content_hash string, content string")
    rows = {r["content_hash"]: r for r in A.embedded(df, embed, 16).collect()}
    assert len(rows) == 2 and rows["h2"]["embedding"] is None and "empty" in rows["h2"]["error"] and len(rows["h1"]["embedding"]) == 16
    assert all(r["error"] for r in A.embedded(df, embed, 8).collect())
