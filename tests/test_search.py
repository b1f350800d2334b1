import math
import random
import re
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import terms
from tessera.functions import text as X
from tessera.operators import search as S

GOLDEN = {
    "simple": "simple", "parseConfig": "parseconfig parse config", "ParseConfig": "parseconfig parse config", "HTTPServer": "httpserver http server",
    "getHTTPClient": "gethttpclient get http client", "parse_config": "parse_config parse config", "MAX_RETRY_COUNT": "max_retry_count max retry count", "main": "main",
    "func parseConfig() {}": "func parseconfig parse config {}", "": "", "x": "x", "getV2Client": "getv2client get v2 client",
    "my_parseConfig": "my_parseconfig my parseconfig parse config", "parseHTTP2": "parsehttp2 parse http2", "_foo": "_foo", "__init__": "__init__",
    "_fooBar": "_foobar foobar foo bar", "(parseConfig)": "( parseconfig parse config", "123": "123", "fmt.Println(x)": "fmt.println(x fmt. println(x",
}

SCHEMA = "id string, file_path string, language string, content string, content_hash string, node_kind string, name string, parent string, start_line int, end_line int, embedding array<float>"


def chunk(i, path="a.go", name="", content="", vector=(1.0, 0.0, 0.0), language="go", kind="function_declaration", parent=""):
    return (str(i), path, language, content, f"h{i}", kind, name, parent, 1, 5, [float(v) for v in vector])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def names(df):
    return [r["name"] for r in df.orderBy("rn").collect()]


def test_tokenizer(spark):
    df = spark.createDataFrame([(k,) for k in GOLDEN], "t string").select("t", F.array_join(X.search_tokens(F.col("t")), " ").alias("got"))
    assert {r["t"]: r["got"] for r in df.collect()} == GOLDEN


def test_both_tokenizers_agree(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choices("aZbQé_9.({ ßÄ\t-x", k=rnd.randrange(30))) for _ in range(800)] + list(GOLDEN)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.search_tokens(F.col("t")).alias("got"))
    for r in df.collect():
        assert list(r["got"]) == terms.search_tokens(r["t"]), r["t"]
    assert terms.search_tokens(None) == [] and terms.index_terms("Naïve_fooBar {}") == ["naive", "foobar", "naive", "foobar", "foo", "bar"]


def fts5(rows, query):
    """Scores of sqlite's own full-text index over columns that hold search tokens."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, a, b, c, tokenize=unicode61)")
    db.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", rows)
    return {r[0]: r[1] for r in db.execute("SELECT id, bm25(f) FROM f WHERE f MATCH ?", (query,))}


def test_bm25_like_a_full_text_index(spark):
    rnd = random.Random(4)
    vocabulary = ["parse", "config", "parseConfig", "load_file", "naïve", "x1", "{}", "read", "parse parse parse", "a-b"]
    rows = [chunk(i, content=" ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 12))), name=rnd.choice(["parseConfig", "", "read"]), parent=rnd.choice(["", "Loader"])) for i in range(61)]
    rows.append(chunk(99, content=None, name=None, parent=None))
    df = frame(spark, rows).cache()
    told = df.select("id", *[F.array_join(X.search_tokens(F.coalesce(F.col(c), F.lit(""))), " ").alias(c) for c in ("content", "name", "parent")]).collect()
    for query in ("parse", "parseConfig", "load_file read", "naive", "{} read", "parse parse", "Loader", "a-b", "nothing"):
        tokens = spark.range(1).select(X.search_tokens(F.lit(query)).alias("t")).first()["t"]
        want = fts5([tuple(r) for r in told], " ".join('"' + t.replace('"', '""') + '"' for t in tokens))
        got = {r["id"]: r["score"] for r in S.bm25(df, query).collect()}
        assert got.keys() == want.keys(), query
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in got), query
    assert S.bm25(df, "{}").count() == 0 and S.bm25(df.limit(0), "parse").count() == 0


def test_sides_alone_and_together(spark):
    rows = [chunk(1, name="funcA", content="func handleAuth() { validateToken() }", vector=(0.9, 0.1, 0)), chunk(2, name="funcB", content="func handlePayment()", vector=(0, 0.9, 0.1)), chunk(3, name="funcC", content="func handleLogging()", vector=(0.1, 0, 0.9))]
    got = S.search(frame(spark, rows), S.Query(embedding=(0.9, 0.1, 0.0), limit=2))
    assert names(got)[0] == "funcA" and got.count() == 2
    rows = [chunk(1, name="parseConfig", content="func parseConfig() { readYAML() }", vector=(0.9, 0.1, 0)), chunk(2, name="loadConfig", content="func loadConfig()", vector=(0.85, 0.15, 0)), chunk(3, name="unrelated", content="x", vector=(0, 0, 1))]
    df = frame(spark, rows)
    assert names(S.search(df, S.Query(text="parseConfig")))[0] == "parseConfig"
    both = S.search(df, S.Query(text="parseConfig", embedding=(0.88, 0.12, 0.0))).collect()
    assert both[0]["name"] == "parseConfig" and both[0]["score"] == pytest.approx(2 / 61, rel=1e-6)


def test_filters_paging_and_deepening(spark):
    rows = [chunk(i, path=p, content=f"content {i}", language="go" if i < 2 else "python") for i, p in enumerate(["src/main.go", "src/utils/h.go", "test/m.go", *["b/x.py"] * 7])]
    df = frame(spark, rows)
    q = dict(text="content", embedding=(1.0, 0.0, 0.0))
    assert S.search(df, S.Query(**q, limit=2, languages=("go",))).count() == 2
    assert {r["file_path"] for r in S.search(df, S.Query(**q, paths=("src/**",))).collect()} == {"src/main.go", "src/utils/h.go"}
    assert {r["file_path"] for r in S.search(df, S.Query(**q, package="test")).collect()} == {"test/m.go"}
    pages = [[r["id"] for r in S.search(df, S.Query(**q, limit=3, offset=o)).orderBy("rn").collect()] for o in (0, 3, 6, 9)]
    assert sum(pages, []) == sorted(sum(pages, [])) and len(sum(pages, [])) == 10
    assert "content" not in S.search(df, S.Query(**q, metadata_only=True)).columns


def test_budget(spark):
    df = frame(spark, [chunk(i, content="x" * 101) for i in range(3)]).withColumn("rn", F.col("id").cast("int") + 1)
    assert S.within_budget(df, 50).count() == 2 and S.within_budget(df, 1).count() == 1
    assert S.within_budget(df.drop("content"), 1).count() == 3


@pytest.mark.parametrize("bad", [dict(), dict(text="x", paths=("src/**/test.go",)), dict(text="x", paths=("/a",)), dict(text="x", paths=("../a",)), dict(text="x", package=".."), dict(text="x", package="/a")])
def test_refused(bad):
    with pytest.raises(ValueError):
        S.Query(**bad).checked()


def test_bounds():
    q = S.Query(text="x", limit=999, offset=-1, names=tuple(map(str, range(60))), paths=("src/*.go", "src/utils/**")).checked()
    assert (q.limit, q.offset, len(q.names)) == (100, 0, 50) and S.Query(text="x", limit=0).checked().limit == 10


def test_many_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    x = np.random.default_rng(0).normal(size=(200, 8)).astype(np.float32)
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "vid long, embedding array<float>")
    got = {(r["qid"], r["rn"]): r["vid"] for r in S.nearest_many(df, df.where("vid % 25 = 0"), 4, "vid", width=8).collect()}
    for q in range(0, 200, 25):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        assert [got[q, r] for r in range(1, 5)] == sorted(range(200), key=lambda i: (d[i], i))[:4]
    assert S.nearest_many(df, df.limit(0), 4, "vid", width=8).count() == 0
    one = [r["vid"] for r in S.nearest(df, x[3].tolist(), 3, "vid").orderBy("rn").collect()]
    assert one[:2] == [3, 7] and S.nearest(df, x[3].tolist(), 0, "vid").count() == 0


def test_scalars(spark):
    row = spark.range(1).select(
        X.package_of(F.lit("main.go")).alias("a"), X.package_of(F.lit("internal/parser/x.go")).alias("b"), X.line_range(F.lit(3), F.lit(3)).alias("c"), X.line_range(F.lit(3), F.lit(9)).alias("d"),
        X.kind_label(F.lit("function_declaration")).alias("e"), X.kind_label(F.lit("odd")).alias("f"), X.visibility(F.lit("go"), F.lit("NewServer"), F.lit("")).alias("g"), X.visibility(F.lit("go"), F.lit("helper"), F.lit("")).alias("h"),
        X.token_estimate(F.lit("ééé")).alias("i"), X.project_hash(F.lit("/a/b/")).alias("j"),
    ).first()
    import hashlib

    assert list(row)[:9] == [".", "internal/parser", ":3", ":3-9", "func", "odd", "+", "-", 1]
    assert row["j"] == hashlib.sha1(b"a/b").hexdigest() and re.fullmatch(r"[0-9a-f]{40}", row["j"])
