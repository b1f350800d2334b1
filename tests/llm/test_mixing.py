import pytest

from tessera.llm import mixing as M

DOCS = "doc_id long, text string, source string, lang string, copies int"
TARGETS = "source string, target_share double, max_repeats int, lang string"


def test_rake_meets_sources_and_marginals():
    cells = {("a", "en", "x"): 100.0, ("a", "de", "x"): 50.0, ("b", "en", "y"): 400.0, ("b", "de", "y"): 100.0, ("c", "en", "x"): 9.0, ("z", "en", "x"): 5.0}
    raked = M.rake(cells, {"a": (0.3, 2), "b": (0.6, 1), "c": (0.1, 4), "gone": (0.5, 1)})
    rate = raked.rate
    assert raked.shares[0] == pytest.approx({"a": 0.3, "b": 0.6, "c": 0.1}) and raked.rounds >= 1
    got = {s: sum(rate[c] * cells[c] for c in rate if c[0] == s) for s in "abc"}
    total = sum(got.values())
    assert got["a"] / total == pytest.approx(0.3) and got["c"] / total == pytest.approx(0.1)
    assert got["c"] == pytest.approx(36) and all(rate[c] <= {"a": 2, "b": 1, "c": 4}[c[0]] + 1e-9 for c in rate)
    free = M.rake({("a", "en"): 300.0, ("a", "de"): 100.0, ("b", "en"): 100.0, ("b", "de"): 300.0}, {"a": (0.5, 9), "b": (0.5, 9)}, total=100).rate
    assert sum(free[c] * n for c, n in {("a", "en"): 300.0, ("b", "en"): 100.0}.items()) == pytest.approx(50)
    assert M.rake({}, {"a": (1.0, 1)}).rate == {} and M.rake({("a", "x"): 1.0}, {}).rate == {}


def test_cap_of_a_cell_goes_to_the_others():
    cells = {("a", "en"): 10.0, ("a", "de"): 90.0, ("b", "en"): 900.0}
    rate = M.rake(cells, {"a": (0.5, 1), "b": (0.5, 1)}).rate
    assert rate["a", "en"] == pytest.approx(1) and rate["a", "de"] == pytest.approx(1)


def test_drawn_shares(spark):
    rows = [(i, f"word number {i} of many words", ["big", "Big ", "small"][i % 3 if i % 10 == 0 else i % 2], ["en", "eng", None][i % 3], 0) for i in range(3000)]
    rows += [(9001, None, "big", "en", 0), (9002, "", "big", "en", 0), (9003, "text", None, "en", 0), (9004, "text", "other", "en", 0), (9005, "w " * 50_000, "untargeted", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.7, 1, "x"), ("small", 0.3, 3, "x"), ("absent", 0.2, 1, "x"), (None, 0.1, 1, "x")], TARGETS)
    mixed = M.mix(docs, targets)
    drawn = mixed.drawn
    got = {r["doc_id"]: r["copies"] for r in drawn.collect()}
    assert not got.keys() & {9001, 9002, 9003, 9004, 9005}
    assert max(got.values()) <= 3 and {r["source"] for r in drawn.collect()} == {"big", "small"}
    rows = {(r["axis"], r["value"]): r for r in M.report(mixed).collect()}
    assert abs(rows["source", "big"]["reached_share"] - 0.7 / 1.0) < 0.01 and rows["source", "absent"]["reached_share"] == 0
    assert rows["source", "absent"]["target_share"] == 0.2 and rows["source", "big"]["aimed_share"] == pytest.approx(0.7)
    assert {v for a, v in rows if a == "lang"} == {"en", "und"} and abs(rows["lang", "en"]["reached_share"] - rows["lang", "en"]["aimed_share"]) < 0.05
    for axis in ("source", "lang", "topic"):
        assert sum(r["reached_share"] for (a, _), r in rows.items() if a == axis) == pytest.approx(1)
    assert {r["doc_id"]: r["copies"] for r in M.mix(docs, targets).drawn.collect()} == got


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1, "x")], TARGETS)
    assert M.mix(docs, targets).drawn.count() == 0
    assert M.mix(spark.createDataFrame([(1, "x", "a", "en", 0)], DOCS), targets.limit(0)).drawn.count() == 0
    assert [r["reached_share"] for r in M.report(M.mix(docs, targets)).collect()] == [0]


def test_shares_of_the_table(spark):
    for r in M.p9_shares(spark, "/root/testdata/sf0.01").collect():
        if r["axis"] == "source" and r["documents"]:
            assert abs(r["reached_share"] - r["aimed_share"]) < 0.01


def test_every_area_of_a_document_counts(spark):
    """Documents of "art" and "transport" at once, and of "art" alone, lie in different sources."""
    rows = [(i, "word " * 20, "a" if i % 2 else "b", "en", 0) for i in range(2000)]
    areas = [(i, "art") for i in range(2000)] + [(i, "transport") for i in range(2000) if i % 2 and i % 5 < 4 or i % 2 == 0 and i % 5 == 0]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.2, 1, "x"), ("b", 0.8, 1, "x")], TARGETS)
    topics = spark.createDataFrame(areas, "doc_id long, subject string")
    drawn = {r["doc_id"]: r["copies"] for r in M.mix(docs, targets, topics=topics, total=10_000.0).drawn.collect()}
    transport = {i for i, s in areas if s == "transport"}
    assert abs(sum(n for i, n in drawn.items() if i in transport) / sum(drawn.values()) - len(transport) / 2000) < 0.03
