import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pieces as P


def sound(text, got, limit, overlap):
    """Pieces within the limit; without their overlaps they are the text; lines are right."""
    lines = text.split("\n")
    at = 0
    data = text.encode("utf-8", "surrogatepass")
    for t, a, b in got:
        raw = t.encode("utf-8", "surrogatepass")
        assert 0 < len(raw) <= limit or not text
        begin = max(0, at - overlap)
        where = next(i for i in range(begin, at + 1) if data.startswith(raw, i) and i + len(raw) > at or not raw)
        assert data.count(b"\n", 0, where) == a
        assert b == data.count(b"\n", 0, where + len(raw) - (raw.endswith(b"\n") and where + len(raw) < len(data)))
        at = where + len(raw)
    assert at == len(data) and got[-1][2] == len(lines) - 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab {};.\n\r\té漢🙂")), max_size=600), st.integers(16, 90), st.integers(0, 8), st.sampled_from([None, "section", "function_definition"]))
def test_round_trip(text, limit, overlap, kind):
    sound(text, P.split(text, limit, overlap, kind), limit, overlap)


def code(n, rnd):
    return "\n\n".join(f"def f{i}(a):\n    x = {rnd.random()}\n    for y in a:\n        x += y * {rnd.randrange(999)}\n    return x" for i in range(n))


def test_cuts_are_natural():
    text = code(300, random.Random(1))
    got = P.split(text, 2000, 0, "block")
    sound(text, got, 2000, 0)
    assert len(got) > 5 and all(t.startswith("def ") for t, _, _ in got)


def test_edits_stay_local():
    text = code(600, random.Random(2))
    other = text[:9000] + "\n    z = 'inserted text of some length'\n" + text[9000:]
    a, b = ({t for t, _, _ in P.split(x, 2000, 0, "block")} for x in (text, other))
    assert len(a - b) <= 4 and len(a) > 15


@pytest.mark.parametrize("text", ["x" * 100_000, "🙂" * 20_000, "\n" * 9000, "a b" * 30_000, "é" * 4096 + "\r\n" * 3000])
def test_without_boundaries(text):
    sound(text, P.split(text), P.LIMIT, P.OVERLAP)


def test_bounds():
    for limit, overlap in ((4, 0), (100, 60), (100, -1)):
        with pytest.raises(ValueError):
            P.split("x", limit, overlap)


def test_rows(spark):
    df = spark.createDataFrame(
        [("1", "a", "x\n" * 5000, 7, "block", 0), ("1", "a", "x\n" * 5000, 7, "block", 1), ("2", "a", None, 1, None, 0), ("3", "a", "é" * 2048, 1, None, 0), ("4", None, "é" * 2049, None, None, 0), ("5", "a", "", 1, None, 0)],
        "id string, file_path string, content string, start_line int, node_kind string, piece int",
    )
    rows = P.pieces(df).collect()
    assert {r["id"] for r in rows} == {"1", "4"}
    first = [r for r in rows if r["id"] == "1" and r["piece"] == 0]
    assert len(first) == 1 and first[0]["start_line"] == 7
    assert max(r["end_line"] for r in rows if r["id"] == "1") == 7 + 5000
    assert P.pieces(df.limit(0)).count() == 0


def test_all_chunks(spark):
    sf = "/root/testdata/sf0.01"
    from tests.oracle import check

    assert check(spark, P.p6_found, P.SQL["p6_found"], sf) > 0
    for r in spark.read.parquet(f"{sf}/chunks.parquet").where("octet_length(content) > 4096").collect():
        sound(r["content"], P.split(r["content"], kind=r["node_kind"]), P.LIMIT, P.OVERLAP)
