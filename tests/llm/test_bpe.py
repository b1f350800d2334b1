
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

RANKS = bpe.read_ranks(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")
ENC = bpe.Encoder(RANKS)


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


REF = reference()


def test_hash_is_minimal_and_perfect():
    assert sorted(ENC.table.values.tolist()) == sorted(RANKS.values())
    assert ENC.table.find(list(RANKS)).tolist() == list(RANKS.values())
    assert ENC.table.find([b"surely not an entry", b""]).tolist() == [-1, -1]


def test_merges_reach_every_entry():
    assert all(bpe.merge(k, RANKS) == [v] for k, v in RANKS.items())


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_like_public_encoder(text):
    assert ENC.encode([text])[0] == REF.encode_ordinary(text)
    assert b"".join({v: k for k, v in RANKS.items()}[i] for i in ENC.encode([text])[0]).decode() == text


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000, " " * 9_999, "ß漢字🙂" * 3000, "x\r\ny\t\t z", "<|endoftext|>"])
def test_long_and_odd(text):
    assert ENC.encode([text])[0] == REF.encode_ordinary(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, "hello world", 1), (1, "hello world", 2), (2, None, 3), (3, "", 4), (None, "x", 5)], "doc_id long, text string, ids int")
    got = [(r["doc_id"], list(r["ids"])) for r in bpe.encode(df).collect()]
    want = REF.encode_ordinary("hello world")
    assert sorted(got, key=str) == sorted([(1, want), (1, want), (2, []), (3, []), (None, REF.encode_ordinary("x"))], key=str)
    assert bpe.encode(df.limit(0)).count() == 0


def test_whole_table(spark):
    from tessera.llm.tokens import p8_ids

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in p8_ids(spark, "/root/testdata/sf0.01").collect()}
    assert got == {k: REF.encode_ordinary(t or "") for k, t in texts.items()}
