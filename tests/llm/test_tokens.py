import random

import pytest

from phyllo.llm import tokens as T

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def public():
    import base64

    with open(T.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    pools = [(32, 127), (32, 0x2FFF), (0x1F300, 0x1F6FF), (9, 14), (0x600, 0x6FF), (0xAC00, 0xAD00)]
    out = ["".join(chr(rng.randrange(*rng.choice(pools))) for _ in range(rng.randrange(80))) for _ in range(400)]
    return out + ["", " ", "\n\n \n", "<|endoftext|>", "a" * 20000, "=" * 5000 + "x", " " * 4000, "don't we'll I'D", "\x00\x00", "é" * 300, "cafÃ©"]


def test_encoding_is_that_of_the_public_library(spark, public, clash):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in T.encode(clash(df)).collect()}
    assert len(got) == len(texts) + 1 and got[len(texts)] == []
    for i, text in enumerate(texts):
        assert got[i] == public.encode_ordinary(text), text[:50]
    counts = {r.doc_id: r.tokens for r in T.token_counts(df).collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}


def test_round_trip_and_small_cache(public):
    t = T.Tokenizer(cache=50)
    texts = odd_texts()
    for begin in range(0, len(texts), 20):
        part = texts[begin : begin + 20]
        for ids, text in zip(t.encode(part).to_pylist(), part):
            assert public.decode_bytes(ids).decode("utf-8") == text


def test_perfect_hash():
    for n in (1, 2, 7, 1000, 20000):
        keys = [f"key{i}".encode() for i in range(n)]
        h = T.PerfectHash(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(n))
        assert h.find(keys) == list(range(n))
        assert h.find([b"other%d" % i for i in range(50)]) == [-1] * 50


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert T.encode(none).count() == 0 and T.token_counts(none).count() == 0
