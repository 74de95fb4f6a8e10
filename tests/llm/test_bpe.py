"""Operator 13 against the tiktoken library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from skein.llm import bpe, queries

rnd = random.Random(13)
PARTS = ["a", "b", "ab", " ", "  ", "\n", "é", "ü", "1", "23", "'s", "'", "中", "文", "ing", "the", "!", "..", "\t", "\x1c", "\x85", " ", "<|endoftext|>"]


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def known(request):
    with open(public_tokenizers.path(request.param), "rb") as f:
        data = f.read()
    tokens = bpe.read_ranks(data)
    return data, tokens, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def ids_of(encoder, texts):
    ids, n = encoder.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_same_ids_as_the_library(known):
    _, tokens, library = known
    encoder, decoder = bpe.Encoder(tokens, public_tokenizers.PATTERN), bpe.Decoder(tokens)
    texts = [None, "", " "] + ["".join(rnd.choices(PARTS, k=rnd.choice([2, 9, 40, 300]))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(300)]
    got = ids_of(encoder, texts)
    assert got == [library.encode_ordinary(t or "") for t in texts]
    assert [decoder.decode(np.array(g, np.int64)) for g in got] == [(t or "").encode() for t in texts]


def test_long_pieces(known, monkeypatch):
    _, tokens, library = known
    texts = ["a" * 5001, "ab" * 3000, " " * 3000, "\n " * 2000, "".join(rnd.choices("abcdefgh", k=9000)), "".join(rnd.choices("中文字典語", k=3000)), "=-" * 2500, "1" * 4001]
    encoder = bpe.Encoder(tokens, public_tokenizers.PATTERN)
    assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "LONG", 2)  # all merges by the way of long pieces
    texts = ["".join(rnd.choices(["the", "er", "tion", "a", "ab", "aa", "ing"], k=8)) for _ in range(400)]
    assert ids_of(bpe.Encoder(tokens, public_tokenizers.PATTERN), texts) == [library.encode_ordinary(t) for t in texts]


def test_slices_and_a_small_cache(known, monkeypatch):
    _, tokens, library = known
    monkeypatch.setattr(bpe, "SLICE", 20)
    monkeypatch.setattr(bpe, "CACHE", 30)
    texts = ["".join(rnd.choices(PARTS, k=150)) for _ in range(300)]
    assert ids_of(bpe.Encoder(tokens, public_tokenizers.PATTERN), texts) == [library.encode_ordinary(t) for t in texts]


def test_columns_and_hard_rows(spark, known):
    data, _, library = known
    texts = [None, "", "same", "same", "x " * 200_000, "word" * 30_000]
    df = spark.createDataFrame([(None if i == 2 else i, t, "old", "kept") for i, t in enumerate(texts)], "doc_id long, text string, ids string, other string")
    out = bpe.decode(bpe.encode(df, data, public_tokenizers.PATTERN), data)
    assert sorted(out.columns) == ["decoded", "doc_id", "ids", "other", "text"]
    rows = sorted(out.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    texts = [texts[2], texts[0], texts[1], *texts[3:]]
    assert [r["ids"] for r in rows] == [library.encode_ordinary(t or "") for t in texts]
    assert [bytes(r["decoded"]) for r in rows] == [(t or "").encode() for t in texts]
    assert bpe.decode(bpe.encode(df.limit(0), data, public_tokenizers.PATTERN), data).collect() == []
    nulls = bpe.decode(spark.createDataFrame([(1, None), (2, [65, 66])], "doc_id long, ids array<int>"), data)
    assert [bytes(r["decoded"]) for r in nulls.orderBy("doc_id").collect()][0] == b""


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        tokens = bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op13_byte_bpe(spark, sf).collect()}
    assert got == want
