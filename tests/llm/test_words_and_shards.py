"""Hashes of structured words, and token shards, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import jaccard, lines, rans, substrings, tokens, words
from skein.llm.queries import tokenizer_path

A = "".join("ab"[i.bit_count() & 1] for i in range(1024))  # Thue-Morse: powers of any odd base meet on A and B
B = A.translate(str.maketrans("ab", "ba"))


def spans_of(texts):
    buf = " ".join(texts).encode()
    buf = np.frombuffer(buf, np.uint8)
    starts, ends, _ = words.spans(buf, np.array([0, len(buf)]))
    return words.span_hashes(buf, starts, ends), words.span_hashes(buf, starts, ends, lower=True)


def test_hashes_of_spans():
    texts = [A, B, A[:32], B[:32], A[:33], B[:33], "a", "b", "aa", "x" * 8, "x" * 9, "X" * 9, "y" + "x" * 8]
    texts += ["".join("ab"[i >> k & 1] for k in range(n)) for n in range(1, 13) for i in range(1 << n)]
    plain, lower = spans_of(texts)
    assert len(set(plain.tolist())) == len(set(texts))
    assert len(set(lower.tolist())) == len({x.lower() for x in texts})
    assert np.array_equal(spans_of(["q", *texts])[0][1:], plain)


def test_windows_of_two_words():
    h = np.array([3, 1 << 63], np.uint64)
    seen = {tuple(A[i : i + 64]): int(words.windows(np.where([x == "a" for x in A[i : i + 64]], h[0], h[1]), 64)[0]) for i in range(900)}
    assert len(set(seen.values())) == len(seen)


@pytest.fixture(scope="module")
def twins(spark):
    rows = [(i, A if i % 2 else B) for i in range(12)] + [(20, " ".join([A] * 20)), (21, " ".join([B] * 20)), (22, A + " " + B)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_operators_tell_structured_words_apart(twins):
    groups = {r.doc_id: r.component_id for r in jaccard.jaccard_components(twins, 4, 85).collect()}
    assert groups == {i: i % 2 for i in range(12)} | {20: 20, 21: 21, 22: 22}
    assert {r.doc_id: r.n_removed for r in substrings.substring_dedup(twins, 20).collect()}[21] == 0
    assert {r.n_dropped for r in lines.line_dedup(twins, 10, 1, False, filter_bits=16).collect()} == {0}
    ids = {r.doc_id: r.ids for r in tokens.token_output(twins, tokenizer_path(), with_ids=True).collect()}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    for i, t in ((0, B), (1, A), (22, A + " " + B)):
        assert ids[i] == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_pieces_are_the_tokenizers_own():
    rnd = random.Random(1)
    letters = [*" \n\tabé9'.,-× 中sl 　ẞ\x0b\x1c", "<|endoftext|>", "don't", " We'll", "  ", "x²"]
    texts = ["", " ", None, "été ñu × ÷ a×b", "\t\tx\r\ny  \n  z ", "''s '' 's"] + ["".join(rnd.choices(letters, k=rnd.randrange(30))) for _ in range(3000)]
    coder = tokens.PieceEncoder(tokenizer_path())
    for i, j, buf, offsets in words.chunks(pa.array(texts, pa.string()), 5000):
        ids, lengths = coder.encode(buf, offsets)
        ends = np.cumsum(lengths)
        for k in range(i, j):
            want = coder.tokenizer.encode(texts[k] or "", add_special_tokens=False).ids
            assert ids[ends[k - i] - lengths[k - i] : ends[k - i]].tolist() == want, texts[k]


def test_pieces_after_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    coder = tokens.PieceEncoder(tokenizer_path())
    for k in range(5):
        text = " ".join("w%dx" % (k * 40 + i % 80) for i in range(200))
        ids, _ = coder.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    coder = tokens.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = "Some Words, it's  all\nhere 12"
    ids, _ = coder.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_shard_is_read_from_its_bytes_alone(spark, tmp_path):
    texts = [(None, "null id"), (1, ""), (2, None), (3, "one two three"), (3, "three"), (4, "word " * 70000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    manifest = tokens.write_tokens(docs, f"file://{tmp_path}", tokenizer_path())
    manifest.write.parquet(str(tmp_path / "manifest"))
    coder = tokens.PieceEncoder(tokenizer_path())
    got = [(d, ids.tolist()) for f in sorted(tmp_path.glob("*.rans")) for d, ids in tokens.read_shard(f.read_bytes())]
    want = [(d, [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in texts]
    assert sorted(got, key=str) == sorted(want, key=str)
    with pytest.raises(OSError):
        next(tokens.read_shard(b"nothing of the kind"))


def test_blocks_of_unlike_lengths():
    g = np.random.default_rng(3)
    ranks = g.integers(0, 5, 70000)
    bounds = np.array([0, 0, 1, 40, 65000, 70000])
    freq = rans.quantise(np.bincount(ranks))
    coded = rans.encode(ranks, freq, bounds)
    assert np.array_equal(np.concatenate(rans.decode([(s, w, int(n)) for (s, w), n in zip(coded, np.diff(bounds))], freq)), ranks)
    one = rans.quantise(np.array([7]))
    (state, word) = rans.encode(np.zeros(100, np.int64), one, np.array([0, 100]))[0]
    assert np.array_equal(rans.decode([(state, word, 100)], one)[0], np.zeros(100))
