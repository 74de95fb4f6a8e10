"""Chains of edits, labels under a real tokenizer, draws of the Mersenne Twister."""

import os
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import patch
from skein.operators import labels, runs, tokenized
from skein.plans import catalog

rnd = random.Random(29)


def hunk(start, old, new, path="m"):
    lines = "".join(f"-{x}\n" for x in old) + "".join(f"+{x}\n" for x in new)
    return f"--- a/{path}\n+++ b/{path}\n@@ -{start},{len(old)} +{start},{len(new)} @@\n{lines}".rstrip("\n") + "\n"


def test_edits_apply_to_what_those_before_left(spark):
    files = spark.createDataFrame([(1, "m", "a\nb\nc\n"), (1, "n", "x\n"), (2, "m", "a\n")], "k long, path string, text string")
    diffs = [
        (1, 2, hunk(1, ["A"], ["AA"])), (1, 1, hunk(1, ["a"], ["A"]) + hunk(1, ["x"], ["y"], "n")), (1, 3, hunk(3, ["c"], ["C"]) + hunk(1, ["zzz"], ["q"], "n")),
        (1, 4, hunk(0, [], ["new"], "new")), (1, 5, hunk(1, ["new"], ["newer"], "new")), (2, 1, hunk(1, ["a"], ["b"])), (2, 2, hunk(1, ["a"], ["c"])),
    ]
    rnd.shuffle(diffs)
    got = {(r.k, r.path): (r.ok, r.text, r.error) for r in runs.apply_to_tree(files, spark.createDataFrame(diffs, "k long, at int, diff string"), "k", order="at").collect()}
    assert got[1, "m"] == (True, "AA\nb\nC\n", None) and got[1, "new"] == (True, "newer\n", None)
    assert got[1, "n"][:2] == (False, None) and got[1, "n"][2].startswith("edit 2 of 2: ") and got[2, "m"][0] is False and len(got) == 4


def test_chains_equal_one_edit_at_a_time():
    for _ in range(60):
        text, want, chain = "\n".join("abcdef") + "\n", list("abcdef"), []
        for _ in range(rnd.randrange(1, 6)):
            at = rnd.randrange(len(want))
            new = [rnd.choice("xyz") + str(rnd.randrange(99)) for _ in range(rnd.randrange(1, 3))]
            chain.append(hunk(at + 1, [want[at]], new))
            want[at : at + 1] = new
        assert patch.apply_all(text, chain) == "\n".join(want) + "\n"


def closing(messages):
    """No prefix but the whole is a beginning of a longer one: the last turn is trimmed and closed."""
    return tokenized.turns(messages[:-1]) + f"<start_of_turn>{messages[-1]['role']}\n{(messages[-1]['content'] or '').strip()} <eot>\n\n"


def ranks():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


WORDS = ["the", " ", "  ", "\n", "\n\n", "it's", "é", "中文", "x" * 40, "123", ".", " a", "'s", "\t"]


def transcript(n):
    return [{"role": rnd.choice(["system", "user", "assistant", "tool"]), "content": rnd.choice([None, "".join(rnd.choices(WORDS, k=rnd.randrange(120)))]), "train": rnd.choice([None, True, False])} for _ in range(n)]


@pytest.mark.parametrize("template", [tokenized.turns, closing])
def test_prefixes_count_as_if_encoded_anew(template):
    encode = tokenized.rank_encoder(*ranks())
    for _ in range(40):
        messages = transcript(rnd.randrange(1, 9))
        prefixes = [template(messages[:i]) for i in range(1, len(messages) + 1)]
        assert [list(x) for x in tokenized.prefix_ids(prefixes, encode)] == [encode(p) for p in prefixes]
        ids, mask, ends, cut = tokenized.encoded(messages, encode, template)
        start, want = 0, [labels.MASKED] * len(ids)
        for m, p in zip(messages, prefixes):
            end = max(start, min(len(encode(p)), len(ids)))
            if m["role"] == "assistant" and m["train"] is not False:
                want[start:end] = ids[start:end]
            start = end
        if set(want) == {labels.MASKED}:
            want[-1] = ids[-1]
        assert ids == encode(prefixes[-1]) and mask == want and ends == sorted(ends) and cut == 0


def test_prefixes_cost_about_one_encoding():
    encode, seen = tokenized.rank_encoder(*ranks()), []

    def counted(text):
        seen.append(len(text))
        return encode(text)

    messages = [{"role": "user", "content": "some words of text " * 20} for _ in range(200)]
    total = len(tokenized.turns(messages))
    for template in (tokenized.turns, closing):
        seen.clear()
        tokenized.encoded(messages, counted, template)
        assert sum(seen) < 3 * total + 200 * 3 * tokenized.STRETCH < total * 20


def test_common_beginnings():
    for _ in range(300):
        a, b = ("".join(rnd.choices("ab", k=rnd.randrange(9))) for _ in range(2))
        assert tokenized._in_common(a, b) == len(os.path.commonprefix([a, b]))


def test_encoded_column(spark):
    rows = [(1, [("user", "hello there", None), ("assistant", "yes it is", None)]), (2, []), (3, None), (4, [("user", "x", None)]), (5, [("assistant", "a b c d e f g", False), ("assistant", None, True)])]
    df = spark.createDataFrame(rows, "k long, messages array<struct<role: string, content: string, train: boolean>>")
    got = {r.k: r.e for r in df.select("k", tokenized.encode_transcripts("messages", *ranks(), max_len=8).alias("e")).collect()}
    assert got[2].input_ids == [] == got[3].input_ids == got[2].labels and got[3].ends == []
    assert len(got[1].input_ids) == 8 == len(got[1].labels) and got[1].hard_truncated == 1 and got[1].labels == got[1].input_ids
    assert sum(x != labels.MASKED for x in got[4].labels) == 1 and got[4].labels[-1] == got[4].input_ids[-1]


def test_query_over_conversations(spark):
    encode = tokenized.rank_encoder(*ranks())
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    for r in catalog.queries()["token_labels"](spark, "/root/testdata/sf0.001").collect():
        messages = [{"role": x.role, "content": x.text} for x in rows if x.conv_id == r.conv_id]
        ends = [len(encode(tokenized.turns(messages[:i]))) for i in range(1, len(messages) + 1)]
        assert r.ends == "[" + ",".join(map(str, ends)) + "]" and r.n == ends[-1]
        assert r.supervised == (sum(b - a for m, a, b in zip(messages, [0, *ends], ends) if m["role"] == "assistant") or 1)


def test_draws_of_the_twister(spark):
    df = spark.createDataFrame([(n, seed) for n in (1, 3, 6, 20, 50) for seed in (0, 1, 7, 2**40)], "n int, seed long")
    for limit in (0, 4, 6):
        for r in df.select("n", "seed", labels.shuffled_steps(F.col("n"), limit, F.col("seed")).alias("s")).collect():
            rng, pool = random.Random(r.seed), list(range(r.n - 1))
            rng.shuffle(pool)
            want = list(range(r.n)) if limit <= 0 or r.n <= limit else sorted({r.n - 1, *pool[: limit - 1]})
            assert r.s == want
    # published first draws: MT19937 with key [5489] by array
    assert random.Random(42).sample(range(10), 3) == [1, 0, 4]
