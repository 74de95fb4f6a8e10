"""Every stage of the pipeline, and the whole of it, against brute force on a table with null and repeated ids."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import decontam, mixing, quality
from skein.llm.queries import tokenizer_path

rnd = random.Random(8)
VOCAB = ["p%d" % i for i in range(500)]
ITEM = " ".join(rnd.choices(VOCAB, k=30))


def text(n=60):
    return "\n".join(" ".join(rnd.choices(VOCAB, k=n // 3)) + "." for _ in range(3))


COPY = text()
NEAR = COPY.replace(COPY.split()[7], "other", 1)
ROWS = [(k, text(), "s%d" % (k % 3)) for k in range(12)]
ROWS += [(20, COPY, "s0"), (21, COPY, "s1"), (22, NEAR, "s1"), (None, COPY, None), (20, text(), "s0"), (None, text(), None), (5, ROWS[5][1], "s2"), (5, ROWS[5][1], "s2")]
ROWS += [(30, text() + "\n" + ITEM + ".", "s0"), (31, None, "s0"), (32, "", None), (33, "$ % &", "s1"), (34, "Home | News | Sport | Help\n" + text() + "\nAll rights reserved", "s1")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, `a.b` string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "c%d" % k, "d") for k, (i, t, s) in enumerate(ROWS)], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def nears(rows):
    """Rows of which one of each group stays: the least id, nulls last."""
    sets, group = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = Counter()
    for g in set(group):
        of = [r for r, x in zip(rows, group) if x == g]
        if not shingles(of[0]["text"]):
            out.update((r["doc_id"], r["text"]) for r in of)
            continue
        least = min((r["doc_id"] is None, r["doc_id"] or 0) for r in of)
        out["group", frozenset((r["doc_id"], r["text"]) for r in of if (r["doc_id"] is None, r["doc_id"] or 0) == least)] += 1
    return out


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = [r.asDict() for r in docs.collect()]

    def step(k, docs):
        out = corpus_pipeline.STAGES[k][1](spark, docs, tables)
        rows = [r.asDict() for r in out.collect()]
        return spark.createDataFrame(rows, out.schema), rows, out.columns

    docs1, rows1, cols = step(0, docs)
    assert cols == columns
    judged = {r.kept_text_: (r.kept, r.new) for r in quality.quality_rules(spark.createDataFrame([(r["text"], r["kept_text"]) for r in before], "text string, kept_text_ string")).withColumnRenamed("kept_text", "new").collect()}
    want = Counter((r["doc_id"], judged[r["kept_text"]][1], r["kept_text"]) for r in before if judged[r["kept_text"]][0])
    assert Counter((r["doc_id"], r["text"], r["kept_text"]) for r in rows1) == want and all(r["n_chars"] == len(r["text"]) for r in rows1)
    assert not any("rights" in r["text"] or "Home" in r["text"] for r in rows1) and len(rows1) > 15

    docs2, rows2, cols = step(1, docs1)
    assert cols == columns
    chosen = Counter()
    for key in nears(rows1):
        if key[0] == "group":
            of = [(r["doc_id"], r["text"]) for r in rows2 if (r["doc_id"], r["text"]) in key[1]]
            assert len(of) == 1, key
            chosen[of[0]] += 1
    assert sum(chosen.values()) == len(rows2)
    assert {r["doc_id"] for r in rows2 if r["text"] in (COPY, NEAR)} == {20}

    docs3, rows3, cols = step(2, docs2)
    assert cols == columns and [r["doc_id"] for r in rows2 if r not in rows3] == [30] and len(rows3) == len(rows2) - 1

    docs4, rows4, cols = step(3, docs3)
    plan = {(r.doc_id, r._key): r.copies for r in mixing.plan_mix(docs3).collect()}
    assert cols == columns and len(rows4) == sum(plan.values()) and all(r in rows3 for r in rows4)
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(words(rows4) - words(rows3)) <= 3 * 70

    _, rows5, cols = step(4, docs4)
    from tokenizers import Tokenizer

    tokenizer, at, got = Tokenizer.from_file(tokenizer_path()), 0, sorted(rows5, key=lambda r: r["start"])
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows4)
    coded = Counter((r["doc_id"], zlib.crc32(np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in rows4)
    assert coded == Counter((r["doc_id"], r["ids_crc32"]) for r in got)
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))

    whole = corpus_pipeline.run(spark, tables).collect()
    assert sorted(map(str, whole)) == sorted(str(r) for r in corpus_pipeline.run(spark, tables).collect())
    assert Counter((r.doc_id, r.ids_crc32) for r in whole) == coded


def test_stages_of_an_empty_table(spark, tables):
    none = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, work in corpus_pipeline.STAGES:
        assert work(spark, none, tables).count() == 0, name


def test_other_texts_under_a_removed_id_stay(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(None, ITEM), (None, "q"), (5, "q"), (5, "see " + ITEM)]
    left = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(["(None, 'q')", "(5, 'q')"])
