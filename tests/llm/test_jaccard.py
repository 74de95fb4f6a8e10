"""The n-gram Jaccard join against all pairs: groups around the threshold, blocks, links, removal by row."""

import random

import pytest

from skein.llm import components as connected
from skein.llm import jaccard

rnd = random.Random(11)
VOCAB = ["v%d" % i for i in range(4000)]


def shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def truth(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    links = set()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                links.add((j, i))
    root = list(range(len(texts)))
    for j, i in sorted(links):
        x, y = root[j], root[i]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return sets, links, root


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = rnd.choice(VOCAB)
    return " ".join(words)


BASE = rnd.choices(VOCAB, k=120)
#: copies around a base with links to few of the others, a chain, a base text that is a hub, sizes around the bands
TEXTS = [edited(BASE, rnd.randrange(2, 5)) for _ in range(90)]
CHAIN = [rnd.choices(VOCAB, k=60)]
for _ in range(12):
    CHAIN.append(edited(CHAIN[-1], 1).split())
TEXTS += [" ".join(x) for x in CHAIN]
TEXTS += [" ".join(BASE[:n]) for n in range(60, 120, 6)] + ["a b c", "A b C", "a b", "a b c d e f", "", None, " \n"]
LONG = rnd.choices(VOCAB, k=6000)
TEXTS += [edited(LONG, n) for n in (0, 40, 80, 90, 100, 400)] + [" ".join(rnd.choices(VOCAB, k=6000))]


@pytest.mark.parametrize("k,percent,block", [(5, 80, 512), (4, 85, 512), (4, 85, 16)])
def test_components(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, percent).collect()}
    sets, _, root = truth(TEXTS, k, percent)
    assert got == {i: (len(sets[i]), root[i]) for i in range(len(TEXTS))}
    assert len(set(root)) > 15


@pytest.mark.parametrize("hub", [1000, 5])
def test_stars_and_union_find_agree(spark, monkeypatch, hub):
    monkeypatch.setattr(connected, "HUB", hub)
    edges = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 140)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(90)] + [(-5, 7), (500, 500), (3, 2)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {(r.node, r.root) for r in connected.components(df).collect()}
    assert one == {(r.node, r.root) for r in connected.star_components(df).collect()} and (39, -5) in one
    assert connected.components(df.limit(0)).count() == 0 == connected.star_components(df.limit(0)).count()


def test_links(spark):
    texts = TEXTS[:60] + TEXTS[:3] + TEXTS[-16:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, links = jaccard.jaccard_links(docs, 5, 80)
    members = {r.doc_id: r for r in members.collect()}
    found = {frozenset((r.a, r.b)) for r in links.collect()}
    sets, want, _ = truth(texts, 5, 80)
    for j, i in want:
        a, b = members[j].class_id, members[i].class_id
        assert a == b or frozenset((a, b)) in found
    assert len(found) == len({frozenset((frozenset(sets[j]), frozenset(sets[i]))) for j, i in want if sets[j] != sets[i]})
    ends = [x for pair in want for x in pair]
    copies = {i: [j for j in members if sets[j] == sets[i]] for i in members}
    for i, r in members.items():
        # links of a class are counted once for every class at their other end
        others = {frozenset(sets[j if x == i else x]) for x, j in want if i in (x, j)} - {frozenset(sets[i])}
        assert r.n_links == (len(others) + len(copies[i]) - 1 if sets[i] else 0), (i, ends.count(i))


def test_one_row_of_each_component_stays(spark):
    p, q, r = " ".join(BASE), "some other text of six words", edited(BASE, 1)
    rows = [(3, p, "a"), (7, p, "b"), (7, q, "c"), (None, p, "d"), (None, q, "e"), (None, q, "e"), (9, r, "f"), (3, p, "a"), (5, "", "g"), (5, "", "g"), (None, None, "h"), (4, "Twice", "i"), (4, "Twice", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _r_id string")
    got = jaccard.without_near_duplicates(docs, 5, 80)
    assert got.columns == docs.columns
    want = [(3, p, "a"), (7, q, "c"), (5, "", "g"), (5, "", "g"), (None, None, "h"), (4, "Twice", "i")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert jaccard.without_near_duplicates(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, p), (None, p), (None, r)], "doc_id long, text string")
    assert jaccard.without_near_duplicates(nulls).count() == 1
