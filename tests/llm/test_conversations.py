"""Operators 11 and 12 against brute force: every beginning counted one by one, every way to edit tried."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest

from skein.llm import queries, repair, trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, depth string, cost string"
rnd = random.Random(11)


def table(spark, rows):
    """id, depth and cost clash with the operators' own columns."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def many_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_trie(seqs):
    members = defaultdict(list)
    for i, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(i)
    out = set()
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * words(q[-1][1]) for q in below if q)
        leaves = sum(1 for q in below if not any(len(r) == len(q) + 1 and r[:-1] == q for r in below))
        children = sum(1 for q in below if len(q) == len(p) + 1)
        ends = ",".join(str(i) for i in sorted(ids) if len(seqs[i]) == len(p))
        out.add((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, key, (role, text)))
    return {c: [x[-1] for x in sorted(v)] for c, v in convs.items()}


def nodes(df):
    return [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


def shared_rows(n, letters, most):
    """Many conversations with the same beginnings; a third of them are one and the same."""
    same = [("user", "all the same"), ("assistant", "one two three"), ("user", "")]
    rows = []
    for c in range(n):
        turns = same if c % 3 == 0 else [("user", rnd.choice(letters)) for _ in range(rnd.randrange(1, most))]
        rows += [(c * 7 % n, i, role, text) for i, (role, text) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("letters,most,n", [(["a", "b c"], 7, 150), (["a"], 12, 60), ([str(i) for i in range(40)], 3, 90)])
def test_trie_over_many_blocks(many_blocks, letters, most, n):
    rows = shared_rows(n, letters, most)
    seqs = trie.sequences(trie.ordered_turns(trie.turn_keys(table(many_blocks, rows))))
    got = nodes(trie.trie(seqs))
    assert len(got) == len(set(got))
    assert set(got) == brute_trie(in_order(rows))


def test_trie_of_hard_rows(spark):
    long = [(5, i, "user", f"turn {i}") for i in range(300)] + [(6, i, "user", f"turn {i}") for i in range(299)]
    rows = long + [
        (1, None, None, None), (1, 3, "user", "x" * 100_000), (1, 3, "user", "x" * 100_000), (2, None, "", ""), (2, 3, "user", "x" * 100_000),
        (3, 0, "us", "er:a"), (4, 0, "user", ":a"), (None, 0, "user", "nobody"), (-7, 0, "user", "a b"), (-8, 2**62, "user", "a b"),
    ]
    df = table(spark, rows)
    assert set(nodes(trie.trie(trie.sequences(trie.ordered_turns(trie.turn_keys(df)))))) == brute_trie(in_order(rows))
    assert nodes(trie.trie(trie.sequences(trie.ordered_turns(trie.turn_keys(df.limit(0)))))) == []


def test_trie_last_key_finds_the_text(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "c")]
    keyed = trie.turn_keys(table(spark, rows))
    out = {(r["conv_id"], r["depth"]): r["last_key"] for r in trie.trie(trie.sequences(trie.ordered_turns(keyed))).collect()}
    key = {(r["id"], r["turn"]): r["key"] for r in keyed.collect()}
    assert out == {(1, 0): None, (1, 1): key[1, 0], (1, 2): key[1, 1], (2, 2): key[2, 1]}


def test_query_rebuilds_conversations(many_blocks, tmp_path):
    rows = [(c, t, rnd.choice(["user", None]), rnd.choice(["a", "b", None])) for c in range(70) if c % 40 for t in range(rnd.randrange(1, 6))] + [(41, None, "user", "first")]
    table(many_blocks, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    own = in_order(rows)
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    want = brute_trie({c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own})
    assert set(nodes(queries.op11_conversation_trie(many_blocks, str(tmp_path)))) == want


def test_nearest_smaller():
    for _ in range(300):
        v = np.array([rnd.randrange(4) for _ in range(rnd.randrange(0, 12))], np.int64)
        before, after = trie.nearest_smaller(v)
        for i in range(len(v)):
            assert before[i] == max([j for j in range(i) if v[j] < v[i]], default=-1)
            assert after[i] == min([j for j in range(i + 1, len(v)) if v[j] < v[i]], default=len(v))


def stripped(text):
    return text.rstrip(" \t\n\x0b\x0c\r")


def brute_repair(rows):
    """rows: (turn, role, text) of one conversation in order; None for its name alone."""
    rows = [r for r in rows if r]
    fault, seen = [], set()
    for _, role, text in rows:
        tail = stripped(text)
        fault.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None
    for ops in product("DKua", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and o != "D" for f, o in zip(fault, ops)):
            continue
        cost, audit, out, last, ok = 0, "", [], "", True
        for (_, role, text), f, o in zip(rows, fault, ops):
            if o == "D":
                cost, audit = cost + 3, audit + "D"
                continue
            cost += (f == "truncated") + (0 if o == "K" else 2)
            to = (role[:1] or "?") if o == "K" else o
            while last + to not in ("s", "u", "su", "ua", "au"):  # the insert that brings the next turn nearer
                put = "u" if last in ("", "s", "a") else "a"
                if to not in ("u", "a") or audit.endswith("III"):
                    ok = False
                    break
                cost, audit, last = cost + 2, audit + "I", put
                out.append(({"u": "user", "a": "assistant"}[put], ""))
            if not ok:
                break
            audit, last = audit + ("K" if o == "K" else "R"), to
            out.append((role if o == "K" else {"u": "user", "a": "assistant"}[o], text))
        if not ok:
            continue
        while last in ("s", "u"):
            put = "u" if last == "s" else "a"
            cost, audit, last = cost + 2, audit + "I", put
            out.append(({"u": "user", "a": "assistant"}[put], ""))
        if best is None or (cost, audit) < best[:2]:
            best = (cost, audit, out)
    known = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"),
        sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], best[2],
    )


def check_repair(df, convs):
    got = {r["id"]: r for r in df.collect()}
    assert set(got) == set(convs)
    for c, rows in convs.items():
        r = got[c]
        want = brute_repair(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) if None not in rows else rows)
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], [(t["role"], t["text"]) for t in r["repaired"]]) == want, rows


def test_repair_tries_every_edit(spark):
    convs = {}
    for c in range(400):
        n = rnd.randrange(0, 7)
        convs[c] = [(i * rnd.choice([1, 1, 2]), rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice(["a.", "b!", "c?", "cut", " ", "d. \n", "é"])) for i in range(n)] or [None]
    rows = [(c, *(r or (None, None, None))) for c, v in convs.items() for r in v]
    rnd.shuffle(rows)
    check_repair(repair.repair(table(spark, rows).repartition(5)), convs)


def test_repair_of_hard_rows(spark):
    rows = [(1, None, None, "x."), (1, 3, "user", None), (1, 3, "user", None), (None, 1, "user", "nobody"), (2, None, None, None), (3, -5, "user", "a."), (3, 9, "assistant", "b.")]
    out = repair.repair(table(spark, rows))
    check_repair(out, {1: [(None, " ", "x."), (3, "user", " "), (3, "user", " ")], 2: [None], 3: [(-5, "user", "a."), (9, "assistant", "b.")]})
    assert repair.repair(table(spark, rows).limit(0)).collect() == []
    long = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(3001)] + [(1, 4000, "user", "x" * 1_000_000 + "!")]
    row = repair.repair(table(spark, long)).first()
    assert (row["cost"], row["gaps"], row["audit"]) == (2, 999, "K" * 3001 + "R")
    assert [t["role"] for t in row["repaired"]] == ["user", "assistant"] * 1501


def test_conversations_across_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        convs = {c: [(i, rnd.choice(["user", "assistant"]), rnd.choice(["a.", "b.", "cut", ""])) for i in range(c % 6 + 1)] for c in range(40)}
        check_repair(repair.repair(table(spark, [(c, *r) for c, v in convs.items() for r in v]).coalesce(1)), convs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_damage(spark, tmp_path):
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a. b", "c!", None])) for c in range(60) for t in [None, 0, 1, 2]]
    table(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    convs = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            convs[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = {r["conv_id"]: r for r in queries.op12_structure_repair(spark, str(tmp_path)).collect()}
    for c in range(60):
        want = brute_repair(sorted(convs[c], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])))
        text = "\n".join(f"{a}:{b}" for a, b in want[-1])
        r = got[c]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) == (*want[:-1], hashlib.sha256(text.encode()).hexdigest())
