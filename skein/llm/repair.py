"""Operator 12, structure repair: the cheapest edits that make each conversation's roles read system? (user assistant)+.

Faults are found in SQL as far as a row shows them (blank, truncated); a row whose role and text stood earlier in its
conversation is a duplicate.  Edits are Keep (0), Rerole to user or assistant (2), Delete (3; blank and duplicate rows must
go) and Insert of an empty user or assistant turn (2); a truncated row that stays costs 1 more.

The edits come from a dynamic programme over retained turns.  A turn that stays, as it is or with a new role, follows an
earlier one that stays: the gap costs the deletions between them (prefix sums of 3 a turn) and the inserts that the pair of
roles determines (user user: an assistant; system assistant: a user; ...).  So for each role that may stand last one running
minimum is kept, of cost less the prefix sum at its turn, and every turn is priced from the four of them.  Of equal costs the
edits whose initials are least in ASCII win: all audits of equally many turns end in an edit of a turn, so none begins
another, and the order of the four is carried on as ranks instead of strings.  Of one gap deletions come first (D before I).
All conversations of an Arrow batch take a step at a time in numpy; four back pointers a turn give the edits.

One shuffle by conversation, sorted there; a task holds a batch of rows and one conversation beyond it.  A conversation's
audit and text are single values, so a conversation passes through one task, however long.
Turns go by number, nulls first; of one number by role and text, so repeated rows stand together.  A null role or text is
one space.  A row whose role and text are both null is no turn but names its conversation, which is then reported even with
no turns: zeros, an empty audit.  Rows without a conversation id belong to none and are left out.  A role's initial is its
first code point; an empty role has none and cannot be kept, nor can any but s, u, a.  Other columns are not read.  An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
_INF = np.int64(1 << 60)
#: states: nothing stays yet, then the role of the last turn that stays
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
#: what is added to an audit, in ASCII order
_ADDED = ["D", "IK", "IR", "K", "R"]
_D, _IK, _IR, _K, _R = range(5)
#: inserts between two retained roles, and after the last one; -1 where the second cannot follow
_BETWEEN = {_USER: (0, 0, 1, 0), _ASSISTANT: (1, 1, 0, 1), _SYSTEM: (0, -1, -1, -1)}
_AFTER = np.array([0, 2, 1, 0])
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}

REPORT = (
    "id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired array<struct<role: string, text: string, turn: long>>"
)


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: id, gaps in the turn numbers, faults by kind, illegal neighbours, cost, audit and the repaired turns.

    repaired has role, text and the number of the turn that it comes from (null: inserted).
    """
    there = F.col(role_col).isNotNull() | F.col(text_col).isNotNull()
    text = F.coalesce(F.col(text_col), F.lit(" "))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        text.alias("text"),
        there.alias("there"),
    )
    tail: Column = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.select(
        "*",
        (tail == "").alias("is_blank"),
        (~F.right(tail, F.lit(1)).isin(".", "!", "?")).alias("is_cut"),
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("key"),
    )
    ordered = rows.repartition("id").sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(_repaired, REPORT)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_conversations(batches):
        yield from _repair_rows(rows)


def _whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, so that each table ends with a conversation."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0).to_numpy()
        cut = int(np.searchsorted(ids, ids[-1]))  # where the last conversation begins
        if kept and (cut or kept[-1].column(0)[-1].as_py() != ids[0]):
            yield pa.Table.from_batches([*kept, b.slice(0, cut)])
            kept = []
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        kept.append(b.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def _repair_rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = table.combine_chunks()
    all_ids = rows["id"].to_numpy()
    ids = all_ids[np.concatenate([[True], all_ids[1:] != all_ids[:-1]])]
    rows = rows.filter(rows["there"])
    n_rows = rows.num_rows
    first = np.searchsorted(rows["id"].to_numpy(), ids)
    n = np.append(first[1:], n_rows) - first
    conv = np.repeat(np.arange(len(ids)), n)

    initial = pc.utf8_slice_codeunits(rows["role"], 0, 1)
    kind = np.full(n_rows, -1, np.int64)
    for letter, state in (("s", _SYSTEM), ("u", _USER), ("a", _ASSISTANT)):
        kind[pc.equal(initial, letter).to_numpy(zero_copy_only=False).astype(bool)] = state
    blank = rows["is_blank"].to_numpy().astype(bool)
    key = rows["key"].combine_chunks() if isinstance(rows["key"], pa.ChunkedArray) else rows["key"]
    codes = key.dictionary_encode().indices.to_numpy().astype(np.int64) if n_rows else np.zeros(0, np.int64)
    seen = np.ones(n_rows, bool)
    seen[np.unique(conv * (n_rows + 1) + codes, return_index=True)[1]] = False
    duplicate = ~blank & seen
    cut = ~blank & ~duplicate & rows["is_cut"].to_numpy().astype(bool)

    pair_ok = np.zeros((4, 4), bool)
    pair_ok[[_SYSTEM, _USER, _ASSISTANT], [_USER, _ASSISTANT, _USER]] = True
    same = conv[1:] == conv[:-1]
    illegal = same & ~((kind[1:] > 0) & (kind[:-1] > 0) & pair_ok[kind[:-1], kind[1:]])

    def count(flags: np.ndarray, of: np.ndarray = conv) -> np.ndarray:
        return np.bincount(of[flags], minlength=len(ids))

    plan = _edits(first, n, kind, blank | duplicate, cut)
    audits, take, role = _applied(first, n, conv, *plan[1:])
    lengths = np.bincount(take[0], minlength=len(ids))
    source = pa.array(take[1], mask=take[1] < 0)
    new_role = pc.if_else(pa.array(role > 0), pc.take(pa.array(["", "", "user", "assistant"]), pa.array(role)), pc.take(rows["role"], source))
    repaired = pa.StructArray.from_arrays(
        [_flat(new_role), _flat(pc.fill_null(pc.take(rows["text"], source), "")), _flat(pc.take(rows["turn"], source))], names=["role", "text", "turn"]
    )
    columns = [ids, _gaps(rows["turn"], conv, len(ids)), count(blank), count(duplicate), count(cut), count(illegal, conv[1:]), plan[0]]
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    yield pa.RecordBatch.from_arrays(
        [*[pa.array(c, pa.int64()) for c in columns], pa.array(audits, pa.string()), pa.ListArray.from_arrays(offsets, repaired)],
        names=["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"],
    )


def _flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _gaps(turn: pa.ChunkedArray, conv: np.ndarray, n: int) -> np.ndarray:
    """Last number - first + 1 - different numbers; nulls do not count, and stand first."""
    known = pc.is_valid(turn).to_numpy().astype(bool)
    number, of = pc.drop_null(turn).to_numpy(), conv[known]
    out = np.zeros(n, np.int64)
    if len(of):
        begins = np.concatenate([[True], of[1:] != of[:-1]])
        ends = np.append(begins[1:], True)
        other = begins.copy()
        other[1:] |= number[1:] != number[:-1]
        out[of[begins]] = number[ends] - number[begins] + 1 - np.bincount(of[other], minlength=n)[of[begins]]
    return out


def _edits(first: np.ndarray, n: np.ndarray, kind: np.ndarray, must_go: np.ndarray, cut: np.ndarray) -> tuple:
    """Cost of each conversation, its last state, and for each turn the best way into each of the four states."""
    way = np.zeros((len(kind), 4), np.int8)  # what is added to the audit
    back = np.zeros((len(kind), 4), np.int8)  # the state before
    # running minima by the role that stands last, of cost less the prefix sum of deletions (DELETE for every turn so far)
    best = np.full((len(n), 4), _INF)
    best[:, _NONE] = 0
    rank = np.tile(np.arange(4), (len(n), 1))  # of their audits
    longest = np.argsort(-n, kind="stable")
    sizes = -n[longest]
    for t in range(int(n.max(initial=0))):
        on = longest[: np.searchsorted(sizes, -t)]  # conversations with a turn t
        row = first[on] + t
        before, order = best[on], rank[on]
        new, key, come = before.copy(), order * 8 + _D, np.tile(np.arange(4, dtype=np.int8), (len(on), 1))
        k, go, extra = kind[row], must_go[row], cut[row] * TRUNCATED
        for to, inserts in _BETWEEN.items():
            keeps = k == to
            price = np.where(keeps, 0, REROLE) + extra - DELETE  # the turn itself is not deleted
            stays = ~go & (keeps | (to != _SYSTEM))
            for state, inserted in enumerate(inserts):
                if inserted < 0:
                    continue
                cost = np.where(stays & (before[:, state] < _INF), before[:, state] + price + inserted * INSERT, _INF)
                audit = order[:, state] * 8 + np.where(keeps, _IK if inserted else _K, _IR if inserted else _R)
                less = (cost < new[:, to]) | ((cost == new[:, to]) & (cost < _INF) & (audit < key[:, to]))
                new[less, to], key[less, to], come[less, to] = cost[less], audit[less], state
        best[on], rank[on] = new, np.argsort(np.argsort(np.where(new < _INF, key, 1 << 20), axis=1), axis=1)
        way[row], back[row] = key % 8, come
    total = np.where(best < _INF, best + _AFTER * INSERT, _INF)
    least = total.min(axis=1, keepdims=True)
    last = np.where(total == least, rank, 99).argmin(axis=1)
    return least[:, 0] + DELETE * n, last, way, back


def _applied(first: np.ndarray, n: np.ndarray, conv: np.ndarray, last: np.ndarray, way: np.ndarray, back: np.ndarray) -> tuple:
    """Audits; (conversation, row or -1) of every repaired turn; its new role's state, 0 where the old role stays."""
    added, state_of = np.zeros(len(conv), np.int64), np.zeros(len(conv), np.int64)
    state = last.copy()
    longest = np.argsort(-n, kind="stable")
    sizes = -n[longest]
    for t in range(int(n.max(initial=0)) - 1, -1, -1):
        on = longest[: np.searchsorted(sizes, -t)]
        row = first[on] + t
        added[row], state_of[row] = way[row, state[on]], state[on]
        state[on] = back[row, state[on]]
    # in order of conversation: each row with the insert before it, then the inserts at its end
    n_end = _AFTER[last]
    inserted = (added == _IK) | (added == _IR)
    stays = added != _D
    of = np.concatenate([conv[inserted], conv, np.repeat(np.arange(len(n)), n_end)])
    at = np.concatenate([np.flatnonzero(inserted) * 2, np.arange(len(conv)) * 2 + 1, np.full(n_end.sum(), 2 * len(conv))])
    ends = np.concatenate([np.arange(x) for x in n_end]) if n_end.sum() else np.zeros(0, np.int64)
    letter = np.concatenate([np.full(inserted.sum(), ord("I")), np.array([ord(x[-1]) for x in _ADDED])[added], np.full(n_end.sum(), ord("I"))]).astype(np.uint8)
    source = np.concatenate([np.full(inserted.sum(), -1), np.where(stays, np.arange(len(conv)), -2), np.full(n_end.sum(), -1)])
    other = np.where(state_of == _USER, _ASSISTANT, _USER)
    final = np.repeat(last, n_end)
    end_role = np.where((final == _SYSTEM) & (ends == 0), _USER, _ASSISTANT)
    role = np.concatenate([other[inserted], np.where((added == _R) | (added == _IR), state_of, 0), end_role])
    order = np.lexsort((np.concatenate([np.zeros(len(letter) - len(ends), np.int64), ends]), at, of))
    of, letter, source, role = of[order], letter[order], source[order], role[order]
    text = letter.tobytes().decode()
    stop = np.cumsum(np.bincount(of, minlength=len(n)))
    audits = [text[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]
    there = source != -2
    return audits, (of[there], source[there]), role[there]
