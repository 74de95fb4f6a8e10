"""Operator 11, the prefix trie of conversations, from the LCP array of their sorted order.

sequences() gives each conversation as a row: its turns' keys (MD5 of role and text, 16 bytes each) in turn order, and the
words of each turn.  Equal turns have equal keys, so any order of the keys serves to bring equal beginnings together.

trie() sorts the sequences by (keys, id) into ranges; a range is a block.  LCP[i] is the number of turns that row i shares
with the row before.  Every node of the trie is an interval of rows: it begins at a row whose LCP is less than the node's
depth and ends before the next such row.  So the all-nearest-smaller-values of the LCP array give the Cartesian tree's
intervals; equal LCPs with the same interval are one node, and the depths between a node and its parent's, which the
Cartesian tree skips, are expanded to unary chains over the same interval.  What a node counts comes from differences of
prefix sums over its interval (rows, leaves, words shared with the row before) and a table of range minima (ids).

Blocks do this each for itself and in parallel, as if there were no other rows.  Nodes that touch a block's first or last row
are pieces of nodes that may go on beyond it; there are at most as many as the two rows have turns.  For these the nearest
smaller value lies in another block and is found by the blocks' minima, a number a block: those and the LCPs over the
blocks' borders are all that goes to the driver.  Pieces of one node are then summed by (block in which it begins, depth).

saved_tokens of a node: each row in its interval but the first shares LCP turns with the row before, so the words of those
turns are saved, less those above the node.  ends_sha256 hashes the ids, in pieces of text, one for each block that a run of
equal conversations crosses; the digest of such a run is sequential by definition and streams these pieces through a task.

A conversation is one row of 20 bytes a turn.  Equal turn numbers go by key; null turns first; null role or text is empty;
rows without a conversation id belong to none and are left out; repeated conversations are members each.  Texts of any
length are hashed whole.  No conversations give no nodes.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

KEY = 16
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
#: ids in one piece of a run's text
PIECE = 1 << 16

_SEQUENCE = "id long, keys binary, words array<int>"
#: what blocks write.  kind: 0 node, 1 piece of a node, 2 ids of a run that a piece may continue, 3 the block's border.
#: side: 0 for pieces that begin at the block's first row, 1 for others that reach its last.  shared: words above the node.
_BLOCK = (
    "kind int, block int, side int, depth int, id long, parent_id long, parent_side int, n long, children long, more int, leaves long, "
    "words long, shared long, last_key binary, ends string, at_end int, piece int, keys_first binary, keys_last binary, words_first array<int>, inner int"
)
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, last_key binary"


def turn_keys(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, key, words) of every row with a conversation id."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    return turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )


def ordered_turns(keyed: DataFrame, *by: str) -> DataFrame:
    """Per conversation (and the columns by): its turns in order, an array of (turn, key, words)."""
    return keyed.groupBy(*by, "id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("there"), "turn", "key", "words"))).alias("turns"))


def sequences(turns_of: DataFrame) -> DataFrame:
    """(id, keys, words) of rows with an array turns."""
    key, words = F.transform("turns", lambda t: F.hex(t["key"])), F.transform("turns", lambda t: t["words"])
    return turns_of.select("id", F.unhex(F.array_join(key, "")).alias("keys"), words.alias("words"))


def trie(seqs: DataFrame) -> DataFrame:
    """A row for each distinct beginning of a sequence, the empty one included.

    conv_id: least member; depth; parent_conv_id; n_convs: members; n_children; n_leaves and saved_tokens of the subtree;
    ends_sha256 of the ids of sequences that end there; last_key: key of the last turn, by which its text can be joined.
    """
    spark = seqs.sparkSession
    sorted_rows = seqs.select("id", "keys", "words").repartitionByRange("keys", "id").sortWithinPartitions("keys", "id")
    blocks = materialise(sorted_rows.mapInArrow(_block, _BLOCK), "trie")
    borders = _Borders(blocks)
    pieces = blocks.where("kind = 1").mapInPandas(borders.joined, "block int, side int, depth int, to_block int, to_side int, id long, parent_side int, "
        "n long, children long, leaves long, words long, shared long, last_key binary, starts int")  # fmt: skip
    pieces = materialise(pieces, "trie-pieces")
    whole = pieces.groupBy("to_block", "to_side", "depth").agg(
        F.min("id").alias("conv_id"), F.sum("n").alias("n"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
        F.sum("words").alias("words"), F.min("shared").alias("shared"), F.min("last_key").alias("last_key"), F.max(F.when(F.col("starts") == 1, F.col("parent_side"))).alias("parent_side"),
    )
    whole = materialise(whole, "trie-whole")
    at = ["to_block", "to_side", "depth"]
    # the least member of the node that a piece belongs to, for those who name the piece as their parent
    named = pieces.select("block", "side", *at).join(whole.select(*at, F.col("conv_id").alias("parent_conv_id")), at)
    parents = named.select("block", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), "parent_conv_id")
    to = [F.col("to_block").alias("block"), F.col("to_side").alias("side")]
    digests = blocks.where("kind = 2").select("block", "side", "depth", "piece", F.col("ends").alias("text")).join(pieces.select("block", "side", *at), ["block", "side", "depth"])
    digests = digests.repartition(*at).sortWithinPartitions(*at, "block", "piece").select(*at, "text").mapInArrow(_digests, "block int, side int, depth int, ends string")
    joint = whole.withColumns({"block": F.col("to_block"), "side": F.col("to_side")}).join(digests, ["block", "side", "depth"], "left")
    joint = joint.join(parents, ["block", "parent_side", "depth"], "left").select(*_node(F.coalesce("ends", F.lit(EMPTY)), F.col("parent_conv_id")))
    nodes = blocks.where("kind = 0")
    inner = nodes.where("parent_id is not null").withColumn("conv_id", F.col("id"))
    edge = nodes.where("parent_id is null").withColumn("conv_id", F.col("id")).join(parents, ["block", "parent_side", "depth"])
    return inner.select(*_node(F.col("ends"), F.col("parent_id"))).unionByName(edge.select(*_node(F.col("ends"), F.col("parent_conv_id")))).unionByName(joint)


def _node(ends, parent) -> list:
    saved = F.col("words") - (F.col("n") - 1) * F.col("shared")
    return [
        F.col("conv_id"), F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), ends.alias("ends_sha256"), F.col("last_key"),
    ]


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the places of the nearest lesser one before it (-1) and after it (len)."""
    n = len(values)
    before, after, open_ = np.full(n, -1), np.full(n, n), []
    for i, v in enumerate(values.tolist()):
        while open_ and open_[-1][0] > v:
            after[open_.pop()[1]] = i
        # of equal values the one before has the same nearest lesser one
        before[i] = (before[open_[-1][1]] if open_[-1][0] == v else open_[-1][1]) if open_ else -1
        open_.append((v, i))
    return before, after


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a:b] for each pair, by a table of minima over powers of two."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half, last = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(last[:-half], last[half:]))
    level = np.frexp(b - a)[1] - 1
    out = np.empty(len(a), values.dtype)
    for k in range(len(table)):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][a[at]], table[k][b[at] - (1 << k)])
    return out


def _lcp(keys: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Turns that each row shares with the row before; 0 for the first."""
    out = np.zeros(len(n), np.int64)
    rows, depth = np.arange(1, len(n)), 0
    while len(rows):
        rows = rows[(n[rows] > depth) & (n[rows - 1] > depth)]
        a, b = first[rows] + depth, first[rows - 1] + depth
        rows = rows[(keys[a] == keys[b]).all(axis=1)]
        out[rows] += 1
        depth += 1
    return out


def _ragged(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and their numbers."""
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie of a range of sorted rows."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    ids = table["id"].to_numpy()
    words, n = _ragged(table["words"].chunk(0))
    first = np.cumsum(n) - n
    packed = table["keys"].chunk(0)
    data, offsets = packed.buffers()[2], np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    yield from _BlockTrie(TaskContext.get().partitionId(), ids, raw.reshape(-1, KEY), words.astype(np.int64), first, n).rows()


class _BlockTrie:
    def __init__(self, block: int, ids: np.ndarray, keys: np.ndarray, words: np.ndarray, first: np.ndarray, n: np.ndarray):
        self.block, self.ids, self.keys, self.first, self.n, self.words = block, ids, keys, first, n, words
        rows = len(ids)
        lcp = _lcp(keys.view(np.uint64).reshape(-1, 2), first, n)
        total = np.concatenate([[0], np.cumsum(words)])
        self.inner = int(lcp[1:].min()) if rows > 1 else 1 << 30
        bounded = np.concatenate([[-1], lcp[1:], [-1]])  # LCP of the rows of this block alone
        before, after = nearest_smaller(bounded[1:-1])
        # intervals: those of the inner LCPs, equal ones as one, and each row by itself; rows a to b - 1, depths low to high
        left, right = before + 1, after + 1
        _, lead, number = np.unique(left * (rows + 1) + right, return_index=True, return_inverse=True)
        alone = np.maximum(bounded[:-1], bounded[1:])
        one = np.flatnonzero(n > alone)
        a, b = np.concatenate([left[lead], one]), np.concatenate([right[lead], one + 1])
        low = np.concatenate([np.maximum(bounded[a[: len(lead)]], bounded[b[: len(lead)]]), alone[one]]) + 1
        high = np.concatenate([lcp[1:][lead], n[one]])
        # children at the lowest depth: rows that leave the row before just there, and the first row if it goes on
        child = np.bincount(number[n[1:] > lcp[1:]], minlength=len(a)) + (n[a] > high)
        # expand depths
        times = high - low + 1
        of = np.repeat(np.arange(len(a)), times)
        depth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + low[of]
        order = np.lexsort((depth, a[of]))
        of, depth = of[order], depth[order]
        self.a, self.b, self.depth = a[of], b[of], depth
        self.children = np.where(depth == high[of], child[of], 1)
        shared_before = np.concatenate([[0], np.cumsum(total[first + lcp] - total[first])])
        leaf = np.concatenate([[0], np.cumsum(np.append(lcp[1:], -1) < n)])
        self.leaves = leaf[self.b] - leaf[self.a]
        self.shared_words = shared_before[self.b] - shared_before[self.a + 1]
        self.above = total[first[self.a] + np.maximum(depth - 1, 0)] - total[first[self.a]]
        self.least = _least(ids, a, b)[of]
        self.parent = self._parents(bounded)

    def _parents(self, bounded: np.ndarray) -> np.ndarray:
        """The place, among the nodes, of each node's parent; -1 for the root."""
        # nodes come by (first row, depth): depths bounded[row] + 1 .. n[row] for each row
        begin = np.concatenate([[0], np.cumsum(np.bincount(self.a, minlength=len(self.n)))])
        out = np.arange(len(self.a)) - 1  # within a row's chain
        heads = begin[:-1][np.diff(begin) > 0]
        # the head of a chain has depth LCP + 1; its parent has depth LCP and begins at the nearest row before with a lesser LCP
        rows = self.a[heads]
        before, _ = nearest_smaller(bounded[:-1])
        start = before[rows]
        out[heads] = np.where(rows > 0, begin[np.maximum(start, 0)] + bounded[rows] - bounded[np.maximum(start, 0)] - 1, -1)
        return out

    def rows(self) -> Iterator[pa.RecordBatch]:
        rows = len(self.ids)
        left, right = self.a == 0, self.b == rows
        edge = left | right
        side = np.where(left, 0, 1)
        parent_edge = (self.parent >= 0) & edge[self.parent]
        parent_id = np.where(self.parent >= 0, self.least[self.parent], 0)
        n_ends = self._ends()
        text = [str(i) for i in self.ids.tolist()]

        def ids_of(k: int) -> str:
            return ",".join(text[self.a[k] : self.a[k] + n_ends[k]])

        digests = [hashlib.sha256(ids_of(k).encode()).hexdigest() if n_ends[k] and not edge[k] else EMPTY for k in range(len(self.a))]
        last = self.keys[np.minimum(self.first[self.a] + np.maximum(self.depth - 1, 0), len(self.keys) - 1)] if len(self.keys) else np.zeros((len(self.a), KEY), np.uint8)
        last = pa.array([k.tobytes() if d else None for k, d in zip(last, self.depth.tolist())], pa.binary())
        m = len(self.a)
        columns = {
            "kind": edge.astype(np.int32), "block": np.full(m, self.block), "side": pa.array(side, mask=~edge), "depth": self.depth, "id": self.least,
            "parent_id": pa.array(parent_id, mask=parent_edge | (self.parent < 0)), "parent_side": pa.array(np.where(left[self.parent], 0, 1), mask=~parent_edge),
            "n": self.b - self.a, "children": self.children, "more": (self.n[self.a] > self.depth).astype(np.int32), "leaves": self.leaves,
            "words": self.shared_words, "shared": self.above, "last_key": last, "ends": pa.array(digests), "at_end": right.astype(np.int32),
        }
        yield _batch(m, columns)
        at = [(k, c) for k in np.flatnonzero(edge & (n_ends > 0)).tolist() for c in range(0, int(n_ends[k]), PIECE)]
        if at:
            k = np.array([x for x, _ in at])
            texts = [",".join(text[self.a[x] + c : self.a[x] + min(c + PIECE, int(n_ends[x]))]) for x, c in at]
            yield _batch(len(at), {"kind": np.full(len(at), 2), "block": np.full(len(at), self.block), "side": side[k], "depth": self.depth[k], "piece": np.array([c // PIECE for _, c in at]), "ends": pa.array(texts)})
        key = [self.keys[self.first[i] : self.first[i] + self.n[i]].tobytes() for i in (0, rows - 1)]
        words = pa.array([self.words[: self.n[0]].tolist()], pa.list_(pa.int32()))
        border = {"kind": np.array([3]), "block": np.array([self.block]), "keys_first": pa.array(key[:1], pa.binary()), "keys_last": pa.array(key[1:], pa.binary())}
        yield _batch(1, border | {"words_first": words, "inner": np.array([self.inner])})

    def _ends(self) -> np.ndarray:
        """Rows of each node's interval that end at its depth; they are its first ones."""
        run = np.concatenate([[True], self._differs()])
        stop = np.append(np.flatnonzero(run)[1:], len(self.n))
        length = np.zeros(len(self.n), np.int64)
        length[np.flatnonzero(run)] = stop - np.flatnonzero(run)
        return np.where(self.n[self.a] == self.depth, length[self.a], 0)

    def _differs(self) -> np.ndarray:
        """Whether each row but the first differs from the row before: it begins a node, as all that is new does."""
        begins = np.bincount(self.a, minlength=len(self.n)) > 0
        return begins[1:]


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _batch(n: int, columns: dict) -> pa.RecordBatch:
    """A batch of the block schema; columns that are not given are null."""
    fields = [f.split(" ") for f in _BLOCK.split(", ")]
    arrays = [pa.nulls(n, _ARROW[kind]) if name not in columns else pa.array(columns[name]).cast(_ARROW[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _keys(name: str):
    """The keys in a binary column, as an array."""
    cut = F.expr(f"transform(sequence(1, cast(length({name}) / {KEY} as int)), i -> substring({name}, (i - 1) * {KEY} + 1, {KEY}))")
    return F.when(F.length(name) > 0, cut).otherwise(F.array().cast("array<binary>"))


class _Borders:
    """How blocks meet: turns shared over each border and words in them, and the minimum of each block's LCPs."""

    def __init__(self, blocks: DataFrame):
        edge = blocks.where("kind = 3")
        info = {r[0]: r for r in edge.select("block", "inner", F.size("words_first"), F.length("keys_last") / KEY).collect()}
        self.blocks = np.array(sorted(info), np.int64)
        m = len(self.blocks)
        self.inner = np.array([info[b][1] for b in self.blocks], np.int64)
        self.n_first = np.array([info[b][2] for b in self.blocks], np.int64)
        self.n_last = np.array([int(info[b][3]) for b in self.blocks], np.int64)
        self.shared, self.words = np.full(m + 1, -1), np.zeros(m + 1, np.int64)  # over the border before each block
        if m > 1:
            following = blocks.sparkSession.createDataFrame(list(zip(self.blocks[:-1].tolist(), self.blocks[1:].tolist())), "block int, next int")
            last = edge.join(following, "block").select(F.col("next").alias("block"), F.posexplode(_keys("keys_last")).alias("d", "k"))
            start = edge.select("block", _keys("keys_first").alias("k"), F.col("words_first").alias("w"))
            start = start.select("block", F.posexplode(F.arrays_zip("k", "w")).alias("d", "x")).select("block", "d", F.col("x.k").alias("k2"), F.col("x.w").alias("w"))
            met = start.join(last, ["block", "d"], "left").select("block", "d", "w", F.coalesce(F.col("k") == F.col("k2"), F.lit(False)).alias("same"))
            stop = met.groupBy("block").agg(F.coalesce(F.min(F.when(~F.col("same"), F.col("d"))), F.max("d") + 1).alias("lcp"))
            words = met.join(stop, "block").where("d < lcp").groupBy("block").agg(F.sum("w").alias("w"))
            place = {int(b): i for i, b in enumerate(self.blocks)}
            self.shared[1:m] = 0
            for block, lcp, w in stop.join(words, "block", "left").select("block", "lcp", F.coalesce("w", F.lit(0))).collect():
                if place[block]:
                    self.shared[place[block]], self.words[place[block]] = lcp, w
        self.least = np.minimum(self.shared[:m], self.inner)
        self.before = nearest_smaller(self.least)[0]

    def joined(self, parts):
        """Pieces with the (block, side) in which their node begins, and counts that hold across the borders."""
        for p in parts:
            if not len(p):
                continue
            place = np.searchsorted(self.blocks, p["block"])
            depth = p["depth"].to_numpy()
            on_left = (p["side"] == 0).to_numpy() & (depth <= self.shared[place])
            # where a node begins: by the blocks' minima, from the block before on to the nearest lesser one
            start, rest = place.copy(), np.flatnonzero(on_left)
            start[rest] -= 1
            while len(rest := rest[self.least[start[rest]] >= depth[rest]]):
                start[rest] = self.before[start[rest]]
            to_side = np.where(on_left, (self.inner[start] < depth).astype(int), p["side"])
            more = p["more"].to_numpy()
            # the first row goes on from the block before: it begins a child only if it leaves the one before there
            children = p["children"] - np.where(on_left & (self.shared[place] != depth), more, 0)
            # the last row is no leaf if the next block's first row goes on from it
            goes_on = (p["at_end"] == 1).to_numpy() & (self.shared[place + 1] >= self.n_last[place])
            yield p[["block", "side", "depth"]].assign(
                to_block=self.blocks[start], to_side=to_side, id=p["id"], parent_side=p["parent_side"], n=p["n"], children=children, leaves=p["leaves"] - goes_on,
                words=p["words"] + np.where(on_left, self.words[place], 0), shared=p["shared"], last_key=p["last_key"], starts=(~on_left).astype(int),
            )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces of ids, which come in order, joined by commas."""
    now, digest, out = None, None, []

    def batch():
        return pa.RecordBatch.from_pydict({"block": pa.array([k[0] for k, _ in out], pa.int32()), "side": pa.array([k[1] for k, _ in out], pa.int32()), "depth": pa.array([k[2] for k, _ in out], pa.int32()), "ends": [d for _, d in out]})

    for b in batches:
        for *key, text in zip(*[c.to_pylist() for c in b.columns]):
            if key != now:
                if now:
                    out.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if now:
        out.append((now, digest.hexdigest()))
    if out:
        yield batch()
