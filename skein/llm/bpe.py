"""Operator 13, byte-level BPE encoding and decoding by a table of ranks, in numpy matrices.

A text is cut into matches of a pattern; each distinct match (piece) is encoded once a cache.  A piece that is a token is
that token.  The others are grouped by length into buckets (up to 4, 8, 16, ... bytes) and become the rows of matrices of
token ids, padded to the bucket's width.  In each round every row merges its leftmost pair of the least rank: ranks of all
adjacent pairs stand in a second matrix, the merged cell takes the new id, the cells behind it move one place to the left
(compaction), and only the two pairs beside it are looked up anew.  Rows without a pair leave the matrix; columns that no
row uses any more go too.

The pair lookup is an open-addressing hash table in numpy of all (left id, right id) whose bytes joined are a token, whichever
merge made it, as ranks are looked up by joined bytes.

A piece longer than LONG bytes is a matrix of one row, in which a round merges every pair of the least rank at once, from
left to right.  That equals merging one by one as long as no pair that stands beside a merged one, at the time or later, has
a lesser rank; else that round merges the leftmost alone.

Encoding and decoding read nothing but their own row, so there is no shuffle, and a lost task costs its own rows.
Nulls and empty texts have no ids; null ids have no bytes.  Letters and numbers are those
of Unicode 16.  Texts of any length go through in slices that end before white
space, where every match ends.  Repeated rows are encoded alike.  An empty table gives an empty table.  All other columns
stay; a column named as the output is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NONE = np.int32(2**31 - 1)
#: cells of a matrix, bytes above which a piece is a row of its own, distinct pieces known at a time, characters of a slice,
#: texts that a task has as Python strings at a time
CELLS = 1 << 18
LONG = 1 << 9
CACHE = 1 << 17
SLICE = 1 << 18
ROWS = 1 << 9

#: Letters and numbers of Unicode versions after 16, which the classes of the library's patterns do not have.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 "
    "16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 "
    "1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
).split()


def read_ranks(data: bytes) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank; a line each), by rank."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, data.splitlines())}
    return [ranks[i] for i in range(len(ranks))]


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one run after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class PairTable:
    """(left id, right id) to the id of both joined, by open addressing with linear probing."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens)}
        keys, values = [], []
        for joined, i in ids.items():
            for cut in range(1, len(joined)):
                left, right = ids.get(joined[:cut]), ids.get(joined[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(i)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(key)
        while len(key):  # of the keys that want one free slot the first gets it, the others go on
            free = self.keys[slot] < 0
            place, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[place >= 0]
            self.keys[slot[first]], self.values[slot[first]] = key[first], value[first]
            on = np.ones(len(key), bool)
            on[first] = False
            key, value, slot = key[on], value[on], (slot[on] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined ids, NONE where there is no such token."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        at = self.keys[slot]
        out = np.where(at == key, self.values[slot], NONE)
        rest = np.flatnonzero((at != key) & (at >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            at = self.keys[slot[rest]]
            hit = at == key[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (at >= 0)]
        return out


class _Numbers(dict):
    """Pieces in the order in which they were first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Decoder:
    """Bytes of ids; tokens are given by rank, and a rank is an id."""

    def __init__(self, tokens: list[bytes]):
        self.n_bytes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.n_bytes) - self.n_bytes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[_runs(self.starts[ids], self.n_bytes[ids])].tobytes()


class Encoder:
    """Ids of texts, for a vocabulary that has every single byte."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.tokens, self.ids = tokens, {t: i for i, t in enumerate(tokens)}
        newer = "[" + "".join("-".join(f"\\U{int(x, 16):08x}" for x in span.split("-")) for span in NEWER) + "]"
        exact = pattern
        for kind in (r"\p{L}", r"\p{N}"):
            exact = exact.replace(kind, f"[{kind}--{newer}]")
        self.newer, self.find_exact = regex.compile(newer).search, regex.compile("(?V1)" + exact).findall
        self.find = regex.compile(pattern).findall
        self.cut = regex.compile(r"(?<=\S)\s")
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(tokens)
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.known = 0
        self.pool, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _pieces(self, text: str) -> list[str]:
        # the newer ones begin at U+0558, in UTF-8 with 0xD5
        wide = not text.isascii() and np.frombuffer(text.encode(), np.uint8).max() >= 0xD5
        return self.find_exact(text) if wide and self.newer(text) else self.find(text)

    def _slices(self, text: str) -> Iterator[str]:
        a = 0
        while len(text) - a > SLICE:
            m = self.cut.search(text, a + SLICE)
            if not m:
                break
            yield text[a : m.start()]
            a = m.start()
        yield text[a:] if a else text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        parts, lengths = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        of, waiting, size = [], [], 0
        for i, text in enumerate(texts):
            for part in self._slices(text or ""):
                of.append(i)
                waiting.append(np.fromiter(map(self.numbers.__getitem__, self._pieces(part)), np.int64))
                size += len(part)
                if size > SLICE:
                    parts.append(self._ids(of, waiting, lengths))
                    of, waiting, size = [], [], 0
        if of:
            parts.append(self._ids(of, waiting, lengths))
        return np.concatenate(parts), lengths

    def _ids(self, of: list[int], waiting: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """The ids of the slices that wait, whose pieces are known by number; adds to the lengths of their texts."""
        if len(self.numbers) > self.known:
            self._learn()
        pieces = np.concatenate(waiting)
        starts = self.offsets[pieces]
        n = self.offsets[pieces + 1] - starts
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum([len(w) for w in waiting])
        np.add.at(lengths, of, total[ends] - total[ends - [len(w) for w in waiting]])
        ids = self.pool[_runs(starts, n)]
        if len(self.numbers) > CACHE:
            self._clear()
        return ids

    def _learn(self) -> None:
        new = [p.encode() for p in islice(self.numbers, self.known, None)]
        self.known = len(self.numbers)
        ids, lengths = self.encode_pieces(new)
        self.pool = np.concatenate([self.pool, ids])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each has."""
        whole = np.array([self.ids.get(p, -1) for p in pieces], np.int64)
        n = np.array([len(p) for p in pieces], np.int64)
        raw = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        first = np.cumsum(n) - n
        lengths = np.where(n > 0, 1, 0)
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero((whole >= 0) & (n > 0)), whole[(whole >= 0) & (n > 0)].astype(np.int32))]
        low = 1
        while low < LONG:
            high = max(4, 2 * low)
            rows = np.flatnonzero((whole < 0) & (n > low) & (n <= high))
            for a in range(0, len(rows), max(1, CELLS // high)):
                part = rows[a : a + max(1, CELLS // high)]
                ids, lengths[part] = self._merge_rows(raw, first[part], n[part])
                done.append((part, ids))
            low = high
        for i in np.flatnonzero((whole < 0) & (n > low)):
            ids = self._merge_long(raw[first[i] : first[i] + n[i]])
            lengths[i] = len(ids)
            done.append((np.array([i]), ids))
        out = np.zeros(lengths.sum(), np.int32)
        begin = np.cumsum(lengths) - lengths
        for rows, ids in done:
            out[_runs(begin[rows], lengths[rows])] = ids
        return out, lengths

    def _merge_rows(self, raw: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A bucket: rows of n ids of raw each, merged; their ids one after another, and their numbers."""
        width = int(n.max())
        cells = np.zeros((len(n), width), np.int32)
        inside = np.arange(width) < n[:, None]
        cells[inside] = raw[_runs(first, n)]
        ranks = np.full((len(n), width), NONE, np.int32)  # of the pair that begins in the cell
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self.pairs.find(cells[:, :-1][pair], cells[:, 1:][pair])
        out, left, row = cells.copy(), n.copy(), np.arange(len(n))
        while len(row):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            best = ranks[np.arange(len(row)), at]
            end = best == NONE
            if end.any():
                out[row[end], : cells.shape[1]] = cells[end]
                go = ~end
                row, at, best, cells, ranks = row[go], at[go], best[go], cells[go], ranks[go]
                if not len(row):
                    break
            left[row] -= 1
            width = int(left[row].max())  # at least one less than before
            col, here = np.arange(width), np.arange(len(row))
            before = col <= at[:, None]
            cells = np.where(before, cells[:, :width], cells[:, 1 : width + 1])
            ranks = np.where(before, ranks[:, :width], ranks[:, 1 : width + 1])
            cells[here, at] = best
            ranks[here, at] = NONE
            for place, ok in ((at, at + 1 < left[row]), (at - 1, at > 0)):
                r, c = here[ok], place[ok]
                ranks[r, c] = self.pairs.find(cells[r, c], cells[r, c + 1])
        return out[np.arange(out.shape[1]) < left[:, None]], left

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        ranks = np.append(self.pairs.find(ids[:-1], ids[1:]), NONE)
        while (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            # of pairs that overlap, every second one of a run counts, from its left end
            order = np.arange(len(at))
            begins = np.concatenate([[True], np.diff(at) > 1])
            at = at[(order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0]
            merged, place = self._merge_at(ids, at, best)
            if len(at) > 1:
                inner, right = place[place > 0], at[at + 2 < len(ids)]
                on_left = self.pairs.find(merged[inner - 1], merged[inner])
                on_right = self.pairs.find(np.full(len(right), best, np.int32), ids[right + 2])  # what stood there at the time
                if (on_left < best).any() or (on_right < best).any():
                    at = at[:1]
                    merged, place = self._merge_at(ids, at, best)
            ids, ranks = merged, np.delete(ranks, at + 1)
            ranks[place] = NONE
            for p in (place[place + 1 < len(ids)], place[place > 0] - 1):
                ranks[p] = self.pairs.find(ids[p], ids[p + 1])
        return ids

    @staticmethod
    def _merge_at(ids: np.ndarray, at: np.ndarray, best: np.int32) -> tuple[np.ndarray, np.ndarray]:
        merged, place = np.delete(ids, at + 1), at - np.arange(len(at))
        merged[place] = best
        return merged, place


@lru_cache(2)
def _encoder(data: bytes, pattern: str) -> Encoder:
    return Encoder(read_ranks(data), pattern)


@lru_cache(2)
def _decoder(data: bytes) -> Decoder:
    return Decoder(read_ranks(data))


def _with_column(df: DataFrame, name: str, kind: T.DataType, values) -> DataFrame:
    """df with a column that values (an Arrow batch to an Arrow array) makes, in place of one of that name."""
    kept = [i for i, c in enumerate(df.columns) if c != name]
    schema = T.StructType([df.schema.fields[i] for i in kept] + [T.StructField(name, kind)])

    def add(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], values(b)], names=[*[b.schema.names[i] for i in kept], name])

    return df.mapInArrow(add, schema)


def encode(df: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with the ids (int array) of each text by the rank file's content."""
    at = df.columns.index(text_col)

    def values(b):
        column = b.column(at)
        encoder = _encoder(ranks, pattern)
        parts = [encoder.encode(column.slice(i, ROWS).to_pylist()) for i in range(0, len(column), ROWS)]
        ids, lengths = (np.concatenate([np.zeros(0, kind), *[p[k] for p in parts]]) for k, kind in ((0, np.int32), (1, np.int64)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids))

    return _with_column(df, ids_col, T.ArrayType(T.IntegerType()), values)


def decode(df: DataFrame, ranks: bytes, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the bytes (binary) that the ids of each row stand for."""
    at = df.columns.index(ids_col)

    def values(b):
        column, decoder = b.column(at), _decoder(ranks)
        ids = [column[i].values for i in range(len(column))]
        return pa.array([decoder.decode(v.to_numpy()) if v is not None else b"" for v in ids], pa.binary())

    return _with_column(df, bytes_col, T.BinaryType(), values)
