"""Operator 1, benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

Texts and items are lower-cased words of letters and digits.  A CGK walk reads a window of words and, at every step, writes
the word it stands on and moves on or not as a random bit of the step and the word says; windows at a small edit distance
write sequences at a small Hamming distance.  A repetition has its own walk and samples one coordinate of it; the samples of
the items are the keys of a table (length, piece, repetition, word), in which the samples of a window are looked up.  What
the table finds is a candidate, and nothing else is.  How many repetitions reach the target recall is measured for each
length, with substitutions, insertions and deletions at the bound (`repetitions`): about one for every two words.  Items
over PIECE words are hashed in pieces: some piece has at most its share of the edits.  Items that match only themselves are
looked up by the hash of all their words.  Candidates are verified by the exact edit distance of the item to its best span.

Which windows are walked.  An edit spoils at most three of an item's word triples, so the window of as many words as the item
has, from the start of a span within the bound, still holds a number of triples that some item of that length has; windows
elsewhere cannot match and are left out without loss, whichever item they are near.  Windows may run past the end of a text,
so a text shorter than an item, or one that ends in a passage with deleted words, is searched as well.  Triples and words are
compared by 64-bit hashes.

The items are sent in blocks of at most block_words words, so what is sent stays bounded; every document meets every
block, without any shuffle.
Nulls and empty texts, of documents or items, match nothing; null ids come back as null.  Items with fewer than
min_words words match only themselves, word for word.  Repeated rows are reported each.  Ties: of spans at one distance the
shortest, of those the first.  Very long texts and items are searched whole.  Other columns are not read, whatever their
names.  Empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise
from .words import NOT_ALNUM, chunks, mix, same_row, span_hashes, spans, windows

TRIPLE_BITS = 24
PIECE = 128
TARGET, TRIALS = 0.999, 500
#: words of the windows that are walked together
SLAB = 1 << 19


def bound(n_words: int, percent: int, min_words: int) -> int:
    """The largest edit distance, in words, at which a span matches an item of n_words words (under a third of them)."""
    return min(n_words * percent // 100, (n_words - 3) // 3) if n_words >= max(min_words, 3) else 0


def triples(h: np.ndarray) -> np.ndarray:
    """Short hashes of three words in a row; a false agreement only costs time."""
    return windows(h, 3) >> np.uint64(64 - TRIPLE_BITS)


def walk(words: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The sampled words of repetitions begin to end - 1 of the CGK walks over rows of words; 0 past a row's end."""
    n = words.shape[1]
    padded = np.concatenate([words, np.zeros((len(words), 1), np.uint64)], axis=1)
    name = mix(np.arange(begin, end, dtype=np.uint64) + np.uint64(0xC6B0_0000))
    sample = ((name >> np.uint64(32)) * np.uint64(2 * n) >> np.uint64(32)).astype(np.int64)  # a coordinate of 2n steps
    order = np.argsort(-sample, kind="stable")
    name, sample = name[order], sample[order]
    at, out = np.zeros((len(words), end - begin), np.int64), np.zeros((len(words), end - begin), np.uint64)
    for t in range(int(sample[0]) + 1):
        m = int(np.searchsorted(-sample, -t, "right"))  # walks that are still under way
        word = np.take_along_axis(padded, at[:, :m], axis=1)
        here = sample[:m] == t
        if here.any():
            out[:, order[:m][here]] = word[:, here]
        step = mix(word + mix(name[:m] + np.uint64(t))) & np.uint64(1)
        at[:, :m] = np.minimum(at[:, :m] + step.astype(np.int64), n)
    return out


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b) & (a != 0)


@lru_cache(maxsize=None)
def _measured(n: int, limit: int) -> int:
    """The least repetitions, in eights, that find TARGET of random windows at `limit` edits, of each kind."""
    g = np.random.default_rng(n)
    word = lambda *size: g.integers(1, 1 << 63, size, dtype=np.uint64)
    items, windows_ = word(3 * TRIALS, n), []
    for i, item in enumerate(items):
        places = np.sort(g.choice(n, limit, replace=False))
        if i % 3 == 0:
            new = item.copy()
            new[places] = word(limit)
        elif i % 3 == 1:
            new = np.insert(item, places, word(limit))
        else:
            new = np.concatenate([np.delete(item, places), word(limit)])
        windows_.append(new[:n])
    pending = np.arange(len(items))
    windows_, done = np.array(windows_), 0
    while max(np.bincount(pending % 3, minlength=3)) > (1 - TARGET) * TRIALS:
        found = agree(walk(items[pending], done, done + 8), walk(windows_[pending], done, done + 8)).any(axis=1)
        pending, done = pending[~found], done + 8
    return done


def repetitions(n: int, limit: int) -> int:
    """Repetitions for windows of n words and `limit` edits: those of the next power of two with as large a share of edits."""
    if not limit:
        return 1
    size = 1 << (n - 1).bit_length()
    return _measured(size, min(-(-limit * size // n), size - 1))


def best_span(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edit distance, start, end) of the span of text nearest to item; of these the shortest, then the first."""
    m = len(text) + 1
    scale = np.int64(m + 1)
    column = np.arange(m, dtype=np.int64)
    cells, steps = column.copy(), column * scale  # distance * scale + start
    for a in item:
        row = cells + scale
        row[1:] = np.minimum(row[1:], cells[:-1] + np.where(text == a, 0, scale))
        cells = np.minimum.accumulate(row - steps) + steps
    d, start = cells // scale, cells % scale
    at = np.lexsort((column, column - start, d))[0]
    return int(d[at]), int(start[at]), int(at)


def _pieces(n: int) -> list[tuple[int, int]]:
    """(offset, size) of the pieces of an item of n words."""
    ends = np.linspace(0, n, -(-n // PIECE) + 1).astype(int).tolist()
    return [(a, b - a) for a, b in zip(ends[:-1], ends[1:])]


class _Table:
    """Items of one length by the samples of one piece: (repetition, word) to items."""

    def __init__(self, items: np.ndarray, words: np.ndarray, repeats: int):
        """words: a row an item, of the piece's words; with no repeats items are known by all of them."""
        self.repeats = repeats
        keys = self.keys_of(words)
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.items = keys.ravel()[order], np.repeat(items, keys.shape[1])[order]
        self.keys, self.items = self.keys[self.keys != 0], self.items[self.keys != 0]

    def keys_of(self, words: np.ndarray) -> np.ndarray:
        """A row of keys for each row of words; 0 for samples past a row's end."""
        if not self.repeats:
            return windows(words.ravel(), words.shape[1])[:: words.shape[1]][:, None]
        samples = walk(words, 0, self.repeats)
        return np.where(samples != 0, mix(samples + mix(np.arange(self.repeats, dtype=np.uint64) + np.uint64(0x7AB1E))), np.uint64(0))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item), each pair once, of the rows of words that share a key with an item."""
        keys = self.keys_of(words)
        low, high = np.searchsorted(self.keys, keys.ravel()), np.searchsorted(self.keys, keys.ravel(), "right")
        n = np.where(keys.ravel() != 0, high - low, 0)
        hit = np.flatnonzero(n)
        n, low = n[hit], low[hit]
        item = self.items[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pairs = np.unique(np.stack([np.repeat(hit // keys.shape[1], n), item]), axis=1)
        return pairs[0], pairs[1]


class ItemIndex:
    """A block of items, by length: their triples, and a table for each piece; it is what every task gets."""

    def __init__(self, items: list[tuple], percent: int, min_words: int):
        self.percent, self.min_words = percent, min_words
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        by_length = defaultdict(list)
        for k, w in enumerate(self.words):
            if len(w):
                by_length[len(w)].append(k)
        self.triples = np.zeros(1 << TRIPLE_BITS, bool)
        for w in self.words:
            self.triples[triples(w)] = True
        self.own, self.tables = {}, {}
        for n, ks in sorted(by_length.items()):
            of, limit = np.stack([self.words[k] for k in ks]), bound(n, percent, min_words)
            self.own[n] = np.unique(np.concatenate([windows(self.words[k], 3) for k in ks]))
            pieces = _pieces(n) if limit else [(0, n)]
            repeats = [repetitions(size, limit // len(pieces)) if limit else 0 for _, size in pieces]
            self.tables[n] = [(offset, size, _Table(np.array(ks), of[:, offset : offset + size], r)) for (offset, size), r in zip(pieces, repeats)]

    def stretches(self, n: int, h: np.ndarray, first: np.ndarray, row_of: np.ndarray, all3: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of the stretches of words in which items of n words can match, apart from each other."""
        limit = bound(n, self.percent, self.min_words)
        if n < 3:
            low = np.flatnonzero(same_row(first, len(h), n))
            return row_of[low], low, low + n
        need = max(1, n - 2 - 3 * limit)
        own = self.own[n]
        hit = known[own[np.minimum(np.searchsorted(own, all3[known]), len(own) - 1)] == all3[known]]
        last = need - 1
        if len(hit) < need:
            return (np.zeros(0, np.int64),) * 3
        i = np.flatnonzero((hit[last:] - hit[: len(hit) - last] <= n - 3) & (row_of[hit[last:]] == row_of[hit[: len(hit) - last]]))
        row = row_of[hit[i]]
        low = np.maximum(first[row], hit[i + last] - (n - 3))
        end = np.minimum(hit[i] + n + limit, first[row + 1])
        if not len(i):
            return row, low, end
        new = np.append(True, (row[1:] != row[:-1]) | (low[1:] > np.maximum.accumulate(end)[:-1]))
        begins = np.flatnonzero(new)
        return row[begins], low[begins], np.maximum.reduceat(end, begins)

    def candidates(self, n: int, h: np.ndarray, first: np.ndarray, row: np.ndarray, low: np.ndarray, end: np.ndarray):
        """(row, item, start, end) of the stretches around the windows that a table finds, an item's apart from each other."""
        limit, found = bound(n, self.percent, self.min_words), []
        for offset, size, table in self.tables[n]:
            start = np.maximum(low, low + offset - limit)
            count = np.maximum(np.maximum(low, end - n + offset + limit) + 1 - start, 0)
            at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
            of = np.repeat(row, count)
            for a in range(0, len(at), max(1, SLAB // size)):
                begin, stop = at[a : a + max(1, SLAB // size)], first[of[a : a + max(1, SLAB // size)] + 1]
                place = begin[:, None] + np.arange(size)
                hit, item = table.find(np.where(place < stop[:, None], h[np.minimum(place, len(h) - 1)], np.uint64(0)))
                found.append((of[a + hit], item, begin[hit] - offset))
        if not found:
            return
        rows, items, begin = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((begin, items, rows))
        rows, items, begin = rows[order], items[order], begin[order]
        # a piece stands up to `limit` words from its place in the item, and the span ends up to `limit` words later or earlier
        slack = limit * (2 if len(self.tables[n]) > 1 else 1)
        a, b = np.maximum(first[rows], begin - slack), np.minimum(begin + n + slack, first[rows + 1])
        if len(rows):
            new = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (items[1:] != items[:-1]) | (a[1:] > b[:-1])))
            yield from zip(rows[new].tolist(), items[new].tolist(), a[new].tolist(), np.maximum.reduceat(b, new).tolist())

    def matches(self, h: np.ndarray, first: np.ndarray):
        """(row, item, distance, start, end) of the words h of some rows; first: each row's first word and their number."""
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        all3 = windows(h, 3)
        known = np.flatnonzero(self.triples[all3 >> np.uint64(64 - TRIPLE_BITS)] & same_row(first, len(h), 3)) if len(all3) else np.zeros(0, np.int64)
        found = {}
        for n in self.tables:
            limit = bound(n, self.percent, self.min_words)
            for row, k, a, b in self.candidates(n, h, first, *self.stretches(n, h, first, row_of, all3, known)):
                d, start, end = best_span(self.words[k], h[a:b])
                if d <= limit:
                    best = (d, a + start - int(first[row]), a + end - int(first[row]))
                    if (row, k) not in found or best < found[row, k]:
                        found[row, k] = best
        return [(row, self.ids[k], *best) for (row, k), best in found.items()]


def _words(column: pa.Array):
    """(first row, word hashes, first words of rows) of chunks of lower-cased texts."""
    lower = pa.array([t.lower() for t in column.fill_null("").to_pylist()], pa.large_string())
    for i, _, buf, offsets in chunks(lower, 1 << 22):
        starts, ends, first = spans(buf, offsets, NOT_ALNUM)
        yield i, span_hashes(buf, starts, ends), first


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """Lists of (item id, word hashes) of at most block_words words, a longer item alone."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).orderBy(item_col).toLocalIterator():
        words = np.concatenate([h for _, h, _ in _words(pa.array([r[1]], pa.string()))] or [np.zeros(0, np.uint64)])
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((r[0], words))
        size += len(words)
    if block:
        yield block


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    percent: int = 20,
    min_words: int = 8,
    block_words: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item, distance, start, end): the nearest span of each document and item within percent edits of the words.

    start and end count words of letters and digits in the document.
    """
    spark = docs.sparkSession
    schema = f"{id_col} long, {item_col} long, distance int, start long, end long"
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def task(shared):
        def search(batches):
            for batch in batches:
                out = []
                ids = batch.column(0).to_pylist()
                for i, h, first in _words(batch.column(1)):
                    out += [(ids[i + row], *rest) for row, *rest in shared.value.matches(h, first)]
                columns = list(zip(*out)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[id_col, item_col, "distance", "start", "end"])

        return search

    parts = [
        texts.mapInArrow(task(spark.sparkContext.broadcast(ItemIndex(block, percent, min_words))), schema)
        for block in item_blocks(benchmark, item_col, item_text_col, block_words)
    ]
    if not parts:
        return spark.createDataFrame([], schema)
    if len(parts) == 1:
        return parts[0]
    # one pass a block; written one by one, so plans stay small
    out = materialise(parts[0], "matches")
    for part in parts[1:]:
        out = out.union(materialise(part, "matches"))
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, percent: int = 20, min_words: int = 8, block_words: int = 1 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """docs without the rows whose text matches an item.

    Each row is judged by its own text where it lies, so ids, null or repeated, play no part and nothing is shuffled; more
    blocks of items are more filters in the same pass.  Columns are as they were, whatever their names.
    """
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # one column, whatever the names inside
    schema = rows.schema

    def task(shared):
        def clean(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, h, first in _words(batch.column(0).field(at).cast(pa.string())):
                    keep[[i + row for row, *_ in shared.value.matches(h, first)]] = False
                yield batch.filter(pa.array(keep))

        return clean

    for block in item_blocks(benchmark, item_col, item_text_col, block_words):
        rows = rows.mapInArrow(task(spark.sparkContext.broadcast(ItemIndex(block, percent, min_words))), schema)
    return rows.select("row.*")
