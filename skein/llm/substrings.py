"""Operator 9, substring dedup: seed on winnowed anchors, extend both ways, keep maximal repeats over the threshold.

Seeds: the k-grams of words that are the smallest hash of some run of w k-grams, k + w - 1 = min_words.  Every window
of min_words words holds such an anchor, and equal windows hold equal anchors, so every repeat of min_words words
shares a seed.  Only seeds that occur twice go on.  Extension: around them, the windows of min_words words that hold
the seed meet by hash, all occurrences at once instead of pair by pair, and lose to the earliest of their kind.  The
union of the windows that lose is the maximal repeats, returned as word spans.

Each batch of some thousand texts folds what it holds of one seed or window first: of repeats inside it only the earliest
goes to the shuffle, so a passage in a third of all documents sends a row a batch.
Nulls: a null text is empty; ids that are null or repeat are handled by keys.with_uid (rows equal in id and text are
one document).  Ties: of windows at one place in rows that count as one document, all stay or go.  Texts under min_words words lose nothing.  Empty tables give empty results.  Other columns are not
returned.  Hashes are 64 bits.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import with_uid
from .scratch import shuffle_partitions
from .words import chunks, mix, same_row, span_hashes, spans, windows


def anchors(h: np.ndarray, first: np.ndarray, k: int, w: int) -> np.ndarray:
    """Ascending positions of the winnowed k-grams; first: each row's first word, and their number at the end."""
    grams = windows(h, k)
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # smallest of w consecutive grams by doubling
    low, span = grams, 1
    while span * 2 <= w:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[w - span : w - span + n])
    low = np.where(same_row(first, len(h), k + w - 1), low, np.uint64(0))  # 0: crosses a row's end
    # a gram is chosen if it equals the smallest of one of the w runs that hold it; those are never above it
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    high, span = padded, 1
    while span * 2 <= w:
        high = np.maximum(high[: len(high) - span], high[span:])
        span *= 2
    high = np.maximum(high[: len(grams)], high[w - span : w - span + len(grams)])
    return np.flatnonzero(grams == high)


def _unique_keys(uid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys under which rows that need no counterpart pass through the shuffle one by one."""
    return mix(mix(uid.astype(np.uint64) + np.uint64(0x51ED2701)) + at.astype(np.uint64))


def _batch(names, *columns):
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def repeated_spans(rows: DataFrame, min_words: int) -> DataFrame:
    """(uid, spans): starts and lengths of the windows that occur earlier, from (uid, id, text) hash-partitioned by uid.

    All readers of rows take the same columns, so the texts are shuffled once and the exchange is reused.
    """
    k = min_words // 2
    w = min_words - k + 1

    def seeds(batches):
        for batch in batches:
            uid = batch.column(0).to_numpy()
            got = []
            for i, j, buf, offsets in chunks(batch.column(2)):
                starts, ends, first = spans(buf, offsets)
                h = span_hashes(buf, starts, ends)
                at = anchors(h, first, k, w)
                row = np.searchsorted(first, at, "right") - 1
                got.append((windows(h, k)[at], uid[i:j][row], at - first[row]))
            if not got:
                continue
            h, u, at = (np.concatenate(x) for x in zip(*got))
            keys, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            many = count[inverse] > 1
            h = np.where(many, _unique_keys(u, at), h)
            told = keys[count > 1]
            # one number for the place, from 1, and whether the task has the seed once or more; 0 for a row that only tells so
            yield _batch(
                ["key", "uid", "place"],
                np.concatenate([h, told]).view(np.int64),
                np.concatenate([u, np.zeros(len(told), np.int64)]),
                np.concatenate([(at + 1) * 4 + np.where(many, 2, 1), np.full(len(told), 2)]),
            )

    def contest(batches):
        for batch in batches:
            uid, seeds_at = batch.column(0).to_numpy(), batch.column(3)
            got = []
            for i, j, buf, offsets in chunks(batch.column(2)):
                starts, ends, first = spans(buf, offsets)
                h = span_hashes(buf, starts, ends)
                part = seeds_at.slice(i, j - i)
                n_seeds = np.diff(np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1])
                at = part.flatten().to_numpy().astype(np.int64) + np.repeat(first[:-1], n_seeds)
                # windows that hold a seed start up to min_words - k words before it
                near = np.zeros(len(h) + 1, np.int64)
                np.add.at(near, np.maximum(at - (min_words - k), 0), 1)
                np.add.at(near, at + 1, -1)
                good = (np.cumsum(near)[:-1] > 0)[: max(0, len(h) - min_words + 1)] & same_row(first, len(h), min_words)
                start = np.flatnonzero(good)
                row = np.searchsorted(first, start, "right") - 1
                got.append((windows(h, min_words)[start], uid[i:j][row], start - first[row]))
            if not got:
                continue
            h, u, at = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((at, u, h))
            h, u, at = h[order], u[order], at[order]
            later = np.append(False, h[1:] == h[:-1])
            # what is later than its like inside the task is settled; runs of it go on as one row
            lu, la = u[later], at[later]
            order = np.lexsort((la, lu))
            lu, la = lu[order], la[order]
            head = np.flatnonzero(np.append(True, (lu[1:] != lu[:-1]) | (la[1:] != la[:-1] + 1))) if len(lu) else np.zeros(0, np.int64)
            length = np.diff(np.append(head, len(lu)))
            # by document again: neighbours with like ids compress in the shuffle
            fh, fu, fa = h[~later], u[~later], at[~later]
            order = np.lexsort((fa, fu))
            fh, fu, fa = fh[order], fu[order], fa[order]
            # one number for the place and, of windows that are settled, how many follow each other from there
            yield _batch(
                ["key", "uid", "place"],
                np.concatenate([fh, _unique_keys(lu[head], la[head])]).view(np.int64),
                np.concatenate([fu, lu[head]]),
                np.concatenate([fa, la[head] + (length << 32)]),
            )

    texts = rows.select("uid", "id", "text")
    found = texts.mapInArrow(seeds, "key long, uid long, place long")
    found = found.withColumn("total", F.sum(F.col("place").bitwiseAND(3)).over(Window.partitionBy("key"))).where("total > 1 and place >= 4")
    found = found.groupBy("uid").agg(F.collect_list((F.shiftright("place", 2) - 1).cast("int")).alias("at"))
    joined = texts.join(found.hint("shuffle_hash"), "uid").select("uid", "id", "text", "at")
    met = joined.mapInArrow(contest, "key long, uid long, place long")
    earliest = F.min(F.struct("uid", "place")).over(Window.partitionBy("key"))
    settled = F.shiftright("place", 32)
    lost = met.withColumn("e", earliest).where((settled > 0) | (F.col("e.uid") != F.col("uid")) | (F.col("e.place") != F.col("place")))
    span = F.struct(F.col("place").bitwiseAND(0x7FFFFFFF).cast("int").alias("at"), F.greatest(settled, F.lit(1)).cast("int").alias("n"))
    return lost.groupBy("uid").agg(F.collect_list(span).alias("spans"))


def substring_dedup(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text, spans) of each document.

    A word goes if a window of min_words words over it starts earlier too, in a smaller id or before it in the same
    text.  kept_text: the other words joined by one space; spans: the maximal removed [start, end) in words.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    # no uid is null; said here, it is not inferred for one join alone, which would part the shared exchange
    rows = with_uid(docs, id_col, text_col).where("uid is not null").repartition(shuffle_partitions(docs.sparkSession), "uid")
    lost = repeated_spans(rows, min_words)

    def keep(batches):
        for batch in batches:
            ids, texts, found = batch.column(1), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3)
            n_words, n_removed, kept, removed = [], [], [], []
            for text, runs in zip(texts, found):
                words = text.split()
                n = len(words)
                edge = np.zeros(n + 1, np.int32)
                if runs.is_valid:
                    at, length = runs.values.field(0).to_numpy(), runs.values.field(1).to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length + min_words - 1, -1)
                gone = np.cumsum(edge)[:n] > 0
                flips = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
                if len(flips):
                    words = compress(words, (~gone).tolist())
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(words))
                removed.append([{"start": int(a), "end": int(b)} for a, b in flips])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield _batch(
                [id_col, "n_words", "n_removed", "kept_text", "spans"],
                ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, kind),
            )

    return (
        rows.join(lost.hint("shuffle_hash"), "uid", "left")
        .select("uid", "id", "text", "spans")
        .mapInArrow(keep, f"{id_col} long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>")
    )
