"""Operator 7, line dedup with two Bloom filters: hashes seen once and hashes seen twice.

A first pass over the lines sets each task's bits for keys seen in a document and keys seen in two; the filters merge
by segments (a bit that two tasks set counts as seen twice).  A second pass sends only suspected repeats, lines whose
bits are all in the twice-seen filter, folded to one row a key and task, to the shuffle, where their exact keys are
counted and their first documents chosen.  The filter has a fixed size: 2**filter_bits bits, at most 32 MB sent to the
driver and to each task by default; over more lines it lets more suspects through and stays exact.
Keys that are confirmed are sent to all tasks only while they fit max_broadcast_bytes; beyond that the
suspected lines meet them in a shuffle join.
Nulls: a null text is one empty line, as an empty one.  Each row is a document, repeated rows and null ids included (with
keep_first, rows equal in id and text count as one).  Ties: of one key's lines in the first document the first stays.  Very
long lines are keys as any other.  Empty tables give empty results.  Other columns are not returned, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import with_uid
from .scratch import materialise, shuffle_partitions
from .words import SPACE, chunks, mix, span_hashes

SEGMENTS = 256
BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def line_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of the key of every line that has one, a line without white space around it, lower case."""
    solid = np.flatnonzero(~SPACE[buf])
    feeds = np.flatnonzero(buf == 10)
    begin = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    finish = np.sort(np.concatenate([offsets[1:], feeds]))
    lo, hi = np.searchsorted(solid, begin), np.searchsorted(solid, finish)
    full = hi > lo
    starts, ends = solid[lo[full]], solid[hi[full] - 1] + 1
    return span_hashes(buf, starts, ends, lower=True), np.searchsorted(offsets, starts, "right") - 1, starts, ends


def _bits(h: np.ndarray, filter_bits: int) -> np.ndarray:
    """Two bit positions of each hash."""
    shift = np.uint64(64 - filter_bits)
    return np.concatenate([h >> shift, mix(h) >> shift])


def _pack(bits: np.ndarray) -> bytes:
    return zlib.compress(np.diff(bits, prepend=0).astype("<u4").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.int64)


def twice_filter(rows: DataFrame, filter_bits: int) -> np.ndarray:
    """The twice-seen filter over the keys of rows.text, as packed bits."""
    width = (1 << filter_bits) // SEGMENTS

    def local(batches):
        once, twice = [], []
        for batch in batches:
            for _, _, buf, offsets in chunks(batch.column(0)):
                h, row, _, _ = line_hashes(buf, offsets)
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
                keys, count = np.unique(h[new], return_counts=True)
                once.append(keys)
                twice.append(keys[count > 1])
        if not once:
            return
        keys, count = np.unique(np.concatenate(once), return_counts=True)
        one = np.unique(_bits(keys, filter_bits))
        two = np.unique(_bits(np.concatenate([keys[count > 1], *twice]), filter_bits))
        edges = np.arange(SEGMENTS + 1, dtype=np.uint64) * np.uint64(width)
        a, b = np.searchsorted(one, edges), np.searchsorted(two, edges)
        yield pa.RecordBatch.from_pydict(
            {
                "segment": pa.array(range(SEGMENTS), pa.int32()),
                "once": [_pack(one[a[s] : a[s + 1]] - edges[s]) for s in range(SEGMENTS)],
                "twice": [_pack(two[b[s] : b[s + 1]] - edges[s]) for s in range(SEGMENTS)],
            }
        )

    def merge(batches):
        segment, seen, repeated = None, None, None

        def out():
            return pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "bits": [zlib.compress(np.packbits(repeated).tobytes(), 1)]})

        for batch in batches:
            for r in batch.to_pylist():
                if r["segment"] != segment:
                    if segment is not None:
                        yield out()
                    segment, seen, repeated = r["segment"], np.zeros(width, bool), np.zeros(width, bool)
                one = _unpack(r["once"])
                repeated[one[seen[one]]] = True
                seen[one] = True
                repeated[_unpack(r["twice"])] = True
        if segment is not None:
            yield out()

    parts = rows.select("text").mapInArrow(local, "segment int, once binary, twice binary")
    merged = parts.repartition(shuffle_partitions(rows.sparkSession), "segment").sortWithinPartitions("segment")
    bits = np.zeros((SEGMENTS, width // 8), np.uint8)
    # SEGMENTS rows, 2**filter_bits bits in all
    for r in merged.mapInArrow(merge, "segment int, bits binary").toLocalIterator():
        bits[r["segment"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return bits.reshape(-1)


def _suspect(h: np.ndarray, bits: np.ndarray, filter_bits: int) -> np.ndarray:
    at = _bits(h, filter_bits).astype(np.int64)
    hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    return (hit[: len(h)] & hit[len(h) :]).astype(bool)


def line_dedup(
    docs: DataFrame,
    min_docs: int = 2,
    min_chars: int = 1,
    keep_first: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    filter_bits: int = 28,
    max_broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """(id, n_lines, n_dropped, kept_text) of each document.

    Keys of at least min_chars code points found in at least min_docs documents lose their lines; with keep_first the
    first line of the key in the smallest id stays.
    """
    spark = docs.sparkSession
    rows = (with_uid(docs, id_col, text_col) if keep_first else docs.select(F.col(id_col).alias("uid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    bits = spark.sparkContext.broadcast(twice_filter(rows, filter_bits))

    def long_enough(key: bytes) -> bool:
        return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)

    def count(batches):
        for batch in batches:
            uid = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False) if keep_first else None
            keys, n, least = [], [], []
            for i, _, buf, offsets in chunks(batch.column(1), 1 << 23):
                h, row, starts, ends = line_hashes(buf, offsets)
                s = np.flatnonzero(_suspect(h, bits.value, filter_bits))
                seen: dict[bytes, set[int]] = {}
                for a, b, r in zip(starts[s].tolist(), ends[s].tolist(), row[s].tolist()):
                    seen.setdefault(line_key(buf[a:b].tobytes()), set()).add(r)
                for key, of in seen.items():
                    if long_enough(key):
                        keys.append(key)
                        n.append(len(of))
                        least.append(min(int(uid[i + r]) for r in of) if keep_first else None)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(least, pa.int64())], names=["key", "n", "uid"])

    counted = rows.select("uid", "text").mapInArrow(count, "key binary, n long, uid long")
    hot = counted.groupBy("key").agg(F.sum("n").alias("n"), F.min("uid").alias("first_uid")).where(F.col("n") >= min_docs)
    hot = materialise(hot.select("key", "first_uid"), "hot-lines")
    size = hot.agg(F.coalesce(F.sum(F.length("key") + 64), F.lit(0))).first()[0]
    schema = f"{id_col} long, n_lines long, n_dropped long, kept_text string"

    def cleaned(ids, texts, drop):
        n_lines, n_dropped, kept = [], [], []
        for i, text in enumerate(texts):
            lines = text.split(b"\n")
            left = drop(i, lines)
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
            kept.append(b"\n".join(left))
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_lines", "n_dropped", "kept_text"])

    if size <= max_broadcast_bytes:
        known = spark.sparkContext.broadcast({bytes(r["key"]): r["first_uid"] for r in hot.toLocalIterator()})

        def clean(batches):
            for batch in batches:
                uid = batch.column(0).to_pylist()

                def drop(i, lines):
                    left, seen = [], set()
                    for line in lines:
                        key = line_key(line)
                        if key not in known.value or (keep_first and known.value[key] == uid[i] and key not in seen and not seen.add(key)):
                            left.append(line)
                    return left

                yield cleaned(batch.column(1), batch.column(2).cast(pa.binary()).to_pylist(), drop)

        return rows.mapInArrow(clean, schema)

    # too many keys to send to all: suspected lines meet them by key, and their numbers go to the documents
    rows = with_uid(docs, id_col, text_col).repartition(shuffle_partitions(spark), "uid")

    def suspects(batches):
        for batch in batches:
            uid = batch.column(0).to_numpy()
            out = []
            for i, _, buf, offsets in chunks(batch.column(1)):
                h, row, starts, ends = line_hashes(buf, offsets)
                feeds = np.flatnonzero(buf == 10)
                number = np.searchsorted(feeds, starts) - np.searchsorted(feeds, offsets[row])
                for s in np.flatnonzero(_suspect(h, bits.value, filter_bits)).tolist():
                    out.append((line_key(buf[starts[s] : ends[s]].tobytes()), int(uid[i + row[s]]), int(number[s])))
            keys, uids, at = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(uids, pa.int64()), pa.array(at, pa.int32())], names=["key", "uid", "at"])

    found = rows.select("uid", "text").mapInArrow(suspects, "key binary, uid long, at int").join(hot, "key")
    if keep_first:
        stays = found.where("uid = first_uid").groupBy("key", "uid").agg(F.min("at").alias("at"))
        found = found.join(stays, ["key", "uid", "at"], "left_anti")
    found = found.groupBy("uid").agg(F.collect_list("at").alias("at"))

    def clean_numbers(batches):
        for batch in batches:
            gone = [set(x or ()) for x in batch.column(2).to_pylist()]
            yield cleaned(batch.column(0), batch.column(1).cast(pa.binary()).to_pylist(), lambda i, lines: [x for k, x in enumerate(lines) if k not in gone[i]])

    return rows.join(found.hint("shuffle_hash"), "uid", "left").select("id", "text", "at").mapInArrow(clean_numbers, schema)
