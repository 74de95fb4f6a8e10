"""Operator 2, token-id output: a corpus as shards of range-ANS coded blocks, and back.

Documents are range-partitioned and sorted by id; a task encodes its range into shard files.  A shard holds one
frequency table shared by its blocks, and independent blocks of whole documents of some 2**16 tokens, each with its own
interleaved lanes and CRC-32, in groups with the ids and lengths of their documents.  A directory at its end makes it
readable alone (read_shard).  The manifest has one row for each group, with its checkpoints: byte range and tokens
before it; every group decodes on its own.

Shard file (little-endian): for each group the length of its head (int64), the head (ids, nulls and lengths of documents,
blocks' sizes, words and CRCs), blocks' words (uint32), blocks' lane states (32 uint64 a block); then the table (symbols,
frequencies), the directory (starts and lengths of groups; place of the table), its length (int64) and 'RANS'.  Head, table
and directory are int64 arrays with their lengths, in zlib.
Nulls: a null text is empty; null ids sort first.  Empty texts have the end token alone.  Repeated ids keep all their
rows, ordered by text.  Very long texts are one block each.  Empty tables give empty results.  Other columns are not
written.  `ids` (int array) is returned on demand.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rans
from .blobs import read_blob, write_blob
from .scratch import materialise, scratch_dir, shuffle_partitions
from .words import chunks, span_hashes

BLOCK = 1 << 16
GROUP = 64
SHARD = 1 << 23
MAGIC = b"RANS"
CACHE = 3 << 19
SLOT_BITS = 22

#: classes of bytes: space, other white space, letters, digits, punctuation, and what only the tokenizer can judge
_SPACE, _BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER  # U+00C0 to U+027F
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 13]] = _BLANK
_CLASS[32] = _SPACE
_CLASS[39] = _OTHER  # an apostrophe may begin a contraction
#: white space beyond ASCII in UTF-8: its last bytes, and the bytes that may stand before them
_WIDE_LAST, _WIDE_BEFORE = np.zeros(256, bool), np.zeros(256, bool)
_WIDE_LAST[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_WIDE_BEFORE[[0xC2, 0x9A, 0x80, 0x81]] = True
#: byte-level BPE writes a byte as one character: itself where it prints, else the next one from U+0100 on
_PRINTS = np.array([33 <= x <= 126 or 161 <= x <= 172 or x >= 174 for x in range(256)])
_CHARACTER = np.where(_PRINTS, np.arange(256), 255 + np.cumsum(~_PRINTS)).astype("<u4")

MANIFEST = "pid int, shard int, file string, grp int, n_ids long, before_ids long, start long, length long, table_start long, table_length long"


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after another."""
    end = np.cumsum(lengths)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(starts - end + lengths, lengths)


class PieceEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each distinct piece once while the cache lasts.

    A text is cut where the pre-tokenizer always cuts: between white space, letters, digits and punctuation (one space
    goes with what follows it).  Such a piece is one word of the BPE model and goes to it as such.  Where a text has
    an apostrophe, a special token or a character beyond U+027F, it is cut before single spaces only, and the whole
    tokenizer encodes those pieces.  Other kinds of tokenizer get every text whole.  Pieces are known by 64-bit hashes
    (spans of up to eight bytes never meet); a task knows CACHE of them at a time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        cut, model = said["pre_tokenizer"] or {}, said["model"]
        self.byte_level = (
            cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not said["normalizer"]
            and model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(False).items():
            self.n_bytes[i] = len(token)
        self.special = [str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)  # open addressing: 0 is a free slot
        self.number = np.zeros(1 << SLOT_BITS, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.offsets = np.zeros(1 << 18, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of every piece, -1 for pieces not known."""
        out = np.full(len(h), -1, np.int32)
        at, slot = np.arange(len(h)), (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(at):
            key = self.keys[slot]
            hit = key == h[at]
            out[at[hit]] = self.number[slot[hit]]
            on = ~hit & (key != 0)
            at, slot = at[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def _add(self, h: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Pieces by their distinct hashes, and their ids one after another."""
        n = self.n + len(h)
        ends = self.offsets[self.n] + np.cumsum(lengths)
        while n + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        while ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.offsets[self.n] : ends[-1]] = ids
        self.offsets[self.n + 1 : n + 1] = ends
        at, slot = np.arange(len(h)), (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(at):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[at[free]]
            won = self.keys[slot] == h[at]
            self.number[slot[won]] = self.n + at[won]
            at, slot = at[~won], (slot[~won] + 1) & ((1 << SLOT_BITS) - 1)
        self.n = n

    def _model_ids(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of pieces that are one word of the model."""
        # the words as the model writes them, with spaces between, some 2**16 to a text
        texts = []
        for i in range(0, len(starts), 1 << 16):
            length = lengths[i : i + (1 << 16)]
            chars = np.full(int(length.sum()) + len(length), 32, "<u4")
            chars[_ranges(np.cumsum(length + 1) - length - 1, length)] = _CHARACTER[buf[_ranges(starts[i : i + (1 << 16)], length)]]
            texts.append(chars.tobytes().decode("utf-32-le"))
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.words.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum(self.n_bytes[ids])
        if ends[-1] != lengths.sum():
            raise ValueError("the model's vocabulary lacks a byte")
        return ids, np.diff(np.append(0, np.searchsorted(ends, np.cumsum(lengths)) + 1))

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, whole: np.ndarray) -> None:
        """whole: pieces for the whole tokenizer, the others are one word of the model."""
        one = np.flatnonzero(~whole)
        if len(one):
            self._add(h[one], *self._model_ids(buf, starts[one], ends[one] - starts[one]))
        whole = np.flatnonzero(whole)
        if len(whole):
            texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[whole].tolist(), ends[whole].tolist())]
            ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._add(h[whole], np.concatenate(ids), np.array([len(x) for x in ids]))

    def _cuts(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts of pieces, whether a piece is for the whole tokenizer)."""
        n, begins = len(buf), offsets[:-1][np.diff(offsets) > 0]
        if not self.byte_level:
            return begins, np.ones(len(begins), bool)
        kind = _CLASS[buf]
        kind[:-1][(buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))] = _OTHER  # the signs of multiplication and division
        raw = buf.tobytes() if self.special else b""
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                kind[at : at + len(token)] = _OTHER
                at = raw.find(token, at + 1)
        prev = np.empty(n, np.uint8)
        prev[0], prev[1:] = _SPACE, kind[:-1]
        blank = kind <= _BLANK
        solid_next = np.zeros(n, bool)
        solid_next[:-1] = ~blank[1:]
        solid_next[begins[1:] - 1] = False
        cut = np.where(blank, (prev > _BLANK) | solid_next, (kind != prev) & (prev != _SPACE))
        cut[begins] = True
        other = kind == _OTHER
        if not other.any():
            starts = np.flatnonzero(cut)
            return starts, np.zeros(len(starts), bool)
        last, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        last[1:], before[2:] = buf[:-1], buf[:-2]
        coarse = (kind == _SPACE) & (prev > _BLANK) & (last > 32) & (last != 127) & ~(_WIDE_LAST[last] & _WIDE_BEFORE[before])
        coarse[begins] = True
        at = np.flatnonzero(coarse)
        odd = np.logical_or.reduceat(other, at)
        inside = np.repeat(odd, np.diff(np.append(at, n)))
        starts = np.flatnonzero(np.where(inside, coarse, cut))
        return starts, inside[starts]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row)."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts, whole = self._cuts(buf, offsets)
        ends = np.append(starts[1:], n)
        h = np.maximum(span_hashes(buf, starts, ends), np.uint64(1))
        at = self._find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            unique, first = np.unique(h[new], return_index=True)
            if self.n + len(unique) > CACHE:
                self.clear()
                unique, new = np.unique(h, return_index=True)
                first = np.arange(len(new))
            first = new[first]
            for i in range(0, len(first), CACHE):  # more than CACHE in one text of its own: the table grows fuller
                part = slice(i, i + CACHE)
                self._learn(buf, starts[first[part]], ends[first[part]], unique[part], whole[first[part]])
            at = self._find(h)
        begin = self.offsets[at]
        length = self.offsets[at + 1] - begin
        ids = self.pool[_ranges(begin, length)]
        per_row = np.append(0, np.cumsum(length))[np.searchsorted(starts, offsets)]
        return ids, np.diff(per_row)


_encoders: dict[str, PieceEncoder] = {}


def _packed(*arrays) -> bytes:
    """Arrays with their lengths, in zlib."""
    return zlib.compress(b"".join(struct.pack("<q", len(a)) + a.astype("<i8").tobytes() for a in arrays), 1)


def _unpacked(data: bytes) -> list[np.ndarray]:
    data, at, out = zlib.decompress(data), 0, []
    while at < len(data):
        (n,) = struct.unpack_from("<q", data, at)
        out.append(np.frombuffer(data, "<i8", n, at + 8))
        at += 8 + 8 * n
    return out


def _shard_rows(folder, pid, shard, doc_ids, nulls, lengths, ids):
    """Write one shard and return its manifest rows."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[symbols] = np.arange(len(symbols))
    ranks, freq = rank_of[ids], rans.quantise(counts[symbols])
    ends = np.cumsum(lengths)
    # a block ends with the first document that passes another BLOCK of tokens
    last = np.flatnonzero(np.diff(np.append((ends - lengths) // BLOCK, -1)))
    doc_bounds = np.append(0, last + 1)
    bounds = np.append(0, ends[last])
    body, rows, at = [], [], 0
    for g in range(0, len(last), GROUP):
        h = min(g + GROUP, len(last))
        # blocks of a group are coded together
        coded = rans.encode(ranks[bounds[g] : bounds[h]], freq, bounds[g : h + 1] - bounds[g])
        d, e = doc_bounds[g], doc_bounds[h]
        crcs = np.array([zlib.crc32(ids[bounds[i] : bounds[i + 1]].astype("<u4").tobytes()) for i in range(g, h)])
        words = np.array([len(w) for _, w in coded])
        head = _packed(doc_ids[d:e], nulls[d:e], lengths[d:e], np.diff(bounds[g : h + 1]), words, crcs)
        group = b"".join([struct.pack("<q", len(head)), head, *[w.astype("<u4").tobytes() for _, w in coded], *[x.astype("<u8").tobytes() for x, _ in coded]])
        rows.append((g // GROUP, int(bounds[h] - bounds[g]), int(bounds[g]), at, len(group)))
        body.append(group)
        at += len(group)
    table = _packed(symbols, freq)
    directory = _packed(np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), np.array([at, len(table)]))
    uri = write_blob(folder, b"".join([*body, table, directory, struct.pack("<q", len(directory)), MAGIC]), ".rans")
    return [(pid, shard, uri, *r, at, len(table)) for r in rows]


def _decoded(data: bytes, symbols: np.ndarray, freq: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, whether each is null, lengths, token ids) of a group; raises where a block's CRC differs."""
    (n,) = struct.unpack_from("<q", data)
    doc_ids, nulls, lengths, sizes, counts, crcs = _unpacked(data[8 : 8 + n])
    words = np.frombuffer(data, "<u4", int(counts.sum()), 8 + n)
    states = np.frombuffer(data, np.uint8, offset=8 + n + 4 * len(words)).copy().view("<u8").reshape(-1, rans.LANES)
    at = np.cumsum(counts) - counts
    blocks = rans.decode([(states[b], words[at[b] : at[b] + counts[b]], int(sizes[b])) for b in range(len(sizes))], freq)
    blocks = [symbols[b].astype("<u4") for b in blocks]
    if [zlib.crc32(b.tobytes()) for b in blocks] != crcs.tolist():
        raise OSError(f"checksum differs in {name}")
    return doc_ids, nulls.astype(bool), lengths, np.concatenate(blocks)


def read_shard(data: bytes):
    """(document id, token ids) of every document in a shard's bytes, from nothing else."""
    if data[-4:] != MAGIC:
        raise OSError("not a shard, or not all of it")
    (n,) = struct.unpack_from("<q", data, len(data) - 12)
    starts, lengths, (table, size) = _unpacked(data[-12 - n : -12])
    symbols, freq = _unpacked(data[table : table + size])
    for a, k in zip(starts.tolist(), lengths.tolist()):
        doc_ids, nulls, n_ids, ids = _decoded(data[a : a + k], symbols, freq, "shard")
        for doc, null, e, m in zip(doc_ids.tolist(), nulls.tolist(), np.cumsum(n_ids).tolist(), n_ids.tolist()):
            yield None if null else doc, ids[e - m : e]


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write docs as shards in folder (a URI that all executors share); the result is the manifest, to be written."""
    n = shuffle_partitions(docs.sparkSession)
    schema = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[kind]) for name, kind in map(str.split, MANIFEST.split(", "))])

    def encode(batches):
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = PieceEncoder(tokenizer_path)
        coder = _encoders[tokenizer_path]
        pid, shard, held, n_held = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            doc_ids, nulls, lengths, ids = (np.concatenate(x) for x in zip(*held))
            rows = _shard_rows(folder, pid, shard, doc_ids, nulls, lengths, ids)
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            key = batch.column(0)
            doc_ids = key.fill_null(0).to_numpy(zero_copy_only=False)
            nulls = key.is_null().to_numpy(zero_copy_only=False)
            for i, j, buf, offsets in chunks(batch.column(1), 1 << 22):
                ids, lengths = coder.encode(buf, offsets)
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                held.append((doc_ids[i:j], nulls[i:j], lengths + 1, ids))
                n_held += len(ids)
                if n_held >= SHARD:
                    yield flush()
                    shard, held, n_held = shard + 1, [], 0
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    return ranged.mapInArrow(encode, MANIFEST)


def read_tokens(manifest: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of the documents in the files of a written manifest.

    start counts the ids of all documents before; it comes from one row a shard.  Raises where a block's CRC differs.
    """
    n = shuffle_partitions(manifest.sparkSession)
    shards = manifest.groupBy("pid", "shard").agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("pid", "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("_start", F.coalesce(F.sum("_ids").over(before), F.lit(0))).drop("_ids")
    groups = manifest.join(shards, ["pid", "shard"]).withColumn("first_id", F.col("_start") + F.col("before_ids")).drop("_start")
    out_schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def decode(batches):
        tables: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] not in tables:
                    tables = {r["file"]: _unpacked(read_blob(r["file"], r["table_start"], r["table_length"]))}
                data = read_blob(r["file"], r["start"], r["length"])
                doc_ids, nulls, lengths, ids = _decoded(data, *tables[r["file"]], f"{r['file']}, group {r['grp']}")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - k : e]) for e, k in zip(ends.tolist(), lengths.tolist())]
                columns = [pa.array(doc_ids, mask=nulls), pa.array(r["first_id"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                names = [id_col, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return groups.repartition(n).mapInArrow(decode, out_schema)


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Write docs to shards in the shared scratch folder and read them back."""
    folder = scratch_dir(docs.sparkSession, "tokens")
    manifest = materialise(write_tokens(docs, folder, tokenizer_path, end_id, id_col, text_col), "token-manifest")
    return read_tokens(manifest, id_col, with_ids)
