"""Vectorised words, windows and hashes over Arrow string columns, a chunk of rows at a time.

A short span's hash is the sum of its groups of eight bytes, each mixed with a number of its place (no two spans of up
to eight bytes meet); a long one's is XXH3.  Windows of words are sums of word hashes, each times a random odd number for
its place.  All are taken modulo 2**64 and mixed, so repeated letters or words make no two of them meet more often than
chance does.  Equal content gives equal hashes in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_BLOCK = 1 << 20
_SHORT = 32
_rng = np.random.default_rng(20240601)
_PLACES = _rng.integers(0, 1 << 64, _SHORT // 8, dtype=np.uint64)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.zeros(0, np.uint64)

#: ASCII white space [\x20\x09-\x0D], and everything in ASCII but letters and digits
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of buf[starts[i]:ends[i]] for ascending, disjoint spans."""
    out = np.zeros(len(starts), np.uint64)
    length = ends - starts
    buf = _LOWER[buf] if lower else buf
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from every byte on
    rest = np.flatnonzero((length > 0) & (length <= _SHORT))
    for place, salt in enumerate(_PLACES):
        left = length[rest] - 8 * place
        out[rest] += mix((eight[starts[rest] + 8 * place] & _FIRST_BYTES[np.minimum(left, 8)]) + salt)
        rest = rest[left > 8]
    long = np.flatnonzero(length > _SHORT)
    if len(long):
        raw = buf.tobytes()
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long))
    return mix(out + length.astype(np.uint64))


def chunks(column: pa.Array, max_bytes: int = _BLOCK):
    """(first row, last row + 1, bytes, offsets of the rows in them) for runs of rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in buf, and for each row the number of its first word (and their total at the end)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = separator[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _factors(k: int) -> np.ndarray:
    """k random odd numbers, the same in every process."""
    global _FACTORS
    if len(_FACTORS) < k:
        _FACTORS = np.random.default_rng(20240602).integers(0, 1 << 64, max(k, 64), dtype=np.uint64) | np.uint64(1)
    return _FACTORS


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words that start at each word (len(h) - k + 1 of them, or none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = _factors(k)
    out = h[:n] * factors[0]
    for j in range(1, k):
        out += h[j : n + j] * factors[j]
    return mix(out)


def same_row(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """For each window of k words: whether it lies in one row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return row[: n_words - k + 1] == row[k - 1 :] if n_words >= k else np.zeros(0, bool)
