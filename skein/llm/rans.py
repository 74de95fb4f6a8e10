"""Static range asymmetric numeral system over symbol ids: one frequency table, independent blocks, 32 lanes a block.

States are under 2**52, so that they divide exactly as doubles, and are renormalised by 32-bit words; frequencies sum to
2**18.  All blocks of a call run side by side in numpy: a step codes 32 symbols of every block.
"""

from __future__ import annotations

import numpy as np

SCALE = 18
LANES = 32
LOW = 1 << 20
#: a state of at least f << LIMIT gives a word away before a symbol of frequency f
LIMIT = 52 - SCALE


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 each that sum to 2**SCALE, near the counts."""
    room = (1 << SCALE) - len(counts)
    if room < 0:
        raise ValueError("more symbols than 2**18")
    total = int(counts.sum())
    out = 1 + (counts.astype(np.float64) * room / max(total, 1)).astype(np.int64)
    out[int(np.argmax(counts))] += (1 << SCALE) - int(out.sum())
    return out


def _padded(sizes: np.ndarray) -> np.ndarray:
    """Steps of each block: its last step is filled up with the first symbol of all."""
    return -(-sizes // LANES)


def _layout(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each step, over blocks in falling order of steps: how many blocks take part, and where its rows begin."""
    rows = np.searchsorted(-steps, -np.arange(int(steps.max(initial=0))), "left")
    return rows, np.cumsum(rows) - rows


def encode(ranks: np.ndarray, freq: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(final states, words) of each block ranks[bounds[i]:bounds[i+1]]; ranks index freq."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    start, steps = bounds[:-1][order], _padded(n[order])
    most = int(steps.max(initial=0))
    rows, begin = _layout(steps)
    table = np.empty((int(steps.sum()), LANES), ranks.dtype)
    for i, (a, k, t) in enumerate(zip(start.tolist(), n[order].tolist(), steps.tolist())):
        line = np.zeros(t * LANES, ranks.dtype)
        line[:k] = ranks[a : a + k]
        table[begin[:t] + i] = line.reshape(t, LANES)
    # whole numbers under 2**53 are exact as doubles, and doubles divide many at a time
    f64 = freq.astype(np.float64)
    c64 = np.cumsum(f64) - f64
    limit = f64 * float(1 << LIMIT)
    state = np.full(len(n) * LANES, float(LOW))
    out_lane, out_word = [], []
    for t in range(most - 1, -1, -1):
        r = int(rows[t]) * LANES
        s = table[begin[t] : begin[t] + rows[t]].reshape(-1)
        x = state[:r]
        which = np.flatnonzero(x >= limit[s])
        if len(which):
            out = x[which].astype(np.int64)
            out_lane.append(which)
            out_word.append((out & 0xFFFFFFFF).astype(np.uint32))
            x[which] = out >> 32
        f = f64[s]
        q = np.floor(x / f)  # exact: q is under 2**34 and a fraction at least 2**-18
        q *= float(1 << SCALE) - f
        x += q
        x += c64[s]
    lanes = np.concatenate(out_lane[::-1]) if out_lane else np.zeros(0, np.int64)
    words = np.concatenate(out_word[::-1]) if out_word else np.zeros(0, np.uint32)
    block = (lanes // LANES).astype(np.int32)
    words = words[np.argsort(block, kind="stable")]
    ends = np.cumsum(np.bincount(block, minlength=len(n)))
    state = state.astype(np.uint64).reshape(-1, LANES)
    result: list = [None] * len(n)
    for i, b in enumerate(order):
        result[b] = (state[i], words[ends[i - 1] if i else 0 : ends[i]])
    return result


def decode(blocks: list[tuple[np.ndarray, np.ndarray, int]], freq: np.ndarray) -> list[np.ndarray]:
    """Ranks of each block from (states, words, number of symbols)."""
    if not blocks:
        return []
    n = np.array([b[2] for b in blocks])
    order = np.argsort(-n, kind="stable")
    steps = _padded(n[order])
    most = int(steps.max(initial=0))
    slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    # for each slot its symbol's frequency and its place in the symbol's range
    width = freq.astype(np.int64)[slots]
    base = np.arange(1 << SCALE) - (np.cumsum(freq.astype(np.int64)) - freq)[slots]
    state = np.stack([blocks[b][0] for b in order]).astype(np.int64).reshape(-1)
    words = np.concatenate([*[blocks[b][1] for b in order], np.zeros(1, np.uint32)]).astype(np.int64)
    count = np.array([len(blocks[b][1]) for b in order])
    at_word = np.cumsum(count) - count
    rows, begin = _layout(steps)
    out = np.empty((int(steps.sum()), LANES), np.uint32)
    for t in range(most):
        r = int(rows[t])
        x = state[: r * LANES]
        slot = x & ((1 << SCALE) - 1)
        s = slots[slot]
        out[begin[t] : begin[t] + r] = s.reshape(r, LANES)
        x = width[slot] * (x >> SCALE) + base[slot]
        short = np.flatnonzero(x < LOW)
        if len(short):
            # a block's words go to its short lanes in order
            block = short // LANES
            used = np.bincount(block, minlength=r)
            first = np.cumsum(used) - used
            x[short] = (x[short] << 32) | words[at_word[block] + np.arange(len(short)) - first[block]]
            at_word[:r] += used
        state[: r * LANES] = x
    result: list = [None] * len(blocks)
    for i, b in enumerate(order):
        result[b] = out[begin[: steps[i]] + i].reshape(-1)[: n[b]]
    return result
