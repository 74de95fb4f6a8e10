"""Ids, labels and message ends of transcripts under a real tokenizer and chat template.

A message ends where the transcript up to it ends, in tokens.  Rendering a prefix may differ from the beginning of the whole
(templates that close or trim the last turn), so every prefix counts by its own tokens, and ends are clamped to go forward.

Prefixes are not encoded from their start.  A tokenizer cuts a text at some places whatever follows (`cut`: by default before
white space after other characters, as the patterns of byte-level BPE do); tokens up to the last such place that two prefixes
have in common are the same, and only what stands behind it is encoded again.  So all prefixes together cost the encoding of
the transcript and a stretch a message.

Transcripts without messages have no ids.  A null text is empty.  Without a label that counts, the last token is one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import MASKED

CUT = r"(?<=\S)\s"
#: characters between two places at which tokens are counted
STRETCH = 256
ENCODED = "struct<input_ids: array<int>, labels: array<int>, ends: array<int>, hard_truncated: int>"


def turns(messages: list[dict]) -> str:
    """A template of turns: a prefix renders as the beginning of the whole."""
    return "".join(f"<start_of_turn>{m['role']}\n{m['content'] or ''}<end_of_turn>\n" for m in messages)


@lru_cache(4)
def rank_encoder(ranks: bytes, pattern: str) -> Callable[[str], list[int]]:
    """The encoder of a rank file's content (base64 token, rank; a line each), without special tokens."""
    import tiktoken

    merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary


def _in_common(a: str, b: str) -> int:
    """Length of the longest common beginning."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b)) + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if b.startswith(a[low:middle], low) else (low, middle)
    return low


def prefix_ids(texts: Iterable[str], encode: Callable[[str], list[int]], cut: str = CUT) -> Iterator[list[int]]:
    """The ids of each text; the list is changed for the next one.  Texts with long beginnings in common are cheap."""
    find = re.compile(cut).search
    before, ids, places = "", [], [(0, 0)]  # places: where the tokenizer cuts, and tokens before
    for text in texts:
        same = _in_common(before, text)
        while places[-1][0] >= max(same, 1):
            places.pop()
        at, n = places[-1]
        del ids[n:]
        while at < len(text):
            m = find(text, at + STRETCH)
            end = m.start() if m else len(text)
            ids += encode(text[at:end])
            if m:
                places.append((end, len(ids)))
            at = end
        before = text
        yield ids


def encoded(messages: list[dict], encode: Callable[[str], list[int]], template: Callable[[list[dict]], str], max_len: int = 0, cut: str = CUT) -> tuple:
    """(input_ids, labels, ends, hard_truncated) of one transcript; beyond max_len the latest tokens stay."""
    ids: list[int] = []
    lengths = []
    for ids in prefix_ids((template(messages[:i]) for i in range(1, len(messages) + 1)), encode, cut):
        lengths.append(len(ids))
    labels, ends, start = [MASKED] * len(ids), [], 0
    for m, length in zip(messages, lengths):
        end = max(start, min(length, len(ids)))
        if m["role"] == "assistant" and m.get("train") in (None, True):
            labels[start:end] = ids[start:end]
        ends.append(end)
        start = end
    if ids and not any(x != MASKED for x in labels):
        labels[-1] = ids[-1]
    cut_off = bool(max_len) and len(ids) > max_len
    return (ids[-max_len:], labels[-max_len:], ends, 1) if cut_off else (ids, labels, ends, 0)


def encode_transcripts(messages: Column, ranks: bytes, pattern: str, template: Callable[[list[dict]], str] = turns, max_len: int = 0) -> Column:
    """struct<input_ids, labels, ends, hard_truncated> of an array of messages (role, content, train if there is one)."""

    def rows(s: pd.Series) -> pd.DataFrame:
        encode = rank_encoder(ranks, pattern)
        done = (encoded([dict(m) for m in (x if x is not None else [])], encode, template, max_len) for x in s)
        return pd.DataFrame(list(done), columns=["input_ids", "labels", "ends", "hard_truncated"])

    return F.pandas_udf(rows, ENCODED)(messages)
