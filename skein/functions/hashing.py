"""Deterministic draws from ids: the same number in every engine and on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(key: Column) -> Column:
    """The first 32 bits of the key's SHA-1 modulo 100."""
    return F.conv(F.substring(F.sha1(key.cast("string")), 1, 8), 16, 10).cast("long") % 100


def split_name(key: Column, widths: dict[str, int]) -> Column:
    """The split whose cumulated width first exceeds the key's bucket; the first split if none does."""
    out, end = F.lit(next(iter(widths))), 0
    cases = []
    for name, width in widths.items():
        end += width
        cases.append((end, name))
    for end, name in reversed(cases):
        out = F.when(bucket(key) < end, F.lit(name)).otherwise(out)
    return out


def byte_draw(key: Column, rate: float) -> Column:
    """Whether the first byte of the key's SHA-256, over 255, lies under rate."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 2), 16, 10).cast("int") / F.lit(255.0) < rate


def order_key(key: Column, seed: int | str) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))
