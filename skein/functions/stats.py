"""Intervals, paired tests and quantiles as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k in n, (0, 1) without observations, cut to [0, 1]."""
    p = k / n
    base = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    return (
        F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0),
        F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(1.0),
    )


def mcnemar_log10(b: Column, c: Column) -> Column:
    """log10 of the exact two-sided McNemar p-value for b and c discordant pairs; 0 without any.

    The binomial tail is summed relative to its largest term, so it holds for any n.
    """
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")
    # log of C(n, k) / 2**n by steps, then the terms below k relative to it
    top = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        n.cast("double") * -F.log(F.lit(2.0)),
        lambda acc, i: acc + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")),
    )
    tail = F.aggregate(
        F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * i / (n - i + 1)).alias("term"), (acc["total"] + acc["term"] * i / (n - i + 1)).alias("total")
        ),
        lambda acc: acc["total"],
    )
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(0.0), (top + F.log(tail) + F.log(F.lit(2.0))) / F.log(F.lit(10.0))))


def exclusive_decile(values: Column, d: int) -> Column:
    """The d-th decile by the exclusive method of an array of at least two numbers; it may extrapolate."""
    a = F.sort_array(values)
    m = F.size(a)
    j = F.least(F.greatest(F.floor(d * (m + 1) / 10), F.lit(1)), m - 1).cast("int")
    delta = d * (m + 1) - 10 * j
    return (F.element_at(a, j) * (10 - delta) + F.element_at(a, j + 1) * delta) / 10.0
