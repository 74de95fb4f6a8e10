"""Transcripts as rows (conversation, position): sizes, spans, neighbours, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import exclusive_decile


def sizes(df: DataFrame, key: str, text: Column, arguments: Column | None = None) -> DataFrame:
    """Characters of each conversation: texts, and the arguments (array<string>) of the calls that a row makes."""
    size = F.length(F.coalesce(text, F.lit("")))
    if arguments is not None:
        size = size + F.aggregate(F.coalesce(arguments, F.array().cast("array<string>")), F.lit(0), lambda n, a: n + F.length(F.coalesce(a, F.lit(""))))
    return df.groupBy(key).agg(F.sum(size).alias("size"))


def size_quantiles(df: DataFrame, size: str) -> DataFrame:
    """Median, ninth decile (exclusive method) and maximum of one number a conversation.

    The decile needs two order statistics: ranks come from a sorted histogram of the distinct sizes.
    """
    hist = df.groupBy(size).count()
    w = Window.orderBy(size)
    ranked = hist.withColumn("_to", F.sum("count").over(w)).withColumn("_m", F.sum("count").over(Window.partitionBy()))
    j = F.least(F.greatest(F.floor(9 * (F.col("_m") + 1) / 10), F.lit(1)), F.col("_m") - 1)
    at = lambda k: F.min(F.when(F.col("_to") >= k, F.col(size)))
    m = F.max("_m")
    picks = ranked.agg(at(F.greatest(j, F.lit(1))).alias("a"), at(F.least(j + 1, F.col("_m"))).alias("b"), F.max(size).alias("max"), m.alias("m"), at(F.floor((F.col("_m") + 1) / 2)).alias("lo"), at(F.floor(F.col("_m") / 2) + 1).alias("hi"))
    delta = F.when(F.col("m") == 1, 0).otherwise(9 * (F.col("m") + 1) - 10 * F.least(F.greatest(F.floor(9 * (F.col("m") + 1) / 10), F.lit(1)), F.col("m") - 1))
    return picks.select(((F.col("lo") + F.col("hi")) / 2.0).alias("median"), F.round((F.col("a") * (10 - delta) + F.col("b") * delta) / 10.0, 6).alias("p90"), "max")


def adjacent(df: DataFrame, key: str, pos: str, role: str, first: str, second: str) -> DataFrame:
    """Rows of role `second` that come right after one of role `first`."""
    w = Window.partitionBy(key).orderBy(pos)
    return df.withColumn("_p", F.lag(role).over(w)).where((F.col(role) == second) & (F.col("_p") == first)).drop("_p")


def prefix_spans(df: DataFrame, key: str, pos: str, length: Column, supervised: Column) -> DataFrame:
    """[begin, end) of every message in its conversation, and whether it is trained on."""
    w = Window.partitionBy(key).orderBy(pos)
    end = F.sum(length).over(w)
    return df.withColumns({"begin": end - length, "end": end, "train": supervised})


def first_fitting_suffix(df: DataFrame, key: str, pos: str, length: Column, start: Column, budget: int) -> DataFrame:
    """The first start whose suffix fits the budget, else the last start."""
    after = Window.partitionBy(key).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
    rows = df.withColumn("_s", F.sum(length).over(after)).where(start)
    return rows.groupBy(key).agg(
        F.coalesce(F.min(F.when(F.col("_s") <= budget, F.col(pos))), F.max(pos)).alias("start"),
        F.bool_or(F.col("_s") <= budget).alias("fits"),
    )


def budget_take(df: DataFrame, key: str, pos: str, length: Column, budget: int) -> DataFrame:
    """The prefix of each conversation whose lengths plus one stay within the budget."""
    run = F.sum(length + 1).over(Window.partitionBy(key).orderBy(pos))
    return df.withColumn("used", run).where(F.col("used") <= budget)
