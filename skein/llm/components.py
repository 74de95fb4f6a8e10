"""Connected components of an edge table.

Up to ONE_TASK edges (16 bytes each) are one task's work, by union-find; more of them go through alternating large-star
and small-star steps, each written to scratch.  Both give the same rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

ONE_TASK = 100_000
HUB = 1000
MAX_HUBS = 100_000


def _least(edges: DataFrame) -> DataFrame:
    """(u, the least of its neighbours in v, their number): partial sums first, so a hub is folded before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with the m of their u.

    Nodes of HUB edges or more, which would each be one task's work, are sent to all tasks, and their edges stay where
    they are; only if there are more than MAX_HUBS of them (16 bytes each) do they go through the shuffle as well.
    """
    least = materialise(least, "cc-least")
    hubs = least.where(F.col("n") >= HUB)
    if hubs.isEmpty() or hubs.limit(MAX_HUBS + 1).count() > MAX_HUBS:
        return edges.join(least.select("u", "m"), "u")
    hubs = hubs.select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    told = edges.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    others = told.where("hub is null").select("u", "v").join(least.where(F.col("n") < HUB).select("u", "m"), "u")
    return told.where("hub is not null").select("u", "v", F.col("hub_m").alias("m")).union(others.select("u", "v", "m"))


def _union_find(batches):
    parent: dict[int, int] = {}

    def top(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = i = parent[parent[i]]
        return i

    for batch in batches:
        for a, b in zip(*[c.to_pylist() for c in batch.columns]):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(i) for i in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), a written table: root is the least node of its component."""
    edges = edges.where("a != b")
    if edges.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return edges.select("a", "b").coalesce(1).mapInArrow(_union_find, "node long, root long")
    return star_components(edges)


def star_components(edges: DataFrame) -> DataFrame:
    """The same by steps that join edges with the least neighbour of one end."""
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above u go to the least of u and its neighbours
        least = _least(both).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialise(large, "cc-large")
        # small star: u and its smaller neighbours go to the least of them
        small = _with_least(large, _least(large)).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.union(_least(large).select("u", F.col("m").alias("v"))).where("u != v").distinct(), "cc")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
