"""Operator 3, n-gram Jaccard join by parity sketches.

A document's set is its distinct shingles.  Every shingle flips one bit of a wide sketch; flips that meet cancel, so the
Hamming distance of two sketches is never above the symmetric difference of the sets.  For two sets that link, that
difference is at most d, which follows from the sizes; sizes are banded so that a pair shares a scheme with one d.
The sketch is cut into d + 1 + t parts, so linked pairs agree on t + 1 of them; each set posts its d + 1 parts with most
shingles (an order of the parts' contents alone, so linked pairs still share one), and equal parts meet in an equi-join.
The wide sketch's parts are kept as 64-bit XOR codes of their bits.  A folded sketch of 512 bits, then one of two to four bits
a shingle (of small sets COPIES independent ones), bound the distance again before the sets themselves verify a pair.

Components.  Texts with equal sets are one class from the start.  In a bucket of equal parts every class first meets the
least class only; the links found make components.  Then rounds follow: the classes of a bucket that are in different
components are compared by their sketches, at most BLOCK at a time with BLOCK others, and of the pairs that pass, if there
are more than FEW, only a spanning forest goes on, the nearest first; its pairs are verified, the links make components, and pairs that failed are
not tried again.  It ends when no bucket has a pair left that passes, so no link that could join two components is lost,
and what a bucket sends on is in proportion to its members, whatever the number of links between them.

Nulls: a null or blank text has the empty set, links with nothing and is a component of its own; null ids take part in
links but never name a component (component_id is null if a component has no other).  Rows that repeat an id keep their
own sets.  Ties (equal similarity, equal distance) need no rule: a component does not depend on the order of its links.
Very long texts are sets like others, their sketches as much wider.  Empty tables give empty results; other columns are
not returned.  Shingles, parts and classes are compared by 64-bit hashes (classes: expected false merges n^2 / 2^65).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import broadcast_if_small, materialise, shuffle_partitions
from .words import chunks, mix, span_hashes, spans, windows

FOLD = 512
SEEN = 1 << 17
BLOCK = 512
COPIES, SMALL, FEW = 3, 256, 64


def row_sets(buf: np.ndarray, offsets: np.ndarray, size: int):
    """The sorted distinct shingle hashes of every row; with fewer than size words, the whole sequence as one."""
    starts, ends, first = spans(buf, offsets)
    h = span_hashes(buf, starts, ends, lower=True)
    grams = windows(h, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield windows(h[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def bands(percent: int) -> np.ndarray:
    """Lower ends of the size bands: sizes of a linked pair lie in one band or in two that follow each other."""
    ends = [1, 2]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, 100 * (ends[-1] - 1) // percent + 1))
    return np.array(ends, np.int64)


@lru_cache(maxsize=4096)
def scheme(band: int, percent: int) -> tuple[int, int]:
    """(d, parts) of a band: the largest difference of a linked pair of sizes below the band's end."""
    top = int(bands(percent)[band + 1]) - 1
    d = 2 * top * (100 - percent) // (100 + percent)
    return d, d + 1 + (d + 1) // 4 + 1


def postings(values: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Keys of the d + 1 parts with most shingles; none if linked sets of the band must be equal."""
    d, parts = scheme(band, percent)
    if not d:
        return np.zeros(0, np.uint64)
    part = ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    count = np.bincount(part.astype(np.int64), minlength=parts)
    full = count > 0
    code = np.zeros(parts, np.uint64)
    begin = np.cumsum(count) - count
    code[full] = np.bitwise_xor.reduceat(mix(values[order] ^ np.uint64(0xA5A5A5A5)), begin[full])
    key = mix(code + np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band << 32))
    return key[np.lexsort((key, count))[::-1][: d + 1]]


def parity(values: np.ndarray, bits: int) -> np.ndarray:
    """The parity sketch of `bits` bits, a power of two, as bytes."""
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def copies(n: int) -> int:
    """How many sketches a set of n shingles has: in a narrow one more of a pair's flips meet."""
    return COPIES if n <= SMALL else 1


def parities(values: np.ndarray, bits: int) -> np.ndarray:
    """The sketches of a set, each by a hash of its own, a row each; the first is parity(values, bits)."""
    return np.stack([parity(mix(values + np.uint64(c)) if c else values, bits) for c in range(copies(len(values)))])


def narrowed(sketch: np.ndarray, size: int) -> np.ndarray:
    """Sketches folded to `size` bytes: the halves of one flip the same bits."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def sketches(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, n_shingles, digest, fold, sketch, keys) of every row, in one pass over the texts.

    keys is null where the same task has posted an equal set before; it remembers SEEN sets at a time, and a set that
    it or another task posts again only adds an equal row to its buckets.
    """
    ends = bands(percent)

    def sketch(batches):
        seen: set = set()
        for batch in batches:
            # a block of texts at a time, so that a task never holds the keys of a whole batch
            for i, j, buf, offsets in chunks(batch.column(2)):
                n, digest, folds, wide, keys = [], [], [], [], []
                for values in row_sets(buf, offsets, size):
                    n.append(len(values))
                    digest.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                    new = len(values) > 0 and digest[-1] not in seen
                    if new:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest[-1])
                    band = int(np.searchsorted(ends, len(values), "right")) - 1
                    bits = parities(values, max(FOLD, 1 << (2 * len(values) - 1).bit_length())) if new else None
                    folds.append(narrowed(bits[0], FOLD // 8).view(np.int64) if new else None)
                    wide.append(bits.tobytes() if new else None)
                    keys.append(np.concatenate([postings(values, b, percent) for b in (band, band + 1)]).view(np.int64) if new else None)
                columns = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(folds, pa.list_(pa.int64())), pa.array(wide, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[:2]], *columns], names=["id", "text_key", "n_shingles", "digest", "fold", "sketch", "keys"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(sketch, "id long, text_key long, n_shingles long, digest binary, fold array<long>, sketch binary, keys array<long>")


def near_pairs(sketch: list[bytes], n: np.ndarray, apart: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, distance) of the pairs of sets that the matrix `apart` asks for and that sizes and sketches leave possible."""
    many = [copies(k) for k in n.tolist()]
    both, width = min(many), min(len(x) // c for x, c in zip(sketch, many))
    wide = np.stack([narrowed(np.frombuffer(x, np.uint8).reshape(c, -1)[:both], width) for x, c in zip(sketch, many)]).view(np.uint64)
    rows, columns = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
    distance = np.zeros((len(rows), len(columns)), np.int32)
    for c in range(both):  # each is a lower bound; the greatest counts
        one = np.zeros_like(distance)
        for word in wide[:, c].T:
            one += np.bitwise_count(word[rows][:, None] ^ word[columns][None, :])
        distance = np.maximum(distance, one)
    a, b = n[rows][:, None], n[columns][None, :]
    possible = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (distance * (100 + percent) <= (a + b) * (100 - percent))
    x, y = np.nonzero(possible & apart[np.ix_(rows, columns)])
    return rows[x], columns[y], distance[x, y]


def forest(root: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, node: np.ndarray) -> list[int]:
    """Which of the pairs (x, y) make a spanning forest of the components `root`, the nearest first.

    Ties go by a hash of the pair's nodes, so that buckets which share pairs choose the same ones.
    """
    tie = mix(node[x].astype(np.uint64)) + mix(node[y].astype(np.uint64))
    names, at = np.unique(root, return_inverse=True)
    parent, chosen, left = list(range(len(names))), [], len(names) - 1

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for k in np.lexsort((tie, weight)).tolist():
        a, b = top(at[x[k]]), top(at[y[k]])
        if a != b:
            parent[a] = b
            chosen.append(k)
            left -= 1
            if not left:
                break
    return chosen


def compared(members: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """(key, a, b), a < b: pairs of a bucket that may link, of members (key, n_members, node, root, n, sketch, tried).

    spanning: pairs of different roots that are not in `tried` of the greater node; of more than FEW in a block, a spanning
    forest.  Else all pairs.  A bucket of more than BLOCK members is cut into blocks, and each pair of them is a group of its own.
    """
    blocks = F.ceil(F.col("n_members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "root", "n", "sketch", "tried")

    def pairs(group: dict):
        node, root, i, j = group["node"], group["root"], group["i"][0], group["j"][0]
        if i == j:
            apart = np.triu(np.ones((len(node), len(node)), bool), 1)
        else:
            apart = (group["mine"] == i)[:, None] & (group["mine"] == j)[None, :]
        if spanning:
            apart &= root[:, None] != root[None, :]
            place = None
            for k, known in enumerate(group["tried"]):
                if known:
                    place = place or {v: p for p, v in enumerate(node.tolist())}
                    for p in (place[v] for v in known if v in place):
                        apart[k, p] = apart[p, k] = False
        if not apart.any():
            return ()
        x, y, distance = near_pairs(group["sketch"], group["n"], apart, percent)
        if spanning and len(x) > FEW:
            chosen = forest(root, x, y, distance, node)
            x, y = x[chosen], y[chosen]
        return zip(np.minimum(node[x], node[y]).tolist(), np.maximum(node[x], node[y]).tolist())

    def compare(batches):
        held = None

        def groups(table, last):
            """The whole groups of a table of rows in order, and the rows of its last group unless it is the last table."""
            columns = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "mine", "node", "root", "n")}
            new = (np.diff(columns["key"]) != 0) | (np.diff(columns["i"]) != 0) | (np.diff(columns["j"]) != 0)
            bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(table)]
            end = len(bounds) - 1 if last else len(bounds) - 2
            sketch, tried = table.column("sketch").to_pylist(), table.column("tried").to_pylist()
            out = []
            for a, b in zip(bounds[:end], bounds[1 : end + 1]):
                if b - a > 1:
                    group = {c: v[a:b] for c, v in columns.items()} | {"sketch": sketch[a:b], "tried": tried[a:b]}
                    out += [(int(columns["key"][a]), *p) for p in pairs(group)]
            key, x, y = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key, x, y)], names=["key", "a", "b"]), table.slice(bounds[end])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None and len(held) else table
            if len(table):
                out, held = groups(table.combine_chunks(), False)
                yield out
        if held is not None and len(held):
            yield groups(held.combine_chunks(), True)[0]

    dealt = rows.repartition(shuffle_partitions(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(compare, "key long, a long, b long")


class Join:
    """Rows, classes and buckets of one table, and the verification of pairs of classes."""

    def __init__(self, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, max_broadcast_rows: int):
        self.size, self.percent, self.max_broadcast_rows = size, percent, max_broadcast_rows
        self.texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.rows = materialise(sketches(docs, size, percent, id_col, text_col), "sketches")
        some = self.rows.where("n_shingles > 0").withColumn("node", F.xxhash64("digest"))
        classes = some.groupBy("digest").agg(
            F.min("id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("fold", True).alias("fold"), F.first("sketch", True).alias("sketch")
        )
        self.classes = materialise(classes.withColumn("node", F.xxhash64("digest")), "classes")
        posted = some.where("keys is not null").select("node", F.explode("keys").alias("key"))
        bucket = Window.partitionBy("key")
        met = posted.withColumns({"least": F.min("node").over(bucket), "most": F.max("node").over(bucket)}).where("least != most")
        # more: besides the least there are two classes or more
        more = F.min(F.when(F.col("node") != F.col("least"), F.col("node"))).over(bucket) != F.col("most")
        self.met = materialise(met.withColumn("more", more).select("key", "node", "least", "more").distinct(), "buckets")  # clustered by key: no further shuffle

    def screened(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that sizes and folded sketches leave possible."""
        p = self.percent
        x, y = (self.classes.select("node", "n", "fold").alias(t) for t in "xy")
        difference = sum((F.bit_count(F.col("x.fold")[i].bitwiseXOR(F.col("y.fold")[i])) for i in range(FOLD // 64)), F.lit(0))
        near = (100 * F.least("x.n", "y.n") >= p * F.greatest("x.n", "y.n")) & (difference * (100 + p) <= (F.col("x.n") + F.col("y.n")) * (100 - p))
        kept = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(near)
        return self.screened_wide(materialise(kept.select("a", "b"), name), name)

    def screened_wide(self, pairs: DataFrame, name: str) -> DataFrame:
        """The same by the wide sketches."""
        p = self.percent

        def narrow(batches):
            for batch in batches:
                ok = []
                for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns[2:]]):
                    found, _, _ = near_pairs([x, y], np.array([a, b]), np.array([[False, True], [False, False]]), p)
                    ok.append(len(found) > 0)
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

        side = lambda t, node: self.classes.select(F.col("node").alias(node), F.col("n").alias("n" + t), F.col("sketch").alias("s" + t))
        both = pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").select("a", "b", "na", "nb", "sa", "sb")
        return materialise(both.mapInArrow(narrow, "a long, b long"), name + "-wide")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) of nodes that link, by their sets, which are computed anew for the texts that need it."""
        size, percent = self.size, self.percent
        need = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        need = need.join(self.classes, "node").select("node", F.col("least_id").alias("need_id"), F.col("digest").alias("need_digest"))
        need = materialise(need, name + "-need")
        texts = self.texts.join(broadcast_if_small(need, self.max_broadcast_rows), F.col("id").eqNullSafe(F.col("need_id")))

        def compute(batches):
            for batch in batches:
                digests = batch.column(2).to_pylist()
                for i, _, buf, offsets in chunks(batch.column(1)):
                    nodes, values = [], []
                    for k, v in enumerate(row_sets(buf, offsets, size)):
                        if xxhash.xxh3_128_digest(v.tobytes()) == digests[i + k]:  # rows that repeat an id have other sets
                            nodes.append(batch.column(0)[i + k].as_py())
                            values.append(v.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(values, pa.binary())], names=["node", "values"])

        sets = texts.select("node", "text", "need_digest").mapInArrow(compute, "node long, values binary")
        sets = materialise(sets.dropDuplicates(["node"]), name + "-sets")

        def verify(batches):
            for batch in batches:
                ok = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    ok.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

        left = sets.select(F.col("node").alias("a"), F.col("values").alias("va"))
        right = sets.select(F.col("node").alias("b"), F.col("values").alias("vb"))
        joined = pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb")
        return materialise(joined.mapInArrow(verify, "a long, b long"), name + "-links")

    def members(self, rows: DataFrame, roots: DataFrame | None, failed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Rows (key, node, root, n_members) of buckets with classes of two roots, and those rows for `compared`."""
        rows = rows.select("key", "node")
        rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")) if roots is not None else rows.withColumn("root", F.col("node"))
        bucket = Window.partitionBy("key")
        rows = rows.withColumns({"r1": F.min("root").over(bucket), "r2": F.max("root").over(bucket), "n_members": F.count("*").over(bucket)})
        rows = materialise(rows.where("r1 != r2").drop("r1", "r2"), "apart")
        light = self.classes.select("node", "n", "sketch")
        if failed is None:
            light = light.withColumn("tried", F.lit(None).cast("array<long>"))
        else:
            light = light.join(failed.groupBy(F.col("b").alias("node")).agg(F.collect_set("a").alias("tried")), "node", "left")
        return rows, rows.join(light, "node")

    def components(self) -> DataFrame:
        """(node, root) of the classes that have links."""
        stars = self.met.where("node != least").select(F.col("node").alias("b"), F.col("least").alias("a")).distinct()
        stars = self.screened(stars.select("a", "b"), "stars")
        links = self.verified(stars, "stars")
        failed = stars.join(links, ["a", "b"], "left_anti")
        roots = materialise(components(links), "roots")
        # every pair with the least of a bucket has been tried; rounds over the others
        rows = self.met.where("more and node != least")
        for step in range(1, 1 << 30):
            rows, full = self.members(rows, roots, failed)
            found = materialise(compared(full, self.percent, True), f"round{step}")
            if found.isEmpty():
                return roots
            pairs = found.select("a", "b").distinct()
            more = self.verified(pairs, f"round{step}")
            failed = materialise(failed.union(pairs.join(more, ["a", "b"], "left_anti")), f"failed{step}")
            links = links.union(more)
            roots = materialise(components(links), "roots")
            rows = rows.join(found.select("key").distinct(), "key", "left_semi")

    def links(self) -> DataFrame:
        """(a, b) of all classes that link."""
        pairs = compared(self.members(self.met, None, None)[1], self.percent, False)
        return self.verified(materialise(pairs.select("a", "b").distinct(), "pairs"), "pairs")


def jaccard_links(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = 1_000_000
) -> tuple[DataFrame, DataFrame]:
    """The whole join: (members, links).

    members has (id, text_key, n_shingles, class_id, n_links) of each row, links (a, b), a < b, of every two classes that link;
    n_links counts the other rows of the class and the links of the class to others.  Its size is that of the result,
    which for a group of near copies is the square of the group; jaccard_components is not bound to it.
    """
    join = Join(docs, size, percent, id_col, text_col, max_broadcast_rows)
    links = join.links()
    ends = links.select(F.col("a").alias("class_id")).union(links.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("n_others"))
    sizes = join.rows.where("n_shingles > 0").groupBy(F.xxhash64("digest").alias("class_id")).agg((F.count("*") - 1).alias("n_copies"))
    sizes = materialise(sizes.join(ends, "class_id", "left").select("class_id", (F.col("n_copies") + F.coalesce("n_others", F.lit(0))).alias("n_links")), "n-links")
    members = join.rows.withColumn("class_id", F.when(F.col("n_shingles") > 0, F.xxhash64("digest"))).join(sizes, "class_id", "left")
    return members.select(F.col("id").alias(id_col), "text_key", "n_shingles", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), links


def jaccard_components(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = 1_000_000
) -> DataFrame:
    """(id, text_key, n_shingles, class_id, component_id) of each row: 100 * intersection >= percent * union links two sets.

    class_id names the texts of one set, text_key (xxhash64) the text.  component_id is the least id that links reach.
    """
    join = Join(docs, size, percent, id_col, text_col, max_broadcast_rows)
    named = join.classes.join(join.components(), "node", "left").withColumn("root", F.coalesce("root", "node")).select("digest", "node", "root", "least_id")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialise(named.join(least, "root").select("digest", F.col("node").alias("class_id"), "root", "component_id"), "named")
    return join.rows.select("id", "text_key", "n_shingles", "digest").join(named, "digest", "left").select(
        F.col("id").alias(id_col),
        "text_key",
        "n_shingles",
        "class_id",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.col("root").alias("component"),
    )


def without_near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = 1_000_000
) -> DataFrame:
    """docs with one row of each component: that of the least id (nulls last), then of the least hash of the text.

    Rows are told apart by id and text, so other texts under a removed row's id stay, rows with a null id are judged as
    others are, and of rows that repeat both one stays.  Rows without words all stay.  Columns are as they were.
    """
    groups = jaccard_components(docs, size, percent, id_col, text_col, max_broadcast_rows).where("n_shingles > 0")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_key").alias("text_key"))
    alike = materialise(groups.groupBy("component", order.alias("row")).agg(F.count("*").alias("n")), "near-rows")
    first = alike.groupBy("component").agg(F.min("row").alias("first"))
    judged = alike.join(first, "component").where("row != first or n > 1")
    judged = materialise(judged.select(F.col("row.id").alias("_r_id"), F.col("row.text_key").alias("_r_key"), (F.col("row") != F.col("first")).alias("_r_gone")), "near-duplicates")
    judged = broadcast_if_small(judged, max_broadcast_rows)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    told = whole.join(judged, F.col("id").eqNullSafe(F.col("_r_id")) & (F.col("text_key") == F.col("_r_key")), "left")
    # rows that repeat a first row meet by their key; they are few, all others stay where they are
    once = told.where("not _r_gone").dropDuplicates(["id", "text_key"])
    return told.where("_r_gone is null").select("row.*").unionByName(once.select("row.*"))
