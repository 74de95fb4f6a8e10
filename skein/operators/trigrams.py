"""Literal and regular-expression search by an index of byte trigrams.

A text can match an expression only if it has the trigrams that the expression requires: for each expression these are a
choice of alternatives, each a set of trigrams.  Texts and expressions meet in an equi-join on the rarest trigrams of each
alternative, and what has all of them is verified with the expression itself, so the index loses nothing and adds nothing.
Expressions that require no trigram (shorter than three bytes, or all classes and repeats) must see every text: they go
in blocks past the texts.

Expressions are written as Python and Java both read them.  Nulls match nothing.  Repeated queries count once.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections.abc import Iterable
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: strings that a part of an expression may stand for, and alternatives, before the analysis takes the weaker statement
MAX_STRINGS, MAX_ALTERNATIVES = 16, 32
#: trigrams of an alternative that are looked up; queries without a trigram that pass a text together
LOOKED_UP, BLOCK = 3, 64

Need = frozenset  # of alternatives, each a frozenset of trigrams; an empty alternative requires nothing
NOTHING: Need = frozenset([frozenset()])


def of_bytes(data: bytes) -> np.ndarray:
    """The distinct trigrams of a byte string, as numbers."""
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    return np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else np.zeros(0, np.int32)


def _either(needs: Iterable[Need]) -> Need:
    out = frozenset().union(*needs)
    out = frozenset(a for a in out if not any(b < a for b in out))  # what a lesser alternative allows anyway
    return out if len(out) <= MAX_ALTERNATIVES else NOTHING


def _both(a: Need, b: Need) -> Need:
    if len(a) * len(b) > MAX_ALTERNATIVES:  # one of two requirements is still a requirement
        return max(a, b, key=lambda n: min(map(len, n)))
    return _either([frozenset(x | y for x in a for y in b)])


def _of_strings(strings: Iterable[bytes]) -> Need:
    return _either([frozenset([frozenset(of_bytes(s).tolist())]) for s in strings])


class _Part:
    """What is known of a part's matches: all of them (exact), or how they begin and end, and the trigrams they need."""

    def __init__(self, exact: Iterable[bytes] | None = None, begins=(b"",), ends=(b"",), need: Need = NOTHING):
        self.exact = None if exact is None else frozenset(exact)
        if self.exact is not None and len(self.exact) > MAX_STRINGS:
            begins, ends, need = self.exact, self.exact, _of_strings(self.exact)
            self.exact = None
        if self.exact is not None:
            begins, ends, need = self.exact, self.exact, _of_strings(self.exact)
        self.begins, self.ends, self.need = _few(x[:2] for x in begins), _few(x[-2:] for x in ends), need

    def then(self, other: _Part) -> _Part:
        if self.exact is not None and other.exact is not None:
            return _Part(a + b for a in self.exact for b in other.exact)
        across = _of_strings(a + b for a in self.ends for b in other.begins)
        begins = self.begins if self.exact is None else [a + b for a in self.exact for b in other.begins]
        ends = other.ends if other.exact is None else [a + b for a in self.ends for b in other.exact]
        return _Part(None, begins, ends, _both(_both(self.need, other.need), across))


def _few(strings: Iterable[bytes]) -> frozenset[bytes]:
    out = frozenset(strings)
    return out if len(out) <= MAX_STRINGS else frozenset([b""])


_EMPTY, _ANY = _Part([b""]), _Part()


def _any_of(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts):
        return _Part(s for p in parts for s in p.exact)
    return _Part(None, [b for p in parts for b in p.begins], [e for p in parts for e in p.ends], _either([p.need for p in parts]))


def _class(items) -> _Part:
    chars: list[bytes] = []
    for kind, value in items:
        if kind is op.LITERAL:
            chars.append(chr(value).encode())
        elif kind is op.RANGE and value[1] - value[0] < MAX_STRINGS:
            chars += [chr(c).encode() for c in range(value[0], value[1] + 1)]
        else:
            return _ANY
    return _Part(chars)


def _sequence(tokens, flags: int) -> _Part:
    return reduce(_Part.then, (_token(kind, value, flags) for kind, value in tokens), _EMPTY)


def _token(kind, value, flags: int) -> _Part:
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return _EMPTY
    if kind is op.SUBPATTERN:
        return _sequence(value[3], (flags | value[1]) & ~value[2])
    if kind is op.ATOMIC_GROUP:
        return _sequence(value, flags)
    if kind is op.BRANCH:
        return _any_of([_sequence(v, flags) for v in value[1]])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        once = _sequence(inner, flags)
        if most == 1:
            return _any_of([once, _EMPTY]) if least == 0 else once
        if least == 0:
            return _ANY
        times = reduce(_Part.then, [once] * min(least, 4))
        return times if least == most <= 4 else times.then(_ANY).then(once)
    if flags & re.IGNORECASE:  # other letters may match, of other lengths
        return _ANY
    if kind is op.LITERAL:
        return _Part([chr(value).encode()])
    return _class(value) if kind is op.IN else _ANY


@lru_cache(4096)
def required(query: str, is_regex: bool) -> Need:
    """The alternatives of trigrams of which a match has one whole; ValueError for what is no expression."""
    if not is_regex:
        return _of_strings([query.encode()])
    try:
        tree = parser.parse(query)
    except (re.error, OverflowError) as e:
        raise ValueError(f"invalid regex: {e}") from e
    return _sequence(tree, tree.state.flags).need


def requirements(query: Column, is_regex: Column) -> Column:
    """required() as array<array<int>>, each array in order."""

    def rows(q: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else sorted(sorted(x) for x in required(a, bool(b))) for a, b in zip(q, r)])

    return F.pandas_udf(rows, "array<array<int>>")(query, is_regex)


def index(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, trigram) of every distinct trigram of a text."""
    schema = texts.select(*keys).schema

    def postings(batches):
        for b in batches:
            found = [of_bytes((t or "").encode()) for t in b.column(len(keys)).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            columns = [b.column(i).take(at) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int32))], names=[*keys, "trigram"])

    return texts.select(*keys, text).mapInArrow(postings, schema.add("trigram", IntegerType()))


def matches(line: Column, query: Column, is_regex: Column) -> Column:
    return F.when(is_regex, F.regexp(line, query)).otherwise(F.contains(line, query))


def asked(queries: DataFrame, query: str = "query", is_regex: str | None = None) -> DataFrame:
    """(query, is_regex, needs) of the distinct queries that are neither null nor empty."""
    regex = F.col(is_regex) if is_regex else F.lit(False)
    rows = queries.select(F.col(query).alias("query"), regex.alias("is_regex")).where(F.length("query") > 0).distinct()
    return rows.withColumn("needs", requirements(F.col("query"), F.col("is_regex")))


def candidates(postings: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(query, is_regex, keys) of the texts that have all looked-up trigrams of an alternative; wanted is that of asked().

    Of each alternative the rarest trigrams are looked up; fewer of them only make more candidates.
    """
    alternatives = wanted.where(~F.array_contains(F.transform("needs", F.size), 0)).select("query", "is_regex", F.posexplode("needs").alias("alternative", "trigrams"))
    rows = alternatives.select("query", "is_regex", "alternative", F.explode("trigrams").alias("trigram"))
    n_texts = postings.join(rows.select("trigram").distinct(), "trigram", "left_semi").groupBy("trigram").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("query", "is_regex", "alternative").orderBy(F.coalesce("n", F.lit(0)), "trigram")
    rows = rows.join(n_texts, "trigram", "left").withColumn("k", F.row_number().over(rarest)).where(F.col("k") <= LOOKED_UP)
    of = F.count("*").over(Window.partitionBy("query", "is_regex", "alternative"))
    rows = rows.withColumn("of", of).select("query", "is_regex", "alternative", "of", "trigram")
    met = postings.join(rows, "trigram").groupBy("query", "is_regex", "alternative", "of", *keys).agg(F.count("*").alias("met"))
    return met.where("met = of").select("query", "is_regex", *keys).distinct()


def unindexed(texts: DataFrame, wanted: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(query, is_regex, keys, text) of texts that match a query without trigrams: a pass of all texts for each block of queries.

    Blocks are dealt out by text and block, so neither side is one task's.
    """
    loose = wanted.where(F.array_contains(F.transform("needs", F.size), 0)).select("query", "is_regex")
    blocks = -(-loose.count() // BLOCK)
    shares = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    which, share = F.pmod(F.xxhash64("query", "is_regex"), F.lit(max(blocks, 1))), F.sequence(F.lit(0), F.lit(shares - 1))
    packed = loose.groupBy(which.alias("_block")).agg(F.collect_list(F.struct("query", "is_regex")).alias("_queries")).withColumn("_share", F.explode(share))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))) if blocks else F.explode(F.expr("array_repeat(0L, 0)"))
    passed = texts.select(*keys, text, F.pmod(F.xxhash64(*keys), F.lit(shares)).cast("int").alias("_share"), every.alias("_block")).join(packed, ["_block", "_share"])
    found = passed.select(*keys, text, F.explode(F.filter("_queries", lambda q: matches(F.col(text), q["query"], q["is_regex"]))).alias("_q"))
    return found.select("_q.query", "_q.is_regex", *keys, text)


def matching(texts: DataFrame, queries: DataFrame, keys: list[str], text: str, query: str = "query", is_regex: str | None = None, postings: DataFrame | None = None) -> DataFrame:
    """(query, is_regex, keys, text) of all texts that match a query; postings: their index(), if there is one already."""
    wanted = asked(queries, query, is_regex)
    postings = index(texts, keys, text) if postings is None else postings
    rows = candidates(postings, wanted, keys).join(texts.select(*keys, text), keys)
    exact = rows.where(matches(F.col(text), F.col("query"), F.col("is_regex")))
    columns = ["query", "is_regex", *keys, text]
    return exact.select(columns).unionByName(unindexed(texts, wanted, keys, text).select(columns))


def file_lines(text: Column) -> Column:
    """array<struct<line_no, line>> of a text whose lines end with a line feed; nothing follows the last one."""
    lines = F.split(text, "\n")
    lines = F.when(F.endswith(text, F.lit("\n")) | (text == ""), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return F.transform(lines, lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line")))


def lines_in(texts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, line_no, line) of the lines that match the row's own query."""
    found = F.filter(file_lines(F.col(text)), lambda x: matches(x["line"], F.col("query"), F.col("is_regex")))
    return texts.select(*keep, F.explode(found).alias("_x")).select(*keep, "_x.line_no", "_x.line")


def matching_lines(texts: DataFrame, queries: DataFrame, keys: list[str], text: str, query: str = "query", is_regex: str | None = None, postings: DataFrame | None = None) -> DataFrame:
    """(query, is_regex, keys, line_no, line): every line of a text that matches a query; the index is of texts, not of lines."""
    wanted = asked(queries, query, is_regex)
    postings = index(texts, keys, text) if postings is None else postings
    some = candidates(postings, wanted, keys).join(texts.select(*keys, text), keys)
    some = some.where(F.col("is_regex") | F.contains(text, F.col("query")))  # before texts are cut into lines
    columns = ["query", "is_regex", *keys, "line_no", "line"]
    each = texts.select(*keys, F.explode(file_lines(F.col(text))).alias("_x")).select(*keys, "_x.line_no", "_x.line")
    return lines_in(some, ["query", "is_regex", *keys], text).select(columns).unionByName(unindexed(each, wanted, [*keys, "line_no"], "line").select(columns))
