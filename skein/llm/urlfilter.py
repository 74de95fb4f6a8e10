"""Operator 10, URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, precedence.

Every URL is expanded into (host suffix + path prefix) expressions, only for numbers of labels and path lengths that some
rule has, so a row's expressions stay as many as the rules have such pairs, however long its host.  The expressions meet
the rules in an equi-join on the first four bytes of their SHA-256 alone; of the rules met, those whose full digest is the
expression's are confirmed, and the longest of them wins (ties: block before allow, then the rule's text).
Nulls: a null url, or one without "://", has an empty host and path and meets no rule.  A null host or verdict in the
rules drops that rule; a null path means "/", an empty one every path; one that does not begin with "/" fits no URL.  Repeated rows come back as often as they were.  Other columns of the
input are not returned; join on id and url for them.  Empty tables give empty results; without rules all is `default`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import broadcast_if_small


def split_url(url):
    """(host, path): host in lower-case ASCII letters, both empty without '://'."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


#: stands between host and path in an expression; neither a URL's host nor its path can hold it
BETWEEN = "?"


def _digest(text):
    return F.unhex(F.sha2(text, 256))


def _short(digest):
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")


def url_verdicts(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_broadcast_rules: int = 1_000_000,
) -> DataFrame:
    """Per row of pages: id, url, host, path, rule ('host' + 'path', null if none fits) and verdict.

    rules has the columns host, path and verdict.  They are broadcast only up to max_broadcast_rules rows and 64 MB; more
    of them are shuffled.
    """
    spark = pages.sparkSession
    rules = rules.select(F.lower("host").alias("r_host"), F.coalesce("path", F.lit("/")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    rules = rules.where("r_host is not null and r_verdict is not null").distinct()
    rules = rules.withColumn("r_rule", F.concat("r_host", "r_path")).withColumn("r_digest", _digest(F.concat("r_host", F.lit(BETWEEN), "r_path")))
    rules = rules.withColumn("r_short", _short(F.col("r_digest")))
    # the distinct shapes of rules, (labels of the host, length of the path): a few small numbers
    labels = lambda host: F.size(F.split(host, r"\."))
    shapes = sorted(tuple(r) for r in rules.select(labels(F.col("r_host")), F.length("r_path")).distinct().collect())

    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    expression = lambda n, k: F.concat(F.substring_index("host", ".", -n), F.lit(BETWEEN), F.left("path", F.lit(k)))
    expressions = [F.when((labels(F.col("host")) >= n) & (F.length("path") >= k), expression(n, k)) for n, k in shapes]
    # the first, null, keeps the row and counts it once
    expanded = urls.withColumn("_e", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_compact(F.array(*expressions).cast("array<string>")))))
    expanded = expanded.withColumn("_digest", _digest(F.col("_e"))).withColumn("_short", _short(F.col("_digest")))
    joined = expanded.join(broadcast_if_small(rules, max_broadcast_rules), F.col("_short") == F.col("r_short"), "left")
    best = F.max(
        F.when(
            F.col("_digest") == F.col("r_digest"),
            F.struct(F.length("r_rule").alias("n"), (F.col("r_verdict") == "block").alias("b"), F.col("r_rule").alias("rule"), F.col("r_verdict").alias("verdict")),
        )
    )
    # one URL's expressions leave one map task, so the partial aggregate folds them before the shuffle
    judged = joined.groupBy("_id", "_url", "host", "path").agg(
        best.alias("_best"), F.count_if(F.col("_e").isNull()).alias("_n")
    )
    return judged.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"),
    )
