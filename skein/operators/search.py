"""Search over file lines, and what augmentation makes of it: candidate names, emulated searches, choices, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import trigrams

#: Words that name no code
STOP_WORDS = (
    "this that with from have when then there these those should would could which where while about after before into also only some same "
    "each here does doesn didn issue error errors test tests bug problem expected actual result results value values code file files line "
    "lines none true false self return import class def print python django sympy sphinx pytest pylint xarray flask seaborn traceback call "
    "last most recent example description using used uses use make made like just seems works work fails fail failed raises raise raised "
    "instead output input type types name names data object objects string http https html github com org www md rst txt"
).split()
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
MAX_RESULTS, MAX_CANDIDATES, BROAD_LINES = 25, 14, 8


def _tokens(text: Column) -> Column:
    """Tokens of a text, each dotted one followed by its parts."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(found, lambda t: F.when(t.contains("."), F.concat(F.array(t), F.split(t, r"\."))).otherwise(F.array(t))))


def candidates(tasks: DataFrame, key: str, text: str, limit: int | None = MAX_CANDIDATES) -> DataFrame:
    """(key, token, score, first, rank): names worth searching for, the most code-like first.

    In backticks any token counts, elsewhere one that looks like code.  A token keeps its best score and its first place.
    """
    ticks = F.transform(F.regexp_extract_all(text, F.lit(r"`([^`\n]{2,80})`"), F.lit(1)), _tokens)
    named = lambda a, quoted: F.transform(a, lambda t: F.struct(t.alias("token"), F.lit(quoted).alias("quoted")))
    rows = tasks.select(key, F.posexplode(F.concat(named(F.flatten(ticks), True), named(_tokens(F.col(text)), False))).alias("first", "t")).select(key, "first", "t.*")
    codelike = F.col("quoted") | F.col("token").contains("_") | F.col("token").contains(".") | F.col("token").rlike("[a-z][A-Z]")
    rows = rows.where(F.length("token").between(4, 60) & ~F.lower("token").isin(*STOP_WORDS) & F.col("token").rlike("[A-Za-z]") & codelike)
    score = 2 * F.col("quoted").cast("int") + F.col("token").contains("_").cast("int") + F.col("token").contains(".").cast("int")
    best = rows.groupBy(key, "token").agg(F.max(score).alias("score"), F.min("first").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "first"))
    ranked = best.withColumn("rank", rank)
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def lines_of(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    return files.select(*keys, F.posexplode(F.split(text, "\n")).alias("_i", "line")).withColumn("line_no", (F.col("_i") + 1).cast("long")).drop("_i")


def token_index(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, token) of every distinct identifier of a line, the inverted index of its words."""
    words = F.array_distinct(F.regexp_extract_all("line", F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    return lines.select(*keys, "line_no", F.explode(words).alias("token"))


def search(lines: DataFrame, queries: DataFrame, keys: list[str], query: str = "query") -> DataFrame:
    """(query, keys, line_no, line): lines that hold a query literally.

    An equi-join: a line and a query meet on the longest inner word of the query, which the line must hold whole; the text
    confirms.  Queries without such a word (at most one word, so its ends may lie inside longer words) are searched by the
    trigrams of lines, and only those of fewer than three bytes see every line.
    """
    inner = F.regexp_extract_all(query, F.lit(r"(?<=[^A-Za-z0-9_])[A-Za-z0-9_]+(?=[^A-Za-z0-9_])"), F.lit(0))
    asked = queries.select(query).distinct().withColumn("_w", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    index = token_index(lines, keys).withColumnRenamed("token", "_w")
    exact = index.join(asked.where("_w is not null"), "_w").join(lines, [*keys, "line_no"]).where(F.contains("line", F.col(query)))
    loose = trigrams.matching(lines, asked.where("_w is null"), [*keys, "line_no"], "line", query).withColumnRenamed("query", query)
    columns = [query, *keys, "line_no", "line"]
    return exact.select(columns).unionByName(loose.select(columns))


def overridden(base: DataFrame, patched: DataFrame, keys: list[str]) -> DataFrame:
    """Hits of a commit with those of patched files in the place of their old ones."""
    return base.join(patched.select(*keys).distinct(), keys, "left_anti").unionByName(patched)


def limited(hits: DataFrame, group: list[str], order: list[str], limit: int = MAX_RESULTS) -> DataFrame:
    """The first hits of each search, and whether as many as the limit were found."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(*group))
    return hits.withColumns({"_k": rank, "truncated": n >= limit}).where(F.col("_k") <= limit).drop("_k")


def first_lines(hits: DataFrame, group: list[str], path: str) -> DataFrame:
    """The first hit's line of each file."""
    return hits.groupBy(*group, path).agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"))


def chosen(options: DataFrame, group: list[str], path: str, rank: str, n_lines: str, broad: bool = False) -> DataFrame:
    """One narrow search a file: that with the fewest hits, then of the best rank; with `broad`, for the first file that has
    options also the search with the most hits, if it has BROAD_LINES and is another one."""
    w = Window.partitionBy(*group, path)
    rows = options.withColumn("narrow", F.row_number().over(w.orderBy(n_lines, rank)) == 1)
    if not broad:
        return rows.where("narrow")
    first = F.min(path).over(Window.partitionBy(*group)) == F.col(path)
    rows = rows.withColumn("broad", (F.row_number().over(w.orderBy(F.desc(n_lines), rank)) == 1) & first & (F.col(n_lines) >= BROAD_LINES))
    return rows.where("narrow or broad")


def passed_before(messages: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """Whether a passing test run stands before each message."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("passed_before", F.coalesce(F.bool_or(F.startswith(F.col(text), F.lit("status=pass"))).over(w), F.lit(False)))


def until_shown(events: DataFrame, key: str, pos: str, path: str, shown: str) -> DataFrame:
    """Events of a path up to the first that shows it."""
    first = F.min(F.when(F.col(shown), F.col(pos))).over(Window.partitionBy(key, path))
    return events.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(pos) <= F.col("_first"))).drop("_first")


def note(kind: Column, subject: Column, n: Column) -> Column:
    """A one-line note on a step that says no more than what happened; braces would look like a call."""
    said = (
        F.when(kind == "search", F.format_string("The search for %s found %d lines.", subject, n))
        .when(kind == "read", F.format_string("Lines of %s around the change: %d.", subject, n))
        .when(kind == "edit", F.format_string("The edit of %s changes %d lines.", subject, n))
        .otherwise(F.format_string("%s: %d.", subject, n))
    )
    return F.translate(said, "{}", "()")


def listing_text(paths: Column, cap: int = 80) -> Column:
    """A listing of paths, '...' after the first `cap`."""
    return F.array_join(F.when(F.size(paths) > cap, F.concat(F.slice(paths, 1, cap), F.array(F.lit("...")))).otherwise(paths), "\n")


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two result tables has, as bags."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
